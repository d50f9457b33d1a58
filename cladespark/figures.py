"""Figures as SVG, drawn from the tables behind them: no plotting library is needed."""

from __future__ import annotations

from html import escape

#: Colours of series, in order.
COLOURS = ("#3b6ea8", "#d9822b", "#4f9d69", "#a64d79", "#7a6f5d", "#2aa198", "#b58900", "#6c71c4")
WIDTH, HEIGHT, EDGE = 720, 420, 60


def _page(body: list[str], title: str, width: int = WIDTH, height: int = HEIGHT) -> str:
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="11"><rect width="100%" height="100%" fill="white"/><text x="{width // 2}" y="20" text-anchor="middle" font-size="14">{escape(title)}</text>' + "".join(body) + "</svg>"


def _axes(top: float, labels: list[str], low: float = 0.0) -> list[str]:
    """A frame with five marks on the left and a label below each of the places."""
    out = [f'<path d="M{EDGE} {EDGE // 2}V{HEIGHT - EDGE}H{WIDTH - 20}" fill="none" stroke="black"/>']
    for k in range(5):
        y = HEIGHT - EDGE - k * (HEIGHT - EDGE * 1.5) / 4
        out.append(f'<text x="{EDGE - 6}" y="{y + 4:.1f}" text-anchor="end">{low + (top - low) * k / 4:.4g}</text>')
    step = (WIDTH - EDGE - 20) / max(1, len(labels))
    every = max(1, len(labels) // 30)
    for k, label in enumerate(labels):
        if k % every == 0:
            x = EDGE + (k + 0.5) * step
            out.append(f'<text x="{x:.1f}" y="{HEIGHT - EDGE + 14}" text-anchor="end" transform="rotate(-35 {x:.1f} {HEIGHT - EDGE + 14})">{escape(str(label)[:24])}</text>')
    return out


def _legend(names: list[str]) -> list[str]:
    return [f'<rect x="{WIDTH - 190}" y="{30 + 16 * k}" width="10" height="10" fill="{COLOURS[k % len(COLOURS)]}"/><text x="{WIDTH - 174}" y="{39 + 16 * k}">{escape(str(n))}</text>' for k, n in enumerate(names)]


def bars(title: str, labels: list[str], series: dict[str, list[float]]) -> str:
    """Stacked bars, one for each label."""
    tops = [sum(values[k] for values in series.values()) for k in range(len(labels))]
    top, step, body = max([*tops, 1e-9]), (WIDTH - EDGE - 20) / max(1, len(labels)), []
    for k in range(len(labels)):
        base = 0.0
        for n, values in enumerate(series.values()):
            h = values[k] / top * (HEIGHT - EDGE * 1.5)
            body.append(f'<rect x="{EDGE + k * step + step * 0.1:.1f}" y="{HEIGHT - EDGE - base - h:.1f}" width="{step * 0.8:.1f}" height="{h:.1f}" fill="{COLOURS[n % len(COLOURS)]}"/>')
            base += h
    return _page(body + _axes(top, labels) + (_legend(list(series)) if len(series) > 1 else []), title)


def lollipops(title: str, labels: list[str], values: list[float], groups: list[str]) -> str:
    """A stem and a dot for each label, coloured by group."""
    names = list(dict.fromkeys(groups))
    low, top = min([0.0, *values]), max([1e-9, *values])
    step, body = (WIDTH - EDGE - 20) / max(1, len(labels)), []
    for k, (v, g) in enumerate(zip(values, groups)):
        x, y = EDGE + (k + 0.5) * step, HEIGHT - EDGE - (v - low) / (top - low) * (HEIGHT - EDGE * 1.5)
        body.append(f'<path d="M{x:.1f} {HEIGHT - EDGE}V{y:.1f}" stroke="#999"/><circle cx="{x:.1f}" cy="{y:.1f}" r="4" fill="{COLOURS[names.index(g) % len(COLOURS)]}"/>')
    return _page(body + _axes(top, labels, low) + _legend(names), title)


def lines(title: str, series: dict[str, list[tuple[float, float]]], bands: dict[str, list[tuple[float, float, float]]] | None = None) -> str:
    """Lines through points, with a band (x, low, high) behind each if given."""
    points = [p for s in series.values() for p in s] + [(x, y) for b in (bands or {}).values() for x, low, high in b for y in (low, high)]
    xs, ys = [p[0] for p in points] or [0], [p[1] for p in points] or [0]
    x0, x1, top = min(xs), max(xs), max([*ys, 1e-9])
    at = lambda x, y: f"{EDGE + (x - x0) / max(x1 - x0, 1e-9) * (WIDTH - EDGE - 20):.1f} {HEIGHT - EDGE - y / top * (HEIGHT - EDGE * 1.5):.1f}"
    body = []
    for k, (name, own) in enumerate(series.items()):
        colour = COLOURS[k % len(COLOURS)]
        if bands and name in bands:
            edge = [at(x, low) for x, low, _ in bands[name]] + [at(x, high) for x, _, high in reversed(bands[name])]
            body.append(f'<path d="M{"L".join(edge)}Z" fill="{colour}" opacity="0.2"/>')
        if own:
            body.append(f'<path d="M{"L".join(at(*p) for p in own)}" fill="none" stroke="{colour}" stroke-width="2"/>')
    return _page(body + _axes(top, [f"{x0 + (x1 - x0) * k / 4:.4g}" for k in range(5)]) + _legend(list(series)), title)


def cells(title: str, rows: list[str], columns: list[str], values: list[list[float | None]]) -> str:
    """A grid of cells from white (least) to the first colour (greatest); grey where there is no value."""
    known = [v for row in values for v in row if v is not None]
    low, high = min(known, default=0.0), max(known, default=1.0)
    w, h = (WIDTH - 140) / max(1, len(columns)), (HEIGHT - 100) / max(1, len(rows))
    shade = lambda v: "#ddd" if v is None else "#" + "".join(f"{round(255 + (c - 255) * (v - low) / max(high - low, 1e-9)):02x}" for c in (59, 110, 168))
    body = [f'<rect x="{120 + j * w:.1f}" y="{40 + i * h:.1f}" width="{w + 0.3:.1f}" height="{h + 0.3:.1f}" fill="{shade(v)}"/>' for i, row in enumerate(values) for j, v in enumerate(row)]
    body += [f'<text x="114" y="{40 + (i + 0.7) * h:.1f}" text-anchor="end">{escape(str(r)[:18])}</text>' for i, r in enumerate(rows) if i % max(1, len(rows) // 40) == 0]
    body += [f'<text x="{120 + (j + 0.5) * w:.1f}" y="{HEIGHT - 44}" text-anchor="middle">{escape(str(c)[:10])}</text>' for j, c in enumerate(columns) if j % max(1, len(columns) // 20) == 0]
    return _page([*body, f'<text x="120" y="{HEIGHT - 16}">{low:.4g} (white) to {high:.4g}</text>'], title)
