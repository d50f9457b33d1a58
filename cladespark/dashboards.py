"""Dashboard payloads: one JSON document, and a small page that holds it."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.operators.summaries import top_with_other
from cladespark.sources.tables import lenient, read_tsv


def sources_in(folder: str, marker: str = "hits.tsv", preferred: tuple[str, ...] = ("vcf", "gfa", "xmfa")) -> list[str]:
    """The folder itself if it holds the marker, else its children that do: preferred names first, then the others sorted."""
    if os.path.exists(os.path.join(folder, marker)):
        return [folder]
    kids = [d for d in sorted(os.listdir(folder)) if os.path.exists(os.path.join(folder, d, marker))]
    return [os.path.join(folder, d) for d in [*(p for p in preferred if p in kids), *(k for k in kids if k not in preferred)]]


def first_rows(df: DataFrame, n: int) -> list[dict]:
    """The first n rows of a file, in its order."""
    return [r.asDict() for r in df.orderBy("ord").limit(n).drop("ord").collect()]


def read_json(path: str) -> dict:
    """A JSON object; unreadable or missing files are empty."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def scan_payload(spark: SparkSession, folder: str, hits: int = 5000, regions: int = 1000, contigs: int = 20) -> dict:
    """Counters, classes, contigs and the first rows of every source in a scan's folder."""
    out: dict = {"sources": [], "n_hits": 0}
    for path in sources_in(folder):
        table = read_tsv(spark, f"{path}/hits.tsv")
        score = lenient("final_score")
        one = table.agg(F.count("*").alias("n"), F.max(score).alias("best"), F.min(score).alias("least")).first()
        by = lambda c, t=table: {r[c]: r["count"] for r in t.groupBy(c).count().collect()}
        top = top_with_other(table.groupBy("contig").count(), "contig", contigs)
        source = {"name": os.path.basename(path), "n_hits": one["n"], "best_score": one["best"], "least_score": one["least"], "strictness": by("strictness_class"), "variant_types": by("variant_type"), "contigs": {r["contig"]: r["count"] for r in top.collect()}, "hits": first_rows(table, hits), "run": read_json(f"{path}/run.json")}
        if os.path.exists(f"{path}/regions.tsv"):
            source["regions"] = first_rows(read_tsv(spark, f"{path}/regions.tsv"), regions)
        out["sources"].append(source)
        out["n_hits"] += one["n"]
    return out


def landscape_payload(spark: SparkSession, folder: str, windows: int = 20_000, blocks: int = 5_000) -> dict:
    """Windows, contig and sample means and blocks; undefined rates count as 0 in means."""
    w, s = read_tsv(spark, f"{folder}/windows.tsv"), read_tsv(spark, f"{folder}/sample_windows.tsv")
    mean = lambda c: F.avg(lenient(c)).alias(c)
    contig = w.groupBy("contig").agg(F.count("*").alias("n_windows"), F.sum(lenient("n_variants", "long")).alias("n_variants"), mean("target_mean_missing_rate"), mean("offtarget_mean_missing_rate"))
    sample = s.groupBy("sample", "role").agg(mean("missing_rate"), mean("nonref_rate"), mean("private_alt_rate"))
    near = s.groupBy("sample", "nearest").count()
    rows = lambda df, *o: [r.asDict() for r in df.orderBy(*o).collect()]
    return {"windows": first_rows(w, windows), "contigs": rows(contig, "contig"), "samples": rows(sample, "sample"), "background": rows(near, "sample", "nearest"), "blocks": first_rows(read_tsv(spark, f"{folder}/background_blocks.tsv"), blocks), "candidates": first_rows(read_tsv(spark, f"{folder}/candidate_introgression_blocks.tsv"), blocks), "run": read_json(f"{folder}/landscape.json")}


def pangenome_payload(spark: SparkSession, folder: str, features: int = 10_000) -> dict:
    """Composition, coverage, mean growth and the first features."""
    growth = read_tsv(spark, f"{folder}/growth_curves.tsv").groupBy("grp", lenient("n", "long").alias("n")).agg(F.avg(lenient("features")).alias("features"), F.avg(lenient("bp")).alias("bp"))
    plain = lambda name: [r.asDict() for r in read_tsv(spark, f"{folder}/{name}.tsv").drop("ord").collect()]
    return {"composition": plain("composition"), "coverage": plain("coverage_histogram"), "growth": [r.asDict() for r in growth.orderBy("grp", "n").collect()], "features": first_rows(read_tsv(spark, f"{folder}/feature_summary.tsv"), features), "run": read_json(f"{folder}/pangenome.json")}


def write_page(payload: dict, path: str, title: str = "cladespark") -> None:
    """A self-contained page with the payload, and the payload beside it as JSON."""
    data = json.dumps(payload, default=str)
    with open(os.path.splitext(path)[0] + ".json", "w", encoding="utf-8") as f:
        f.write(data)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"<!doctype html><meta charset=utf-8><title>{title}</title><h1>{title}</h1><pre id=v></pre><script type=application/json id=d>{data.replace('</', '<' + chr(92) + '/')}</script><script>document.getElementById('v').textContent=JSON.stringify(JSON.parse(document.getElementById('d').textContent),null,1)</script>")
