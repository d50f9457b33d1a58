"""Settings of a run: defaults, then a YAML file, then options given on the command line."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, fields, replace

from cladespark.operators.compare import CompareRules
from cladespark.operators.kernel import Weights


@dataclass(frozen=True)
class ScanSettings:
    min_target_support: float = 1.0
    max_off_target_support: float = 0.0
    relaxed_target_missing: float | None = None
    relaxed_offtarget_missing: float | None = None
    pass_only: bool = True
    min_qual: float | None = None
    allow_multiallelic: bool = True
    merge_distance: int = 0
    same_variant_class_only: bool = False


@dataclass(frozen=True)
class ReadSettings:
    min_depth: int = 8
    allele_fraction_min: float = 0.2
    min_alt_count: int = 2
    min_mapq: int = 20
    min_baseq: int = 20


@dataclass(frozen=True)
class GraphSettings:
    min_segment_length: int = 1


@dataclass(frozen=True)
class ScoreSettings:
    discovery_weight: float = 1.0
    support_weight: float = 0.7
    penalty_weight: float = 0.8

    def weights(self) -> Weights:
        return Weights(self.discovery_weight, self.support_weight, self.penalty_weight)


@dataclass(frozen=True)
class Settings:
    project_name: str = "run"
    mode: str = "private_allele"
    scan: ScanSettings = field(default_factory=ScanSettings)
    bam: ReadSettings = field(default_factory=ReadSettings)
    gfa: GraphSettings = field(default_factory=GraphSettings)
    scoring: ScoreSettings = field(default_factory=ScoreSettings)
    compare: CompareRules = field(default_factory=CompareRules)

    def as_dict(self) -> dict:
        return asdict(self)


#: Bounds of settings: share in 0..1, or not negative.
_SHARES = ("min_target_support", "max_off_target_support", "relaxed_target_missing", "relaxed_offtarget_missing", "allele_fraction_min", "min_reciprocal_overlap")


def checked(settings: Settings) -> Settings:
    """The settings, or ValueError for one out of range or a mode that doesn't exist."""
    if settings.mode != "private_allele":
        raise ValueError(f"mode {settings.mode!r} isn't implemented: only private_allele is")
    for part in (settings.scan, settings.bam, settings.gfa, settings.scoring, settings.compare):
        for f in fields(part):
            value = getattr(part, f.name)
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                continue
            if f.name in _SHARES and not 0 <= value <= 1:
                raise ValueError(f"{f.name} must be between 0 and 1")
            if value < 0:
                raise ValueError(f"{f.name} must not be negative")
    if settings.gfa.min_segment_length < 1:
        raise ValueError("min_segment_length must be at least 1")
    return settings


def updated(settings: Settings, given: dict) -> Settings:
    """Settings with the values of a nested dict; parts and names that don't exist are ignored, as are nulls for whole parts."""
    names = {f.name for f in fields(settings)}
    out = settings
    for key, value in given.items():
        if key not in names or value is None:
            continue
        part = getattr(settings, key)
        if isinstance(part, str):
            out = replace(out, **{key: str(value)})
        elif isinstance(value, dict):
            own = {f.name for f in fields(part)}
            out = replace(out, **{key: replace(part, **{k: v for k, v in value.items() if k in own})})
        else:
            raise ValueError(f"{key} must be a mapping")
    return out


def load(path: str | None = None, options: dict | None = None) -> Settings:
    """Defaults, overridden by a YAML file, overridden by ``options`` (nested like the file, only what was given)."""
    settings = Settings()
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
        if not isinstance(raw, dict):
            raise ValueError(f"{path} must hold a mapping")
        settings = updated(settings, raw)
    return checked(updated(settings, options or {}))
