"""Cohorts: named target and off-target samples, and their checks."""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Spellings of roles in cohort files (fixed values).
TARGET_WORDS = ("target", "targets", "case", "cases")
OFF_TARGET_WORDS = ("off_target", "off_targets", "offtarget", "offtargets", "background", "backgrounds", "comparison", "comparisons", "control", "controls")
IGNORED_WORDS = ("ignored", "ignore", "exclude", "excluded")
#: Accepted names of the two columns of a cohort table, best first (fixed values).
SAMPLE_COLUMNS = ("sample_id", "sample", "sample_name")
ROLE_COLUMNS = ("cohort_role", "role", "group")


class CohortError(ValueError):
    """A cohort that can't be used."""


def role_of(word: str) -> str:
    """target, off_target or ignored, from any accepted spelling."""
    plain = word.strip().lower().replace("-", "_").replace(" ", "_")
    for role, words in (("target", TARGET_WORDS), ("off_target", OFF_TARGET_WORDS), ("ignored", IGNORED_WORDS)):
        if plain in words:
            return role
    raise CohortError(f"unknown cohort role: {word!r}")


def unique(values) -> tuple[str, ...]:
    """Values without blanks and repeats, in first-seen order."""
    return tuple(dict.fromkeys(v.strip() for v in values if v and v.strip()))


@dataclass(frozen=True)
class Cohort:
    """Which samples must carry an allele and which must not."""

    targets: tuple[str, ...]
    off_targets: tuple[str, ...]
    ignored: tuple[str, ...] = ()

    def __post_init__(self):
        if not self.targets or not self.off_targets:
            raise CohortError("a cohort needs at least one target and one off-target sample")
        if both := set(self.targets) & set(self.off_targets):
            raise CohortError(f"samples in both groups: {sorted(both)}")

    @staticmethod
    def of(targets, off_targets, ignored=()) -> Cohort:
        return Cohort(unique(targets), unique(off_targets), unique(ignored))

    def check_samples(self, present) -> list[str]:
        """Missing sample names; an error if a whole group is missing from the data."""
        known = set(present)
        for name, group in (("target", self.targets), ("off-target", self.off_targets)):
            if not known & set(group):
                raise CohortError(f"no {name} sample is in the input")
        return [s for s in (*self.targets, *self.off_targets) if s not in known]

    def frame(self, spark: SparkSession) -> DataFrame:
        """(sample, role, ord): one row per sample; as large as the cohort, so it can be broadcast."""
        rows = [(s, role, i) for i, (s, role) in enumerate([(s, "target") for s in self.targets] + [(s, "off_target") for s in self.off_targets])]
        return spark.createDataFrame(rows, "sample string, role string, ord int")


def inferred_groups(samples, targets, off_targets=None, ignored=()) -> dict[str, tuple[str, ...]]:
    """Overlapping groups full, target, off_target: off-targets default to all samples that are neither target nor ignored."""
    have = list(dict.fromkeys(samples))
    targets, ignored = unique(targets), unique(ignored)
    if unknown := [s for s in (*targets, *unique(off_targets or ()), *ignored) if s not in set(have)]:
        raise CohortError(f"samples not in the input: {unknown}")
    off = unique(off_targets) if off_targets else tuple(s for s in have if s not in set(targets) | set(ignored))
    cohort = Cohort(targets, off, ignored)
    inside = set(cohort.targets) | set(cohort.off_targets)
    return {"full": tuple(s for s in have if s in inside), "target": cohort.targets, "off_target": cohort.off_targets}


def read_cohort(path: str) -> Cohort:
    """A cohort from TSV (a sample and a role column) or YAML (lists by role)."""
    if not path.lower().endswith((".yaml", ".yml", ".tsv")):
        raise ValueError(f"a cohort file is .tsv, .yaml or .yml, not {path}")
    if path.lower().endswith((".yaml", ".yml")):
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
        raw = raw.get("cohorts", raw.get("cohort", raw))
        groups: dict[str, list[str]] = {"target": [], "off_target": [], "ignored": []}
        for key, value in raw.items():
            try:
                role = role_of(key.removesuffix("_samples"))
            except CohortError:
                continue
            groups[role] += [value] if isinstance(value, str) else list(value or [])
        return Cohort.of(groups["target"], groups["off_target"], groups["ignored"])
    with open(path, encoding="utf-8", newline="") as f:
        rows = list(csv.DictReader((x for x in f if not x.startswith("#")), delimiter="\t"))
    names = rows[0].keys() if rows else ()
    sample = next((c for c in SAMPLE_COLUMNS if c in names), None)
    role = next((c for c in ROLE_COLUMNS if c in names), None)
    if sample is None or role is None:
        raise CohortError("a cohort table needs a sample column and a role column")
    groups = {"target": [], "off_target": [], "ignored": []}
    for row in rows:
        if (row[sample] or "").strip():
            groups[role_of(row[role] or "")].append(row[sample])
    return Cohort.of(groups["target"], groups["off_target"], groups["ignored"])


def read_sample_list(path: str) -> tuple[str, ...]:
    """The first word of each line; lines that begin with # and blank ones are skipped."""
    with open(path, encoding="utf-8") as f:
        return unique(x.split()[0] for x in f if x.strip() and not x.strip().startswith("#"))
