"""Sinks: BED, GFF3, TSV, JSON and single-file text."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.functions.rounding import general_6, half_even, quoted

_TAB = "\t"


def checked_interval(id_col: str = "locus_id") -> tuple[Column, Column]:
    """start and end, or an error that names the row."""
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") < 0) | (F.col("end") < F.col("start"))
    fail = F.raise_error(F.concat(F.lit("bad interval in row "), F.coalesce(F.col(id_col).cast("string"), F.lit("?"))))
    return F.when(bad, fail.cast("long")).otherwise(F.col("start")), F.when(bad, fail.cast("long")).otherwise(F.col("end"))


def bed_score(score: str) -> Column:
    """0 to 1000 from a score of 0 to 1; unreadable scores are 0."""
    value = F.col(score).try_cast("double")
    return F.coalesce(half_even(F.least(F.greatest(value * 1000, F.lit(0.0)), F.lit(1000.0)), 0).cast("long"), F.lit(0))


def bed_line(id_col: str, score: str, more: tuple[str, ...] = ()) -> Column:
    start, end = checked_interval(id_col)
    return F.concat_ws(_TAB, "contig", start, end, F.col(id_col), bed_score(score), F.lit("."), *more)


def gff3_line(score: str | None, attributes: list[str], kind: str = "sequence_variant", source: str = "cladespark") -> Column:
    """1-based closed GFF3; empty attributes are left out. Quoting runs in Python only for values that need it."""
    start, end = checked_interval(attributes[0])
    plain = lambda c: F.when(F.col(c).cast("string").rlike("^[A-Za-z0-9._:~-]*$"), F.col(c).cast("string")).otherwise(quoted(F.col(c).cast("string")))
    parts = [F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.concat(F.lit(f"{c}="), plain(c))) for c in attributes]
    value = F.coalesce(general_6(F.col(score).try_cast("double")), F.lit(".")) if score else F.lit(".")
    return F.concat_ws(_TAB, "contig", F.lit(source), F.lit(kind), start + 1, F.greatest(end, start + 1), value, F.lit("."), F.lit("."), F.concat_ws(";", *parts))


def _one_file(spark, folder: str, path: str, header: list[str] | None = None) -> None:
    """Moves a folder's only part to ``path``, behind the header's lines, through Hadoop's file system: any store will do."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(folder).getFileSystem(conf)
    part = next(f.getPath() for f in fs.listStatus(place(folder)) if f.getPath().getName().startswith("part-"))
    fs.delete(place(path), False)
    if header:
        out = fs.create(place(path))
        out.write(bytearray("".join(x + "\n" for x in header), "utf-8"))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(part), out, conf, True)
    else:
        fs.rename(part, place(path))
    fs.delete(place(folder), True)


def write_tsv(df: DataFrame, path: str, columns: list[str] | None = None, single_file: bool = True) -> None:
    """Tab-separated text with a header, nulls as NA and true/false as True/False; a folder of parts unless ``single_file``."""
    names = columns or df.columns
    if extra := set(names) - set(df.columns):
        raise ValueError(f"columns not in the table: {sorted(extra)}")
    kinds = dict(df.dtypes)
    show = lambda c: F.coalesce(F.initcap(F.col(c).cast("string")) if kinds[c] == "boolean" else F.col(c).cast("string"), F.lit("NA")).alias(c)
    out = df.select(*map(show, names))
    (out.coalesce(1) if single_file else out).write.csv(path + ".parts" if single_file else path, sep="\t", header=True, quote="", escape="", emptyValue="", mode="overwrite")
    if single_file:
        _one_file(df.sparkSession, path + ".parts", path)


def write_lines(df: DataFrame, path: str, header: list[str] | None = None) -> None:
    """The column ``line`` as one text file behind the header, in the table's order."""
    df.select("line").coalesce(1).write.mode("overwrite").text(path + ".parts", lineSep="\n")
    _one_file(df.sparkSession, path + ".parts", path, header)


def write_json(path: str, payload: dict) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, sort_keys=False, default=str)
        f.write("\n")
