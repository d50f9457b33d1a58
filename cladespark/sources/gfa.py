"""GFA 1.0 and 1.1 graphs as DataFrames: segments, links, paths, walks and steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladespark.operators.intervals import union_of_intervals
from cladespark.sources.text import lines, tags


class GfaError(ValueError):
    """A graph that can't be read."""


def _records(spark: SparkSession, path: str) -> DataFrame:
    rows = lines(spark, path).select(F.split("line", "\t").alias("f"), "rec_ord")
    return rows.filter(F.col("f")[0].isin("H", "S", "L", "P", "W"))


def read_gfa(spark: SparkSession, path: str, length_from_tag: bool = False) -> dict[str, DataFrame]:
    """Tables of a graph. A segment's length is that of its sequence, else LN; with ``length_from_tag`` LN comes first."""
    rec = _records(spark, path)
    version = rec.filter((F.col("f")[0] == "H") & F.exists("f", lambda t: t.startswith("VN:Z:2"))).limit(1).count()
    if version:
        raise GfaError("GFA 2 isn't supported")
    at = lambda i: F.get("f", F.lit(i))
    s = rec.filter(F.col("f")[0] == "S").select(at(1).alias("name"), F.when(at(2) != "*", F.length(at(2))).alias("seq_len"), tags(F.slice("f", 4, 1000)).alias("tags"), "rec_ord")
    tag = lambda k: F.try_element_at("tags", F.lit(k))
    ln = tag("LN").try_cast("long")
    length = F.coalesce(ln, F.col("seq_len").cast("long"), F.lit(0)) if length_from_tag else F.coalesce(F.col("seq_len").cast("long"), ln, F.lit(0))
    start = tag("SO").try_cast("long")
    segments = s.select("name", tag("SN").alias("contig"), start.alias("start"), F.when(length > 0, start + length).alias("end"), length.cast("long").alias("length"), "rec_ord")
    links = rec.filter(F.col("f")[0] == "L").select(at(1).alias("from_segment"), at(2).alias("from_orient"), at(3).alias("to_segment"), at(4).alias("to_orient"), at(5).alias("overlap"))
    p = rec.filter(F.col("f")[0] == "P").select(at(1).alias("path"), at(2).alias("steps"), "rec_ord")
    # SAMPLE#HAPLOTYPE#CONTIG names a sample; any other name is one itself
    paths = p.select("path", F.split("path", "#")[0].alias("sample"), "steps", "rec_ord")
    walks = rec.filter(F.col("f")[0] == "W").select(at(1).alias("sample"), at(2).alias("haplotype"), at(3).alias("contig"), at(4).try_cast("long").alias("start"), at(5).try_cast("long").alias("end"), at(6).alias("walk"), "rec_ord")
    by_path = paths.select("sample", F.concat(F.lit("P"), "path").alias("walk_id"), F.posexplode(F.filter(F.split("steps", ","), lambda x: x != "")).alias("pos", "x"))
    by_path = by_path.select("sample", "walk_id", "pos", F.regexp_replace("x", "[+-]$", "").alias("segment"), F.when(F.col("x").endswith("-"), "-").otherwise("+").alias("orient"))
    by_walk = walks.select("sample", F.concat(F.lit("W"), "rec_ord").alias("walk_id"), F.posexplode(F.regexp_extract_all("walk", F.lit("([><][^><]+)"), 1)).alias("pos", "x"))
    by_walk = by_walk.select("sample", "walk_id", "pos", F.substring("x", 2, 1_000_000).alias("segment"), F.when(F.col("x").startswith("<"), "-").otherwise("+").alias("orient"))
    return {"segments": segments, "links": links, "paths": paths, "walks": walks, "steps": by_path.unionByName(by_walk)}


def samples(graph: dict[str, DataFrame]) -> list[str]:
    """All sample names, sorted."""
    names = graph["paths"].select("sample").union(graph["walks"].select("sample")).distinct()
    return [r["sample"] for r in names.orderBy("sample").collect()]


def segment_samples(graph: dict[str, DataFrame]) -> DataFrame:
    """(segment, sample): who traverses what, once each."""
    return graph["steps"].select("segment", "sample").distinct()


def scan_index(graph: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What a graph scan reads: placed segments, traversals and, per sample, the merged intervals of the segments it traverses.

    A walk's own coordinates don't decide presence; only segments with a contig
    and a start do.
    """
    placed = graph["segments"].filter("contig is not null and start is not null").select("name", "contig", "start", (F.col("start") + F.col("length")).alias("end"))
    steps = segment_samples(graph).withColumnRenamed("segment", "name")
    coverage = steps.join(placed, "name").filter("end > start")
    return {"segments": placed, "segment_sample": steps, "coverage": union_of_intervals(coverage, ["sample", "contig"])}


#: Version of the index tables, kept in their metadata.
INDEX_VERSION = 1


def default_index(path: str) -> str:
    """Where a graph's index is looked for."""
    return f"{path}.index"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Size and time of change of a graph file."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place)
    changed = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).getModificationTime()
    return f"{status.getLength()}:{changed}"


def write_index(index: dict[str, DataFrame], path: str, source: str | None = None) -> None:
    """Parquet tables and their metadata; segments are laid out by contig and start, so a region reads few row groups."""
    index["segments"].repartitionByRange("contig", "start").sortWithinPartitions("contig", "start").write.mode("overwrite").parquet(f"{path}/segments")
    for name in ("segment_sample", "coverage"):
        index[name].write.mode("overwrite").parquet(f"{path}/{name}")
    spark = index["segments"].sparkSession
    meta = [(INDEX_VERSION, source, fingerprint(spark, source) if source else None)]
    spark.createDataFrame(meta, "version int, source string, fingerprint string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def read_index(spark: SparkSession, path: str, source: str | None = None) -> dict[str, DataFrame]:
    """The tables of an index; an error if it is missing, of another version or made from another state of ``source``."""
    if not _exists(spark, f"{path}/meta"):
        raise GfaError(f"no index of this engine at {path}")
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta["version"] != INDEX_VERSION:
        raise GfaError(f"index {path} has version {meta['version']}, not {INDEX_VERSION}: build it again")
    if source and meta["fingerprint"] and meta["fingerprint"] != fingerprint(spark, source):
        raise GfaError(f"index {path} was built from another state of {source}: build it again")
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("segments", "segment_sample", "coverage")}


def index_for(spark: SparkSession, path: str, index: str | None = None) -> dict[str, DataFrame]:
    """The index given (an error if it doesn't fit), else the one beside the graph, else one made from the graph."""
    if index:
        return read_index(spark, index, path)
    beside = default_index(path)
    if _exists(spark, f"{beside}/meta"):
        return read_index(spark, beside, path)
    return scan_index(read_gfa(spark, path, length_from_tag=True))


def segments_at(index: dict[str, DataFrame], contig: str, start: int, end: int) -> DataFrame:
    """Segments that overlap [start, end) of a contig."""
    return index["segments"].filter((F.col("contig") == contig) & (F.col("start") < end) & (F.col("end") > start))


def traversing(index: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """(name, sample): who traverses any of the named segments."""
    return index["segment_sample"].filter(F.col("name").isin(*names)).distinct()


def present_at(graph: dict[str, DataFrame], index: dict[str, DataFrame], contig: str, start: int, end: int) -> DataFrame:
    """Samples with segments or walks over any part of [start, end) of a contig; here the walks' own coordinates count."""
    meets = (F.col("contig") == contig) & (F.col("start") < end) & (F.col("end") > start)
    return index["coverage"].filter(meets).select("sample").unionByName(graph["walks"].filter(meets).select("sample")).distinct()
