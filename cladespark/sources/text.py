"""Reading text with line numbers that survive shuffles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, rec_ord): lines of a text file, plain or gzip, with an ordinal that grows along the file.

    A gzip file is one task; larger data are best written once as Parquet
    partitioned by contig, which every operator reads as well.
    """
    return spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("rec_ord"))


def head_lines(spark: SparkSession, path: str, test) -> list[str]:
    """The first lines of a file (of a folder's first file), up to the first for which ``test`` fails.

    Read through Hadoop's file system on the driver, so any store works and no
    more than the header is read.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    if not fs.exists(place):
        raise FileNotFoundError(path)
    if fs.getFileStatus(place).isDirectory():
        files = sorted(f.getPath().toString() for f in fs.listStatus(place) if f.isFile() and not f.getPath().getName().startswith(("_", ".")))
        if not files:
            return []
        place = jvm.org.apache.hadoop.fs.Path(files[0])
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(place)
    stream = fs.open(place)
    stream = codec.createInputStream(stream) if codec else stream
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    out = []
    try:
        while (line := reader.readLine()) is not None and test(line):
            out.append(line)
    finally:
        reader.close()
    return out


def parse_region(region: str | None) -> tuple[str | None, int | None, int | None]:
    """contig, 0-based start and end of ``contig:start-end`` (1-based, commas allowed); coordinates that can't be read mean the whole contig."""
    if not region:
        return None, None, None
    contig, _, rest = region.partition(":")
    a, _, b = rest.replace(",", "").partition("-")
    if a.isdigit() and b.isdigit():
        return contig, int(a) - 1, int(b)
    return contig, None, None


def in_region(contig: Column, start: Column, end: Column, region: tuple) -> Column:
    """The overlap test that Catalyst pushes to Parquet; always true without a region."""
    name, lo, hi = region
    test = F.lit(True)
    if name is not None:
        test = contig == name
    if lo is not None:
        test &= (start < hi) & (end > lo)
    return test


def tags(fields: Column) -> Column:
    """A map from ``XX:T:value`` fields; malformed ones are skipped."""
    entries = F.transform(F.filter(fields, lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")), lambda t: F.struct(F.substring(t, 1, 2).alias("key"), F.regexp_extract(t, "^.....(.*)$", 1).alias("value")))
    return F.map_from_entries(entries)
