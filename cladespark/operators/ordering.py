"""Global numbering of distributed rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def shared_folder(spark) -> str:
    """The folder the cluster shares (``spark.checkpoint.dir``). A local session without one gets a folder of its own; elsewhere that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        found = _own_folder()
    return found.rstrip("/")


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="cladespark-")
    atexit.register(shutil.rmtree, path, True)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors.

    The copies go when the session's Python process ends.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/cladespark-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    delete_at_exit(spark, root)
    return spark.read.schema(df.schema).parquet(f"{root}/{name}")


def delete_at_exit(spark, path: str) -> None:
    """The file system deletes the path when the driver's JVM ends."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)


def global_row_number(df: DataFrame, column: str, *order, start: int = 0) -> DataFrame:
    """``start``, ``start`` + 1, ... in the given order, by a range sort and per-partition offsets.

    Only the number of rows in each partition (as many rows as partitions) meets
    in one place.
    """
    rows = df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    rows = stored(rows.sortWithinPartitions(*order), "ordered")
    sizes = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(sizes.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return rows.withColumn("_own", own).join(offsets, "_p").withColumn(column, (F.col("_before") + F.col("_own") - 1 + start).cast("long")).drop("_p", "_own", "_before")
