"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null integer id inside the operators, so that it sorts before every other.
NULL_ID = -(2**63)
#: ASCII white space, as the text contracts define it.
ASCII_SPACE = "\t\n\x0b\x0c\r "


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, as ``spark.checkpoint.dir`` names it. A local session without one gets a folder of its own; elsewhere that is an error."""
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


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder, then read again.

    The stored copy survives lost executors, is used by several readers
    without running the plan again, and gives the planner true sizes.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/cladespark-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # gone when the driver's JVM ends
    return spark.read.schema(df.schema).parquet(f"{root}/{name}")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names made from ``names`` that ``df`` doesn't have, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        found = f"_{name}"
        while found.lower() in taken:
            found = f"_{found}"
        taken.add(found.lower())
        out.append(found)
    return out


def doc_key(column: str = "doc_id") -> Column:
    """An id that is never null: null ids become ``NULL_ID``."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def real_id(column: str) -> Column:
    """The inverse of ``doc_key``."""
    return F.when(F.col(column) != NULL_ID, F.col(column))


#: Rows and bytes of a batch that goes to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let batches of texts be small: the JVM keeps them outside its heap, several copies of each, beside the workers.

    Sets the session's two limits where they are larger; results don't depend on them.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256, megabytes: float = 8) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice with very long texts stays small in memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        mean = max(1, batch.nbytes // batch.num_rows)
        step = int(max(1, min(rows, megabytes * 1e6 // mean)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def give_back(*caches) -> None:
    """Empty a worker's caches and return free memory to the system: workers outlive their tasks and share an executor with its JVM."""
    for cache in caches:
        cache.clear()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def crc_mod(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as the empty text)."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
