"""Classification of alleles on a stream of records.

Counting, strictness and scores look at one record only, so the batch plan runs
unchanged on a stream, without state. Ranks, regions and windows are global and
stay with the batch commands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from cladespark.cohort import Cohort
from cladespark.scan import vcf_alleles


def classified(records: DataFrame, samples: list[str], cohort: Cohort, **options) -> DataFrame:
    """Passing alleles of a streaming table of records, in append mode."""
    return vcf_alleles(records, samples, cohort, **options).filter("pattern_pass")


def append_hits(hits: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table; offsets and commits in ``checkpoint`` make it exactly once. Stops when the input there is has been read."""
    return hits.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
