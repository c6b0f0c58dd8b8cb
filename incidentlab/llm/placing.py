"""Rows in one global order, spread over many tasks, with their places known from per-partition totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlab.llm.common import scratch

PART, SEQ = "__part", "__seq"
_TIE = "__tie"


def place(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` as a table in the shared folder, range-partitioned and sorted on ``order``, with the partition in ``__part`` and
    in ``__seq`` a number that rises by one inside it and from partition to partition.

    Rows that are equal in ``order`` are spread too: their place in the input comes last in the order, so no value, however
    frequent, makes one partition large. The table outlives its executors.
    """
    folder = scratch(df.sparkSession, name)
    keys = {f"__key{i}": c for i, c in enumerate(order)}
    columns = [F.col(k) for k in (*keys, _TIE)]
    ranged = df.withColumns(keys).withColumn(_TIE, F.monotonically_increasing_id())
    ranged.repartitionByRange(*columns).sortWithinPartitions(*columns).drop(*keys, _TIE).withColumn(
        SEQ, F.monotonically_increasing_id()).write.parquet(folder)
    # the partition stands in the upper bits of the number
    return df.sparkSession.read.parquet(folder).withColumn(PART, F.shiftright(SEQ, 33))
