"""Contiguous shards of nearly equal bytes, by global prefix sums.

Documents are range-partitioned and sorted by doc_id once. One total of bytes
and rows for each partition, summed from the first partition on, tells where
each partition begins in the whole corpus. The corpus is cut at equal targets
(total * k / shards): a document belongs to the shard in which the middle of
its bytes lies, so a shard's size is off by less than one document at either
end. Only partitions in which a target falls are looked at row by row; all
others lie in one shard as a whole. Every step is a DataFrame operation.

Size of a document: the UTF-8 bytes of its text and one more (a separator). A
NULL text has size 1. NULL ids come first; rows of one id follow a hash of
their text, rows that are equal come in any order, each in its own slot. One
document may be larger than a target; shards between then stay empty. An empty
table gives no rows. Columns named ``size``, ``shard`` or ``slot`` are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlab.llm.placing import PART, SEQ, place

SHARDS = 8


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _share(point: Column, whole: Column, shards: int) -> Column:
    """floor(shards * point / whole), exactly and without overflow."""
    wide, by = point.cast("decimal(20,0)") * F.lit(shards).cast("decimal(10,0)"), whole.cast("decimal(20,0)")
    return ((wide - wide % by) / by).cast("long")


def partition_totals(placed: DataFrame) -> DataFrame:
    """Rows and bytes of each partition, those of all partitions before it, and the bytes of all."""
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))
    # one row for each partition, so these windows do not grow with the documents of a partition
    return totals.select(PART, "rows", "bytes", F.sum("bytes").over(everything).alias("whole"),
                         F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
                         F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"))


def shard_spans(placed: DataFrame, shards: int) -> DataFrame:
    """(partition, shard, first and last global row in both, first global row of the shard, rows before the partition)."""
    totals = partition_totals(placed)
    low = _share(F.col("bytes_before"), F.col("whole"), shards)
    high = _share(F.col("bytes_before") + F.col("bytes"), F.col("whole"), shards)
    totals = totals.withColumn("low", low).withColumn("cut", (low < high) & (high > 0))
    whole = totals.where(~F.col("cut")).select(
        PART, F.col("low").alias("shard"), F.col("rows_before").alias("from"),
        (F.col("rows_before") + F.col("rows") - 1).alias("to"), "rows_before")
    # at most one partition for each target, and each is as large as a partition
    running = Window.partitionBy(PART).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    middle = 2 * (F.col("bytes_before") + F.sum("size").over(running)) - F.col("size")
    inside = placed.select(PART, SEQ, "size").join(F.broadcast(totals.where("cut")), PART).select(
        PART, "rows_before", (F.col("rows_before") + F.col(SEQ) - F.shiftleft(PART, 33)).alias("row"),
        F.least(_share(middle, 2 * F.col("whole"), shards), F.lit(shards - 1).cast("long")).alias("shard"))
    spans = inside.groupBy(PART, "shard").agg(F.min("row").alias("from"), F.max("row").alias("to"),
                                              F.first("rows_before").alias("rows_before"))
    first = Window.partitionBy("shard")
    return whole.unionByName(spans).withColumn("begin", F.min("from").over(first))


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` in global order with ``size``, ``shard`` (0 to shards - 1) and ``slot`` (from 0 in each shard)."""
    if shards < 1:
        raise ValueError("at least one shard")
    kept = docs.drop(*[c for c in docs.columns if c in ("size", "shard", "slot")])
    sized = kept.withColumn("size", byte_size(F.col("text").cast("string")))
    placed = place(sized, [F.col("doc_id"), F.xxhash64(F.col("text").cast("string"))], "shards")
    # rows of the spans: partitions and shards together, not documents
    spans = F.broadcast(shard_spans(placed, shards).withColumnRenamed("shard", "__shard").withColumnRenamed("from", "__from")
                        .withColumnRenamed("to", "__to").withColumnRenamed("begin", "__begin")
                        .withColumnRenamed("rows_before", "__before"))
    row = F.col("__before") + F.col(SEQ) - F.shiftleft(PART, 33)
    return placed.join(spans, PART).where(row.between(F.col("__from"), F.col("__to"))).select(
        *[F.col(f"`{c}`") for c in kept.columns], "size", F.col("__shard").cast("int").alias("shard"),
        (row - F.col("__begin")).alias("slot"))


def write_shards(assigned: DataFrame, folder: str) -> None:
    """One folder for each shard (``shard=0`` and so on), rows in the order of their slots inside each file."""
    assigned.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(folder)
