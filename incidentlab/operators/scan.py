"""Prefix combinations of a whole ordered table, a few rows of memory at a time.

An associative ``combine`` is folded over blocks of consecutive rows; the block
results are scanned in the same way, and each block takes over what came
before it. A table of n rows needs log(n) to the base of the block size
levels, every level one grouping on bounded blocks, so a single long series is
spread over as many tasks as any other table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scale import settle

#: Rows of a block. Each row folds those before it in its block.
BLOCK_ROWS = 64

Combine = Callable[[Column, Column], Column]


def _fold(elements: Column, kind: str, combine: Combine) -> Column:
    """All elements of an array combined in order, NULL for none."""
    return F.aggregate(elements, F.lit(None).cast(kind), lambda held, more: F.when(held.isNull(), more).otherwise(combine(held, more)))


def prefixes(df: DataFrame, position: str, element: Column, combine: Combine, name: str, rows: int, block: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with the combination of the elements of all rows before each row, NULL in the first.

    ``position`` counts the rows from 0 without gaps; ``rows`` is their number. ``element`` must not be NULL.
    """
    at = f"{position}_block"  # another name on each level
    placed = df.withColumns({at: F.floor(F.col(position) / block).cast("long"), "_element": element})
    kind = placed.schema["_element"].dataType.simpleString()
    before = Window.partitionBy(at).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("_inside", _fold(F.collect_list("_element").over(before), kind, combine))
    if rows <= block:
        return inside.withColumnRenamed("_inside", name).drop(at, "_element")
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("at"), F.col("_element").alias("e")))), lambda p: p["e"])
    # read by the levels above more than once
    totals = settle(placed.groupBy(at).agg(listed.alias("_listed")).select(at, _fold(F.col("_listed"), kind, combine).alias("_total")))
    carried = prefixes(totals, at, F.col("_total"), combine, "_carry", -(-rows // block), block).select(at, F.col("_carry").alias("_handed"))
    carry, own = F.col("_handed"), F.col("_inside")
    whole = F.when(carry.isNull(), own).when(own.isNull(), carry).otherwise(combine(carry, own))
    return inside.join(carried, at).withColumn(name, whole).drop(at, "_element", "_inside", "_handed")
