"""Building blocks that keep the other operators whole and distributed under skew."""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_dir


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` so that later passes read it instead of computing it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def with_stats(df: DataFrame, name: str, stats: DataFrame) -> DataFrame:
    """``df`` with the one row of ``stats`` as a struct column.

    The row is a scalar subquery: worked out once, sent as a value, no join.
    """
    return df.withColumn(name, stats.select(F.struct(*stats.columns)).scalar())


def global_row_number(df: DataFrame, order: Sequence[Column | str], name: str) -> DataFrame:
    """1..n over the whole frame without a one-task window.

    Rows are range-partitioned and sorted on ``order`` (which must be a total
    order, so a score shared by many rows still splits on its tie-break key),
    fixed by a checkpoint, numbered inside each partition, and shifted by the
    row count of the partitions before.
    """
    shared_dir(df.sparkSession)
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_seq", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_part", F.shiftright("_seq", 33))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    # one row per partition: its size is the number of shuffle partitions
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_seq") - F.shiftleft("_part", 33) + 1)
        .drop("_part", "_seq", "_before")
    )


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, name: str,
                    salt_on: str, salts: int = 256) -> DataFrame:
    """First ``k`` rows of each group in ``order``; a hot group is cut per salt first.

    Each of the ``salts`` parts of a group can hold at most ``k`` winners, so
    the final window sees ``k * salts`` rows of a group however large it is.
    Spark cuts both windows to ``k`` rows before their exchange as well.
    """
    part = F.pmod(F.xxhash64(salt_on), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", part)
        .withColumn("_r", F.row_number().over(first))
        .filter(F.col("_r") <= k)
        .drop("_r", "_salt")
        .withColumn(name, F.row_number().over(final))
        .filter(F.col(name) <= k)
    )


#: Fixed values of 64-bit floating point numbers: bits of the fraction, bias of the exponent, least normal and least positive number.
_FRACTION, _BIAS, _NORMAL, _LEAST = 52, 1023, 2.0 ** -1022, 2.0 ** -1074
#: Digits of a code: four of 16 bits, the highest first.
_SHIFTS = (48, 32, 16, 0)


def order_code(value: Column) -> Column:
    """A 64-bit whole number that orders as the number does: its floating point bits, worked out from exponent and fraction.

    Powers of two and products with them are exact. NULL stays NULL; NaN comes after infinity; 0 and -0 are one.
    """
    x = value.cast("double")
    size = F.abs(x)
    rough = F.floor(F.log2(size)).cast("int")  # may be one off next to a power of two
    power = F.when(F.pow(F.lit(2.0), rough) > size, rough - 1).when(F.pow(F.lit(2.0), rough + 1) <= size, rough + 1).otherwise(rough)
    fraction = ((size / F.pow(F.lit(2.0), power) - 1) * 2.0 ** _FRACTION).cast("long")
    infinite = F.lit((2 * _BIAS + 1) << _FRACTION)
    code = (F.when(size < _NORMAL, (size / _LEAST).cast("long")).when(size == float("inf"), infinite)
            .otherwise(F.shiftleft((power + _BIAS).cast("long"), _FRACTION) + fraction))
    return F.when(F.isnan(x), infinite + 1).when(x < 0, -code).when(x.isNotNull(), code)


def code_value(code: int) -> float:
    """The number that has a code."""
    value = struct.unpack(">d", struct.pack(">q", abs(code)))[0]
    return -value if code < 0 else value


def exact_medians(df: DataFrame, columns: Sequence[str], sizes: Mapping[str, int] | None = None) -> dict[str, float | None]:
    """Exact median of each numeric column by radix selection, all columns together.

    Numbers become order-preserving 64-bit codes. Four passes, whatever the
    data, count the 16-bit digits of the codes, highest first, among the
    numbers that share the digits already known of a middle rank; at most
    65,536 counts for each column and rank are added up in Spark, and only the
    digit in which the rank falls reaches the driver. ``sizes`` are the non-null
    counts where the caller has them already.
    """
    if not columns:
        return {}
    if sizes is None:
        sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first().asDict()
    live = [c for c in columns if sizes[c]]
    if not live:
        return {c: None for c in columns}
    codes = settle(df.select(F.array(*[order_code(F.col(c)) for c in live]).alias("codes")))  # worked out once, read four times
    # ranks from 1 among the numbers that share a prefix: by column and prefix
    wanted = {(c, 0): sorted({(sizes[c] + 1) // 2, sizes[c] // 2 + 1}) for c in live}
    found: dict[tuple[str, int], list[int]] = {}
    for turn, shift in enumerate(_SHIFTS):
        known = {c: sorted(p for n, p in wanted if n == c) for c in live}
        at, code = F.col("at"), F.col("code")
        inside = F.lit(False)
        for i, c in enumerate(live):
            inside = inside | ((at == i) & (F.shiftright(code, shift + 16).isin(known[c]) if turn else code.isNotNull()))
        names = F.array(*map(F.lit, live))
        counted = (codes.select(F.posexplode("codes").alias("at", "code")).where(inside)
                   .groupBy("at", F.shiftright(code, shift).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))
                   .withColumn("name", F.element_at(names, at + 1)))
        above = F.shiftright("prefix", 16) if turn else F.lit(0).cast("long")
        upto = Window.partitionBy("name", "above").orderBy("prefix")
        counted = counted.withColumn("above", above).withColumn("upto", F.sum("n").over(upto))
        hit = F.lit(False)
        for (c, prefix), ranks in wanted.items():
            for rank in ranks:
                hit = hit | ((F.col("name") == c) & (F.col("above") == F.lit(prefix).cast("long"))
                             & (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
        found = {}
        for r in counted.where(hit).collect():
            before = r["upto"] - r["n"]
            ranks = [rank - before for rank in wanted[r["name"], r["above"]] if before < rank <= r["upto"]]
            found[r["name"], r["prefix"]] = ranks
        wanted = found
    out: dict[str, float | None] = {c: None for c in columns}
    for c in live:
        middles = [code_value(code) for name, code in found if name == c]
        out[c] = (min(middles) + max(middles)) / 2
    return out
