"""Merkle dataset manifest by nested-struct rollups.

Every document is a leaf: the SHA-256 of its fields. Inside a group (source)
leaves stand in the order of doc_id; while several nodes remain, every three
consecutive ones become the hash of their digests. What remains is the group's
subroot; the subroots, ordered by source, are rolled up in the same way to the
root of the dataset.

A node's rank in base three is its way to the root, so the rank is split into
digit columns. Ranks are cut into bounded blocks of 3^6 = 729 nodes, and inside
a block the digits are grouped away one after another, the last first: each
``groupBy`` collects at most three child structs into one node struct that
holds its digest and its children. After six digits one nested struct is left
for the block, all by one exchange on (group, block). Block digests are the
nodes of the next tier, until each group has one block.

Proofs are read from the structs: tiers from the top down, each block's struct
meets the siblings above it (a union grouped by block: two rows each), nested
``transform`` calls walk down and collect the siblings on the way, and
``explode`` emits a row for each leaf. There is no join of leaves with nodes.

NULL fields count as ``-``. A NULL source is a group of its own, the first. NULL
ids come first; rows of one id follow their leaf hash. Repeated rows are leaves
of their own. A lone leaf is its own subroot, a lone subroot the root; both then
have no siblings there. An empty table gives no rows. Extra columns do not count.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from incidentlab.llm.common import scratch
from incidentlab.llm.placing import PART, SEQ, place

FAN, DEPTH = 3, 6
BLOCK = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


def leaf_hash(values: Sequence[Column]) -> Column:
    """Digest of the values, each led by its length in bytes, so that no two lists of values read the same."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)))
    return F.sha2(F.concat(*parts), 256)


def _numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` (with ``g``) with the rank inside the group from 0 and the group's number of rows.

    Each partition of the global order counts its rows of each group; the ranks
    follow from the counts of the partitions before.
    """
    placed = place(df, [F.col("g"), *order], name)
    before = Window.partitionBy("g").orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    # rows here: partitions and groups, not leaves
    counts = placed.groupBy("g", PART).agg(F.count(F.lit(1)).alias("here"), F.min(SEQ).alias("first")).select(
        "g", PART, (F.coalesce(F.sum("here").over(before), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("here").over(Window.partitionBy("g")).alias("n"))
    return placed.join(counts, ["g", PART]).withColumn("rank", F.col(SEQ) + F.col("shift")).drop(PART, SEQ, "shift")


def _roll_blocks(nodes: DataFrame) -> DataFrame:
    """(g, n, rank, node) to one nested struct for each block: (g, n, block, node)."""
    digits = [f"d{i}" for i in range(DEPTH)]
    within = F.col("rank") % BLOCK
    current = nodes.select("g", "n", F.floor(F.col("rank") / BLOCK).cast("long").alias("block"),
                           *[(F.floor(within / FAN ** i) % FAN).cast("int").alias(d) for i, d in enumerate(digits)], "node")
    current = current.repartition("g", "block").sortWithinPartitions("g", "n", "block", *reversed(digits))
    for level, digit in enumerate(digits):
        keys = ["g", "n", "block", *reversed(digits[level + 1:])]
        children = [F.first(F.when(F.col(digit) == i, F.col("node")), ignorenulls=True).alias(f"kid{i}") for i in range(FAN)]
        grouped = current.groupBy(*keys).agg(*children).select(
            *keys, F.array_compact(F.array(*[f"kid{i}" for i in range(FAN)])).alias("kids"))
        digest = F.sha2(F.array_join(F.col("kids")["hash"], ""), 256)
        # a node that is the only one left of its group is not hashed again
        current = grouped.select(*keys, F.struct(
            F.when(F.col("n") > FAN ** level, digest).otherwise(F.col("kids")[0]["hash"]).alias("hash"), "kids").alias("node"))
    return current


def _unfold(node: Column, level: int, above: Column, n: Column) -> Column:
    """Array of (item, hash, path) of the leaves below ``node``; a path has the siblings from the leaf upwards."""
    if level == 0:
        return F.array(F.struct(node["item"].alias("item"), node["hash"].alias("hash"), above.alias("path")))
    hashes = node["kids"]["hash"]

    def walk(kid: Column, i: Column) -> Column:
        beside = F.struct(F.array_join(F.slice(hashes, F.lit(1), i), "").alias("left"),
                          F.array_join(F.slice(hashes, i + 2, F.lit(FAN)), "").alias("right"))
        return _unfold(kid, level - 1, F.when(n > FAN ** (level - 1), F.concat(F.array(beside), above)).otherwise(above), n)

    return F.flatten(F.transform(node["kids"], walk))


class Tree:
    """The tiers of nested block structs over numbered leaves (g, n, rank, hash, item), kept in the shared folder."""

    def __init__(self, leaves: DataFrame, name: str):
        spark, self.tiers = leaves.sparkSession, []
        most = leaves.agg(F.max("n")).first()[0] or 1
        nodes = leaves.select("g", "n", "rank", F.struct("hash", "item").alias("node"))
        while True:
            folder = scratch(spark, name)
            _roll_blocks(nodes).write.parquet(folder)
            tier = spark.read.parquet(folder)
            self.tiers.append(tier)
            if most <= BLOCK:
                break
            most = -(-most // BLOCK)
            nodes = tier.select("g", F.ceil(F.col("n") / BLOCK).cast("long").alias("n"), F.col("block").alias("rank"),
                                F.struct(F.col("node.hash").alias("hash"), F.struct("block").alias("item")).alias("node"))

    def tops(self) -> DataFrame:
        """(g, hash): the remaining node of each group."""
        return self.tiers[-1].select("g", F.col("node.hash").alias("hash"))

    def proofs(self, above: DataFrame) -> DataFrame:
        """(g, item, hash, path, more) of all leaves. ``above``: (g, path, more) with the siblings above each group's remaining node."""
        above = above.withColumn("block", F.lit(0).cast("long"))
        for depth in range(len(self.tiers) - 1, -1, -1):
            tier = self.tiers[depth].select("g", "block", "n", "node")
            met = tier.unionByName(above.select("g", "block", "path", "more"), allowMissingColumns=True).groupBy("g", "block").agg(
                *[F.first(c, ignorenulls=True).alias(c) for c in ("n", "node", "path", "more")])
            leaves = met.select("g", "more", F.explode(_unfold(F.col("node"), DEPTH, F.col("path"), F.col("n"))).alias("leaf")).select(
                "g", "leaf.item", "leaf.hash", "leaf.path", "more")
            above = leaves.select("g", F.col("item.block").alias("block"), "path", "more") if depth else leaves
        return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "source", order: str = "doc_id",
             carry: Mapping[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path) of every row, and the columns of ``carry``.

    ``path`` has, level by level from the leaf to the root, the digests of the
    siblings to the left and to the right, joined in order. Only digests leave
    the scan; the texts are not shuffled. ``carry``: further small columns, by
    name, made from the row (say a digest that someone else claims).
    """
    carried = dict(carry or {})
    source = F.col(group).cast("string")
    # the first character keeps a NULL source apart from an empty one and puts it first
    rows = docs.select(F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)).alias("g"),
                       leaf_hash([F.col(f) for f in fields]).alias("hash"),
                       F.struct(F.col(order).alias("doc_id"), source.alias("source"),
                                *[c.alias(n) for n, c in carried.items()]).alias("item"))
    leaves = Tree(_numbered(rows, [F.col("item.doc_id"), F.col("hash")], "merkle-leaves"), "merkle-tier")
    # one row a source; the same rollup over all subroots as one group
    subroots = leaves.tops().select(F.lit("").alias("g"), "hash", F.struct(F.col("g").alias("key")).alias("item"))
    top = Tree(_numbered(subroots, [F.col("item.key")], "merkle-subroots"), "merkle-top")
    root = top.tops().select("hash").scalar()
    start = docs.sparkSession.range(1).select(F.lit("").alias("g"), F.array().cast(_PATH).alias("path"), F.lit(True).alias("more"))
    above = top.proofs(start).select(F.col("item.key").alias("g"), "path", F.col("hash").alias("more"))
    return leaves.proofs(above).select("item.doc_id", "item.source", F.col("hash").alias("leaf"), F.col("more").alias("subroot"),
                                       root.alias("root"), "path", *[F.col("item")[n].alias(n) for n in carried])


def proof_digest(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda beside: F.concat(beside["left"], beside["right"])), ""), 256)


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf digest and its siblings."""
    return F.aggregate(path, leaf, lambda digest, beside: F.sha2(F.concat(beside["left"], digest, beside["right"]), 256))


def verify(rows: DataFrame, claimed: str) -> DataFrame:
    """``folded_root`` from the digest in ``claimed`` and the row's siblings, and whether it is the root."""
    return rows.withColumn("folded_root", fold_path(F.col(claimed), F.col("path"))).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
