"""Ranked lexical search with two trees.

Every document is scored for every item (query) by integer BM25 weights, and
each item's best ``k`` documents are found without scoring most of the pairs.

Documents are read in blocks. The documents of a block are ordered by their
heaviest terms, so that neighbours share them, and stand in a hierarchy of
leaves and larger nodes. A node holds coordinate maxima: for each term the
largest contribution of its documents. Items stand in a hierarchy too (groups,
smaller groups, items); a node's coordinate maxima are the union of its items'
terms, since a term counts once. The sum over the item node's terms of the
document node's maxima bounds the score of every pair below both, so a node
pair whose bound is under the weakest kth score of its items is dropped whole.
Pairs that remain are opened on both sides down to items and documents, whose
scores are exact: integers, in floating point only while every sum stays
below 2^53. A bound that equals the kth score is not dropped, so ties are whole.

Weakest kth scores come from a first round: each block scores, for each item,
only the leaves with the largest bounds; the kth best of all blocks together
is no more than the true one. The second round starts from these.

Items are asked in batches of about ``BATCH_PAIRS`` (item, term) pairs, dealt
by a hash of item_id; a batch's vocabulary goes to the tasks. Documents are cut
into terms once for each batch, whole, and kept as (term, count) arrays in the
shared folder. Counts of documents and terms cover all documents.

A NULL text has no terms. Rows of one item_id are one item, with the terms of
all its rows; items without terms, or whose terms no document holds, have no
rows in the result. Rows of documents that share a doc_id are documents of
their own; a NULL doc_id comes before all others among equal scores. Empty
tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlab.llm.common import map_texts, scratch
from incidentlab.operators.scale import top_k_per_group

#: Fixed values of the ranking: terms are runs of ASCII letters, digits and all other characters from U+0080 on.
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same rule for UTF-8 bytes: what is in no term becomes a space.
FOLD = bytes(b | 0x20 if chr(b) in UPPER else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))

K = 50
BATCH_PAIRS = 100_000
BLOCK_ROWS = 4096
LEAF_ROWS, NODE_LEAVES = 16, 8
GROUP_ITEMS, PART_ITEMS = 16, 4
GROUP_TERMS = 1024
CELLS = 1 << 21


def text_terms(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(FOLD).split()


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each pair once."""
    folded = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    return items.select(F.col("item_id").cast("long").alias("item_id"),
                        F.explode(F.regexp_extract_all(folded, F.lit(TERM), F.lit(1))).alias("term")).distinct()


def term_arrays(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, ids, counts): all terms of each whole text counted, and those of the vocabulary told apart."""
    def make():
        known = vocabulary

        def work(ids, texts):
            out = {"doc_id": ids, "n": [], "ids": [], "counts": []}
            for text in texts:
                counts = Counter(text_terms(text))
                held = [(known[t], c) for t, c in counts.items() if t in known]
                out["n"].append(counts.total())
                out["ids"].append([t for t, _ in held])
                out["counts"].append([c for _, c in held])
            return out

        return work

    return map_texts(docs, make, "doc_id long, n long, ids array<int>, counts array<int>")


class Corpus:
    """Counts over all documents: how many have terms, how many terms there are, and what each known term weighs."""

    def __init__(self, documents: int, terms: int, frequencies: dict[int, int], size: int):
        self.documents, self.terms = documents, terms
        self.weights = np.zeros(size, np.int64)
        for term, df in frequencies.items():
            self.weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))

    def length_norm(self, n: int) -> int:
        return 100 - 50 + (50 * n * self.documents) // self.terms


class Items:
    """The hierarchy over the items of a batch: groups of at most GROUP_ITEMS, parts of PART_ITEMS, items."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray):
        self.terms = terms
        common = [tuple(t[np.argsort(weights[t], kind="stable")].tolist()) for t in terms]  # most frequent terms first
        self.groups: list[list[int]] = []
        union: set[int] = set()
        for i in sorted(range(len(terms)), key=common.__getitem__):
            own = set(terms[i].tolist())
            if not self.groups or len(self.groups[-1]) >= GROUP_ITEMS or len(union | own) > GROUP_TERMS:
                self.groups.append([])
                union = set()
            self.groups[-1].append(i)
            union |= own

    def matrices(self, group: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms of a group; its items by terms, and its parts by terms, as 0 and 1."""
        union = np.unique(np.concatenate([self.terms[i] for i in group]))
        rows = np.zeros((len(group), len(union)))
        for r, i in enumerate(group):
            rows[r, np.searchsorted(union, self.terms[i])] = 1
        parts = np.stack([rows[p:p + PART_ITEMS].max(0) for p in range(0, len(group), PART_ITEMS)])
        return union, rows, parts


class Sparse:
    """Rows of (term, value), turned into dense rows over a few terms when asked."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, values: np.ndarray, size: int):
        self.rows, self.terms, self.values, self.size = rows, terms, values, size
        self.starts = np.searchsorted(rows, np.arange(size + 1))

    def maxima(self, width: int) -> Sparse:
        """One row for every ``width`` rows, with the largest value of each term."""
        above = self.rows // width
        order = np.lexsort((self.terms, above))
        rows, terms = above[order], self.terms[order]
        first = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (terms[1:] != terms[:-1])]) if len(rows) else np.zeros(0, int)
        values = np.maximum.reduceat(self.values[order], first) if len(rows) else self.values
        return Sparse(rows[first], terms[first], values, -(-self.size // width))

    def dense(self, wanted: np.ndarray, column: np.ndarray, width: int, kind) -> np.ndarray:
        """The wanted rows (ascending) over the terms that have a column."""
        out = np.zeros((len(wanted), width), kind)
        lengths = self.starts[wanted + 1] - self.starts[wanted]
        at = np.repeat(self.starts[wanted] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        places = column[self.terms[at]]
        held = places >= 0
        out[np.repeat(np.arange(len(wanted)), lengths)[held], places[held]] = self.values[at][held]
        return out


class Block:
    """The hierarchy over a block of documents: documents, leaves of LEAF_ROWS, nodes of NODE_LEAVES leaves."""

    def __init__(self, batch: pa.RecordBatch, corpus: Corpus):
        counted, ids = batch.column("counts"), batch.column("ids")
        starts = ids.offsets.to_numpy()
        terms = ids.values.to_numpy()[starts[0]:starts[-1]].astype(np.int64)
        tf = counted.values.to_numpy()[counted.offsets[0].as_py():counted.offsets[-1].as_py()].astype(np.int64)
        rows = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        norm = np.array([corpus.length_norm(n) if n else 0 for n in batch.column("n").to_pylist()], np.int64)
        values = corpus.weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * norm[rows]))
        some = values > 0
        rows, terms, values = rows[some], terms[some], values[some]
        order = np.lexsort((terms, -values, rows))
        starts = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        heaviest = []
        for depth in range(3):
            at = starts[:-1] + depth
            there = at < starts[1:]
            heaviest.append(np.where(there, terms[order[np.minimum(at, max(len(order) - 1, 0))]], -1) if len(order) else np.full(len(at), -1))
        by_weight = np.lexsort(heaviest[::-1])
        place = np.empty_like(by_weight)
        place[by_weight] = np.arange(len(by_weight))
        moved = np.lexsort((terms, place[rows]))
        self.docs = Sparse(place[rows][moved], terms[moved], values[moved], batch.num_rows)
        self.leaves = self.docs.maxima(LEAF_ROWS)
        self.nodes = self.leaves.maxima(NODE_LEAVES)
        ids = batch.column("doc_id")
        self.named = ids.is_valid().to_numpy(zero_copy_only=False)[by_weight]
        self.ids = ids.fill_null(0).to_numpy()[by_weight]

    def leaf_rows(self, leaves: np.ndarray) -> np.ndarray:
        rows = (leaves[:, None] * LEAF_ROWS + np.arange(LEAF_ROWS)).ravel()
        return rows[rows < self.docs.size]


class Best:
    """The k best documents of each item so far, and the score below which none can be among them."""

    def __init__(self, items: int, k: int, least: np.ndarray):
        nothing = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        self.k, self.least, self.held = k, least.copy(), [nothing] * items

    def add(self, item: int, scores: np.ndarray, named: np.ndarray, ids: np.ndarray) -> None:
        scores, named, ids = (np.concatenate(p) for p in zip(self.held[item], (scores, named, ids)))
        order = np.lexsort((ids, named, -scores))[:self.k]
        self.held[item] = scores[order], named[order], ids[order]
        if len(order) == self.k:
            self.least[item] = max(self.least[item], self.held[item][0][-1])


def _scored(block: Block, best: Best, group: list[int], rows: np.ndarray, queries: np.ndarray, column: np.ndarray, kind,
            alive: np.ndarray | None) -> None:
    """Exact scores of the wanted documents; ``alive``: by item and row, whether the pair is asked for."""
    step = max(LEAF_ROWS, CELLS // queries.shape[1])
    for at in range(0, len(rows), step):
        some = rows[at:at + step]
        scores = (queries @ block.docs.dense(some, column, queries.shape[1], kind).T).astype(np.int64)
        good = scores >= np.maximum(best.least[group], 1)[:, None]
        if alive is not None:
            good &= alive[:, at:at + step]
        for r in np.flatnonzero(good.any(1)):
            hits = np.flatnonzero(good[r])
            best.add(group[r], scores[r, hits], block.named[some[hits]], block.ids[some[hits]])


def search_block(block: Block, items: Items, best: Best, column: np.ndarray, first_leaves: int | None = None) -> tuple[int, int]:
    """Adds the documents of a block to ``best``. With ``first_leaves``, only those of as many leaves with the largest bounds for
    each item. Returns the numbers of pairs scored and of all pairs."""
    asked = 0
    for group in items.groups:
        union, queries, parts = items.matrices(group)
        column[union] = np.arange(len(union))
        # the largest sum there can be: above 2^53 floating point is not exact
        largest = int(block.docs.values.max(initial=0)) * len(union)
        kind = np.float64 if largest < 2 ** 53 else np.int64
        queries, parts = queries.astype(kind), parts.astype(kind)
        least = np.maximum(best.least[group], 1)
        if first_leaves is None:
            weakest = np.array([least[p:p + PART_ITEMS].min() for p in range(0, len(group), PART_ITEMS)])
            nodes = np.arange(block.nodes.size)
            maxima = block.nodes.dense(nodes, column, len(union), kind)
            open_ = maxima.sum(1) >= weakest.min()  # the whole group against each node
            nodes, maxima = nodes[open_], maxima[open_]
            pairs = parts @ maxima.T >= weakest[:, None]
            kept = pairs.any(0)
            leaves = (nodes[kept][:, None] * NODE_LEAVES + np.arange(NODE_LEAVES)).ravel()
            above = np.repeat(np.repeat(pairs[:, kept], NODE_LEAVES, 1), PART_ITEMS, 0)[:len(group)]
            real = leaves < block.leaves.size
            leaves, above = leaves[real], above[:, real]
            alive = (queries @ block.leaves.dense(leaves, column, len(union), kind).T >= least[:, None]) & above
        else:
            leaves = np.arange(block.leaves.size)
            bounds = queries @ block.leaves.dense(leaves, column, len(union), kind).T
            if len(leaves) > first_leaves:
                bounds_of = np.argpartition(-bounds, first_leaves - 1, 1)[:, :first_leaves]
                alive = np.zeros(bounds.shape, bool)
                np.put_along_axis(alive, bounds_of, True, 1)
            else:
                alive = np.ones(bounds.shape, bool)
        kept = alive.any(0)
        leaves, alive = leaves[kept], alive[:, kept]
        if len(leaves):
            rows = block.leaf_rows(leaves)
            by_row = alive[:, np.searchsorted(leaves, rows // LEAF_ROWS)]
            asked += int(by_row.sum())
            _scored(block, best, group, rows, queries, column, kind, by_row)
        column[union] = -1
    return asked, block.docs.size * len(items.terms)


def _searcher(corpus: Corpus, terms: list[np.ndarray], k: int, least: np.ndarray, first_leaves: int | None):
    """A function over batches of term arrays that yields (item, doc_id, score), at most k a task for each item."""
    def run(batches):
        items, best = Items(terms, corpus.weights), Best(len(terms), k, least)
        column = np.full(len(corpus.weights), -1, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                search_block(Block(batch.slice(start, BLOCK_ROWS), corpus), items, best, column, first_leaves)
        for item, (scores, named, ids) in enumerate(best.held):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), item, np.int32)), pa.array(ids, mask=~named),
                                                  pa.array(scores)], ["item", "doc_id", "score"])

    return run


def _ask(docs: DataFrame, pairs: list, k: int) -> DataFrame | None:
    """The k best documents of the items in ``pairs`` (item_id, term): (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({p.term.encode("utf-8") for p in pairs}))}
    by_item: dict[int | None, list[int]] = {}
    for p in pairs:
        by_item.setdefault(p.item_id, []).append(vocabulary[p.term.encode("utf-8")])
    names, terms = list(by_item), [np.array(sorted(t), np.int64) for t in by_item.values()]
    folder = scratch(spark, "term-arrays")
    term_arrays(docs, vocabulary).write.parquet(folder)
    arrays = spark.read.parquet(folder)
    totals = arrays.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    if not totals.documents:
        return None
    found = arrays.select(F.explode("ids").alias("term")).groupBy("term").count().collect()  # at most the batch's vocabulary
    corpus = Corpus(totals.documents, totals.terms, {r["term"]: r["count"] for r in found}, len(vocabulary))
    held = arrays.where(F.size("ids") > 0)
    hits, order = "item int, doc_id long, score long", [F.col("score").desc(), F.col("doc_id")]

    def asked(least, first_leaves):
        rows = held.mapInArrow(_searcher(corpus, terms, k, least, first_leaves), hits)
        return top_k_per_group(rows, ["item"], order, k, "rank", "doc_id")

    first = asked(np.zeros(len(terms), np.int64), -(-k // LEAF_ROWS))
    least = np.zeros(len(terms), np.int64)
    for r in first.where(F.col("rank") == k).select("item", "score").collect():  # one score an item
        least[r["item"]] = r["score"]
    named = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "item int, item_id long")
    return asked(least, None).join(F.broadcast(named), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, batch_pairs: int = BATCH_PAIRS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 of each item, ties to smaller ids."""
    pairs = item_terms(items)
    batches = max(1, -(-pairs.count() // batch_pairs))
    number = F.pmod(F.xxhash64("item_id"), F.lit(batches))
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for batch in range(batches):
        wanted = pairs.where(number == batch).collect()  # about batch_pairs rows
        found = _ask(docs, wanted, k) if wanted else None
        out = out if found is None else out.unionByName(found)
    return out
