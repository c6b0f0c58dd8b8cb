"""Exact top-k search by exhaustive term-at-a-time accumulation.

Rows are sparse integer vectors: a term is a component that is not 0, its
weight the component. Candidates are dealt into blocks of bounded size, and a
task holds one block as postings: for each term the candidates that have it
and their weights. A block of queries walks its terms; each term scatters its
weighted postings into dense score arrays (one for each query, all candidates
of the block). A partition selects the k best of each array, ties included,
and a second, map-side bounded selection merges the blocks.

Every query meets every candidate block: the score of each pair is what the
operator is asked for, yet only k rows for each query and block leave a task.
Queries are dealt in blocks of bounded size too; neither side is broadcast.

Vectors that are NULL, or hold NULL, NaN or infinite components, take no part.
Equal ids are different rows; a query skips candidates of its own id. Vectors
of different lengths are scored over the components both have. Components
beyond +-2^31 / scale have no exact score in 64 bits and raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HITS = "query_id long, vec_id long, score long"


def quantised(rows: DataFrame, scale: int = 64, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, weights array<long>) of the vectors that take part."""
    v = F.col(vector)
    good = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return rows.where(F.coalesce(good, F.lit(False))).select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("weights"))


class Postings:
    """One block of candidates, turned round: for each term its rows and weights."""

    def __init__(self, vectors: list[np.ndarray], kind):
        self.size, self.kind, self.terms = len(vectors), kind, {}
        lengths = np.array([len(v) for v in vectors])
        for term in range(int(lengths.max(initial=0))):
            has = np.flatnonzero(lengths > term)
            weights = np.array([vectors[i][term] for i in has], kind)
            kept = weights != 0
            self.terms[term] = (has[kept], weights[kept])

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """Dense scores, candidates by queries."""
        out = np.zeros((self.size, len(queries)), self.kind)
        for term, (rows, weights) in self.terms.items():
            asked = np.array([q[term] if len(q) > term else 0 for q in queries], self.kind)
            if len(rows) == self.size:
                out += weights[:, None] * asked
            elif len(rows) and asked.any():
                out[rows] += weights[:, None] * asked
        return out


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Rows of the k highest scores, ties to smaller ids, without rows of the query's own id."""
    rows = np.flatnonzero(ids != own)
    if len(rows) > k:
        held = scores[rows]
        cut = held[np.argpartition(held, len(held) - k)[len(held) - k]]
        rows = rows[held >= cut]
    return rows[np.lexsort((ids[rows], -scores[rows].astype(np.int64)))[:k]]


def top_k(candidates: DataFrame, is_query: Column, k: int = 20, block_rows: int = 4096, query_rows: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query.

    ``candidates``: (vec_id, weights array<long>), see ``quantised``.
    """
    counts = candidates.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_query, 1)).alias("q"),
                            F.max(F.array_max(F.transform("weights", F.abs))).alias("top"),
                            F.max(F.size("weights")).alias("terms")).first()
    if counts.top is not None and counts.top >= 2 ** 31:
        raise ValueError("components beyond 2^31 / scale have no exact 64-bit score")
    blocks, groups = max(1, -(-counts.n // block_rows)), max(1, -(-counts.q // query_rows))
    kind = np.int32 if (counts.top or 0) ** 2 * max(1, counts.terms or 0) < 2 ** 31 else np.int64

    def dealt(n):
        return F.pmod(F.xxhash64("vec_id", "weights"), F.lit(n))

    sides = candidates.select("vec_id", "weights", dealt(blocks).alias("block"), F.lit(-1).alias("part")).unionByName(
        candidates.where(is_query).select("vec_id", "weights", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                                          dealt(groups).cast("int").alias("part")))
    ordered = sides.repartition(blocks, "block").sortWithinPartitions("block", "part", "vec_id")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches):
        state = {"block": None, "vectors": [], "ids": [], "postings": None}

        def answer(ids, vectors):
            held = np.array(state["ids"], np.int64)
            scores = state["postings"].scores(vectors).T if len(held) else np.zeros((len(ids), 0), kind)
            out = [(q, held[rows], s[rows]) for q, s in zip(ids, np.ascontiguousarray(scores)) for rows in [best(s, held, q, k)]]
            return pa.RecordBatch.from_arrays([
                pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]).astype(np.int64)),
                pa.array(np.concatenate([o[1] for o in out])), pa.array(np.concatenate([o[2] for o in out]).astype(np.int64))],
                schema=schema)

        for batch in batches:
            blocks_, parts = batch.column("block").to_pylist(), batch.column("part").to_numpy()
            ids, weights = batch.column("vec_id").to_pylist(), batch.column("weights")
            asked: tuple[list, list] = ([], [])
            for i, block in enumerate(blocks_):
                if block != state["block"]:
                    if asked[0]:
                        yield answer(*asked)
                        asked = ([], [])
                    state = {"block": block, "vectors": [], "ids": [], "postings": None}
                vector = weights[i].values.to_numpy(zero_copy_only=False).astype(kind)
                if parts[i] < 0:
                    state["ids"].append(ids[i])
                    state["vectors"].append(vector)
                    continue
                if state["postings"] is None:
                    state["postings"] = Postings(state["vectors"], kind)
                asked[0].append(ids[i])
                asked[1].append(vector)
                if len(asked[0]) >= 128:
                    yield answer(*asked)
                    asked = ([], [])
            if asked[0]:
                yield answer(*asked)

    order = [F.col("score").desc(), F.col("vec_id")]
    hits = ordered.mapInArrow(run, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
