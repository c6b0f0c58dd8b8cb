"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Items fall into size classes by their number of distinct five-word shingles
(powers of two). For a class whose largest size is u, a document is read in
windows of 5u/4 shingles that start every u/4 shingles (up to u = 4: windows of
u at every place), so that an item lies whole in some window, and the class
bounds their Jaccard similarity from below, however long the document. Items
and windows are sketched by ``ROUNDS`` permutations of the shingle hashes, each
cut into ``BUCKETS``; an equal minimum in one bucket makes a candidate. At
containment 0.8 the smallest similarity is 0.32, and at least 30 filled buckets
make the chance of a miss smaller than 1 in 100,000. Documents without any
shingle of an item are left before they are sketched.

A task needs only to know which minima exist among the items: a Bloom filter
of fixed size (``filter_bits``) says so, and its false hits fall out of the
joins. Candidates are verified on whole documents: a pair stays where the
document holds at least ``threshold`` of the item's distinct shingles.

``benchmark`` may be larger than a broadcast: items are joined by shuffles.
Items with fewer than five words have no shingles and are never found; NULL
and empty texts match nothing; rows of one id count as one document or item.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlab.llm.common import slices
from incidentlab.llm.shingles import Shingler, mix
from incidentlab.session import shared_dir

BUCKETS = 16
ROUNDS = 8
FILTER_BITS = 23
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def size_class(n: int) -> int:
    """c for sizes above 2^(c-1) and up to 2^c."""
    return int(n - 1).bit_length()


def sketch_keys(hashes: np.ndarray, block: np.ndarray, blocks: int, span: int, size: int) -> np.ndarray:
    """Distinct join keys of the bucket minima of all runs of ``span`` blocks, for one size class."""
    keys = []
    for seed in range(ROUNDS):
        dealt = mix(hashes ^ mix(np.array([seed + 1], np.uint64)))
        cell = block * BUCKETS + (dealt % np.uint64(BUCKETS)).astype(np.int64)
        least = np.full(blocks * BUCKETS, NONE, np.uint64)
        np.minimum.at(least, cell, dealt)
        least = least.reshape(blocks, BUCKETS)
        run, last = least, max(1, blocks - span + 1)
        if blocks > 1:
            run = least[:last]
            for k in range(1, min(span, blocks)):
                run = np.minimum(run, least[k:k + last])
        keys.append(np.unique(mix(run[run != NONE] + np.uint64(size * ROUNDS + seed))))
    return np.concatenate(keys)


def window_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    """Join keys of all windows of a document for the class of items up to 2^size shingles."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    step, span = (1, 1 << size) if size <= 2 else (1 << (size - 2), 5)
    block = np.arange(len(hashes)) // step
    return sketch_keys(hashes, block, int(block[-1]) + 1, span, size)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bit(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    top = keys >> np.uint64(64 - bits), mix(keys) >> np.uint64(64 - bits)
    return top[0].astype(np.int64), top[1].astype(np.int64)


def item_rows(items: DataFrame, id_col: str) -> DataFrame:
    """(item_id, kind, key, size, n): kind 0 rows are sketch keys, kind 1 rows distinct shingles."""
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    schema = pa.schema([("item_id", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("size", pa.int32()), ("n", pa.int64())])

    def run(batches):
        shingler = Shingler(short=False)
        for batch in batches:
            for part in slices(batch):
                for item, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist()):
                    own = np.unique(shingler.all(text))
                    if not len(own):
                        continue
                    size = size_class(len(own))
                    sketch = sketch_keys(own, np.zeros(len(own), np.int64), 1, 1, size)
                    keys = np.concatenate([sketch, own])
                    kind = np.repeat([0, 1], [len(sketch), len(own)])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([item] * len(keys), pa.int64()), pa.array(kind, pa.int32()), pa.array(_signed(keys)),
                        pa.array(np.full(len(keys), size), pa.int32()), pa.array(np.full(len(keys), len(own)), pa.int64())], schema=schema)

    return rows.mapInArrow(run, "item_id long, kind int, key long, size int, n long")


def item_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """Two hashes of every key as a bit array of fixed size. At most 2^bits / 8 bytes reach the driver from each of 16 tasks."""
    def run(batches):
        held = np.zeros(1 << bits, bool)
        for batch in batches:
            for place in _bit(batch.column("key").to_numpy().view(np.uint64), bits):
                held[place] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(held).tobytes()], pa.binary())], ["held"])

    parts = keys.select("key").coalesce(16).mapInArrow(run, "held binary")
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.toLocalIterator():
        out |= np.frombuffer(row.held, np.uint8)
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.8, item_id: str = "item_id",
                 filter_bits: int = FILTER_BITS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of every pair at or above the threshold."""
    spark = docs.sparkSession
    shared_dir(spark)
    rows = item_rows(items, item_id).distinct().checkpoint()
    # The items of one id are one item: sizes are those of its rows together.
    wanted = rows.where("kind = 1").select("item_id", "key").distinct()
    sizes = wanted.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_shingles"))
    classes = [r["size"] for r in rows.select("size").distinct().collect()]  # one row for each power of two
    schema = "doc_id long, kind int, key long"
    if not classes:
        return spark.createDataFrame([], "doc_id long, item_id long, n_shingles long, n_shared long, containment double")
    known = spark.sparkContext.broadcast(item_filter(rows, filter_bits))
    arrow = pa.schema([("doc_id", pa.int64()), ("kind", pa.int32()), ("key", pa.int64())])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches):
        shingler, held = Shingler(short=False), known.value

        def present(keys: np.ndarray) -> np.ndarray:
            one, two = _bit(keys, filter_bits)
            return keys[((held[one >> 3] >> (7 - (one & 7))) & (held[two >> 3] >> (7 - (two & 7))) & 1).astype(bool)]

        for batch in batches:
            for part in slices(batch):
                ids, kinds, keys = [], [], []
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    hashes = shingler.all(text)
                    shared = np.unique(present(hashes))
                    if not len(shared):
                        continue  # no shingle of any item
                    found = np.unique(np.concatenate([present(window_keys(hashes, size)) for size in classes]))
                    if len(found):
                        ids += [doc] * (len(found) + len(shared))
                        kinds += [0] * len(found) + [1] * len(shared)
                        keys += [_signed(found), _signed(shared)]
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()),
                                                      pa.array(np.concatenate(keys))], schema=arrow)

    met = texts.mapInArrow(run, schema).checkpoint()
    candidates = met.where("kind = 0").join(rows.where("kind = 0").select("item_id", "key"), "key").select("doc_id", "item_id").distinct()
    shared = (met.where("kind = 1").distinct().join(wanted, "key").groupBy("doc_id", "item_id")
              .agg(F.count(F.lit(1)).alias("n_shared")))
    return (shared.join(candidates, ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
            .withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("containment") >= threshold)
            .select("doc_id", "item_id", "n_shingles", "n_shared", "containment"))

