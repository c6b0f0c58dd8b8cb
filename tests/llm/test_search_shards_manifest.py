"""Ranked search, sharding and the manifest against plain versions of their rules, SQL twins, and odd input."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from incidentlab.llm import dual_tree, merkle, sharding
from incidentlab.llm.common import scratch, ship
from incidentlab.llm.queries import ORACLES, QUERIES
from tools.check import connect

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, hash string, leaf string, g string"
NEW = ["op11_ranked_lexical_search", "op12_sharding", "op13_merkle_manifest"]


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship(spark)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Ties, repeated rows, NULLs in every column, empty and long texts, and columns whose names clash with those inside."""
    row = (5, "ant bee", "en", "s", 7, "a", "b", "c", "d", "e")
    texts = ["", " ", "\n", "ant bee cow", "ANT bee", "Été été", "x\n" * 40_000, "naïve 漢字 🙂", "\x00ant\x7f"]
    return spark.createDataFrame([
        *[(i, t, "en", f"src{i % 2}", len(t), "a", "b", "c", "d", "e") for i, t in enumerate(texts)], row, row,
        (20, None, None, None, None, None, None, None, None, None), (None, "ant", None, "", 3, "a", "b", "c", "d", "e"),
        (None, None, None, None, None, None, None, None, None, None), (21, "cow", "en", "", 3, "a", "b", "c", "d", "e")], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", NEW)
def test_query_equals_sql(spark, data, name):
    ours = QUERIES[name](spark, data).toPandas()
    theirs = connect(data).execute(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    rows = [sorted(map(str, f[columns].astype(object).where(f[columns].notna(), None).itertuples(index=False, name=None)))
            for f in (ours, theirs)]
    assert len(rows[0]) == len(rows[1]) > 0
    assert rows[0] == rows[1]


# --- ranked search --------------------------------------------------------------------------------------------------

RULE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in RULE.findall(text or "")]


def plain_search(docs, items, k):
    """Every document against every item, by the formula."""
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    sizes = [c.total() for _, c in counted]
    n_docs, n_terms = sum(1 for n in sizes if n), sum(sizes)
    df = Counter(t for _, c in counted for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for t, f in df.items()}
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(plain_terms(text))
    out = set()
    for item, terms in asked.items():
        scored = []
        for (doc, held), n in zip(counted, sizes):
            norm = 100 - 50 + 50 * n * n_docs // n_terms if n else 0
            score = sum(weight[t] * (1_000_000_000 * held[t] // (1000 * held[t] + 20 * norm)) for t in terms if t in held)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out |= {(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)}
    return out


def found(frame):
    return {tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()}


def some_texts(n, words, seed):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    return [" ".join(rng.choices(names, weights=[1 / (i + 1) for i in range(words)], k=rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("text", ["Ab-cD_9 É", "a\u0080b\u007fc`d@E[f", "", "ÉTÉ x1Y2", "漢字🙂z!", "\x00\x2f0\x3a9"])
def test_terms_by_bytes_and_by_pattern(spark, text):
    want = plain_terms(text)
    assert [t.decode() for t in dual_tree.text_terms(text)] == want
    rows = dual_tree.item_terms(spark.createDataFrame([(1, text)], "item_id long, text string")).collect()
    assert sorted(r.term for r in rows) == sorted(set(want))


def test_search_equals_plain_search(spark):
    texts = some_texts(3000, 400, 1)
    texts[100:400] = [texts[7]] * 300  # a large group of copies
    docs, items = list(enumerate(texts)), list(enumerate(some_texts(45, 400, 2)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = dual_tree.search(frame, spark.createDataFrame(items, "item_id long, text string"), k=20)
    assert found(got) == plain_search(docs, items, 20)


def test_batches_of_items_give_the_same(spark, documents, data):
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    docs = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    items = [tuple(r) for r in bench.select("item_id", "text").collect()]
    assert found(dual_tree.search(documents, bench, 50, batch_pairs=500)) == plain_search(docs, items, 50)


def test_bounds_prune_pairs_and_keep_results(monkeypatch):
    """Topics stand apart, so that whole batches go; the rest is scored exactly, in integers too."""
    rng = np.random.default_rng(3)
    ids = [sorted(set((rng.integers(0, 40, 12) + 40 * (i % 25)).tolist())) for i in range(2048)]
    corpus = dual_tree.Corpus(2048, 2048 * 12, Counter(t for d in ids for t in d), 1000)
    batch = pa.RecordBatch.from_arrays([
        pa.array(range(2048), pa.int64()), pa.array([len(d) for d in ids], pa.int64()), pa.array(ids, pa.list_(pa.int32())),
        pa.array([[1 + t % 3 for t in d] for d in ids], pa.list_(pa.int32()))], ["doc_id", "n", "ids", "counts"])
    terms = [np.unique(rng.integers(0, 40, 8) + 40 * (i % 25)) for i in range(50)]
    items, block = dual_tree.Items(terms, corpus.weights), dual_tree.Block(batch, corpus)
    results = []
    for limit in (1 << 21, 64):
        monkeypatch.setattr(dual_tree, "CELLS", limit)
        best = dual_tree.Best(50, 10, np.zeros(50, np.int64))
        column = np.full(1000, -1, np.int64)
        dual_tree.search_block(block, items, best, column, 1)
        least = best.least.copy()
        best = dual_tree.Best(50, 10, least)
        asked, pairs = dual_tree.search_block(block, items, best, column)
        assert asked < pairs / 4
        results.append([[x.tolist() for x in held] for held in best.held])
    whole = dual_tree.Best(50, 10, np.zeros(50, np.int64))
    dual_tree.search_block(block, items, whole, np.full(1000, -1, np.int64), 10 ** 6)
    assert results[0] == results[1] == [[x.tolist() for x in held] for held in whole.held]


def test_search_of_odd_rows(spark, odd, empty):
    items = [(1, "Ant COW"), (1, "été"), (2, None), (3, ""), (4, "nowhere"), (None, "bee ÉTÉ"), (5, "ant"), (5, "ant"), (6, "x 漢字")]
    bench = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, term string, score string")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert found(dual_tree.search(odd, bench, 50)) == plain_search(docs, items, 50)
    assert found(dual_tree.search(odd, bench, 2)) == plain_search(docs, items, 2)
    assert dual_tree.search(empty, bench).count() == 0
    assert dual_tree.search(odd, bench.limit(0)).count() == 0
    assert dual_tree.search(odd.where("text IS NULL"), bench).count() == 0


def test_large_weights_are_summed_in_integers():
    """Where a sum could pass 2^53, scores stay exact."""
    corpus = dual_tree.Corpus(10, 100, {0: 1, 1: 1}, 2)
    corpus.weights[:] = 2 ** 40 + 1
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array([2, 1], pa.int64()),
                                        pa.array([[0, 1], [1]], pa.list_(pa.int32())), pa.array([[1, 2], [3]], pa.list_(pa.int32()))],
                                       ["doc_id", "n", "ids", "counts"])
    best = dual_tree.Best(1, 5, np.zeros(1, np.int64))
    dual_tree.search_block(dual_tree.Block(batch, corpus), dual_tree.Items([np.array([0, 1])], corpus.weights), best, np.full(2, -1))
    norm = [100 - 50 + 50 * n * 10 // 100 for n in (2, 1)]
    part = lambda tf, m: (2 ** 40 + 1) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
    assert best.held[0][0].tolist() == sorted([part(1, norm[0]) + part(2, norm[0]), part(3, norm[1])], reverse=True)


# --- sharding -------------------------------------------------------------------------------------------------------


def plain_shards(rows, shards):
    """(doc_id, size) in order to (doc_id, size, shard, slot)."""
    whole, upto, slots, out = sum(s for _, s in rows), 0, Counter(), []
    for doc, size in rows:
        shard = min(shards - 1, shards * (2 * upto + size) // (2 * whole))
        out.append((doc, size, shard, slots[shard]))
        slots[shard] += 1
        upto += size
    return out


@pytest.mark.parametrize("shards", [1, 3, 8, 50])
def test_shards_are_cut_at_equal_targets(documents, shards):
    rows = sorted((r.doc_id, len((r.text or "").encode()) + 1) for r in documents.select("doc_id", "text").collect())
    got = sharding.assign(documents.repartition(6), shards)
    assert got.columns == [*documents.columns, "size", "shard", "slot"]
    assert sorted((r.doc_id, r["size"], r.shard, r.slot) for r in got.collect()) == plain_shards(rows, shards)
    sizes, largest = Counter(), max(s for _, s in rows)
    for r in got.collect():
        sizes[r.shard] += r["size"]
    target = sum(s for _, s in rows) / shards
    assert all(abs(sizes[k] - target) <= largest for k in range(shards))


def test_shards_of_equal_rows_and_one_huge_row(spark):
    frame = spark.createDataFrame([(1, "same")] * 500 + [(2, "x" * 100_000)] + [(3, "end")] * 4, "doc_id long, text string")
    rows = [(1, 5)] * 500 + [(2, 100_001)] + [(3, 4)] * 4
    got = sharding.assign(frame.repartition(7), 8)
    assert sorted((r.doc_id, r["size"], r.shard, r.slot) for r in got.collect()) == sorted(plain_shards(rows, 8))


def test_one_id_does_not_make_one_partition(spark):
    from incidentlab.llm import placing
    frame = spark.createDataFrame([(1, "same")] * 4000, "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in placing.place(frame, [F.col("doc_id"), F.col("text")], "tied").groupBy(placing.PART).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) == 8 and max(sizes) < 1000


def test_shards_of_odd_rows(spark, odd, empty):
    got = sharding.assign(odd, 4).collect()
    assert len(got) == odd.count()
    sizes = Counter((r.doc_id, r["size"]) for r in got)
    assert sizes == Counter((r.doc_id, len((r.text or "").encode()) + 1) for r in odd.collect())
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    assert sharding.assign(empty, 8).count() == 0


def test_written_shards_read_back(spark, documents):
    folder = scratch(spark, "shard-files")
    sharding.write_shards(sharding.assign(documents, 5), folder)
    back = spark.read.parquet(folder)
    assert {r["shard"]: r["count"] for r in back.groupBy("shard").count().collect()} == {
        r["shard"]: r["count"] for r in sharding.assign(documents, 5).groupBy("shard").count().collect()}
    assert {(r.doc_id, r.text) for r in back.collect()} == {(r.doc_id, r.text) for r in documents.collect()}


def test_sharding_runs_no_python(documents):
    plan = sharding.assign(documents)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- manifest -------------------------------------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The remaining node, and for each node its siblings level by level as (left, right)."""
    paths, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(places):
            run = p - p % 3
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1:run + 3])))
            places[i] = p // 3
        level = [digest("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_manifest(rows):
    """Sorted (doc_id, source, leaf, subroot, root, path) of rows (doc_id, source, leaf)."""
    groups = {}
    for doc, source, leaf in rows:
        groups.setdefault(source, []).append((doc is not None, doc or 0, leaf, doc))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([leaf for *_, leaf, _ in sorted(groups[s])]) for s in order}
    root, tops = plain_tree([trees[s][0] for s in order])
    return sorted((str(doc), str(s), leaf, trees[s][0], root, path + tops[i])
                  for i, s in enumerate(order) for (_, _, leaf, doc), path in zip(sorted(groups[s]), trees[s][1]))


def manifest_rows(frame):
    return sorted((str(r.doc_id), str(r.source), r.leaf, r.subroot, r.root, [tuple(p) for p in r.path]) for r in frame.collect())


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest_equals_plain_trees(spark, monkeypatch, depth):
    """Groups of many sizes, one holding a third of all rows; with small blocks over several tiers."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    monkeypatch.setattr(merkle, "BLOCK", 3 ** depth)
    sizes = [1, 2, 3, 4, 8, 9, 10, 27, 28, 82, 90]
    rows = [(k * 1000 + i, f"s{k}", f"t{i}") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = merkle.manifest(frame, ("doc_id", "source", "text"))
    assert manifest_rows(got) == plain_manifest([(d, s, plain_leaf((d, s, t))) for d, s, t in rows])


def test_manifest_of_several_tiers(spark):
    rows = [(i, "big" if i % 3 else None, f"text {i}") for i in range(3000)]
    got = merkle.manifest(spark.createDataFrame(rows, "doc_id long, source string, text string"), ("doc_id", "source", "text"))
    assert manifest_rows(got) == plain_manifest([(d, s, plain_leaf((d, s, t))) for d, s, t in rows])


def test_manifest_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.source, plain_leaf([r[f] for f in merkle.FIELDS])) for r in odd.collect()]
    assert manifest_rows(merkle.manifest(odd)) == plain_manifest(rows)
    assert merkle.manifest(empty).count() == 0
    assert manifest_rows(merkle.manifest(odd.where("doc_id = 3"))) == plain_manifest([r for r in rows if r[0] == 3])


def test_tampered_documents_are_found(spark, data, documents):
    tampered = {r.doc_id for r in documents.collect() if zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and "\n" in (r.text or "")}
    got = QUERIES["op13_merkle_manifest"](spark, data).collect()
    assert {r.doc_id for r in got if not r.verified} == tampered and 0 < len(tampered) < len(got)
    assert all((r.folded_root == r.root) == r.verified for r in got)


def test_proofs_come_without_joins_of_leaves(documents):
    """Block structs meet the siblings above them by one grouping; the only joins are with counts of partitions."""
    rolled = merkle._roll_blocks(documents.select(
        F.col("source").alias("g"), F.lit(10).cast("long").alias("n"), F.col("doc_id").alias("rank"),
        F.struct(F.sha2("text", 256).alias("hash"), F.struct("doc_id").alias("item")).alias("node")))
    plan = rolled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
