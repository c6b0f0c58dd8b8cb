"""Hot anchors and repeated ids in the two dedup operators."""

from __future__ import annotations

import pathlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentlab.llm import dart_minhash, suffix_dedup
from incidentlab.llm.common import ship
from incidentlab.session import shared_dir
from tests.llm.test_corpus import brute_classes, brute_repeats, repeats


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship(spark)


def common_passage(spark):
    """Documents that share one gram or passage in bytes that differ, or that equal each other in part."""
    rule = "=" * 20
    passage = "".join(chr(97 + i * i * 7 % 26) for i in range(90))
    rows = [(i, f"{i * 7919:030d}{rule}{i * 104729:040d} {passage[i % 9:]}{i % 5:030d}") for i in range(60)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_hot_anchors_give_the_same_cuts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 20)
    rows, frame = common_passage(spark)
    assert len(suffix_dedup.hot_anchors(frame))
    assert repeats(frame) == brute_repeats(rows)


def test_all_repeated_anchors_hot(spark, monkeypatch, data):
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 2)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    assert repeats(spark.createDataFrame(rows, "doc_id long, text string")) == brute_repeats(rows)


def test_hot_anchors_are_a_share_of_the_input(spark, monkeypatch):
    """An anchor with a fixed number of rows is hot in a small input only, so that hot rows grow with the input and not faster."""
    monkeypatch.setattr(suffix_dedup, "HOT_SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 40)
    rule = "=" * 60
    rows = [(i, f"{rule}{i * 7919:030d}") for i in range(50)]
    assert len(suffix_dedup.hot_anchors(spark.createDataFrame(rows, "doc_id long, text string")))
    draw = np.random.default_rng(3)
    rows += [(100 + i, draw.bytes(9000).hex()) for i in range(100)]
    assert not len(suffix_dedup.hot_anchors(spark.createDataFrame(rows, "doc_id long, text string")))


def test_anchors_are_dealt_as_lists(spark, monkeypatch):
    """Not a row for each anchor: a row for each bucket and task, here of at most 8 tasks."""
    draw, dealt = np.random.default_rng(4), []
    frame = spark.createDataFrame([(i, draw.bytes(5000).hex()) for i in range(40)], "doc_id long, text string")
    spread = type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda self, f, schema, *more: dealt.append((f.__name__, made := spread(self, f, schema, *more))) or made)
    suffix_dedup.remove_repeats(frame)
    seen = dict(dealt)["seen"]
    assert seen.count() <= 3 * 8 * 8
    assert seen.agg(F.sum(F.size("codes"))).first()[0] > 20_000


def test_anchors_of_several_documents_are_those_of_each():
    draw = np.random.default_rng(6)
    coded = [draw.integers(97, 97 + n, size).astype(np.uint8).tobytes() for n, size in ((1, 300), (2, 49), (3, 50), (26, 700), (1, 0), (2, 200), (1, 51))]
    whole = suffix_dedup.anchors(coded)
    for i, one in enumerate(coded):
        alone, mine = suffix_dedup.anchors([one]), whole.doc == i
        for name in ("name", "low", "high", "place"):
            assert getattr(alone, name).tolist() == getattr(whole, name)[mine].tolist()
        covered = [p for a, b in zip(alone.low.tolist(), alone.high.tolist()) for p in range(a, b + 1)]
        assert covered == list(range(max(0, len(one) - suffix_dedup.LENGTH + 1)))


@pytest.mark.parametrize("length", [16, 39, 79])
def test_other_lengths(spark, length):
    rows, frame = common_passage(spark)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame, length).collect()}
    assert found == brute_repeats(rows, length)


def test_contexts_of_a_hot_anchor_go_to_many_tasks(spark):
    rows = spark.range(2000).select(F.lit(b"x" * 60).alias("context"), F.col("id").alias("doc_id"), F.lit(True).alias("hot"))
    sizes = [r["count"] for r in rows.repartition(8, suffix_dedup.deal_key(F.lit(1).cast("long"))).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 500


@pytest.mark.parametrize("weighting", ["set", "count"])
def test_rows_of_one_id_are_one_document(spark, weighting):
    a, b, c = (" ".join(f"{name}{i}" for i in range(200)) for name in ("ant", "bee", "cow"))
    rows = [(1, a), (1, b), (2, b), (2, a + " tail"), (3, a), (4, a), (4, c), (5, c), (6, c + " tail"), (6, None), (None, c)]
    found = dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), weighting=weighting).collect()
    assert {r.doc_id: r.class_id for r in found if r.doc_id is not None} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5}
    assert len(found) == 7


@pytest.mark.parametrize("part_rows, pivots", [(4, 16)])
def test_crowds_of_near_copies_equal_brute_force(spark, monkeypatch, part_rows, pivots):
    """Most pairs of the crowd meet; some are similar enough, some are not."""
    monkeypatch.setattr(dart_minhash, "PART_ROWS", part_rows)
    monkeypatch.setattr(dart_minhash, "PIVOTS", pivots)
    rows = []
    for i in range(40):
        words = [f"w{k}" for k in range(50 + i % 9)]
        for e in range(i % 3):
            words[(i * 7 + e * 23) % len(words)] = f"edit{i // 2}x{e}"
        rows.append((i, " ".join(words)))
    found = dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_classes(rows)
    assert 1 < len(set(want.values())) < 39
    assert {r.doc_id: r.class_id for r in found} == want


def crowd(n=60):
    """Sets that meet in crowded buckets; some are similar enough, some are not."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(n):
        words = [f"w{k}" for k in range(60)]
        for at in draw.choice(60, i % 5, replace=False):
            words[at] = f"edit{i // 2}x{at}"
        rows.append((i, " ".join(words)))
    return rows


def test_rounds_are_few_and_leave_no_tables(spark, monkeypatch):
    """A bucket of up to 16 members ends with the second round, one of up to 256 with the third."""
    rounds, folder, verified = [], pathlib.Path(shared_dir(spark).removeprefix("file:")), dart_minhash._verified
    monkeypatch.setattr(dart_minhash, "_verified", lambda *a: rounds.append(1) or verified(*a))
    monkeypatch.setattr(dart_minhash, "scratch", lambda _, name: f"{folder}/few-{name}")
    rows = crowd()
    found = dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == brute_classes(rows)
    assert 1 < len(rounds) <= 3
    left = [p.name for p in (folder / "few-near-duplicates").iterdir()]
    assert len(left) <= 1 and all(name.startswith("labels-") for name in left)


def test_each_meeting_pair_is_told_once(spark):
    """Whatever the turns, two members of a bucket are a pair in the round of the first of them."""
    rows = [(1, i, 10, [0] * 8, 3, float(i // 2), i) for i in range(40)]
    members = spark.createDataFrame(rows, "key long, whole long, size int, parities array<long>, parts int, turn double, label long")
    met, done = [], 0
    for turns in (4, 9, 20):
        left = members.where(F.col("turn") >= done)
        met += [frozenset((r.whole, r.pivot)) for r in dart_minhash._met(left, left.where(F.col("turn") < turns), 0.8, dart_minhash._later()).collect()]
        done = turns
    assert len(met) == len(set(met)) == 40 * 39 // 2


def test_parities_never_exceed_the_difference():
    draw = np.random.default_rng(1)
    for size in (1, 30, 400, 3000):
        a = np.unique(draw.integers(0, 2 ** 60, size).astype(np.uint64))
        b = np.concatenate([a[size // 5:], np.unique(draw.integers(0, 2 ** 60, size // 4 + 1).astype(np.uint64))])
        odd = np.bitwise_count((dart_minhash._parities(a) ^ dart_minhash._parities(b)).view(np.uint64)).sum()
        assert odd <= len(np.setxor1d(a, b))


def test_rows_asked_for_all_stay(spark):
    rows, asked = spark.range(3000).withColumnRenamed("id", "k"), spark.range(0, 3000, 7).withColumnRenamed("id", "k")
    kept = dart_minhash._asked_for(rows, "k", asked)
    assert asked.join(kept, "k", "left_anti").count() == 0 and kept.count() < 440
