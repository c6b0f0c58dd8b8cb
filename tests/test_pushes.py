"""Rankings pushed by a stream: each micro-batch against the difference of whole rankings, repeated and restarted."""

from __future__ import annotations

from collections import Counter

import pytest

from incidentlab.streaming import jobs

FILES = [[("a", 3), ("b", 5), ("c", 1)], [("c", 6), ("d", 2)], [("a", 0), ("e", 9)], [("b", 1), ("b", 2), ("d", 1)]]


def ranking(totals):
    return {k: (n, r) for r, (k, n) in enumerate(sorted(totals.items(), key=lambda p: (-p[1], p[0])), 1)}


def expected():
    """(batch, key, change, score, rank) of every push."""
    totals, before, out = Counter(), {}, set()
    for batch, rows in enumerate(FILES):
        for key, n in rows:
            totals[key] += n
        after = ranking(totals)
        out |= {(batch, k, "changed" if k in before else "new", *v) for k, v in after.items() if before.get(k) != v}
        before = after
    return out, before


def rows_of(pushes):
    return {(r.batch, r.key, r.change, r.n, r["rank"]) for r in pushes.collect()}


@pytest.fixture
def arriving(spark, tmp_path):
    """One file after another, in the order of FILES."""
    import os
    folder = tmp_path / "in"
    for i, rows in enumerate(FILES):
        spark.createDataFrame(rows, "key string, n long").coalesce(1).write.mode("append").parquet(str(folder))
        for file in folder.glob("part-*.parquet"):
            if file.stat().st_mtime > 1_000_000 + 10 * len(FILES):
                os.utime(file, (1_000_000 + 10 * i, 1_000_000 + 10 * i))
    return str(folder)


def test_each_micro_batch_pushes_what_changed(spark, arriving):
    pushes = jobs.RankingPushes(spark, "key", "n", "risk_update")
    got = pushes.run(jobs.read_files_in_turn(spark, arriving))
    want, last = expected()
    assert rows_of(got) == want and {r.channel for r in got.collect()} == {"risk_update"}
    held = {r.key: (r.n, r["rank"]) for r in jobs.last_pushes(got, "key").collect()}
    assert held == last == {r.key: (r.n, r["rank"]) for r in pushes.version(spark, 3).collect()}


def test_a_repeated_batch_gives_the_same_rows(spark):
    pushes = jobs.RankingPushes(spark, "key", "n", "risk_update")
    frames = [spark.createDataFrame(rows, "key string, n long") for rows in FILES]
    for turn in (0, 0, 1, 1, 2, 3, 3):
        pushes.apply(frames[turn], turn)
    assert rows_of(pushes.pushed(spark)) == expected()[0]


def test_a_restart_goes_on_with_the_last_version(spark, arriving):
    pushes = jobs.RankingPushes(spark, "key", "n", "risk_update")
    pushes.run(jobs.read_files_in_turn(spark, arriving))
    assert rows_of(pushes.run(jobs.read_files_in_turn(spark, arriving))) == expected()[0]  # nothing new, nothing doubled
    spark.createDataFrame([("a", 100)], "key string, n long").coalesce(1).write.mode("append").parquet(arriving)
    more = rows_of(pushes.run(jobs.read_files_in_turn(spark, arriving))) - expected()[0]
    assert ("a", 103, 1) in {(k, n, r) for b, k, _, n, r in more} and {b for b, *_ in more} == {4}
