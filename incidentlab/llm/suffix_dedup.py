"""Removal of bytes that repeat an earlier document: suffix sorting by a difference cover.

A byte goes where it is covered by a string of ``length`` bytes that also
starts in a document with a smaller doc_id. Matches do not cross documents.

1. Whole copies are told by their hash; only the first of each goes on.
2. Every window of ``length`` bytes names one anchor: the smallest hash among
   its grams of ``GRAM`` bytes. Equal windows have equal anchors, so an anchor
   hash seen in one document only has no repeated window. This leaves exact
   candidates and drops nothing that repeats; about one position in 14 is an
   anchor. Anchors meet in buckets of a bounded size, as lists of 32-bit codes
   and documents; codes that meet by chance only add a candidate.
3. The windows of one candidate anchor form a context of at most
   2 * length - GRAM bytes. Contexts are dealt by their anchor hash, so equal
   windows meet, and every task sorts the suffixes of its distinct contexts:
   it sorts the sampled triples (positions not divisible by 3), recurses on
   their names, sorts the remaining suffixes by first symbol and the rank
   behind it, merges both, and compares the ``length``-byte prefixes of
   neighbours. The smallest doc_id of each run of equal prefixes decides.
4. Anchors that stand in very many documents (common passages, rules, runs of
   one byte) would fill a task, so they are not sorted: their contexts are made
   distinct with their smallest doc_id by partial aggregates, the smallest
   doc_id of every distinct window follows by partial aggregates as well, and
   the answer returns to the occurrences by (context, salt). Both ways are
   exact, so the choice of anchors touches no result. A sample of the distinct
   texts finds them: those of one row in ``HOT_SHARE``, whatever the size of the
   input, but none below ``HOT_ROWS`` sampled rows and all above ``HOT_MOST``;
   at most ``HOT_ANCHORS``, so that any other anchor has less than that share
   of the rows.
5. The removed windows return to their documents as bit masks.

Tasks hold one batch of anchors at a time. The occurrences of one anchor
(equal ``GRAM`` bytes) stand in one batch, those of step 4 excepted: about
``HOT_SAMPLE * HOT_MOST`` rows at most in inputs of any size up to
``HOT_ANCHORS`` times as many.

NULL text is empty. Rows with a NULL id neither lose bytes nor are a source.
Rows of one id do not remove each other. Invalid input bytes cannot occur: the
text column is UTF-8. Output columns: doc_id, n_bytes, n_removed, n_spans,
kept_sha256, and the remaining bytes and text.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from incidentlab.llm.common import slices
from incidentlab.llm.shingles import mix

LENGTH = 50
GRAM = 24
TURN_BITS = 40  # a place is the turn of the text among those of its id, and a byte position
BATCH_SYMBOLS = 1_000_000
SLICE = 200_000  # characters of text that are looked at together
HELD_ANCHORS = 500_000  # anchors of a task that are dealt together
BUCKET_ANCHORS = 1_000_000  # about so many anchors meet in a bucket at most
HOT_SAMPLE = 64  # one distinct text in so many is looked at for anchors of many rows
HOT_ROWS, HOT_MOST = 64, 512  # so many rows in the sample make an anchor hot: by the share below, between these limits
HOT_SHARE = 2048
HOT_ANCHORS = 65_536  # goes to the driver and into each task


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in ascending order (difference cover modulo 3). Symbols must be positive."""
    n = len(text)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    s = np.concatenate([text.astype(np.int64), np.zeros(3, np.int64)])
    some = np.arange(n + (n % 3 == 1))
    sampled = np.concatenate([some[some % 3 == 1], some[some % 3 == 2]])
    wide = int(s.max()) + 1
    if wide ** 3 < 2 ** 63:
        order, names = _names((s[sampled] * wide + s[sampled + 1]) * wide + s[sampled + 2])
    else:
        order, names = _names(_names(s[sampled] * wide + s[sampled + 1])[1] * wide + s[sampled + 2])
    if names.max() < len(names) - 1:
        order = suffix_order(names + 1)
        names = np.empty(len(order), np.int64)
        names[order] = np.arange(len(order))
    rank = np.zeros(len(s) + 1, np.int64)
    rank[sampled] = names + 1
    sampled = sampled[order]
    sampled = sampled[sampled < n]
    rest = np.arange(0, n, 3)
    wide = np.int64(len(s) + 1)
    rest = rest[np.argsort(s[rest] * wide + rank[rest + 1])]
    # where the remaining suffixes go among the sampled ones, class by class
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(s[ones] * wide + rank[ones + 1], s[rest] * wide + rank[rest + 1])
    both = np.concatenate([twos, rest])
    heads, most = s[both] * (s.max() + 1) + s[both + 1], int(s.max()) + 1
    if most ** 2 * int(wide) >= 2 ** 63:
        heads = _names(heads)[1]
    keys = heads * wide + rank[both + 2]
    before += np.searchsorted(keys[:len(twos)], keys[len(twos):])
    out = np.empty(n, np.int64)
    at = np.arange(len(rest)) + before
    out[at] = rest
    free = np.ones(n, bool)
    free[at] = False
    out[free] = sampled
    return out


def _names(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of numbers, and the dense rank of each."""
    order = np.argsort(keys)
    held = keys[order]
    names = np.empty(len(keys), np.int64)
    names[order] = np.cumsum(np.concatenate([[0], held[1:] != held[:-1]])) if len(keys) else 0
    return order, names


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number (zeros behind the end)."""
    w = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        w = (w[:-k] << np.uint64(8 * k)) | w[k:]
    return w[:len(text)]


def window_minima(text: np.ndarray, sizes: np.ndarray, least: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every window of the contexts that stand one behind the other in ``text`` the smallest value of ``least`` among
    contexts that hold the same window, at the place where the window starts."""
    ends = np.cumsum(sizes)
    order = suffix_order(text.astype(np.int64) + 1)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    order = order[order <= (ends - length)[owner[order]]]
    words, same = _words(text), np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, length - 8, 8), length - 8]:
        held = words[np.minimum(order + k, len(text) - 1)]
        same &= held[1:] == held[:-1]
    first = np.concatenate([[True], ~same])[:len(order)]
    best = np.minimum.reduceat(least[owner[order]], np.flatnonzero(first))
    out = np.empty(len(text), np.int64)
    out[order] = best[np.cumsum(first) - 1]
    return out


def gram_size(length: int) -> int:
    """Bytes of the grams of which anchors are made. Longer grams meet by chance less often, but more of them are anchors."""
    return GRAM if length >= 2 * GRAM - 8 else GRAM - 8


class Anchors(NamedTuple):
    """The anchors of some documents, one behind the other."""

    name: np.ndarray  # hash of the gram
    doc: np.ndarray  # number of the document
    low: np.ndarray  # first window start
    high: np.ndarray  # last window start
    start: np.ndarray  # where the document begins in the joined bytes
    place: np.ndarray  # where the gram stands: the first place at or behind the last window start


def anchors(coded: list[bytes], length: int = LENGTH, places: bool = True) -> Anchors:
    """The anchors of the windows of every document. Windows do not cross documents."""
    sizes = np.array([len(c) for c in coded], np.int64)
    data, ends = np.frombuffer(b"".join(coded), np.uint8), np.cumsum(sizes)
    gram = gram_size(length)
    span = length - gram + 1
    if sizes.max(initial=0) < length:
        none = np.empty(0, np.int64)
        return Anchors(none.view(np.uint64), none, none, none, none, none)
    words, grams = _words(data), None
    for k in [*range(0, gram - 8, 8), gram - 8]:
        part = words[k:len(data) - gram + 1 + k]
        grams = mix(part) if grams is None else mix(grams ^ (part * np.uint64(0x9E3779B97F4A7C15)))
    low, have = grams, 1
    while have < span:  # minima of runs of ``span`` grams by doubling
        step = min(have, span - have)
        low, have = np.minimum(low[:-step], low[step:]), have + step
    owner = np.repeat(np.arange(len(coded)), sizes)[:len(low)]
    at = np.flatnonzero(np.arange(length, length + len(low)) <= ends[owner])
    low, owner = low[at], owner[at]
    edge = np.flatnonzero(np.concatenate([[True], (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])]))
    size = np.diff(edge, append=len(low))
    if size.max() > span:  # equal grams in a row share a hash: their windows are cut into contexts of ``span``
        parts = -(-size // span)
        edge = np.repeat(edge, parts) + span * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    name, doc, last = low[edge], owner[edge], at[np.concatenate([edge[1:], [len(low)]]) - 1]
    start = (ends - sizes)[doc]
    place, left = np.full(len(name), -1, np.int64), np.arange(len(name) if places else 0)
    for k in range(span):
        met = grams[last[left] + k] == name[left]
        place[left[met]] = last[left[met]] + k
        left = left[~met]
    return Anchors(name, doc, at[edge] - start, last - start, start, place - start)


def among(names: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Whether each name is in ``held``, which is sorted."""
    if not len(held):
        return np.zeros(len(names), bool)
    return held[np.minimum(np.searchsorted(held, names), len(held) - 1)] == names


def sampled_anchors(rows: DataFrame, length: int = LENGTH) -> tuple[np.ndarray, int]:
    """Anchors that stand in very many places of the distinct texts, by a sample of these, sorted; and about how many anchors there are."""
    drawn = rows.where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("text", F.lit(5)), F.lit(HOT_SAMPLE)) == 0)).select("text").distinct()

    def named(batches):
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                name, count = np.unique(anchors([t.encode() for t in part.column("text").to_pylist()], length, False).name, return_counts=True)
                all_of = pa.array([*name.view(np.int64).tolist(), None], pa.int64())  # NULL for all
                yield pa.RecordBatch.from_arrays([all_of, pa.array(np.append(count, count.sum()).astype(np.int64))], ["anchor", "n"])

    counts = drawn.mapInArrow(named, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("anchor").isNull() | (F.col("n") >= HOT_ROWS)).orderBy(F.col("n").desc(), "anchor").limit(HOT_ANCHORS + 1).collect()
    total = sum(r["n"] for r in top if r["anchor"] is None)
    bar = max(HOT_ROWS, min(HOT_MOST, total // HOT_SHARE))
    found = [r["anchor"] for r in top if r["anchor"] is not None and r["n"] >= bar]
    return np.sort(np.array(found, np.int64).view(np.uint64)), total * HOT_SAMPLE


def hot_anchors(rows: DataFrame, length: int = LENGTH) -> np.ndarray:
    return sampled_anchors(rows, length)[0]


def deal_key(anchor: Column) -> Column:
    """What contexts are dealt by: their anchor; those of hot anchors evenly."""
    return F.when(F.col("hot"), F.xxhash64("context", "doc_id")).otherwise(anchor)


def spread_masks(rows: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, place, mask) of (context, doc_id, place) with removed windows, however many share a context or a window.

    Every group is reduced by partial aggregates; joins back are dealt by a
    salt as well, and only the salts that a context or window has get a copy.
    """
    parts = F.lit(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), parts))
    salted = rows.groupBy("context", "salt").agg(F.min("doc_id").alias("least"))
    contexts = salted.groupBy("context").agg(F.min("least").alias("least"))
    starts = F.sequence(F.lit(0), F.length("context") - length)
    windows = contexts.select("context", "least", F.pmod(F.xxhash64("context"), parts).alias("salt"), F.posexplode(
        F.transform(starts, lambda i: F.substring(F.col("context"), i + 1, F.lit(length)))).alias("t", "window"))
    held = windows.groupBy("window", "salt").agg(F.min("least").alias("least"))
    earliest = held.select("window", "salt").join(held.groupBy("window").agg(F.min("least").alias("earliest")), "window")
    answers = windows.join(earliest, ["window", "salt"]).groupBy("context", "earliest").agg(
        F.bit_or(F.expr("shiftleft(1L, t)")).alias("bits")).groupBy("context").agg(F.collect_list(F.struct("earliest", "bits")).alias("answers"))
    back = salted.select("context", "salt").join(answers, "context")
    mask = F.aggregate(F.filter("answers", lambda x: x["earliest"] < F.col("doc_id")), F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x["bits"]))
    return rows.join(back, ["context", "salt"]).select("doc_id", "place", mask.alias("mask")).where(F.col("mask") != 0)


def _documents(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The rows with ``first``, the smallest id that has this very text, and ``turn``, the place of the text among those of its id."""
    whole = F.xxhash64("text", F.length("text"))
    carried = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.join(first, "doc_id", "left").select(
        "doc_id", "text", *carried, F.array_min(F.transform(F.filter("firsts", lambda x: x["whole"] == whole), lambda x: x["first"])).alias("first"),
        F.coalesce(F.array_position(F.transform("firsts", lambda x: x["whole"]), whole), F.lit(0)).alias("turn"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, texts: tuple[str, ...] = ("kept", "kept_text"),
                   carry: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    ``texts`` adds the remaining bytes (``kept``) and the remaining text
    without characters that were cut in part (``kept_text``). ``carry`` maps
    columns of ``docs`` to the names under which they come along.
    """
    carry = carry or {}
    if not 16 <= length <= 79:
        raise ValueError("length must lie between 16 and 79")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       *[F.col(f"`{old}`").alias(new) for old, new in carry.items()])
    sums = rows.select("doc_id", F.sha2("text", 256).alias("sha"), F.xxhash64("text", F.length("text")).alias("whole")).where(F.col("doc_id").isNotNull())
    least = sums.groupBy("sha").agg(F.min("doc_id").alias("first"))
    first = sums.join(least, "sha").groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("whole", "first"))).alias("firsts"))
    # All three uses of the texts keep the same columns and rows, so that one exchange serves them: copies and
    # documents without candidates are left in Python.
    known = _documents(rows, first)
    hot, about = sampled_anchors(rows, length)
    # buckets of a bounded number of anchors, and some for each task, so that these are even; every task makes a row for each
    buckets = max(3 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-about // BUCKET_ANCHORS))

    def originals(part):
        return part.filter(pc.fill_null(pc.equal(part.column("doc_id"), part.column("first")), False))

    def codes(name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and 32-bit code of anchors. Two that share both by chance only make a candidate more."""
        mixed = mix(name)
        return (mixed & np.uint64(2 ** 32 - 1)) % np.uint64(buckets), (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def seen(batches):
        """The anchors of the originals by bucket: their codes and documents."""
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def dealt():
            name, doc = (np.concatenate(x) for x in zip(*held))
            often = among(name, hot)
            if often.any():  # not dealt; two rows under a name of its own keep the document in
                own = np.unique(doc[often])
                name = np.concatenate([name[~often], mix(own.view(np.uint64)), mix(own.view(np.uint64))])
                doc = np.concatenate([doc[~often], own, ~own])
            bucket, code = codes(name)
            order = np.argsort(bucket.astype(np.int16 if buckets < 2 ** 15 else np.int64), kind="stable")
            count = np.bincount(bucket.astype(np.int64), minlength=buckets)
            on = np.flatnonzero(count)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count[on])]).astype(np.int32))
            return pa.RecordBatch.from_arrays([pa.array(on), pa.ListArray.from_arrays(offsets, pa.array(code[order])),
                                               pa.ListArray.from_arrays(offsets, pa.array(doc[order]))], ["bucket", "codes", "docs"])

        for batch in batches:
            for part in slices(originals(batch), limit=SLICE):
                found = anchors([t.encode() for t in part.column("text").to_pylist()], length, False)
                held.append((found.name, part.column("doc_id").to_numpy()[found.doc]))
                if sum(len(name) for name, _ in held) >= HELD_ANCHORS:
                    yield dealt()
                    held = []
        if held:
            yield dealt()

    def repeated(bucket):
        """The codes that several documents of a bucket have, by document."""
        code, doc = (pc.list_flatten(bucket.column(c).combine_chunks()).to_numpy() for c in ("codes", "docs"))
        order = np.argsort(code)
        code, doc = code[order], doc[order]
        first = np.concatenate([[True], code[1:] != code[:-1]])[:len(code)]
        runs = np.flatnonzero(first)
        met = (np.minimum.reduceat(doc, runs) != np.maximum.reduceat(doc, runs))[np.cumsum(first) - 1] if len(code) else first
        code, doc = code[met], doc[met]
        order = np.argsort(doc)
        code, doc = code[order], doc[order]
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])[:len(doc)])
        offsets = pa.array(np.append(edge, len(doc)).astype(np.int32))
        return pa.table({"doc_id": pa.array(doc[edge]), "codes": pa.ListArray.from_arrays(offsets, pa.array(code))})

    dealt = known.mapInArrow(seen, "bucket long, codes array<int>, docs array<long>").groupBy("bucket")
    wanted = dealt.applyInArrow(repeated, "doc_id long, codes array<int>").groupBy("doc_id").agg(F.flatten(F.collect_list("codes")).alias("wanted"))

    def contexts(batches):
        for batch in batches:
            batch = originals(batch)
            for part in slices(batch.filter(pc.is_valid(batch.column("wanted"))), limit=SLICE):
                coded = [t.encode() for t in part.column("text").to_pylist()]
                found = anchors(coded, length)
                often, lists = among(found.name, hot), part.column("wanted")
                asked = (pc.list_parent_indices(lists).to_numpy().astype(np.int64) << 32) + pc.list_flatten(lists).to_numpy().view(np.uint32)
                keep = often | among((found.doc << 32) + codes(found.name)[1].view(np.uint32), np.sort(asked))
                if not keep.any():
                    continue
                name, doc, low, high, start, place = (x[keep] for x in found)
                whole = b"".join(coded)
                yield pa.RecordBatch.from_arrays([
                    pa.array([whole[a:b] for a, b in zip((start + low).tolist(), (start + high + length).tolist())], pa.binary()),
                    pa.array((place - low).astype(np.int32)), pa.array(part.column("doc_id").to_numpy()[doc]),
                    pa.array((part.column("turn").to_numpy().astype(np.int64)[doc] << TURN_BITS) + low), pa.array(often[keep])],
                    ["context", "gram", "doc_id", "place", "hot"])

    def decided(batches):
        """Bit masks of the removed windows; rows are sorted by anchor and taken in batches of whole anchors."""
        held: list[pa.RecordBatch] = []

        def answer(table: pa.Table) -> pa.RecordBatch:
            docs_, names = table.column("doc_id").to_numpy(), table.column("anchor").to_numpy()
            coded = pc.dictionary_encode(table.column("context").combine_chunks())
            own, listed = coded.indices.to_numpy(), coded.dictionary
            least = np.full(len(listed), np.iinfo(np.int64).max)
            np.minimum.at(least, own, docs_)
            # an anchor with one context needs no sorting: the first document decides
            anchor_of = np.empty(len(listed), np.int64)
            anchor_of[own] = names
            _, back, count = np.unique(anchor_of, return_inverse=True, return_counts=True)
            sorted_ = count[back] > 1
            bytes_ = pc.binary_length(listed).to_numpy().astype(np.int64)
            size = bytes_ - length + 1
            masks = np.zeros(len(docs_), np.uint64)
            full = (np.uint64(1) << size[own].astype(np.uint64)) - np.uint64(1)
            simple = ~sorted_[own]
            masks[simple] = np.where(docs_ > least[own], full, np.uint64(0))[simple]
            rest = np.flatnonzero(~simple)
            if len(rest):
                text = np.frombuffer(b"".join(listed.filter(pa.array(sorted_)).to_pylist()), np.uint8)
                minima = window_minima(text, bytes_[sorted_], least[sorted_], length)
                starts = np.zeros(len(listed), np.int64)
                starts[sorted_] = np.cumsum(bytes_[sorted_]) - bytes_[sorted_]
                sizes = size[own[rest]]
                begin = np.cumsum(sizes) - sizes
                bit = np.arange(sizes.sum()) - np.repeat(begin, sizes)
                earlier = minima[np.repeat(starts[own[rest]], sizes) + bit] < np.repeat(docs_[rest], sizes)
                masks[rest] = np.bitwise_or.reduceat(earlier.astype(np.uint64) << bit.astype(np.uint64), begin)
            on = masks > 0
            return pa.RecordBatch.from_arrays([pa.array(docs_[on]), pa.array(table.column("place").to_numpy()[on]),
                                               pa.array(masks[on].view(np.int64))], ["doc_id", "place", "mask"])

        size = 0
        for batch in batches:
            batch = batch.filter(pc.invert(batch.column("hot")))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("context").nbytes
            if size < BATCH_SYMBOLS:
                continue
            table = pa.Table.from_batches(held)
            names = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(names, names[-1]))
            if cut:
                yield answer(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(b.column("context").nbytes for b in held) if cut else 0  # one anchor fills all: wait for as much again
        if held:
            yield answer(pa.Table.from_batches(held))

    met = known.join(wanted, "doc_id", "left").select(*known.columns, "wanted").mapInArrow(
        contexts, "context binary, gram int, doc_id long, place long, hot boolean")
    anchor = F.xxhash64(F.substring("context", F.col("gram") + 1, F.lit(gram_size(length))))  # told by the context, so not shuffled
    spread = met.repartition(deal_key(anchor))  # one exchange for both ways, so each takes its rows in Python
    masks = spread.withColumn("anchor", anchor).sortWithinPartitions("anchor").mapInArrow(decided, "doc_id long, place long, mask long")

    def often_met(batches):
        for batch in batches:
            yield batch.filter(batch.column("hot")).select(["context", "doc_id", "place"])

    if len(hot):
        masks = masks.unionByName(spread_masks(spread.mapInArrow(often_met, "context binary, doc_id long, place long"), length))
    gone = masks.groupBy("doc_id").agg(F.collect_list(F.struct("place", "mask")).alias("gone"))

    held = [(name, {"kept": pa.binary(), "kept_text": pa.string()}[name]) for name in texts]
    taken = list(carry.values())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), *held])

    def cut_out(batches):
        for batch in batches:
            for part in slices(batch):
                out, lists = [], part.column("gone")
                columns = [part.column(c).to_pylist() for c in ("doc_id", "turn", "first", "text")]
                for i, (doc, turn, first_, text) in enumerate(zip(*columns)):
                    data = np.frombuffer(text.encode(), np.uint8)
                    removed = np.zeros(len(data), bool)
                    if doc is not None and first_ is not None and first_ < doc:
                        removed[:] = len(data) >= length
                    elif lists[i].is_valid:
                        pairs = lists[i].values
                        place, mask = pairs.field("place").to_numpy(), pairs.field("mask").to_numpy().view(np.uint64)
                        mine = (place >> TURN_BITS) == turn
                        place, mask = place[mine] & (2 ** TURN_BITS - 1), mask[mine]
                        row, t = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                        at = place[row] + t
                        change = np.bincount(at, minlength=len(data) + length + 1) - np.bincount(at + length, minlength=len(data) + length + 1)
                        removed = np.cumsum(change)[:len(data)] > 0
                    kept = data[~removed].tobytes()
                    spans = int(removed[:1].sum() + (removed[1:] & ~removed[:-1]).sum())
                    out.append({"doc_id": doc, "n_bytes": len(data), "n_removed": int(removed.sum()), "n_spans": spans,
                                "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept,
                                "kept_text": kept.decode("utf-8", "ignore") if texts else ""})
                made = pa.RecordBatch.from_pylist(out, schema=schema)
                yield pa.RecordBatch.from_arrays([*made.columns, *(part.column(c) for c in taken)], [*schema.names, *taken])

    made_fields = T._parse_datatype_string("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(
        {"kept": ", kept binary", "kept_text": ", kept_text string"}[name] for name in texts))
    carried = [known.schema[c] for c in taken]
    return known.join(gone, "doc_id", "left").select(*known.columns, "gone").mapInArrow(cut_out, T.StructType([*made_fields.fields, *carried]))
