"""Near-duplicate groups by DartMinHash over word shingles.

A document is a weighted set: its five-word shingles, each with weight 1
(``weighting="set"``) or with its count ("count"). Darts fall on the plane of
weight and rank of every element, the same for all documents, as a Poisson
process of rate 1; element regions double ([0, 1), [1, 2), [2, 4), ...). A
document owns the darts whose weight lies below its weight of the element. Each
dart belongs to one of ``k`` coordinates, and a coordinate keeps its dart of
smallest rank. Only darts of rank below t / |x| are thrown, t about k ln k; the
bound doubles for documents with coordinates left empty. Two documents agree in
a coordinate with the probability of their weighted Jaccard similarity.

``bands`` of ``rows`` coordinates are joined. At similarity 0.8 the chance that
no band agrees is (1 - 0.8^rows)^bands, below 1 in 10,000 at the defaults. What
meets is verified exactly on the shingle sets.

Equal sets are one class from the start. Each set carries its size and the
parities of its elements over ``PARITIES`` cells. Two sets differ in at least as
many elements as parities, so sizes and parities alone tell most pairs below
the similarity, without a loss and before a row is made; what passes is
verified on the sets themselves.

Within a bucket of a band no pairs of all members are made. First each set is
verified against the smallest set it meets anywhere that passes. Then the
members of a bucket have turns by a hash, spread over 0 to the bucket's size.
In each round those whose turns are up are pivots, and members of other
components with later turns that pass are verified against them; a bucket ends
when all its members are in one component or all turns are over. So every
meeting pair is either told apart, verified or already connected, and no link
between components is lost. Rounds start with few turns, since what they connect
need not be compared again, and go to 16 times as many each time, by ``PIVOTS``
at most; a bucket of up to 16 members ends with the first.

Crowded buckets, pivots and classes are spread over parts by a salt. Components
come from label propagation with pointer jumping over the components and links
of the round; nothing is gathered on the driver but counts. The plan is the
same for every size: what is asked for goes out as a bitmap of ``ASKED_BITS``
bits, so only rows that may be asked for are shuffled. The tables of a round are
removed when the next one has been written.

Texts without words are classes of their own. Texts of fewer than five words
have one shingle of all their words. NULL text is a text without words. Rows of
one id are one document (the shingles of all its rows).
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incidentlab.llm.common import remove, scratch, slices
from incidentlab.llm.shingles import Shingler, mix
from incidentlab.session import shared_dir

BANDS, ROWS = 20, 4
FIRST_TURNS, MORE_TURNS = 16, 16
PIVOTS = 4096
TURN_BITS = 40
PARITIES = 512
PART_ROWS = 512  # rows of a bucket, or partners of a pivot, in one part
SALTS = 8
ASKED_BITS = 2 ** 24  # a bitmap of 2 MB at most
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def dart_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, documents: int, k: int) -> np.ndarray:
    """Signatures [documents, k] of the weighted sets whose rows ``owner`` deals out; each must have a row.

    Rows of zero weight are allowed. The dart of smallest rank is named by a
    64-bit hash of its element, region and number.
    """
    total = np.bincount(owner, weights, documents)
    bound = (k * np.log(k) + 2 * k) / np.maximum(total, 1e-300)
    names = np.zeros((documents, k), np.uint64)
    open_ = np.arange(documents)
    while len(open_):
        ranks = np.full(documents * k, np.inf)
        found = np.zeros(documents * k, np.uint64)
        chosen = np.zeros(documents, bool)
        chosen[open_] = True
        at = np.flatnonzero(chosen[owner] & (weights > 0))
        top = max(0, int(np.ceil(np.log2(weights[at].max())))) if len(at) else -1
        for region in range(top + 1):
            low, high = (0.0, 1.0) if region == 0 else (2.0 ** (region - 1), 2.0 ** region)
            rows = at[weights[at] > low]
            rank, seed = np.zeros(len(rows)), mix(elements[rows] + np.array([region + 1], np.uint64) * _STEP)
            while len(rows):
                seed = mix(seed + _STEP)
                rank = rank - np.log(_uniform(seed)) / (high - low)
                live = rank < bound[owner[rows]]
                rows, rank, seed = rows[live], rank[live], seed[live]
                inside = low + (high - low) * _uniform(mix(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5))) < weights[rows]
                name = mix(seed ^ np.uint64(0x5851F42D4C957F2D))
                cell = (owner[rows] * k + (name % np.uint64(k)).astype(np.int64))[inside]
                r, n = rank[inside], name[inside]
                order = np.lexsort((n, r, cell))
                cell, r, n = cell[order], r[order], n[order]
                first = np.ones(len(cell), bool)
                first[1:] = cell[1:] != cell[:-1]
                cell, r, n = cell[first], r[first], n[first]
                better = r < ranks[cell]
                ranks[cell[better]], found[cell[better]] = r[better], n[better]
        full = np.isfinite(ranks.reshape(documents, k)).all(axis=1) & chosen
        names[full] = found.reshape(documents, k)[full]
        open_ = np.flatnonzero(chosen & ~full)
        bound[open_] *= 2
    return names


def _documents(docs: DataFrame, weighting: str) -> DataFrame:
    """(doc_id, text, more): one row for each id, with the texts of its other rows in ``more``. Ids of one row are not shuffled
    where no id repeats; rows without an id stay alone."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    once = texts.withColumn("more", F.lit(None).cast("array<string>"))
    repeated = texts.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id").checkpoint()
    if not repeated.limit(1).count():
        return once
    gathered = F.collect_set("text") if weighting == "set" else F.collect_list("text")  # equal texts add nothing to a set
    several = texts.join(repeated, "doc_id").groupBy("doc_id").agg(F.array_sort(gathered).alias("all")).select(
        "doc_id", F.col("all")[0].alias("text"), F.slice("all", F.lit(2), F.size("all") - 1).alias("more"))
    return once.join(repeated, "doc_id", "left_anti").unionByName(several)


def _shingles(shingler: Shingler, text: str, more: list[str] | None) -> np.ndarray:
    """The shingles of all texts of a document, with repeats; none runs from one text into the next."""
    return np.concatenate([shingler.all(t) for t in (text, *more)]) if more else shingler.all(text)


def _parities(elements: np.ndarray) -> np.ndarray:
    """Whether each of ``PARITIES`` cells holds an odd number of the elements, as 64-bit words."""
    cells = (mix(elements ^ _STEP) % np.uint64(PARITIES)).astype(np.int64)
    return np.packbits((np.bincount(cells, minlength=PARITIES) & 1).astype(np.uint8)).view(np.int64)


def _sketched(docs: DataFrame, bands: int, rows: int, weighting: str) -> DataFrame:
    """(doc_id, whole, size, parities, bands): the hash of the weighted set, its size and parities, and the band keys; no row
    for texts without words."""
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "more")
    schema = pa.schema([("doc_id", pa.int64()), ("whole", pa.int64()), ("size", pa.int32()), ("parities", pa.list_(pa.int64())),
                        ("bands", pa.list_(pa.int64()))])

    def listed(values: np.ndarray):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()),
                                        pa.array(values.ravel().view(np.int64)))

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            for part in slices(batch, limit=1_000_000):
                ids, wholes, sets, sizes, odd = [], [], [], [], []
                for doc, text, more in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "more"))):
                    elements, counts = np.unique(_shingles(shingler, text, more), return_counts=True)
                    if len(elements):
                        if weighting == "set":
                            counts = np.ones(len(elements), np.int64)
                        single = _expanded(np.repeat(elements, counts), weighting)
                        ids.append(doc)
                        wholes.append(_whole(elements, counts))
                        sets.append((elements, counts))
                        sizes.append(len(single))
                        odd.append(_parities(single))
                if not ids:
                    continue
                owner = np.repeat(np.arange(len(sets)), [len(e) for e, _ in sets])
                signs = dart_minhash(np.concatenate([e for e, _ in sets]), np.concatenate([c for _, c in sets]).astype(float),
                                     owner, len(sets), bands * rows)
                keys = np.tile(np.arange(bands, dtype=np.uint64), (len(sets), 1))
                for r in range(rows):
                    keys = mix(keys * _STEP + signs[:, r::rows])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(wholes, pa.int64()), pa.array(sizes, pa.int32()),
                                                  listed(np.stack(odd)), listed(keys)], schema=schema)

    return texts.mapInArrow(run, "doc_id long, whole long, size int, parities array<long>, bands array<long>")


def _whole(elements: np.ndarray, counts: np.ndarray) -> int:
    import xxhash
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(elements.tobytes() + counts.astype("<i8").tobytes())).view(np.int64)))


def _expanded(found: np.ndarray, weighting: str) -> np.ndarray:
    """The elements of a set. With counts, the i-th repeat of a shingle is an element of its own, so the Jaccard similarity
    of these sets is the weighted one."""
    found = np.sort(found)
    if weighting == "set":
        return np.unique(found)
    first = np.searchsorted(found, found)
    return np.sort(mix(found + (np.arange(len(found)) - first).astype(np.uint64) * _STEP))


def _sets(docs: DataFrame, weighting: str) -> DataFrame:
    """(whole, hashes): the sets of the given documents."""
    texts = docs.select("whole", "text", "more")
    schema = pa.schema([("whole", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            for part in slices(batch):
                found = [_expanded(_shingles(shingler, t, m), weighting) for t, m in zip(part.column("text").to_pylist(), part.column("more").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("whole"), pa.ListArray.from_arrays(
                    pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate(found).view(np.int64)))], schema=schema)

    return texts.mapInArrow(run, "whole long, hashes array<long>")


def _written(rows: DataFrame, folder: str) -> DataFrame:
    """The rows from a table in the folder. With checkpoints in its place a late round took 39 s on 40 rows, with
    tables about 3 s; the likely cause, not isolated, is what a checkpoint keeps of the plan that made it."""
    path = f"{folder}/{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _asked_for(rows: DataFrame, key: str, asked: DataFrame) -> DataFrame:
    """The rows whose key may be among those of ``asked``, without a shuffle of the rows: a bitmap of ``ASKED_BITS`` bits at
    most is broadcast in pieces of 4 KB. Every row that is asked for stays."""
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(ASKED_BITS))

    bits = asked.groupBy(F.bitmap_bucket_number(place(key)).alias("__piece")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place(key))).alias("__bits"))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    kept = rows.withColumn("__piece", F.bitmap_bucket_number(place(key))).join(F.broadcast(bits), "__piece")
    return kept.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("__piece", "__bits")


def _spread_join(rows: DataFrame, small: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join of rows whose key may be hot with a table that has each key once: the rows of a key go to ``SALTS`` parts."""
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def _may_match(similarity: float):
    """Whether sizes and parities leave room for the similarity: sets at or above it differ in no more elements than this."""
    odd = sum((F.bit_count(F.col("parities")[i].bitwiseXOR(F.col("pivot_parities")[i])) for i in range(PARITIES // 64)), F.lit(0))
    room = (F.col("size") + F.col("pivot_size")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    return (F.abs(F.col("size") - F.col("pivot_size")) <= room) & (odd <= room)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) between the labels of pairs (whole, pivot, label, pivot_label, parts) of sets at or above the Jaccard
    similarity. A pivot's set is sent once to each part that has partners, a partner's set once for each of its pairs."""
    sets = _asked_for(sets, "whole", pairs.select("whole").unionByName(pairs.select(F.col("pivot").alias("whole"))))
    dealt = pairs.withColumn("part", _part())
    partners = dealt.join(sets, "whole")
    parts = dealt.groupBy(F.col("pivot").alias("whole")).agg(F.collect_set("part").alias("of"))
    pivots = parts.join(sets, "whole").select(F.col("whole").alias("pivot"), F.col("hashes").alias("pivot_hashes"), F.explode("of").alias("part"))
    common = F.size(F.array_intersect("hashes", "pivot_hashes"))
    joined = partners.join(pivots, ["pivot", "part"]).select("label", "pivot_label", common.alias("common"), (
        F.size("hashes") + F.size("pivot_hashes")).alias("both"))
    return joined.where(F.col("common") >= similarity * (F.col("both") - F.col("common")) - 1e-9).select(
        F.col("label").alias("a"), F.col("pivot_label").alias("b"))


def components(links: DataFrame, folder: str | None = None) -> DataFrame:
    """(node, label) of the nodes of links (a, b): label is the smallest node reachable. Distributed hooking and pointer jumping.

    Each round gives every node the smallest label around it, then follows the
    label's own label; the state is written to the folder (a fresh one of the
    shared folder) every round. The links are read every round, so they should
    be a table; repeated ones change nothing.
    """
    folder = folder or scratch(links.sparkSession, "components")
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
        links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    state = _written(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label")), folder)
    while True:
        around = _spread_join(both, state.select(F.col("node").alias("other"), "label"), "other", "node")
        seen = around.groupBy("node").agg(F.min("label").alias("near"))
        hooked = _written(state.join(seen, "node").select("node", F.least("label", "near").alias("next"), "label"), folder)
        targets = hooked.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        label = F.least("next", "jump")
        jumped = _written(_spread_join(hooked, targets, "next", "node").select(
            "node", label.alias("label"), (label != F.col("label")).alias("moved")), folder)
        state = jumped.select("node", "label")
        if not jumped.where("moved").limit(1).count():
            return state


def _relabelled(rows: DataFrame, moved: DataFrame) -> DataFrame:
    """The rows with the labels that theirs (label) have moved to (to); other labels stay."""
    return _spread_join(rows, moved, "label", "whole", "left").withColumn("label", F.coalesce("to", "label")).drop("to").select(rows.columns)


def _part():
    """The part of a crowded bucket that a set is dealt to."""
    return F.pmod(F.xxhash64("whole"), F.col("parts")).cast("int")


def _later():
    """Whether a member comes after a pivot, so that two pivots of a round meet once."""
    return (F.col("turn") > F.col("pivot_turn")) | ((F.col("turn") == F.col("pivot_turn")) & (F.col("whole") > F.col("pivot")))


def _met(members: DataFrame, pivots: DataFrame, similarity: float, further: Column) -> DataFrame:
    """The pairs (whole, pivot, label, pivot_label, parts) of members and pivots of their buckets that differ in their labels and
    may be similar. Every part of a bucket meets all its pivots."""
    dealt = members.withColumn("part", _part())
    sent = pivots.select(*[F.col(c).alias(f"pivot_{c}") for c in ("key", "label", "size", "parities", "turn")], F.col("whole").alias("pivot"),
                         F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("pivot_part"))
    return dealt.join(sent, (F.col("key") == F.col("pivot_key")) & (F.col("part") == F.col("pivot_part")) & (
        F.col("label") != F.col("pivot_label")) & further & _may_match(similarity)).select("whole", "pivot", "label", "pivot_label", "parts")


def _labels(buckets: DataFrame, asked: DataFrame, sets: DataFrame, similarity: float, folder: str) -> DataFrame:
    """(whole, label) of the sets that meet others in buckets (key, whole, size, parities, parts, turn). Tables of the rounds are
    kept in the folder no longer than they are read; that of the result stays."""
    spark, state = buckets.sparkSession, asked.select("whole", F.col("whole").alias("label"))
    left, done, turns, number, states = buckets.withColumn("label", F.col("whole")), 0, 0, 0, []
    while True:
        here = f"{folder}/{number}"
        if turns:
            pairs = _met(left, left.where(F.col("turn") < turns), similarity, _later()).groupBy("whole", "pivot", "label", "pivot_label").agg(
                F.max("parts").alias("parts"))
        else:
            smallest = left.groupBy("key").agg(F.min(F.struct("whole", "label", "size", "parities", "parts", "turn")).alias("p")).select("key", "p.*")
            pairs = _met(left, smallest, similarity, F.lit(True)).groupBy("whole", "label").agg(
                F.min("pivot").alias("pivot"), F.max("parts").alias("parts")).withColumn("pivot_label", F.col("pivot"))
        new = _written(_verified(_written(pairs, here), sets, similarity), here)
        if new.limit(1).count():
            moved = components(new, here).select(F.col("node").alias("label"), F.col("label").alias("to"))
            states.append(f"{folder}/labels-{number}")
            state, left = _written(_relabelled(state, moved), states[-1]), _relabelled(left, moved)
            for old in states[:-1]:
                remove(spark, old)
        done, turns, number = turns, min(MORE_TURNS * turns, turns + PIVOTS) or FIRST_TURNS, number + 1
        ahead = left.where(F.col("turn") >= done)
        split = ahead.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
        left = _written(_spread_join(ahead, split, "key", "whole"), f"{folder}/{number}")
        remove(spark, here)
        if not left.limit(1).count():
            remove(spark, f"{folder}/{number}")
            return state


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = BANDS, rows: int = ROWS, weighting: str = "set") -> DataFrame:
    """(doc_id, class_id): class_id is the smallest doc_id of the group, one row for each doc_id."""
    shared_dir(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    texts = _documents(docs, weighting)
    sketch = _sketched(texts, bands, rows, weighting).checkpoint()
    # one representative of each set; a band key holds its band
    sets = sketch.groupBy("whole").agg(F.min(F.struct("doc_id", "size", "parities", "bands")).alias("s")).select("whole", "s.*")
    met = sets.select("whole", "doc_id", "size", "parities", F.explode("bands").alias("key"))
    crowded = sets.select(F.explode("bands").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        "key", "n", F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    turn = F.pmod(F.xxhash64("key", "whole"), F.lit(2 ** TURN_BITS)) / F.lit(2.0 ** TURN_BITS) * F.col("n")
    folder = scratch(docs.sparkSession, "near-duplicates")
    buckets = _written(_spread_join(_asked_for(met, "key", crowded), crowded, "key", "whole").withColumn("turn", turn).drop("n"), f"{folder}/buckets")
    asked = buckets.groupBy("whole").agg(F.min("doc_id").alias("doc_id")).checkpoint()
    held = _written(_sets(_asked_for(texts, "doc_id", asked).join(asked, "doc_id"), weighting), f"{folder}/sets")
    state = _labels(buckets.drop("doc_id"), asked, held, similarity, folder)
    for name in ("buckets", "sets"):
        remove(docs.sparkSession, f"{folder}/{name}")
    named = _spread_join(sketch.select("doc_id", "whole"), state, "whole", "doc_id", "left").select(
        "doc_id", F.coalesce("label", "whole").alias("label"))
    first = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    found = _spread_join(named, first, "label", "doc_id", "left").select("doc_id", F.col("class_id").alias("found"))
    return ids.distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("found", "doc_id").alias("class_id"))
