"""The corpus operators against libraries, brute force and held-out rows, and on odd input."""

from __future__ import annotations

import hashlib
import itertools
import zlib

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from incidentlab.llm import (best_fit, chat_format, dart_minhash, decontaminate, exact_topk, language_id, quality_cnn,
                             suffix_dedup, token_counts, token_files, tokens)
from incidentlab.llm.common import scratch, ship
from incidentlab.llm.queries import ORACLES, QUERIES
from incidentlab.llm.shingles import Shingler

WORD, BYTE, PIECE = (tokens.public_file(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, score string, class_id string, kept string"
ODD = ["", " ", "\n\n a  b\t\n\nc ", "a\tb \r\n x y", "don't we'll I'M 12,345.6 $$$!!", "<|endoftext|> x<|startoftext|>y", "naïve Ünï ß ﬁ é İI",
       "漢字 かな 한글 🙂🙂", "word " * 3000, "x" * 5000, "  lead", "trail  ", "a b\x1cc\x85d", "Don't\nstop.\nNow", "\x00nul\x7f"]


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship(spark)


@pytest.fixture(scope="module")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text or "") for r in documents.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, repeated rows, NULLs in every column, and columns whose names clash with results."""
    texts = [(i, t, "en", "s", 1, "a", "b", "c", "d") for i, t in enumerate(ODD)]
    return spark.createDataFrame([*texts, texts[4], texts[7], (90, None, None, None, None, None, None, None, None),
                                  (None, "a null id", None, None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def library_ids(file, text):
    if file.endswith(".model"):
        return tokens.encoder(file).model.encode(text)
    return tokens.encoder(file).tokenizer.encode(text, add_special_tokens=False).ids


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


# --- tokens ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("file", [WORD, BYTE])
def test_cached_ids_are_those_of_the_library(file, rows):
    for text in [*ODD, *(t for _, t in rows)]:
        assert np.frombuffer(tokens.encoder(file).ids(text), "<u4").tolist() == library_ids(file, text), text[:60]


def test_cache_forgets_and_stays_right(rows):
    coder = tokens.JsonEncoder(WORD)
    coder.words.limit = coder.parts.limit = 50
    for _, text in rows[:20]:
        assert np.frombuffer(coder.ids(text), "<u4").tolist() == library_ids(WORD, text)


@pytest.mark.parametrize("file", [WORD, BYTE, PIECE])
@pytest.mark.parametrize("chunk,overlap", [(300, 20), (700, 200), (64, 4)])
def test_overlapping_chunks_resynchronise(file, chunk, overlap, rows):
    coder = tokens.encoder(file)
    for text in ["a b  c\n\n\nd " * 200, "x" * 900, "word " * 300, " ".join(t for _, t in rows[:3])[:4000], "漢字かな" * 300]:
        assert token_counts.long_ids(coder, text, chunk, overlap).tolist() == library_ids(file, text)


def test_counts(odd, empty, documents, rows):
    got = by_id(token_counts.count_tokens(documents, WORD, chunk_chars=4000, overlap_chars=64))
    for doc, text in rows:
        n = len(library_ids(WORD, text))
        assert (got[doc].n_bytes, got[doc].n_tokens, got[doc].over_limit) == (len(text.encode()), n, n > 2048)
    assert token_counts.count_tokens(odd, WORD).count() == odd.count()
    assert by_id(token_counts.count_tokens(odd, WORD))[90].n_tokens == 0
    assert token_counts.count_tokens(empty, WORD).count() == 0


@pytest.mark.parametrize("width", [2, 4])
def test_token_files_round_trip(spark, documents, rows, odd, empty, width):
    def read(frame):
        folder = scratch(spark, "test-files")
        held = token_files.with_bases(spark, token_files.write_shards(frame, folder, BYTE, 2, width, shards=3))
        return token_files.read_shards(held, folder, doc_rows=7)

    got, start = by_id(read(documents)), 0
    for doc, text in sorted(rows):
        ids = np.array([*library_ids(BYTE, text), 2], "<u4")
        assert tuple(got[doc]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert read(odd).count() == odd.count()
    assert read(empty).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------


def test_packing_covers_every_piece(documents, rows, odd, empty):
    packed = best_fit.pack(best_fit.pieces(documents, WORD, 512), 512, group_pieces=100).collect()
    want = {}
    for doc, text in rows:
        ids = np.array([*library_ids(WORD, text), 0], "<u4")
        for k in range(0, len(ids), 512):
            want[doc, k // 512] = (k, len(ids[k:k + 512]), zlib.crc32(ids[k:k + 512].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in packed} == want and len(packed) == len(want)
    bins = {}
    for r in packed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        assert sorted(parts)[0][0] == 0 and sum(n for _, n in parts) <= 512
        assert all(a + n == b for (a, n), (b, _) in itertools.pairwise(sorted(parts)))
    least = -(-sum(r.length for r in packed) // 512)
    assert len(bins) <= least * 1.03 + 2
    assert best_fit.pack(best_fit.pieces(odd, WORD)).count() >= odd.count()
    assert best_fit.pack(best_fit.pieces(empty, WORD)).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.sort(np.random.default_rng(1).integers(1, 100, 300))[::-1]
    bins, offsets = best_fit.best_fit(lengths, 100, 5, 6000.0, (1.0, 0.5, 0.5), rule)
    for b in set(bins.tolist()):
        held = lengths[bins == b]
        assert held.sum() <= 100 and len(held) <= 5 and ((held ** 2).sum() <= 6000 or len(held) == 1)


# --- chat -----------------------------------------------------------------------------------------------------------


def test_chat_digests_are_those_of_the_rows(spark, data):
    turns = {}
    for r in spark.read.parquet(f"{data}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    hard = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", hard), (1, "assistant", hard)]
    got = {r.conv_id: r for r in QUERIES["op3_chat_formatting"](spark, data).collect()}
    assert got.keys() == turns.keys()
    for conv, held in turns.items():
        held.sort()
        lost = "".join(t for _, role, t in held if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for _, role, text in held)
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(held), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(lost), hashlib.sha256(lost.encode()).hexdigest())


@pytest.mark.parametrize("text", ["", "\\", "\\\\<", "<|turn|>a<|body|>b<|end|>", "<s>[INST] x [/INST]</s>", "<\\s>", "<<SYS>><|image|>\\"])
def test_escapes_turn_back_and_hide_controls(text):
    coded = chat_format.escape(text)
    assert chat_format.unescape(coded) == text
    assert not any(c in coded for c in chat_format.CONTROLS)
    assert chat_format.read_turns(chat_format.TURN + chat_format.escape(text) + chat_format.BODY + coded + chat_format.END) == [(text, text)]


def test_visitor_places_attachments():
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 28, "height": 15}, None,
             {"type": "audio", "ref": "b.wav", "seconds": 2.0}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": None, "text": None}]
    body, found = chat_format.PartVisitor().flatten(parts)
    assert body == "see <|image|><|audio|><|document|>"
    assert [(a["ref"], a["tokens"], body[a["at"]:].startswith(chat_format.PLACEHOLDERS[a["type"]])) for a in found] == [
        ("a.png", 4, True), ("b.wav", 50, True), ("c.pdf", 768, True)]
    with pytest.raises(ValueError):
        chat_format.PartVisitor().flatten([{"type": "video"}])


@pytest.mark.parametrize("control", [*chat_format.CONTROLS, "\\\\", "\\"])
def test_control_strings_split_over_text_parts(control):
    """Cut at every place, with and without an attachment in the cut, beside texts that spell a placeholder."""
    for cut in range(len(control) + 1):
        texts = [f"a{control[:cut]}", f"{control[cut:]}b <|image|>"]
        parts = [{"type": "text", "text": t} for t in texts]
        body, _ = chat_format.PartVisitor().flatten(parts)
        turn = chat_format.TURN + "user" + chat_format.BODY + body + chat_format.END
        assert chat_format.read_turns(turn) == [("user", "".join(texts))]
        assert chat_format.read_parts(turn) == [("user", [("text", "".join(texts))])]
        body, found = chat_format.PartVisitor().flatten([parts[0], {"type": "image", "ref": "i"}, parts[1], None])
        turn = chat_format.TURN + "user" + chat_format.BODY + body + chat_format.END
        assert chat_format.read_parts(turn) == [("user", [("text", texts[0]), ("image", "<|image|>"), ("text", texts[1])])]
        assert body[found[0]["at"]:].startswith("<|image|>")


def test_chat_of_odd_rows(spark):
    rows = [(1, 1, None, None), (1, 0, "assistant", "é"), (1, 0, "assistant", "é"), (None, None, "user", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r.conv_id: r for r in chat_format.conversation_digest(chat_format.format_turns(chat_format.text_parts(frame))).collect()}
    assert (out[1].n_turns, out[1].loss_chars, out[None].n_turns) == (3, 2, 1)
    assert chat_format.conversation_digest(chat_format.format_turns(chat_format.text_parts(frame.limit(0)))).count() == 0


# --- top-k ----------------------------------------------------------------------------------------------------------


def test_topk_equals_sql(spark, data):
    from tools.check import compare, connect
    ours = QUERIES["op6_exact_topk"](spark, data).toPandas()
    assert compare(ours, connect(data).execute(ORACLES["op6_exact_topk"]).df()) is None


def test_topk_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (20, [0.0, 0.0]),
            (7, [0.5]), (0, [2.0, 2.0])]
    frame = exact_topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("weights", F.lit("clash")))
    got = exact_topk.top_k(frame, F.col("vec_id") % 20 == 0, 3, block_rows=2, query_rows=1)
    hits = [(r.query_id, r["rank"], r.vec_id, r.score) for r in got.where("query_id = 20").orderBy("rank").collect()]
    assert hits == [(20, 1, 0, 0), (20, 2, 0, 0), (20, 3, 1, 0)]
    assert exact_topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# --- duplicates -----------------------------------------------------------------------------------------------------


def brute_classes(rows, similarity=0.8):
    sets = [(d, set(Shingler().all(t).tolist())) for d, t in sorted(rows)]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and min(len(x), len(y)) >= similarity * max(len(x), len(y)) and len(x & y) >= similarity * len(x | y) - 1e-9:
            one, two = sorted((find(a), find(b)))
            root[two] = one
    return {d: find(d) for d in root}


def test_near_duplicates_equal_brute_force(spark, documents, rows):
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(documents).collect()}
    assert got == brute_classes(rows)


def test_chained_copies_and_hot_groups(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[i:i + 45])) for i in range(16)]  # neighbours are similar, ends are not
    rows += [(100 + i, "the same words again and again in this row") for i in range(30)] + [(200, ""), (201, ""), (202, "two words"), (203, "Two  words")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(frame).collect()} == brute_classes(rows)


def test_near_duplicates_of_odd_rows(odd, empty):
    got = [r.doc_id for r in dart_minhash.near_duplicates(odd).collect()]
    assert sorted(x for x in got if x is not None) == [*range(len(ODD)), 90]
    assert dart_minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("weights", [(1, 1), (3, 1)])
def test_dart_signatures_agree_as_often_as_sets(weights):
    draw = np.random.default_rng(0)
    a, b = np.arange(300, dtype=np.uint64), np.arange(100, 400, dtype=np.uint64)
    wa, wb = draw.integers(1, weights[0] + 1, 300).astype(float), draw.integers(1, weights[0] + 1, 300).astype(float)
    x, y = dict(zip(a.tolist(), wa)), dict(zip(b.tolist(), wb))
    keys = x.keys() | y.keys()
    want = sum(min(x.get(k, 0), y.get(k, 0)) for k in keys) / sum(max(x.get(k, 0), y.get(k, 0)) for k in keys)
    signs = dart_minhash.dart_minhash(np.concatenate([a, b]), np.concatenate([wa, wb]), np.repeat([0, 1], 300), 2, 2048)
    assert abs((signs[0] == signs[1]).mean() - want) < 0.04
    alone = dart_minhash.dart_minhash(a, wa, np.zeros(300, np.int64), 1, 2048)
    assert (alone[0] == signs[0]).all()  # a signature does not depend on its neighbours


def brute_repeats(rows, length=50):
    least = {}
    coded = [(d, t.encode()) for d, t in rows]
    for d, b in coded:
        for i in range(len(b) - length + 1):
            least[b[i:i + length]] = min(least.get(b[i:i + length], d), d)
    out = {}
    for d, b in coded:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if least[b[i:i + length]] < d:
                gone[i:i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[d] = (len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def repeats(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame).collect()}


def test_suffix_dedup_equals_brute_force(documents, rows):
    assert repeats(documents) == brute_repeats(rows)


def test_suffix_dedup_of_periods_copies_and_edges(spark):
    passage = "".join(chr(97 + i * i * 7 % 26) for i in range(60))
    rows = [(5, passage[:50]), (3, "x" + passage[:49] + "y"), (9, passage + "é" * 40), (12, "a" * 200), (11, "ab" * 80), (2, "aba" * 40), (14, "a" * 49),
            (15, "b" * 30 + "a" * 120), (20, passage + "é" * 40), (21, "é" * 40 + passage), (22, ""), (23, "éa" * 60), (24, "a" * 200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    assert repeats(frame) == brute_repeats(rows)


def test_suffix_dedup_of_odd_rows(odd, empty):
    assert suffix_dedup.remove_repeats(odd).count() == odd.count()
    assert repeats(odd)[90][:3] == (0, 0, 0)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("symbols", [1, 2, 4, 200])
def test_suffix_order(symbols):
    draw = np.random.default_rng(symbols)
    for n in [*range(12), 31, 32, 33, 300]:
        text = draw.integers(1, symbols + 1, n)
        assert suffix_dedup.suffix_order(text).tolist() == sorted(range(n), key=lambda i: text[i:].tolist())


# --- decontamination ------------------------------------------------------------------------------------------------


def brute_leaks(docs, items, threshold=0.8):
    shingler = Shingler(short=False)
    sets = [(i, set(shingler.all(t).tolist())) for i, t in items]
    out = {}
    for d, t in docs:
        own = set(shingler.all(t).tolist())
        for i, s in sets:
            if s and len(s & own) >= threshold * len(s):
                out[d, i] = (len(s), len(s & own))
    return out


def leaks(docs, items):
    return {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontaminate.contaminated(docs, items).collect()}


def test_leaks_equal_brute_force(spark, data, documents, rows):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    assert leaks(documents, items) == brute_leaks(rows, [(r.item_id, r.text) for r in items.collect()])


def test_short_items_in_long_documents(spark, odd, empty):
    words = [f"v{i * i % 997}" for i in range(8000)]
    items = [(n, " ".join(words[100 * n:100 * n + n])) for n in range(3, 70)] + [(90, None), (91, "")]
    docs = [(1, " ".join(words)), (2, " ".join(words[::-1])), (3, None), (4, " ".join(words[900:1000]).upper())]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert leaks(*frames) == brute_leaks([(d, t or "") for d, t in docs], [(i, t or "") for i, t in items])
    assert leaks(odd.withColumn("item_id", F.lit(1)), frames[1]) == {} and leaks(empty, frames[1]) == {} and leaks(frames[0], frames[1].limit(0)) == {}


# --- trained models -------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("make", ["gru", "cnn"])
def test_gradients_equal_differences(make):
    if make == "gru":
        model = language_id.BiGru(3, hidden=4, width=3)
        batch = (*language_id.packed([b" abc", b" x", b" hello"]), np.array([0, 1, 2]))
    else:
        model = quality_cnn.ByteCnn(4, 3, 3)
        batch = ([b"hello world " * 9, b"xx!!", b"abcd efgh" * 30], np.array([1.0, 0, 1]))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, grads = model.gradients(*batch)
    for name, held in model.p.items():
        at = (ord("l"), 1) if name == "embed" else tuple(s // 2 for s in held.shape)
        old, e = held[at], 1e-4
        held[at] = old + e
        up, _ = model.gradients(*batch)
        held[at] = old - e
        down, _ = model.gradients(*batch)
        held[at] = old
        assert abs((up - down) / 2 / e - grads[name][at]) < 1e-4, name


def test_language_of_held_out_rows(spark, data):
    got = QUERIES["op10_language_id"](spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    found = got.where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got.collect())


def test_language_of_odd_rows(odd, documents, empty):
    model = language_id.fit(documents, words_per_language=500, epochs=1)
    got = language_id.identify(odd, model).collect()
    assert len(got) == odd.count() and set(odd.columns) <= set(got[0].asDict())
    named = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert named[90] == named[0] == named[2 - 1] == ("und", 0.0)
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.identify(odd, nothing).collect()} == {"und"}
    assert len(model.label_positions("Das Haus")) == len(" das haus")


def test_quality_of_held_out_rows(spark):
    data = "/root/testdata/sf0.01"
    got = QUERIES["op4_quality_classifier"](spark, data).where("held_out")
    found = got.join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert sum(r.quality == r.predicted for r in found) >= 0.9 * len(found)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    assert {r.predicted for r in found} == {0, 1}
    ones, zeros = ([r.score for r in found if r.quality == q] for q in (1, 0))
    assert sum((a > b) + (a == b) / 2 for a in ones for b in zeros) >= 0.9 * len(ones) * len(zeros)


def test_blocked_scores_equal_a_plain_forward_pass():
    """Every filter at every place, chunk by chunk, without blocks or shared work."""
    network, texts = quality_cnn.ByteCnn(5, 3, 4, seed=9), [b"", b"short", bytes(range(256)) * 3, b"abc d" * 400]
    for text, score in zip(texts, network.scores(texts, block=1 << 9)):
        halves = max(2, -(-(len(text) + quality_cnn.STEP) // quality_cnn.SPAN))
        codes = text.ljust(halves * quality_cnn.SPAN, b"\0")
        step, outs = quality_cnn.STEP, []
        filters = np.concatenate([network.p["now"], network.p["next"]])
        for at in range(0, len(codes) - step, step):
            window = np.concatenate([network.p["embed"][c] for c in codes[at:at + 2 * step]])
            outs.append(np.maximum(window @ filters + network.p["bias"], 0))
        half = quality_cnn.HALF
        chunks = [np.max(outs[k * half:(k + 2) * half], axis=0) for k in range(halves - 1)]
        both = np.concatenate([np.mean(chunks, axis=0), np.max(chunks, axis=0)])
        hidden = np.tanh(both @ network.p["join"] + network.p["join_b"])
        assert abs(score - 1 / (1 + np.exp(-(hidden @ network.p["out"] + network.p["out_b"])[0]))) < 1e-5


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(0, None), (1, 1)], "doc_id long, quality int")
    nothing = quality_cnn.fit(odd, labels)
    assert {r.score for r in quality_cnn.score(odd, nothing).collect()} == {0.5}
    model = quality_cnn.QualityModel(quality_cnn.ByteCnn())
    assert quality_cnn.score(odd, model).count() == odd.count() and quality_cnn.score(empty, model).count() == 0
    texts = ["", "a", "b" * 500, "c!" * 40]
    alone = [model.predict([t])["score"][0] for t in texts]
    assert np.allclose(model.predict(texts)["score"], alone, atol=1e-6)  # no text sees its neighbour


# --- pipeline -------------------------------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark, data, documents):
    docs, columns = documents, documents.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        out = stage(spark, docs, data)
        assert out.columns == columns
        path = f"{scratch(spark, 'test-stage')}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        after = dict((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
        if name == "near_dedup":
            assert after.keys() == set(brute_classes(before).values())
        if name == "suffix_dedup":
            want = brute_repeats(before)
            assert all(after[d] == t for d, t in before if want[d][1] == 0)
            assert all(len(after[d].encode()) <= want[d][0] - want[d][1] for d in after)
        if name == "decontamination":
            assert after.keys() == dict(before).keys() - {d for d, _ in brute_leaks(before, items)}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in docs.collect()}


def test_pipeline_of_odd_rows(spark, odd, data):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch(spark, "test-odd")
        stage(spark, docs, data).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() >= docs.count()
