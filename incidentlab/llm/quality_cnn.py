"""Quality of a text by a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of ``2 * STEP`` bytes slide over the text
in steps of ``STEP`` bytes. Filter outputs are max-pooled over chunks of
``2 * HALF`` filter places that overlap by half, together covering the whole
text. The means over all chunks and the maxima over all chunks of every filter
are combined by one hidden layer into one probability. The text is padded with
zero bytes to whole chunks; an empty text is one chunk of zeros.

Training runs on the driver, by Adam, on a bounded sample of labelled rows
(``docs_per_label`` documents, of each at most ``SAMPLE_CHARS`` characters from
a drawn place). Scores see whole texts and nothing but texts.

NULL text is scored as the empty text. A document with two labels counts with
each of them. Without labelled rows every score is 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlab.llm.common import append_columns, bounded_sample, fold, window_of
from incidentlab.llm.language_id import _sigmoid, adam

STEP = 4
HALF = 16
SPAN = STEP * HALF
SAMPLE_CHARS = 20_000


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one row of half chunks, and the number of half chunks of each text (2 at least).

    Each text ends in at least one step of zeros, whose filter place is not used: no place sees two texts.
    """
    halves = np.array([max(2, -(-(len(t) + STEP) // SPAN)) for t in texts], np.int64)
    flat = b"".join(t.ljust(int(n) * SPAN, b"\0") for t, n in zip(texts, halves))
    return np.frombuffer(flat, np.uint8), halves


class ByteCnn:
    """Parameters, forward pass and gradients."""

    def __init__(self, filters: int = 16, width: int = 4, hidden: int = 8, seed: int = 3):
        draw = np.random.default_rng(seed)

        def normal(*shape):
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.filters, self.width = filters, width
        self.p = {"embed": normal(256, width) * 8, "now": normal(STEP * width, filters), "next": normal(STEP * width, filters),
                  "bias": np.zeros(filters, np.float32), "join": normal(2 * filters, hidden), "join_b": np.zeros(hidden, np.float32),
                  "out": normal(hidden, 1), "out_b": np.zeros(1, np.float32)}

    def _places(self, codes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter outputs [halves, HALF, filters] and the embedded steps. ``last``: the half chunks that end a text."""
        steps = self.p["embed"][codes].reshape(-1, STEP * self.width)
        places = steps @ self.p["now"]
        places[:-1] += (steps @ self.p["next"])[1:]
        places = places.reshape(-1, HALF, self.filters)
        places[last, -1] = -1e30
        return places, steps

    def _combine(self, mean: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        both = np.concatenate([mean, top], axis=1)
        hidden = np.tanh(both @ self.p["join"] + self.p["join_b"])
        return _sigmoid(hidden @ self.p["out"] + self.p["out_b"])[:, 0], hidden, both

    @staticmethod
    def _chunks(pooled: np.ndarray, halves: np.ndarray):
        """Chunk maxima (two neighbouring half chunks of one text) and the first chunk of each text."""
        ends = np.cumsum(halves)
        inner = np.ones(len(pooled), bool)
        inner[ends - 1] = False
        at = np.flatnonzero(inner)
        return at, np.cumsum(halves - 1) - (halves - 1)

    def scores(self, texts: list[bytes], block: int = 1 << 18) -> np.ndarray:
        codes, halves = laid_out(texts)
        last, size = np.cumsum(halves) - 1, block // SPAN
        pooled = np.empty((len(codes) // SPAN, self.filters), np.float32)
        for a in range(0, len(pooled), size):  # one half chunk more is read for the last place of the block
            held = last[np.searchsorted(last, a):np.searchsorted(last, a + size)] - a
            places, _ = self._places(codes[a * SPAN:(a + size + 1) * SPAN], held)
            pooled[a:a + size] = places[:size].max(axis=1)
        pooled = np.maximum(pooled + self.p["bias"], 0)
        at, starts = self._chunks(pooled, halves)
        chunks = np.maximum(pooled[at], pooled[at + 1])
        mean = np.add.reduceat(chunks, starts) / (halves - 1)[:, None].astype(np.float32)
        return self._combine(mean, np.maximum.reduceat(chunks, starts))[0]

    def gradients(self, texts: list[bytes], labels: np.ndarray) -> tuple[float, dict]:
        codes, halves = laid_out(texts)
        places, steps = self._places(codes, np.cumsum(halves) - 1)
        best = places.argmax(axis=1)
        pooled = np.take_along_axis(places, best[:, None], axis=1)[:, 0] + self.p["bias"]
        active = np.maximum(pooled, 0)
        at, starts = self._chunks(active, halves)
        left = active[at] >= active[at + 1]
        chunks = np.maximum(active[at], active[at + 1])
        count = (halves - 1)[:, None].astype(np.float32)
        top = np.maximum.reduceat(chunks, starts)
        p, hidden, both = self._combine(np.add.reduceat(chunks, starts) / count, top)
        loss = -np.mean(np.log(np.where(labels > 0, p, 1 - p) + 1e-9))
        d_out = ((p - labels) / len(labels))[:, None].astype(np.float32)
        grads = {"out": hidden.T @ d_out, "out_b": d_out.sum(axis=0)}
        d_hidden = d_out @ self.p["out"].T * (1 - hidden * hidden)
        grads |= {"join": both.T @ d_hidden, "join_b": d_hidden.sum(axis=0)}
        d_both = d_hidden @ self.p["join"].T
        owner, f = np.repeat(np.arange(len(texts)), halves - 1), self.filters
        is_top = chunks == top[owner]
        ties = np.add.reduceat(is_top.astype(np.float32), starts)
        d_chunks = (d_both[:, :f] / count)[owner] + is_top * (d_both[:, f:] / ties)[owner]
        d_pooled = np.zeros_like(active)
        d_pooled[at] += d_chunks * left
        d_pooled[at + 1] += d_chunks * ~left
        d_pooled *= pooled > 0
        grads["bias"] = d_pooled.sum(axis=0)
        d_places = np.zeros((len(steps), f), np.float32)
        row = np.arange(len(active))[:, None] * HALF + best
        np.put_along_axis(d_places, row, d_pooled, axis=0)
        grads["now"], grads["next"] = steps.T @ d_places, steps[1:].T @ d_places[:-1]
        d_steps = d_places @ self.p["now"].T
        d_steps[1:] += d_places[:-1] @ self.p["next"].T
        d_bytes = d_steps.reshape(-1, self.width)
        grads["embed"] = np.stack([np.bincount(codes, d_bytes[:, i], 256) for i in range(self.width)], axis=1).astype(np.float32)
        return float(loss), grads


class QualityModel:
    """A trained network, or None where there was nothing to learn."""

    def __init__(self, network: ByteCnn | None, threshold: float = 0.3):
        self.network, self.threshold = network, threshold

    def predict(self, texts: list[str]) -> dict[str, list]:
        if self.network is None:
            scores = [0.5] * len(texts)
        else:
            scores = self.network.scores([t.encode() for t in texts]).astype(float).tolist() if texts else []
        return {"score": scores, "predicted": [int(s >= self.threshold) for s in scores]}


def fit(docs: DataFrame, labels: DataFrame, docs_per_label: int = 900, epochs: int = 12, batch: int = 32,
        parts: int = 5, held_out: int = 0, seed: int = 3, min_steps: int = 480) -> QualityModel:
    """Learns from labelled documents whose fold is not the held-out one: ``epochs`` times each, and over again where that is
    fewer than ``min_steps`` batches, since few steps only find the share of the labels."""
    known = labels.where(F.col("quality").isNotNull()).select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(fold(F.col("doc_id"), parts) != held_out)
    drawn = bounded_sample(known, "quality", docs_per_label)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    found = texts.join(F.broadcast(drawn), "doc_id").select("quality", window_of(F.col("text"), SAMPLE_CHARS).alias("text")).collect()
    found.sort(key=lambda r: (r.quality, r.text))
    if len({r.quality > 0 for r in found}) < 2:
        return QualityModel(None)
    network, draw = ByteCnn(seed=seed), np.random.default_rng(seed)
    coded, marks = [r.text.encode() for r in found], np.array([float(r.quality > 0) for r in found])

    def batches():
        for _ in range(max(epochs, -(-min_steps // -(-len(coded) // batch)))):
            order = draw.permutation(len(coded))
            for a in range(0, len(order), batch):
                some = order[a:a + batch]
                yield [coded[i] for i in some], marks[some]
    adam(network, batches())
    counts = known.agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.count(F.lit(1)).alias("n")).first()
    drawn_odds, odds = marks.sum() / (len(marks) - marks.sum()), counts.good / (counts.n - counts.good)
    network.p["out_b"] += np.float32(np.log(odds / drawn_odds))  # the sample has other shares than all labelled rows
    return QualityModel(network)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` with score and predicted."""
    return append_columns(docs, lambda: model.predict, "score double, predicted int")
