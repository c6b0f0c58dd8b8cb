"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads the bytes of each word (a space, then the word in lower
case, without stops and commas; longer words go in pieces of ``WORD_BYTES``) in both directions, labels
every byte position, and starts anew at the next word. A word's vote is the
mean log probability over its positions, a document's probabilities are the
softmax of the summed votes of all its words. Since a word's votes depend on
its bytes alone, a task computes each distinct word once and remembers it.

Training is plain numpy on the driver: backpropagation through time with Adam
on a bounded sample of labelled rows (``docs_per_language`` documents, of each
at most ``SAMPLE_CHARS`` characters from a drawn place, ``words_per_language``
words). Prediction reads whole texts and nothing but texts.

A NULL text, or one without a letter, is "und" with score 0. Repeated rows
each get a row. Without any labelled row there is nothing to learn: every text
is "und".
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlab.llm.common import append_columns, bounded_sample, fold, window_of

UND = "und"
WORD_BYTES = 24
SAMPLE_CHARS = 20_000
CACHE_WORDS = 500_000
LETTER = re.compile(r"[^\W\d_]")


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


class BiGru:
    """Parameters, forward pass and backpropagation of one bidirectional GRU with a label at every position."""

    def __init__(self, classes: int, hidden: int = 16, width: int = 12, seed: int = 5):
        draw = np.random.default_rng(seed)

        def normal(*shape):
            return (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.hidden = hidden
        self.p = {"embed": draw.standard_normal((256, width)).astype(np.float32) * 0.5,
                  "out": normal(2 * hidden, classes), "out_b": np.zeros(classes, np.float32)}
        for way in "fb":
            self.p |= {f"x{way}": normal(width, 3 * hidden), f"h{way}": normal(hidden, 3 * hidden),
                       f"b{way}": np.zeros(3 * hidden, np.float32)}

    def _run(self, way: str, x: np.ndarray, on: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States [T, B, H] of one direction. ``on`` marks positions inside the words."""
        h_n, u = self.hidden, self.p[f"h{way}"]
        given = x @ self.p[f"x{way}"] + self.p[f"b{way}"]
        h, states, tape = np.zeros((x.shape[1], h_n), np.float32), np.empty((*x.shape[:2], h_n), np.float32), []
        for t in range(len(x)):
            fed = h @ u
            gates = _sigmoid(given[t, :, :2 * h_n] + fed[:, :2 * h_n])
            z, r = gates[:, :h_n], gates[:, h_n:]
            n = np.tanh(given[t, :, 2 * h_n:] + r * fed[:, 2 * h_n:])
            new = n + z * (h - n)
            if keep:
                tape.append((h, z, r, n, fed[:, 2 * h_n:]))
            h = np.where(on[t][:, None], new, h)
            states[t] = h
        return states, tape

    def _back(self, way: str, x: np.ndarray, on: np.ndarray, tape: list, d_states: np.ndarray, grads: dict) -> np.ndarray:
        """Backpropagation through time of one direction; returns the gradient of its inputs."""
        h_n, u = self.hidden, self.p[f"h{way}"]
        d_given, d_h = np.zeros((*x.shape[:2], 3 * h_n), np.float32), np.zeros((x.shape[1], h_n), np.float32)
        d_u = np.zeros_like(u)
        for t in range(len(x) - 1, -1, -1):
            h, z, r, n, fed_n = tape[t]
            d_new = (d_states[t] + d_h) * on[t][:, None]
            d_pass = (d_states[t] + d_h) * ~on[t][:, None]
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (h - n) * z * (1 - z)
            d_r = d_n * fed_n * r * (1 - r)
            d_fed = np.concatenate([d_z, d_r, d_n * r], axis=1)
            d_given[t] = np.concatenate([d_z, d_r, d_n], axis=1)
            d_u += h.T @ d_fed
            d_h = d_new * z + d_fed @ u.T + d_pass
        flat = d_given.reshape(-1, 3 * h_n)
        grads[f"h{way}"], grads[f"b{way}"] = d_u, flat.sum(axis=0)
        grads[f"x{way}"] = x.reshape(-1, x.shape[2]).T @ flat
        return d_given @ self.p[f"x{way}"].T

    @staticmethod
    def _turned(lengths: np.ndarray, steps: int) -> np.ndarray:
        """[T, B]: for each place of a reversed word the place it came from; padding stays."""
        t = np.arange(steps)[:, None]
        return np.where(t < lengths, lengths - 1 - t, t)

    def _forward(self, codes: np.ndarray, lengths: np.ndarray, keep: bool = False):
        on = np.arange(len(codes))[:, None] < lengths
        turn, cols = self._turned(lengths, len(codes)), np.arange(codes.shape[1])
        x = self.p["embed"][codes]
        ahead, tape_f = self._run("f", x, on, keep)
        behind, tape_b = self._run("b", x[turn, cols], on, keep)
        both = np.concatenate([ahead, behind[turn, cols]], axis=2)
        logits = both @ self.p["out"] + self.p["out_b"]
        logits -= logits.max(axis=2, keepdims=True)
        logp = logits - np.log(np.exp(logits).sum(axis=2, keepdims=True))
        return logp, on, (x, turn, cols, both, tape_f, tape_b)

    def positions(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Log probabilities [T, B, classes] of every position."""
        return self._forward(codes, lengths)[0]

    def votes(self, words: list[bytes]) -> np.ndarray:
        """Mean log probability over the positions of each word."""
        out = np.zeros((len(words), len(self.p["out_b"])), np.float32)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for a in range(0, len(order), 4096):
            some = order[a:a + 4096]
            codes, lengths = packed([words[i] for i in some])
            logp, on, _ = self._forward(codes, lengths)
            out[some] = (logp * on[:, :, None]).sum(axis=0) / np.maximum(lengths, 1)[:, None]
        return out

    def gradients(self, codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over all positions, and its gradients."""
        logp, on, (x, turn, cols, both, tape_f, tape_b) = self._forward(codes, lengths, keep=True)
        total, h_n = max(1, int(on.sum())), self.hidden
        d_logits = np.exp(logp)
        d_logits[:, np.arange(len(labels)), labels] -= 1
        d_logits *= on[:, :, None] / np.float32(total)
        grads = {"out": both.reshape(-1, 2 * h_n).T @ d_logits.reshape(-1, d_logits.shape[2]), "out_b": d_logits.sum(axis=(0, 1))}
        d_both = d_logits @ self.p["out"].T
        d_x = self._back("f", x, on, tape_f, d_both[:, :, :h_n], grads)
        d_turned = self._back("b", x[turn, cols], on, tape_b, d_both[turn, cols, h_n:], grads)
        d_x += d_turned[turn, cols]
        grads["embed"] = np.zeros_like(self.p["embed"])
        np.add.at(grads["embed"], codes[on], d_x[on])
        return float(-(logp[:, np.arange(len(labels)), labels] * on).sum() / total), grads


def packed(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Byte codes [T, B] and lengths of words."""
    lengths = np.array([len(w) for w in words], np.int64)
    steps = int(lengths.max(initial=1))
    flat = np.frombuffer(b"".join(w.ljust(steps, b"\0") for w in words), np.uint8)
    return np.ascontiguousarray(flat.reshape(len(words), steps).T).astype(np.int64), lengths


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; stops and commas separate like white space."""
    return text.lower().replace(".", " ").replace(",", " ").split()


def pieces(word: str) -> list[bytes]:
    coded = b" " + word.encode()
    return [coded[i:i + WORD_BYTES] for i in range(0, len(coded), WORD_BYTES)]


def adam(model, batches, rate: float = 0.01) -> None:
    """One Adam step for each (codes, lengths, labels) batch, the rate falling to a tenth."""
    m, v = ({k: np.zeros_like(x) for k, x in model.p.items()} for _ in range(2))
    batches = list(batches)
    for step, batch in enumerate(batches, 1):
        _, grads = model.gradients(*batch)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        now = rate * (1 - 0.9 * step / len(batches))
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            model.p[k] -= (now * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)


class LanguageModel:
    """A trained network with its languages."""

    def __init__(self, languages: list[str], network: BiGru | None):
        self.languages, self.network, self.cache = languages, network, {}

    def __getstate__(self):
        return {"languages": self.languages, "network": self.network, "cache": {}}

    def predict(self, texts: list[str]) -> dict[str, list]:
        split = [words_of(t) if LETTER.search(t) else [] for t in texts]
        if not self.languages:
            split = [[] for _ in texts]
        new = list(set().union(*split) - self.cache.keys()) if split else []
        if len(self.cache) + len(new) > CACHE_WORDS:
            self.cache.clear()
            new = list(set().union(*split))
        parts = [pieces(w) for w in new]
        flat = self.network.votes([p for some in parts for p in some]) if new else np.zeros((0, 1))
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        if new:
            self.cache.update(zip(new, np.add.reduceat(flat, starts)))
        names, scores = [], []
        for words in split:
            if not words:
                names.append(UND)
                scores.append(0.0)
                continue
            total = np.add.reduce(list(map(self.cache.__getitem__, words)), dtype=np.float64)
            share = np.exp(total - total.max())
            names.append(self.languages[int(share.argmax())])
            scores.append(float(share.max() / share.sum()))
        return {"lang_pred": names, "score": scores}

    def label_positions(self, text: str) -> list[str]:
        """The most likely language of every byte of the words, in order."""
        words = [p for w in words_of(text) for p in pieces(w)]
        if not words or not self.languages:
            return []
        codes, lengths = packed(words)
        named = self.network.positions(codes, lengths).argmax(axis=2)
        return [self.languages[named[t, b]] for b, n in enumerate(lengths) for t in range(n)]


def fit(labelled: DataFrame, docs_per_language: int = 300, words_per_language: int = 10_000, epochs: int = 2,
        batch: int = 512, hidden: int = 16, seed: int = 5) -> LanguageModel:
    """A model from (doc_id, text, lang) rows; rows without text or language are left out."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = bounded_sample(rows, "lang", docs_per_language)
    found = sample.select("lang", window_of(F.col("text"), SAMPLE_CHARS).alias("text")).collect()
    found.sort(key=lambda r: (r.lang, r.text))
    languages = sorted({r.lang for r in found})
    if not languages:
        return LanguageModel([], None)
    draw, words, labels = np.random.default_rng(seed), [], []
    for i, lang in enumerate(languages):
        all_words = [p for r in found if r.lang == lang for w in words_of(r.text) for p in pieces(w)]
        if all_words:
            words += [all_words[k] for k in draw.integers(0, len(all_words), words_per_language)]
            labels += [i] * words_per_language
    network, labels = BiGru(len(languages), hidden, seed=seed), np.array(labels)

    def batches():
        for _ in range(epochs):
            order = draw.permutation(len(words))
            for a in range(0, len(order), batch):
                some = order[a:a + batch]
                yield (*packed([words[i] for i in some]), labels[some])
    adam(network, batches())
    return LanguageModel(languages, network)


def identify(docs: DataFrame, model: LanguageModel, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The rows of ``docs`` with the predicted language and its score in columns of these names."""
    def make():
        return lambda texts: dict(zip(names, model.predict(texts).values()))

    return append_columns(docs, make, f"`{names[0]}` string, `{names[1]}` double")


def training_rows(docs: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    return docs.where(fold(F.col("doc_id"), parts) != held_out)
