"""Vector best-fit packing of document pieces into sequences.

A bin has three capacities: tokens, documents and attention cost (the sum of
squared piece lengths). Pieces come in descending length; each goes to an open
bin where it fits under every constraint, chosen by the largest weighted dot
product of piece and residual ("dot") or the smallest weighted norm of what is
left ("norm"). Only a piece that fits nowhere opens a bin.

Pieces are dealt by a hash into groups of about ``group_pieces``, and each
group is packed by one task, so no task or group grows with the corpus. Each
group leaves at most a few bins half empty; those are packed once more in a
second round over groups of the same size.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlab.llm.common import map_texts
from incidentlab.llm.tokens import encoder
from incidentlab.session import shared_dir

PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(docs: DataFrame, file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The token pieces of every document: only longer ones are cut. NULL text is empty and gives the end id alone."""
    def make():
        coder, end = encoder(file), np.array([end_id], "<u4").tobytes()

        def work(ids, texts):
            out = {k: [] for k in ("doc_id", "row", "piece", "start", "length", "ids_crc32")}
            for doc, text in zip(ids, texts):
                coded, row = coder.ids(text) + end, zlib.crc32(text.encode())
                for k, a in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[a:a + 4 * capacity]
                    for name, v in zip(out, (doc, row, k, a // 4, len(part) // 4, zlib.crc32(part))):
                        out[name].append(v)
            return out
        return work

    return map_texts(docs, make, PIECES)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, cost: float, weights=(1.0, 0.0, 0.0),
             rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece. Lengths must descend; a piece alone may exceed the cost capacity, not the tokens."""
    full = np.array([tokens, documents, cost], float)
    scale = np.asarray(weights, float)
    left, used = np.empty((len(lengths), 3)), np.zeros(len(lengths), np.int64)
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    live = np.empty(0, np.int64)  # bins that still have room for some piece
    least = float(lengths.min()) if len(lengths) else 0.0
    for i, n in enumerate(lengths.tolist()):
        need = np.array([n, 1.0, float(n) * n])
        rest = left[live] - need
        fits = np.flatnonzero((rest >= 0).all(axis=1))
        if len(fits):
            share = rest[fits] / full
            score = ((share + need / full) * (need / full)) @ scale if rule == "dot" else -(share * share) @ scale
            b = live[fits[np.argmax(score)]]
        else:
            b, opened = opened, opened + 1
            left[b] = full
            live = np.append(live, b)
        bins[i], offsets[i] = b, used[b]
        left[b], used[b] = left[b] - need, used[b] + n
        if left[b, 0] < least or left[b, 1] < 1:
            live = live[live != b]
    return bins, offsets


def _packer(tokens, documents, cost, weights, rule, final, keep_fill):
    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "row", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit(frame["length"].to_numpy(), tokens, documents, cost, weights, rule)
        if not final:
            fill = np.bincount(bins, frame["length"].to_numpy())
            loose = fill[bins] < keep_fill * tokens
        else:
            loose = np.zeros(len(bins), bool)
        ids = int(key[0]) * (1 << 32) + bins + (1 << 62 if final else 0)
        frame["sequence_id"] = pd.Series(np.where(loose, -1, ids), index=frame.index, dtype="int64")
        frame["offset"] = pd.Series(offsets, index=frame.index, dtype="int64")
        return frame.drop(columns="group")
    return pack


def pack(parts: DataFrame, tokens: int = 2048, documents: int = 2048, cost: float | None = None,
         weights=(1.0, 0.0, 0.0), rule: str = "norm", group_pieces: int = 4096, keep_fill: float = 0.98) -> DataFrame:
    """Pieces with sequence_id and offset. Equal rows are packed like any others; ids are arbitrary numbers."""
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule}")
    cost = float(tokens) ** 2 if cost is None else float(cost)
    shared_dir(parts.sparkSession)
    parts = parts.checkpoint()  # read three times: counted, packed, repacked

    def round_of(rows: DataFrame, final: bool) -> DataFrame:
        groups = max(1, -(-rows.count() // group_pieces))
        keyed = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(groups)))
        packer = _packer(tokens, documents, cost, weights, rule, final, keep_fill)
        return keyed.groupBy("group").applyInPandas(packer, PACKED)

    first = round_of(parts, False).checkpoint()
    loose = first.where("sequence_id = -1").drop("sequence_id", "offset")
    return first.where("sequence_id <> -1").unionByName(round_of(loose, True))
