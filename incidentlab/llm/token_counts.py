"""Token counts of whole texts, however long: overlap resynchronisation.

A text longer than ``chunk_chars`` is encoded in overlapping chunks with
offsets. Two neighbours are joined at a boundary proven stable: a character
behind white space at which both have a token start, and from which their
tokens agree up to the next white space. If the overlap holds no such place,
it is doubled, in the end up to the end of the text. Shorter texts are encoded
in one piece. Counts equal those of the library on the whole text.

Rows with NULL text count as empty (0 tokens); repeated rows each give a row;
other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from incidentlab.llm.common import map_texts
from incidentlab.llm.tokens import encoder

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def splice(text: str, start: int, end: int, left: tuple, right: tuple) -> tuple[int, int] | None:
    """Where the chunks that share text[start:end] join: tokens kept of the left, tokens skipped of the right."""
    (left_ids, left_at), (right_ids, right_at) = left, right
    both = np.intersect1d(left_at[left_at > start], right_at[right_at > start])
    stops = [i for i in range(start, end) if text[i].isspace()]
    if len(stops) < 2:
        return None
    for place in both[(both > stops[0]) & (both <= stops[-1])]:
        if text[place - 1].isspace() == text[place].isspace():
            continue  # not an edge of white space
        until = next((s for s in stops if s > place), None)
        if until is None:
            return None
        a, b = int(np.searchsorted(left_at, place)), int(np.searchsorted(right_at, place))
        one, two = left_ids[a:np.searchsorted(left_at, until)], right_ids[b:np.searchsorted(right_at, until)]
        if len(one) and np.array_equal(one, two):
            return a, b
    return None


def long_ids(coder, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
    """Ids of a huge text from overlapping chunks."""
    def coded(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        ids, at = coder.offsets(text[a:b])
        return ids, at + a

    end = min(len(text), chunk)
    kept, ids, at = [], *coded(0, end)
    while end < len(text):
        width, met = overlap, None
        while met is None and width < end:
            begin, reach = max(0, end - width), min(len(text), end - width + chunk + width)
            ids2, at2 = coded(begin, reach)
            met, width = splice(text, begin, end, (ids, at), (ids2, at2)), width * 2
        if met is None:  # no stable place at all: this chunk and the next become one
            begin = int(at[0]) if len(at) else 0
            end = min(len(text), max(end * 2, end + chunk))
            ids, at = coded(min(begin, end), end)
            continue
        kept.append(ids[:met[0]])
        ids, at, end = ids2[met[1]:], at2[met[1]:], reach
    return np.concatenate([*kept, ids])


def count_tokens(docs: DataFrame, file: str, limit: int = 2048, chunk_chars: int = CHUNK_CHARS,
                 overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every text."""
    def make():
        coder = encoder(file)

        def work(ids, texts):
            counts = [len(coder.ids(t)) // 4 if len(t) <= chunk_chars
                      else len(long_ids(coder, t, chunk_chars, overlap_chars)) for t in texts]
            return {"doc_id": ids, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": counts,
                    "over_limit": [n > limit for n in counts]}
        return work

    return map_texts(docs, make, SCHEMA)
