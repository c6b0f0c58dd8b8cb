"""Chat formatting of typed content parts, with a loss mask and a way back.

A message holds an array of parts. A visitor flattens them in order: text is
escaped, every image, audio or document part becomes one placeholder and is
recorded with its reference, place and expanded token count. A turn reads

    <|turn|>role<|body|>text<|end|>

Control strings inside texts and roles are broken by a backslash behind their
first character, and backslashes are doubled, so that the turn marks stay
unique and ``read_turns`` restores role and text exactly. The loss mask covers
the bodies of the trained roles.

Formatting is row by row and needs no shuffle. Only ``conversation_digest``
brings turns together: it sorts inside partitions and streams, so a
conversation of any length needs the memory of one turn.

NULL text, role or parts are empty, a NULL part type is text; unknown types
raise. Turns order by turn (NULL first), then by role and text, so ties and
repeated rows have one order and each counts as a turn.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentlab.llm.common import slices

# The marks of the template and the control strings of common chat templates.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROLS = (TURN, BODY, END, *PLACEHOLDERS.values(), "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
            "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROLS, key=len, reverse=True))) + r"|\\")
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.DOTALL)
_KINDS = {mark: kind for kind, mark in PLACEHOLDERS.items()}
_PLACED = re.compile("(" + "|".join(map(re.escape, _KINDS)) + ")")  # texts hold no bare placeholder

PART = "type string, text string, ref string, width int, height int, seconds double, pages int"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


class PartVisitor:
    """Flattens the parts of one message into text and attachment records."""

    def __init__(self, patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens

    def flatten(self, parts) -> tuple[str, list[dict]]:
        self.out, self.texts, self.length, self.attached = [], [], 0, []
        for part in parts or []:
            if part is not None:
                kind = part.get("type") or "text"
                visit = getattr(self, f"visit_{kind}", None)
                if visit is None:
                    raise ValueError(f"unknown part type {kind!r}")
                visit(part)
        self._close_text()
        return "".join(self.out), self.attached

    def _close_text(self) -> None:
        """Texts that follow each other are escaped as one: a control string may begin in one and end in the next."""
        self._add(escape("".join(self.texts)))
        self.texts.clear()

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def _attach(self, part, kind: str, tokens: int) -> None:
        self._close_text()
        self.attached.append({"ref": part.get("ref") or "", "type": kind, "at": self.length, "tokens": tokens})
        self._add(PLACEHOLDERS[kind])

    def visit_text(self, part) -> None:
        self.texts.append(part.get("text") or "")

    def visit_image(self, part) -> None:
        cells = [max(1, math.ceil((part.get(side) or 1) / self.patch)) for side in ("width", "height")]
        self._attach(part, "image", cells[0] * cells[1])

    def visit_audio(self, part) -> None:
        self._attach(part, "audio", max(1, math.ceil((part.get("seconds") or 0.0) * self.audio_rate)))

    def visit_document(self, part) -> None:
        self._attach(part, "document", max(1, part.get("pages") or 1) * self.page_tokens)


def text_parts(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as messages of one text part each."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text"), F.lit("")).alias("text"),
                    F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
                    F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"),
                    F.lit(None).cast("int").alias("pages"))
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit("")).alias("role"), F.array(part).alias("content"))


def format_turns(messages: DataFrame, trained_roles=("assistant",), visitor: PartVisitor | None = None) -> DataFrame:
    """(conv_id, turn, role, content array<part>) to one formatted turn a row.

    ``attachments.at`` counts characters from the start of the body;
    ``loss_start`` and ``loss_length`` lie in ``formatted`` (length 0: no loss).
    """
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                           F.coalesce("role", F.lit("")).alias("role"), "content")
    schema = "conv_id long, turn long, formatted string, loss_start int, loss_length int, " \
             "attachments array<struct<ref string, type string, at int, tokens int>>"
    arrow = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int32()),
                       ("loss_length", pa.int32()), ("attachments", pa.list_(pa.struct([
                           ("ref", pa.string()), ("type", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())])))])
    trained, walker = frozenset(trained_roles), visitor or PartVisitor()

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                body, attached = walker.flatten(row["content"])
                head = TURN + escape(row["role"]) + BODY
                out.append({"conv_id": row["conv_id"], "turn": row["turn"], "formatted": head + body + END,
                            "loss_start": len(head), "loss_length": len(body) if row["role"] in trained else 0,
                            "attachments": attached})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return rows.mapInArrow(run, schema)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted string."""
    return [(unescape(role), unescape(body)) for role, body in _TURNS.findall(formatted)]


def read_parts(formatted: str) -> list[tuple[str, list[tuple[str, str]]]]:
    """Role and typed parts of every turn: ("text", its text) or a kind and its placeholder. Texts that followed each other come as
    one part; a placeholder that a text spells out stays text."""
    return [(unescape(role), [(_KINDS.get(piece, "text"), unescape(piece)) for piece in _PLACED.split(body) if piece])
            for role, body in _TURNS.findall(formatted)]


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """Digests per conversation, read back from formatted turns and their loss spans."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    arrow = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                       ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    rows = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_length")
    dealt = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "formatted")

    def run(batches):
        key, state = None, None  # state: turns, digest, loss characters, loss digest, characters

        def row():
            return {"conv_id": key[0], "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2],
                    "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}
        for batch in batches:
            out = []
            for part in slices(batch, "formatted"):
                for r in part.to_pylist():
                    if key != (r["conv_id"],):
                        if key:
                            out.append(row())
                        key, state = (r["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, text in read_turns(r["formatted"]):
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                    lost = unescape(r["formatted"][r["loss_start"]:r["loss_start"] + r["loss_length"]])
                    state[2] += len(lost)
                    state[3].update(lost.encode())
                    state[4] += len(r["formatted"])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if key:
            yield pa.RecordBatch.from_pylist([row()], schema=arrow)

    return dealt.mapInArrow(run, schema)
