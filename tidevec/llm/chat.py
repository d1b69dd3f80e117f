r"""Chat formatting with typed content parts.

A turn is a role and a list of parts: text, image, audio or document. A visitor flattens the parts in
order: text is escaped, any other part becomes a numbered placeholder, its reference is recorded, and
its expanded token count is worked out from its measures. A turn reads

    <turn:ROLE>BODY</turn>\n

Every control string begins with ``<`` and no escaped text holds one: in roles, texts and references
``\`` is written ``\\``, ``<`` ``\l`` and ``>`` ``\g``. So formatting is reversible for any text. The
loss mask covers the text of assistant bodies, without markers and placeholders.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOSS_ROLE = "assistant"
_TURN = re.compile(r"<turn:([^<>]*)>(.*?)</turn>\n", re.S)
_PLACEHOLDER = re.compile(r"<(image|audio|document|other):(\d+)>")
_CODED = re.compile(r"\\([\\lg])")
_PLAIN = {"\\": "\\", "l": "<", "g": ">"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")


def unescape(text: str) -> str:
    return _CODED.sub(lambda m: _PLAIN[m[1]], text)


@dataclass
class Part:
    """kind: text, image, audio or document. ``text`` is set for text parts, ``ref`` for others; width and
    height are pixels, seconds a length of sound, pages a document's length. A measure that is None, negative
    or no finite number counts as 0, a text or reference that is None as empty. A part of another kind, or
    of none, becomes an ``other`` placeholder of no tokens, whose attachment has its reference or else its text."""

    kind: str | None = "text"
    text: str | None = None
    ref: str | None = None
    width: int | None = None
    height: int | None = None
    seconds: float | None = None
    pages: int | None = None


@dataclass
class Flattener:
    """Visits the parts of one turn. image_patch: pixels a side per image token; the others: tokens a second and a page."""

    image_patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 256
    body: list[str] = field(default_factory=list)
    length: int = 0
    mask: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: Part) -> None:
        getattr(self, f"visit_{part.kind}", self.visit_other)(part)

    def _put(self, piece: str) -> None:
        self.body.append(piece)
        self.length += len(piece)

    def visit_text(self, part: Part) -> None:
        piece = escape(part.text or "")
        if piece:
            self.mask.append((self.length, self.length + len(piece)))
        self._put(piece)

    def _attach(self, kind: str, part: Part, tokens: int) -> None:
        self.attachments.append({"index": len(self.attachments), "kind": kind, "ref": part.ref or "", "tokens": tokens})
        self._put(f"<{kind}:{len(self.attachments) - 1}>")

    def visit_image(self, part: Part) -> None:
        self._attach("image", part, math.ceil(measure(part.width) / self.image_patch) * math.ceil(measure(part.height) / self.image_patch))

    def visit_audio(self, part: Part) -> None:
        self._attach("audio", part, math.ceil(measure(part.seconds) * self.audio_rate))

    def visit_document(self, part: Part) -> None:
        self._attach("document", part, math.ceil(measure(part.pages)) * self.page_tokens)

    def visit_other(self, part: Part) -> None:
        self._attach("other", replace(part, ref=part.ref or part.text), 0)


def measure(x: float | None) -> float:
    """A measure that is None, negative or no finite number counts as 0."""
    return x if x is not None and math.isfinite(x) and x > 0 else 0


def format_turn(role: str | None, parts: list[Part], **rates) -> dict:
    """formatted: the marked turn; loss: spans of it (code points) under the loss mask; attachments; expanded_tokens of the attachments."""
    flat = Flattener(**rates)
    for part in parts:
        flat.visit(part)
    head = f"<turn:{escape(role or '')}>"
    shift = len(head)
    return {
        "formatted": f"{head}{''.join(flat.body)}</turn>\n",
        "loss": [{"start": a + shift, "end": b + shift} for a, b in flat.mask] if role == LOSS_ROLE else [],
        "attachments": flat.attachments,
        "expanded_tokens": sum(a["tokens"] for a in flat.attachments),
    }


def parse_turns(formatted: str) -> list[tuple[str, list[Part | int]]]:
    """The (role, parts) of formatted turns; a placeholder comes back as its attachment's number."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        parts, done = [], 0
        for p in _PLACEHOLDER.finditer(m[2]):
            if p.start() > done:
                parts.append(Part(text=unescape(m[2][done : p.start()])))
            parts.append(int(p[2]))
            done = p.end()
        if done < len(m[2]) or not parts:
            parts.append(Part(text=unescape(m[2][done:])))
        out.append((unescape(m[1]), parts))
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ATTACHMENT = pa.struct([("index", pa.int64()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
_FORMATTED = "conv_id long, turn long, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<index:long,kind:string,ref:string,tokens:long>>, expanded_tokens long"


def format_conversations(df: DataFrame, parts_col: str | None = None) -> DataFrame:
    """One formatted row per turn: conv_id, turn, formatted, loss, attachments, expanded_tokens.

    ``df`` has conv_id, turn, role and text, or an array of part structs (fields of ``Part``) in
    ``parts_col``. A conversation's output is its rows' ``formatted`` joined in the order of turn (rows
    that repeat a turn: by ``formatted``). Rows are formatted where they lie, so no conversation is too
    long. A null role or text is empty, a null list of parts has none, a null part in it is left out; parts
    of unknown kinds are told at ``Part``; an empty table gives no rows; other columns are ignored.
    """
    content = F.col(f"`{parts_col}`") if parts_col else F.col("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for role, what in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                parts = [Part(text=what)] if not parts_col else [Part(**{k: v for k, v in p.items() if k in Part.__dataclass_fields__}) for p in what or [] if p]
                rows.append(format_turn(role, parts))
            yield pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([r["formatted"] for r in rows], pa.string()),
                    pa.array([r["loss"] for r in rows], pa.list_(_SPAN)),
                    pa.array([r["attachments"] for r in rows], pa.list_(_ATTACHMENT)),
                    pa.array([r["expanded_tokens"] for r in rows], pa.int64()),
                ],
                names=["conv_id", "turn", "formatted", "loss", "attachments", "expanded_tokens"],
            )

    picked = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), content.alias("content"))
    return picked.mapInArrow(run, _FORMATTED)


class Digest:
    """Reads one conversation back from its formatted turns, a turn at a time."""

    def __init__(self, conv_id) -> None:
        self.conv_id, self.turns, self.loss_chars, self.chars, self.masked_turns = conv_id, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        self.chars += len(formatted)
        for role, parts in parse_turns(formatted):
            text = "".join(p.text or "" for p in parts if isinstance(p, Part))
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for span in loss or []:
            learnt = unescape(formatted[span["start"] : span["end"]])
            self.loss_chars += len(learnt)
            self.loss.update(learnt.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """What formatted conversations hold, parsed back: one row per conversation, null conv_id included.

    Rows that repeat a turn are all read, by ``formatted`` and then ``loss``; a null turn is before all others; no rows give none.
    Turns stream past in order and only running digests are held, so memory doesn't grow with a
    conversation's length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, begun, done = None, False, []
        for batch in batches:
            for conv_id, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or conv_id != now.conv_id:
                    if begun:
                        done.append(now.row())
                    now, begun = Digest(conv_id), True
                now.add(text, loss)
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r, strict=True)) for r in done], _DIGESTS)
                done = []
        if begun:
            done.append(now.row())
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, r, strict=True)) for r in done], _DIGESTS)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted", "loss").select("conv_id", "formatted", "loss")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
