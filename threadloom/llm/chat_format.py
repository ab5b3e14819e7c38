"""Operator 13: chat formatting of turns made of typed content parts.

A turn is a list of parts of kind text, image, audio or document. A visitor with a method for each kind
flattens them, in order, into one formatted piece: text is escaped, every other part becomes
its kind's placeholder and is recorded as an attachment with its reference, its offset in the piece and the
tokens it takes once expanded. A template puts the turn between marks and says which roles are learned;
the spans under the loss mask are the text of those turns, without marks and placeholders.

A piece stands for itself, so formatting is one pass without a shuffle, whatever the size of a
conversation; the pieces of a conversation in order of their turns are its formatted text. ``read_back``
parses pieces again. Escaping is reversible: each backslash is doubled, and a backslash is put behind the first
character of every control string in a text, overlapping ones too, so that none is left;
reading takes the character behind each backslash.

Defined results: null text, role and reference are empty; a part of no known kind is text; a null list of
parts is an empty turn; negative or missing extents count 0 tokens beyond an attachment's fixed ones; turns go
by number, nulls first, then by piece; repeated rows are turns of their own; a null conv_id is a conversation of
its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.streams import carried, emit, rows_of

PARTS = "array<struct<kind: string, text: string, ref: string, width: long, height: long, seconds: double, pages: long>>"

#: Control strings of widely used chat templates, in natural order.
CONTROLS = (
    "</s>", "<<SYS>>", "<</SYS>>", "<end_of_turn>", "<s>", "<start_of_turn>", "<|assistant|>", "<|begin_of_text|>", "<|end_header_id|>",
    "<|endoftext|>", "<|eot_id|>", "<|im_end|>", "<|im_start|>", "<|start_header_id|>", "<|system|>", "<|user|>", "[/INST]", "[INST]",
)


@dataclass(frozen=True)
class Template:
    """Marks of a turn: ``open`` role ``split`` text ``close``."""

    open: str = "<|im_start|>"
    split: str = "\n"
    close: str = "<|im_end|>\n"
    learned: tuple[str, ...] = ("assistant",)
    placeholders: dict[str, str] = field(default_factory=lambda: {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"})
    controls: tuple[str, ...] = CONTROLS

    def strings(self) -> list[str]:
        """All that may not stand in an escaped text; the marks without white space about them."""
        marks = (self.open.strip(), self.close.strip(), *self.placeholders.values(), *self.controls)
        return sorted({m for m in marks if len(m) > 1})


@dataclass(frozen=True)
class Extents:
    """Tokens of attachments: an image takes ``tile`` for each square of ``side`` pixels begun and ``base`` besides."""

    base: int = 85
    tile: int = 170
    side: int = 512
    audio_rate: float = 12.5
    page: int = 256

    def image(self, part: dict) -> int:
        wide, high = max(part.get("width") or 0, 0), max(part.get("height") or 0, 0)
        return self.base + self.tile * -(-wide // self.side) * -(-high // self.side)

    def audio(self, part: dict) -> int:
        return int(-(-max(part.get("seconds") or 0.0, 0.0) * self.audio_rate // 1)) if (part.get("seconds") or 0.0) > 0 else 0

    def document(self, part: dict) -> int:
        return self.page * max(part.get("pages") or 0, 0)


class Flatten:
    """Visits the parts of one turn after another and gathers the piece, its attachments and its text spans."""

    def __init__(self, template: Template, extents: Extents):
        self.template, self.extents = template, extents
        any_control = "|".join(map(re.escape, template.strings()))
        self._control = re.compile(f"(?=(?:{any_control}))(.)", re.S)
        self.visits = {kind: self.attachment for kind in template.placeholders}

    def escape(self, text: str) -> str:
        return self._control.sub(r"\1\\", text.replace("\\", "\\\\"))

    def escape_role(self, role: str) -> str:
        """Besides, no string that ends the role stands in it without a backslash before."""
        return self.escape(role).replace(self.template.split, "\\" + self.template.split)

    def text(self, part: dict) -> None:
        piece = self.escape(part.get("text") or "")
        if piece:
            self.spans.append((self.at, self.at + len(piece)))
        self.put(piece)

    def attachment(self, part: dict) -> None:
        kind = part["kind"]
        self.attachments.append({"kind": kind, "ref": part.get("ref") or "", "offset": self.at, "tokens": getattr(self.extents, kind)(part)})
        self.put(self.template.placeholders[kind])

    def put(self, piece: str) -> None:
        self.pieces.append(piece)
        self.at += len(piece)

    def turn(self, role: str, parts: list[dict]) -> dict:
        self.pieces, self.attachments, self.spans, self.at = [], [], [], 0
        self.put(self.template.open + self.escape_role(role) + self.template.split)
        for part in parts:
            self.visits.get(part.get("kind"), self.text)(part)
        self.put(self.template.close)
        return {
            "piece": "".join(self.pieces), "loss": [{"start": a, "end": b} for a, b in self.spans] if role in self.template.learned else [],
            "attachments": self.attachments, "attachment_tokens": sum(a["tokens"] for a in self.attachments),
        }


_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("turn", pa.int64()), ("piece", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("offset", pa.int64()), ("tokens", pa.int64())]))), ("attachment_tokens", pa.int64()),
])
_PIECE_DDL = "conv_id long, turn long, piece string, loss array<struct<start: long, end: long>>, attachments array<struct<kind: string, ref: string, offset: long, tokens: long>>, attachment_tokens long"


def text_parts(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) as turns of one text part."""
    nothing = "NULL AS ref, NULL AS width, NULL AS height, NULL AS seconds, NULL AS pages"
    part = F.expr(f"array(struct('text' AS kind, text, {nothing}))").cast(PARTS)
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", part.alias("parts"))


def format_turns(turns: DataFrame, template: Template | None = None, extents: Extents | None = None) -> DataFrame:
    """(conv_id, turn, piece, loss, attachments, attachment_tokens) of ``turns`` (conv_id, turn, role, parts); offsets are code points of the piece."""
    template, extents = template or Template(), extents or Extents()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visitor = Flatten(template, extents)
        made = ({"conv_id": r["conv_id"], "turn": r["turn"]} | visitor.turn(r["role"] or "", r["parts"] or []) for r in rows_of(batches))
        yield from emit(made, _PIECE)

    return turns.select("conv_id", "turn", "role", "parts").mapInArrow(work, _PIECE_DDL)


def read_turn(piece: str, template: Template) -> tuple[str, str]:
    """Role and text of a piece, placeholders left in the text."""
    body = piece[len(template.open) : len(piece) - len(template.close)]
    at = re.match(r"(?:\\.|(?!" + re.escape(template.split) + r").)*", body, re.S).end()
    return unescape(body[:at]), unescape(body[at + len(template.split) :])


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_back(pieces: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) read from ``format_turns``' pieces, a conversation as one stream."""
    template = template or Template()

    def work(rows: Iterator[dict]) -> Iterator[dict]:
        state: dict | None = None
        for row in rows:
            if state is None or state["conv_id"] != row["conv_id"]:
                if state is not None:
                    yield closed(state)
                state = {"conv_id": row["conv_id"], "n_turns": 0, "loss_chars": 0, "formatted_chars": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256()}
            role, text = read_turn(row["piece"], template)
            state["n_turns"] += 1
            state["formatted_chars"] += len(row["piece"])
            state["turns"].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                learned = unescape(row["piece"][span["start"] : span["end"]])
                state["loss_chars"] += len(learned)
                state["loss"].update(learned.encode())
        if state is not None:
            yield closed(state)

    def closed(state: dict) -> dict:
        return state | {"turns_sha256": state["turns"].hexdigest(), "loss_sha256": state["loss"].hexdigest()}

    schema = pa.schema([
        ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
    ])
    ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    order = [F.col("turn").asc_nulls_first(), "piece"]
    return carried(pieces.select("conv_id", "turn", "piece", "loss"), "conv_id", order, work, schema, ddl)


#: The two turns that every run formats besides: they hold another template's control strings.
PROBE = "VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t (conv_id, turn, role, text)"


def _oracle() -> str:
    template = Template()
    controls = "|".join(re.sub(r"([|\[\]/<>])", r"\\\1", s) for s in template.strings())
    fixed = len(template.open) + len(template.split) + len(template.close)
    longer = f"len(regexp_extract_all({{0}}, '{controls}')) + len(regexp_extract_all({{0}}, '\\\\'))"
    return f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({fixed} + length(role) + length(text) + {longer.format("text")} + {longer.format("role")} + (length(role) - length(replace(role, chr(10), ''))))::BIGINT AS formatted_chars
    FROM rows GROUP BY 1
    """


ORACLE = _oracle()
