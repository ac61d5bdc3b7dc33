"""Chat formatting of messages made of typed content parts.

A message is a role and a list of parts: text, image, audio, document or any other
kind.  A visitor flattens the parts in order.  Text is escaped; every attachment
leaves one placeholder, and its reference, its place and the number of tokens that
the placeholder stands for are recorded.  A turn reads

    <s>role[INST]content[/INST]</s>

Escaping is reversible: a backslash is doubled, and a control string inside a text
or role gets a backslash after its first character, so that no control string is
left in it; reading drops each backslash and takes the next character as it is.

Turns are formatted row by row; rows are dealt by conversation, sorted by Spark and
streamed.  A conversation is cut into segments between turns once one is
`SEGMENT_CHARS` long, so no row of the result holds more than that and one turn.

Defined results: a null role, text or reference is empty; a null list of parts or a
null part adds nothing; a part of another kind is a file; a size that is missing, not
positive or not finite counts as one token; null turns come first, rows of one turn
are ordered by role and parts, repeated rows are turns of their own; a null
conversation id is a conversation; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.common import small_batches

# The template.
OPEN, BODY, DONE, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
PLACEHOLDERS = {"image": "[IMAGE]", "audio": "[AUDIO]", "document": "[DOCUMENT]", "file": "[FILE]"}
CONTROL = r"</?s>|\[/?INST\]|\[(?:IMAGE|AUDIO|DOCUMENT|FILE)\]"
ASSISTANT = "assistant"

#: Tokens of an attachment: a square of so many pixels, a second of sound, a page.
PATCH, TOKENS_A_SECOND, TOKENS_A_PAGE = 28, 25, 256
SEGMENT_CHARS = 1 << 20

PARTS = ("array<struct<type: string, text: string, ref: string, width: bigint, height: bigint, "
         "seconds: double, pages: bigint>>")
SEGMENT = ("segment bigint, n_turns bigint, formatted string, "
           "loss array<struct<start: bigint, end: bigint>>, "
           "attachments array<struct<kind: string, ref: string, start: bigint, tokens: bigint>>, "
           "attachment_tokens bigint")
READ_BACK = ("n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
             "formatted_chars bigint, n_attachments bigint, attachment_tokens bigint")

_ESCAPED = re.compile(r"\\|" + CONTROL)
_UNESCAPED = re.compile(r"\\(.)", re.S)
_PLACE = re.compile("(" + "|".join(map(re.escape, PLACEHOLDERS.values())) + ")")
_KINDS = {mark: kind for kind, mark in PLACEHOLDERS.items()}


def escape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(r"\1", text) if "\\" in text else text


def _tokens(*sizes: float | None) -> int:
    """Product of sizes rounded up, 1 when one of them says nothing."""
    known = [s for s in sizes if s is not None and math.isfinite(s) and s > 0]
    return math.prod(map(math.ceil, known)) if len(known) == len(sizes) else 1


class Visitor:
    """Flattens the parts of messages into one text, and records what lies where."""

    def __init__(self):
        self.pieces: list[str] = []
        self.length = self.n_turns = self.tokens = 0
        self.loss: list[tuple[int, int]] = []
        self.attachments: list[tuple[str, str, int, int]] = []
        self.learned = False

    def _add(self, piece: str) -> None:
        self.pieces.append(piece)
        self.length += len(piece)

    def message(self, role: str | None, parts: list[dict | None] | None) -> None:
        self.learned = role == ASSISTANT
        self._add(OPEN + escape(role or "") + BODY)
        for part in parts or []:
            if part:
                getattr(self, f"visit_{part['type']}", self.visit_file)(part)
        self._add(DONE + CLOSE)
        self.n_turns += 1

    def visit_text(self, part: dict) -> None:
        start = self.length
        self._add(escape(part["text"] or ""))
        if self.learned and self.length > start:
            self.loss.append((start, self.length))

    def visit_image(self, part: dict) -> None:
        patches = [s / PATCH if s else None for s in (part["width"], part["height"])]
        self._attach("image", part, _tokens(*patches))

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"]
        self._attach("audio", part, _tokens(seconds * TOKENS_A_SECOND if seconds else None))

    def visit_document(self, part: dict) -> None:
        pages = part["pages"]
        self._attach("document", part, _tokens(pages * TOKENS_A_PAGE if pages else None))

    def visit_file(self, part: dict) -> None:
        self._attach("file", part, 1)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append((kind, part["ref"] or "", self.length, tokens))
        self.tokens += tokens
        self._add(PLACEHOLDERS[kind])

    def segment(self) -> tuple:
        return self.n_turns, "".join(self.pieces), self.loss, self.attachments, self.tokens


def read_turns(formatted: str, attachments: list[dict]) -> Iterator[tuple[str, list[tuple]]]:
    """Role and parts of each turn: `("text", text)`, or kind, reference and tokens."""
    recorded = iter(attachments)
    for turn in formatted.split(OPEN)[1:]:
        role, _, rest = turn.partition(BODY)
        parts: list[tuple] = []
        for piece in _PLACE.split(rest.removesuffix(DONE + CLOSE)):
            if piece in _KINDS:
                known = next(recorded)
                parts.append((known["kind"], known["ref"], known["tokens"]))
            elif piece:
                parts.append(("text", unescape(piece)))
        yield unescape(role), parts


# --- tables -------------------------------------------------------------------

def text_parts(conversations: DataFrame) -> DataFrame:
    """`(conv_id, turn, role, parts)` of rows with a plain `text`: one text part each."""
    rest = [F.lit(None).cast(kind).alias(name) for name, kind in (
        ("ref", "string"), ("width", "bigint"), ("height", "bigint"), ("seconds", "double"),
        ("pages", "bigint"))]
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), *rest)
    return conversations.select("conv_id", "turn", "role", F.array(part).cast(PARTS).alias("parts"))


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def formatted(messages: DataFrame) -> DataFrame:
    """`(conv_id, ...SEGMENT)` of `messages(conv_id, turn, role, parts)`.  Segments of a
    conversation follow each other within one partition."""
    small_batches(messages.sparkSession)
    schema = f"conv_id {messages.schema['conv_id'].dataType.simpleString()}, {SEGMENT}"
    fields = _arrow(schema)
    rows = (messages.select("conv_id", "turn", "role", "parts").repartition("conv_id")
            .sortWithinPartitions("conv_id", "turn", "role", "parts").select("conv_id", "role", "parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, visitor, segment, out, chars = None, None, 0, [], 0
        packed = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*out), fields)], schema=fields)
        for batch in batches:
            for conv, role, parts in zip(*(c.to_pylist() for c in batch.columns)):
                other = visitor is None or conv != key
                if other or visitor.length >= SEGMENT_CHARS:
                    if visitor:
                        out.append((key, segment, *visitor.segment()))
                        chars += visitor.length
                    key, visitor, segment = conv, Visitor(), 0 if other else segment + 1
                visitor.message(role, parts)
                if chars >= SEGMENT_CHARS:
                    yield packed()
                    out, chars = [], 0
        if visitor:
            out.append((key, segment, *visitor.segment()))
            yield packed()

    return rows.mapInArrow(run, schema)


def in_order(segments: DataFrame) -> DataFrame:
    """Stored segments, each conversation in order within one partition."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")


def read_back(segments: DataFrame) -> DataFrame:
    """`(conv_id, ...READ_BACK)` from segments in order, as `formatted` or `in_order`
    gives them: digests of all turns (`role\\ntext\\n`) and of all text under the loss
    mask.  Segments are streamed; only digests and counts are held."""
    schema = f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, {READ_BACK}"
    fields = _arrow(schema)
    rows = segments.select("conv_id", "formatted", "loss", "attachments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        packed = lambda: pa.RecordBatch.from_arrays(
            [pa.array(list(c), f.type) for c, f in zip(zip(*out), fields)], schema=fields)
        for batch in batches:
            for conv, text, loss, attachments in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != key:
                    if state:
                        out.append((key, *state.row()))
                    key, state = conv, ReadBack()
                state.read(text, loss, attachments)
            if len(out) > 1000:
                yield packed()
                out = []
        if state:
            out.append((key, *state.row()))
            yield packed()

    return rows.mapInArrow(run, schema)


class ReadBack:
    """Digests and counts of a conversation, read segment by segment."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.n_attachments = self.tokens = 0

    def read(self, text: str, loss: list[dict], attachments: list[dict]) -> None:
        for role, parts in read_turns(text, attachments):
            said = "".join(part[1] for part in parts if part[0] == "text")
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
        for span in loss:
            said = unescape(text[span["start"]:span["end"]])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(text)
        self.n_attachments += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return (self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(),
                self.chars, self.n_attachments, self.tokens)
