r"""Chat formatting: turns with typed content parts become one marked text for each conversation.

A visitor goes through the parts of a turn in order. Text is escaped; an image, audio or document
becomes a placeholder, and its reference, place and expanded token count are recorded. A turn is
`[TURN]role[/TURN]body[END]`, and a conversation begins with `<s>`. The bodies
of assistants are under the loss mask, without their placeholders.

Escaping is reversible: a backslash goes before each control string and each backslash of a text,
and comes off again on the way back.

Rendering is done row by row before the one shuffle, by conversation. After it, rows are sorted and
go by in a stream that keeps only a running length, so a conversation may be of any size. The result
has a row for each turn, in order; a conversation's text is its segments put together.

Defined results: null text, role or part is empty; rows of a conversation stand by turn, null first,
then by role and text; a null conversation id is a conversation of its own; a turn without parts has
an empty body; an unknown kind of part is an error; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, TURN, TURN_END, END = "<s>", "[TURN]", "[/TURN]", "[END]"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Our own marks, and marks of well-known templates that a text must not imitate.
CONTROL = (
    BEGIN, TURN, TURN_END, END, *PLACEHOLDERS.values(),
    "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>",
)
PART = (
    "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
)
ATTACHMENT = "struct<kind:string,ref:string,at:bigint,tokens:bigint>"
SEGMENTS = (
    "conv_id {id}, seq bigint, role string, segment string, body_at bigint, body_chars bigint, "
    f"loss boolean, attachments array<{ATTACHMENT}>"
)
_NOTES = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]
    )
)
_SEGMENT_TYPES = (
    ("seq", pa.int64()),
    ("role", pa.string()),
    ("segment", pa.string()),
    ("body_at", pa.int64()),
    ("body_chars", pa.int64()),
    ("loss", pa.bool_()),
    ("attachments", _NOTES),
)
_DIGEST_TYPES = (
    ("n_turns", pa.int64()),
    ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()),
    ("n_attachments", pa.int64()),
)
_ESCAPE = re.compile("|".join(map(re.escape, sorted(("\\", *CONTROL), key=len, reverse=True))))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_MARKS = re.compile(
    r"\\.|" + "|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))), re.S
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


@dataclass(frozen=True)
class Costs:
    """Tokens an attachment stands for."""

    patch: int = 14
    audio_per_second: float = 25.0
    page: int = 768


class PartVisitor:
    """Flattens parts into text and placeholders; a method for each kind.

    Neighbouring texts are escaped as one, so no control string stands across the border of two.
    """

    def __init__(self, costs: Costs):
        self.costs = costs
        self.out: list[str] = []
        self.texts: list[str] = []
        self.chars = 0
        self.attachments: list[dict] = []

    def visit(self, part) -> None:
        if part is not None:
            kind = part["kind"] or "text"
            method = getattr(self, f"visit_{kind}", None)
            if method is None:
                raise ValueError(f"unknown kind of content part: {kind}")
            method(part)

    def visit_text(self, part) -> None:
        self.texts.append(part["text"] or "")

    def visit_image(self, part) -> None:
        side = self.costs.patch
        tokens = math.ceil((part["width"] or 0) / side) * math.ceil((part["height"] or 0) / side)
        self._attach("image", part, tokens)

    def visit_audio(self, part) -> None:
        seconds = part["seconds"] or 0.0
        self._attach("audio", part, math.ceil(seconds * self.costs.audio_per_second))

    def visit_document(self, part) -> None:
        self._attach("document", part, (part["pages"] or 0) * self.costs.page)

    def finish(self) -> None:
        """Add the texts since the last placeholder."""
        if self.texts:
            self._add(escape("".join(self.texts)))
            self.texts = []

    def _attach(self, kind: str, part, tokens: int) -> None:
        self.finish()
        self.attachments.append(
            {"kind": kind, "ref": part["ref"], "at": self.chars, "tokens": max(1, tokens)}
        )
        self._add(PLACEHOLDERS[kind])

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.chars += len(text)


def text_parts(turns: DataFrame, text: str = "text") -> DataFrame:
    """Turns whose whole content is one text part, in the column `parts`."""
    fields = [F.lit("text").alias("kind"), F.col(text).cast("string").alias("text")]
    fields += [F.lit(None).alias(n) for n in ("ref", "width", "height", "seconds", "pages")]
    return turns.withColumn("parts", F.array(F.struct(*fields)).cast(f"array<{PART}>"))


def format_turns(turns: DataFrame, costs: Costs = Costs(), loss_role: str = "assistant") -> DataFrame:
    """Segments of all conversations: from `conv_id`, `turn`, `role`, `parts` to `SEGMENTS`.

    `body_at` and an attachment's `at` count code points from the beginning of the conversation.
    """
    id_type = turns.schema["conv_id"].dataType.simpleString()

    def render(batches):
        for batch in batches:
            heads, bodies, notes, sizes = [], [], [], []
            for role, parts in zip(batch["role"].to_pylist(), batch["parts"].to_pylist()):
                visitor = PartVisitor(costs)
                for part in parts or ():
                    visitor.visit(part)
                visitor.finish()
                heads.append(f"{TURN}{escape(role or '')}{TURN_END}")
                bodies.append("".join(visitor.out))
                notes.append(visitor.attachments)
                sizes.append(visitor.chars)
            made = [pa.array(heads, pa.string()), pa.array(bodies, pa.string())]
            made += [pa.array(notes, _NOTES), pa.array(sizes, pa.int64())]
            names = ["conv_id", "turn", "role", "head", "body", "attachments", "body_chars"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names)

    def place(batches):
        current, at, seq = (), 0, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                first = current != (row["conv_id"],)
                if first:
                    current, at, seq = (row["conv_id"],), 0, 0
                head = (BEGIN if first else "") + row["head"]
                segment = head + row["body"] + END
                for note in row["attachments"]:
                    note["at"] += at + len(head)
                out.append(
                    {
                        "conv_id": row["conv_id"],
                        "seq": seq,
                        "role": row["role"] or "",
                        "segment": segment,
                        "body_at": at + len(head),
                        "body_chars": row["body_chars"],
                        "loss": row["role"] == loss_role,
                        "attachments": row["attachments"],
                    }
                )
                at, seq = at + len(segment), seq + 1
            fields = [("conv_id", batch.schema.field("conv_id").type), *_SEGMENT_TYPES]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

    rendered = turns.select("conv_id", "turn", "role", "parts").mapInArrow(
        render,
        f"conv_id {id_type}, turn {turns.schema['turn'].dataType.simpleString()}, role string, "
        f"head string, body string, attachments array<{ATTACHMENT}>, body_chars bigint",
    )
    in_order = rendered.repartition("conv_id").sortWithinPartitions(
        "conv_id", "turn", "role", "body"
    )
    return in_order.mapInArrow(place, SEGMENTS.format(id=id_type))


def parse(segment: str) -> tuple[str, str]:
    """Role and body, both unescaped, of a segment; placeholders stay in the body."""
    marks = [m for m in _MARKS.finditer(segment) if not m.group().startswith("\\")]
    names = [m.group() for m in marks]
    head = names.index(TURN)
    role = segment[marks[head].end() : marks[head + 1].start()]
    body = segment[marks[head + 1].end() : marks[-1].start()]
    if names[head + 1] != TURN_END or names[-1] != END:
        raise ValueError("not a segment")
    return unescape(role), unescape(body)


def masked(body: str) -> str:
    """The text of a body under the loss mask: all of it but the placeholders."""
    out, at = [], 0
    for m in _MARKS.finditer(body):
        if m.group() in PLACEHOLDERS.values():
            out.append(body[at : m.start()])
            at = m.end()
    return unescape("".join(out) + body[at:])


def digests(segments: DataFrame) -> DataFrame:
    """What can be read back from each conversation's segments, which must come in order.

    A narrow step after `format_turns`: no shuffle, one running digest.
    """
    id_type = segments.schema["conv_id"].dataType.simpleString()

    def run(batches):
        state = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if state is None or row["seq"] == 0:
                    if state is not None:
                        out.append(state.row())
                    state = _Digest(row["conv_id"])
                state.add(row)
            fields = [("conv_id", batch.schema.field("conv_id").type), *_DIGEST_TYPES]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))
        if state is not None:
            yield pa.RecordBatch.from_pylist([state.row()], schema=pa.schema(fields))

    return segments.mapInArrow(
        run,
        f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
        "loss_sha256 string, formatted_chars bigint, n_attachments bigint",
    )


class _Digest:
    """Running digests of one conversation."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = self.attached = 0

    def add(self, row: dict) -> None:
        segment = row["segment"]
        role, text = parse(segment)
        self.n_turns += 1
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if row["loss"]:
            begin = len(segment) - len(END) - row["body_chars"]
            text = masked(segment[begin : begin + row["body_chars"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(segment)
        self.attached += len(row["attachments"])

    def row(self) -> dict:
        return {
            "conv_id": self.conv_id,
            "n_turns": self.n_turns,
            "turns_sha256": self.turns.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.chars,
            "n_attachments": self.attached,
        }
