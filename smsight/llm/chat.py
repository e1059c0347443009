"""Chat formatting: a finite-state machine over roles, and a declarative template that emits segments with loss flags.

Rows are dealt out by conversation and sorted by turn, and the machine walks through them as a stream, so a conversation of
any length needs no more memory than one batch of turns. Each turn becomes three segments: the template's opening, the
text and the template's closing; the loss flag says whether a model is trained on a segment. Control strings inside roles
and texts are escaped: ``<`` and any number of backslashes before ``|`` get one more backslash, so an escaped text never
holds ``<|`` and the escape can be taken back.

Order: the machine's moves say which role may follow which state; a role without a move is an error, counted for the turn
it stands in, and the machine goes on in that role's own state. A conversation must also end in a final state.

Defined results: a null text or role is the empty string (an unknown role is an error, but is formatted); null turns come
first; rows with equal turns stand in the order of role, then text; identical rows are both formatted; the rows of a null
conversation form one conversation. An empty table gives no segments. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from smsight.llm.words import slices


@dataclass(frozen=True)
class Template:
    """What stands around a text, which roles are trained on, and the machine over roles."""

    opening: str = "<|im_start|>{role}\n"
    closing: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)
    start: str = "start"
    moves: dict = field(default_factory=lambda: {
        ("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant",
        ("user", "tool"): "tool", ("assistant", "tool"): "tool", ("tool", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple[str, ...] = ("assistant",)


CHATML = Template()

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


SEGMENTS = "conv_id {kind}, turn_no bigint, part int, role string, text string, loss boolean, error boolean"


def format_conversations(conversations: DataFrame, template: Template = CHATML, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Segments (conv_id, turn_no, part 0..2, role, text, loss, error) of every turn, in order inside each partition."""
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, state, number = object(), template.start, 0
        for batch in slices(batches, "text"):
            out: list[list] = [[] for _ in range(7)]
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != here:
                    here, state, number = conv, template.start, 0
                follow = template.moves.get((state, role))
                state = role if follow is None else follow
                parts = (template.opening.format(role=escape(role)), escape(text), template.closing)
                for part, segment in enumerate(parts):
                    for column, value in zip(out, (conv, number, part, role, segment, part == 1 and role in template.trained, follow is None)):
                        column.append(value)
                number += 1
            types = (batch.schema.field("conv_id").type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_())
            names = ("conv_id", "turn_no", "part", "role", "text", "loss", "error")
            yield pa.record_batch({n: pa.array(v, t) for n, v, t in zip(names, out, types)})

    return rows.mapInArrow(walk, SEGMENTS.format(kind=kind))


DIGESTS = ("conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, "
           "n_errors bigint, complete boolean")


def read_back(segments: DataFrame, template: Template = CHATML) -> DataFrame:
    """Digests of each conversation, parsed from the formatted text and its mask alone.

    ``segments`` is what format_conversations returns, in its order. The roles come from the openings, the texts from what
    stands between opening and closing; ``complete`` says whether the turns end in a final state without an error.
    """
    kind = segments.schema["conv_id"].dataType.simpleString()
    opening = re.compile(re.escape(template.opening).replace(re.escape("{role}"), "(.*?)"), re.S)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = object(), None
        for batch in slices(batches, "text"):
            done = []
            for conv, part, text, loss, error in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "text", "loss", "error"))):
                if conv != here:
                    if held is not None:
                        done.append(closed(here, held))
                    here, held = conv, {"turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "loss_chars": 0,
                                        "errors": 0, "role": ""}
                held["chars"] += len(text)
                if part == 0:
                    role = opening.fullmatch(text)
                    if role is None:
                        raise ValueError(f"no opening: {text[:80]!r}")
                    held["role"] = unescape(role[1])
                    held["turns"] += 1
                    held["errors"] += error
                elif part == 1:
                    plain = unescape(text)
                    held["all"].update(f"{held['role']}\n{plain}\n".encode())
                    if loss:
                        held["loss"].update(plain.encode())
                        held["loss_chars"] += len(plain)
                elif text != template.closing:
                    raise ValueError(f"no closing: {text[:80]!r}")
            if done:
                yield made(done, batch)
            last = batch
        if held is not None:
            yield made([closed(here, held)], last)

    def closed(conv, x: dict) -> tuple:
        return (conv, x["turns"], x["all"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["chars"], x["errors"],
                not x["errors"] and x["role"] in template.final)

    def made(rows: list[tuple], like: pa.RecordBatch) -> pa.RecordBatch:
        types = (like.schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_())
        names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_errors", "complete")
        return pa.record_batch({n: pa.array(v, t) for n, v, t in zip(names, zip(*rows), types)})

    return segments.mapInArrow(parse, DIGESTS.format(kind=kind))
