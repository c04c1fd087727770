"""Chat formatting checked by a grammar round trip.

A conversation is rendered turn by turn as

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

and read back by a deterministic parser. Where the recovered turn differs from the source, its conflicting content is
escaped and the turn is rendered and read again, until both are identical. Escaping puts a backslash after the `<` of
every `<|im_start|>` and `<|im_end|>`, however many backslashes stand there already, and so is undone by taking one
away; in a role a newline and a backslash are escaped too. Turns without conflicts are rendered unchanged.

Rows are sorted by conversation and turn within hash partitions and streamed: a conversation of any length needs the
memory of one segment. A segment is a run of whole turns of one conversation with about `segment_chars` characters;
nearly every conversation is one segment. Loss spans are character ranges of the segment that hold the (escaped) texts
of the trained role.

Nulls and edges: a null text or role is empty; a null turn sorts first; rows of equal turn are ordered by role and then
text, repeats are kept; a null conv_id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

START, END = "<|im_start|>", "<|im_end|>"
SEGMENT_CHARS = 1_000_000
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the text's range in `rendered`) for each turn; ValueError if it breaks the grammar."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        line = rendered.find("\n", at)
        end = rendered.find(END, line + 1) if line >= 0 else -1
        if end < 0 or not rendered.startswith("\n", end + len(END)):
            raise ValueError(f"the turn at {at} does not end")
        role, text = rendered[at + len(START) : line], rendered[line + 1 : end]
        if START in role or END in role or START in text:
            raise ValueError(f"a control string stands inside the turn at {at}")
        turns.append((unescape_role(role), unescape(text), line + 1, end))
        at = end + len(END) + 1
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's rendering and its text's range there. It is proven by reading it back."""
    for r, t in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        out = f"{START}{r}\n{t}{END}\n"
        try:
            found = parse(out)
        except ValueError:
            continue
        if len(found) == 1 and found[0][:2] == (role, text):
            return out, found[0][2], found[0][3]
    raise ValueError("a turn can't be rendered so that it reads back")


def _sorted_turns(df: DataFrame, partitions: int | None) -> DataFrame:
    cols = [F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")]
    rows = df.select(*cols)
    rows = rows.repartition(partitions, "conv_id") if partitions else rows.repartition("conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(df: DataFrame, trained_role: str = "assistant", segment_chars: int = SEGMENT_CHARS, partitions: int | None = None) -> DataFrame:
    """Segments: conv_id, segment, n_turns, formatted, loss_starts and loss_ends (ranges under the loss mask).

    A partition holds whole conversations, their segments in order.
    """

    out = StructType([df.schema["conv_id"], *_parse_datatype_string("segment long, n_turns long, formatted string, loss_starts array<long>, loss_ends array<long>").fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None  # (conv_id,): told from "none yet" even where it is null
        number, parts, starts, ends, n_turns, size, done = 0, [], [], [], 0, 0, []

        def close() -> None:
            nonlocal number, parts, starts, ends, n_turns, size
            if n_turns:
                rendered = "".join(parts)
                if len(parse(rendered)) != n_turns:
                    raise ValueError("a segment does not read back")
                done.append((current[0], number, n_turns, rendered, starts, ends))
            number, parts, starts, ends, n_turns, size = number + 1, [], [], [], 0, 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True)) if done else [[] for _ in out.fields]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(k).type) for k, c in enumerate(cols)], schema=arrow)

        held = 0
        for batch in batches:
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if current is not None and current != (conv,):
                    close()
                    number = 0
                elif size >= segment_chars:
                    close()
                current = (conv,)
                turn, a, b = render_turn(role, text)
                if role == trained_role:
                    starts.append(size + a)
                    ends.append(size + b)
                parts.append(turn)
                size, n_turns, held = size + len(turn), n_turns + 1, held + len(turn)
                if held >= 4 * segment_chars:
                    held = 0
                    yield flush()
        if current is not None:
            close()
        yield flush()

    return _sorted_turns(df, partitions).mapInArrow(run, out)


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation what its formatted segments read back as: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    `segments` is the output of `format_conversations`, in its partitioning and order.
    """

    out = StructType([segments.schema["conv_id"], *_parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])
    arrow = to_arrow_schema(out)

    def utf8(text: str) -> bytes:
        return text.encode("utf-8", "surrogatepass")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple | None = None
        state: list = []

        def made(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in out.fields]
            return pa.RecordBatch.from_arrays([pa.array(c, arrow.field(k).type) for k, c in enumerate(cols)], schema=arrow)

        def row() -> tuple:
            return (current[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        for batch in batches:
            rows = []
            for conv, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_starts", "loss_ends")), strict=True):
                if current != (conv,):
                    if current is not None:
                        rows.append(row())
                    current, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said, _, _ in parse(text):
                    state[0] += 1
                    state[1].update(utf8(f"{role}\n{said}\n"))
                for a, b in zip(starts, ends, strict=True):
                    under = unescape(text[a:b])
                    state[2] += len(under)
                    state[3].update(utf8(under))
                state[4] += len(text)
            yield made(rows)
        if current is not None:
            yield made([row()])

    return segments.mapInArrow(run, out)
