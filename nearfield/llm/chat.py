"""Chat formatting with a grammar round trip.

    turn  = START role "\\n" text END "\\n"
    START = "<|im_start|>"    END = "<|im_end|>"

Text that contains a control string is escaped: a mark is put after its first character.  The
text is rendered, read back by a deterministic parser and compared with the source; while they
differ, the conflicting content is escaped.  The parser takes one mark from every marked control
string, so the source comes back exactly, marked control strings of its own included.

Turns are rendered one by one, so a conversation of any length is never held as a whole; a
training mask is a list of spans of the rendered turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.shared import partitions, prepare

START, END = "<|im_start|>", "<|im_end|>"
CONTROLS = (START, END)
MARK = "\\"
# A control string, or one that has already some marks after its first character.
CONFLICT = re.compile(r"<(\\*)(?=\|im_(?:start|end)\|>)")
ESCAPED = re.compile(r"<\\(\\*)(?=\|im_(?:start|end)\|>)")


def escape(text: str) -> str:
    """One more mark in every control string, marked or not: one to one on all strings."""
    return CONFLICT.sub(lambda m: "<" + MARK + m[1], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "<" + m[1], text)


@dataclass(frozen=True)
class Turn:
    role: str
    text: str


@dataclass(frozen=True)
class Rendered:
    text: str
    body: tuple[int, int]  # the span of the escaped text


def escape_role(role: str) -> str:
    """Roles hold no line break and no control string in the rendered form."""
    return escape(role.replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


def parse(rendered: str) -> list[tuple[Turn, tuple[int, int]]]:
    """The turns of a rendered text, with the span of each escaped text.  Raises ValueError where
    the grammar doesn't hold."""
    out, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(START, at):
            raise ValueError(f"a turn has to start at {at}")
        line = rendered.find("\n", at)
        end = rendered.find(END, line + 1)
        if line < 0 or end < 0 or not rendered.startswith("\n", end + len(END)):
            raise ValueError(f"the turn at {at} doesn't end")
        role, body = rendered[at + len(START) : line], rendered[line + 1 : end]
        if any(c in role or c in body for c in CONTROLS):
            raise ValueError(f"a control string inside the turn at {at}")
        out.append((Turn(unescape_role(role), unescape(body)), (line + 1, end)))
        at = end + len(END) + 1
    return out


def render(turn: Turn) -> Rendered:
    """Render a turn, escaping until the parser gives back the source.

    Marked control strings in the source have to be escaped too, or they would come back with a
    mark less; the loop ends after one escape of each part, as escaping is one to one.
    """
    role, text = turn.role, turn.text
    for _ in range(3):
        line = f"{START}{role}\n{text}{END}\n"
        try:
            got = parse(line)
        except ValueError:
            got = []
        if [t for t, _ in got] == [turn]:
            return Rendered(line, got[0][1])
        role = escape_role(turn.role)
        if got and got[0][0].role == turn.role or not got:
            text = escape(turn.text)
    raise AssertionError("escaping is one to one")


SCHEMA = [("n", T.LongType()), ("role", T.StringType()), ("rendered", T.StringType()), ("loss_start", T.IntegerType()), ("loss_end", T.IntegerType())]


def format_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, turn, role, rendered, loss_start, loss_end)``, one row per turn, unordered.

    ``rendered`` has passed the round trip.  The loss span is the escaped text of a turn whose
    role is in ``train_roles``, in code points of ``rendered``, and null for other turns.  Null
    texts and roles are empty; null ids and turn numbers pass through.  Turns are independent:
    there is no shuffle, and an empty table gives an empty result.  Extra columns are not read.
    """
    prepare(conversations.sparkSession)
    fields = [T.StructField(c, conversations.schema[c].dataType) for c in (id_col, turn_col)]
    schema = T.StructType([*fields, *[T.StructField(n, t) for n, t in SCHEMA[1:]]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, lines, starts, ends = [], [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turn = Turn(role or "", text or "")
                out = render(turn)
                train = turn.role in train_roles
                roles.append(turn.role), lines.append(out.text)
                starts.append(out.body[0] if train else None), ends.append(out.body[1] if train else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roles, pa.string()), pa.array(lines, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=schema.names)

    return conversations.select(id_col, turn_col, role_col, text_col).mapInArrow(run, schema)


def read_back(formatted: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Digests of each conversation, read from the output of :func:`format_turns` alone:
    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``.

    Turns go by number, then by their rendered text, so ties have one order; null numbers come
    first.  A conversation streams through its task turn by turn in bounded memory.  Rows with a
    null id are one conversation.
    """
    prepare(formatted.sparkSession)
    longs = {"n_turns", "loss_chars", "formatted_chars"}
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = T.StructType([formatted.schema[id_col], *[T.StructField(n, T.LongType() if n in longs else T.StringType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        held = None

        def out() -> pa.RecordBatch:
            done = [[r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]] for r in rows]
            rows.clear()
            columns = list(zip(*done)) if done else [()] * len(schema)
            kinds = [pa.int64() if n in longs else pa.string() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *[pa.array(c, k) for c, k in zip(columns[1:], kinds)]], names=schema.names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            lists = [c.to_pylist() for c in batch.columns]
            for conv, line, start, end in zip(*lists):
                if held is None or held[0] != conv:
                    if held is not None:
                        rows.append(held)
                    held = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for turn, _ in parse(line):
                    held[1] += 1
                    held[2].update(f"{turn.role}\n{turn.text}\n".encode())
                if start is not None:
                    loss = unescape(line[start:end])
                    held[3] += len(loss)
                    held[4].update(loss.encode())
                held[5] += len(line)
            yield out()
        if held is not None:
            rows.append(held)
            yield out()

    n = partitions(formatted.sparkSession)
    ordered = formatted.repartition(n, id_col).sortWithinPartitions(id_col, turn_col, "rendered")
    return ordered.select(id_col, "rendered", "loss_start", "loss_end").mapInArrow(run, schema)


def probe(like: DataFrame, conv_id: int, texts: list[tuple[str, str]], id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A conversation of the given (role, text) turns with the four columns of ``like``."""
    rows = [(conv_id, k, role, text) for k, (role, text) in enumerate(texts)]
    made = like.sparkSession.createDataFrame(rows, "c long, t long, r string, x string")
    kinds = {c: like.schema[c].dataType for c in (id_col, turn_col, role_col, text_col)}
    return made.select(*[F.col(a).cast(kinds[b]).alias(b) for a, b in zip("ctrx", kinds)])
