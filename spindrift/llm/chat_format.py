"""Chat formatting by prefix-target expansion.

Every assistant turn is an example of its own: all preceding turns are its context, only its reply
is trainable.  Examples of one conversation share their prefix, so format_conversations() stores what
each example adds (the turns since the last assistant turn) and where its reply lies; that table grows with the input.
expand_examples() makes the examples whole, each with its full context, and read_examples() reads conversations back from those.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import slices
from spindrift.session import share_package

#: Characters of context after which a row without a target is written, so that no row grows without bound.
MAX_ROW = 1_000_000
#: Escaped in texts and roles: the escape itself and what begins a control string.
_ESCAPE = re.compile(r"[\\#<:]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.)*+)</turn>\n", re.S)
SCHEMA = "conv_id {id}, example_no long, target boolean, addition string, prefix_chars long, loss_start long, loss_end long"
WHOLE = "conv_id {id}, example_no long, target boolean, text string, loss_start long, loss_end long"
DIGEST = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
#: Characters of whole examples that are sent on together.
SENT = 1 << 20


def escape(s: str | None) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], s or "")


def unescape(s: str) -> str:
    return _UNESCAPE.sub(r"\1", s)


def turn_text(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn and where its escaped text lies in it."""
    head = f"### {escape(role)}: "
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> conv_id, example_no, target, addition, prefix_chars, loss_start, loss_end.

    Storage is shared by prefix: a row holds what its example adds to the one before; expand_examples() gives the
    examples whole, one after another.  prefix_chars: characters of the conversation's text before the addition; loss_start and
    loss_end: the reply, as positions in the addition (both 0 if target is false: context after the last assistant turn,
    or a part of a context of more than MAX_ROW characters).  Null text or role: empty.  Rows are ordered by turn, then role
    and text; a null turn comes first; rows with a null conv_id form one conversation with a null id; repeated rows each are a
    turn; ids may be of any simple type; other columns are ignored; no rows give none.  A conversation streams through one task in sorted order, as
    its digests need; memory holds one addition.
    """
    share_package(conversations.sparkSession)
    rows = conversations.select("conv_id", F.col("turn").cast("long"), F.col("role"), F.col("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        conv, no, before, held, size = _NONE, 0, 0, [], 0
        for b in slices(batches):
            out = []
            for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
                if c != conv:
                    if held:
                        out.append((conv, no, False, "".join(held), before, 0, 0))
                    conv, no, before, held, size = c, 0, 0, [], 0
                piece, lo, hi = turn_text(role, text)
                held.append(piece)
                target = role == "assistant"
                if target or size + len(piece) > MAX_ROW:
                    out.append((conv, no, target, "".join(held), before, size + lo if target else 0, size + hi if target else 0))
                    no, before, held, size = no + 1, before + size + len(piece), [], 0
                else:
                    size += len(piece)
            kind = b.column("conv_id").type
            yield _batch(out, _EXAMPLE, kind)
        if held:
            yield _batch([(conv, no, False, "".join(held), before, 0, 0)], _EXAMPLE, kind)

    return rows.mapInArrow(run, _typed(SCHEMA, rows))


#: No conversation yet; a null id is one of its own.
_NONE = object()
_EXAMPLE = [("conv_id", None), ("example_no", pa.int64()), ("target", pa.bool_()), ("addition", pa.string()), ("prefix_chars", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
_WHOLE = [("conv_id", None), ("example_no", pa.int64()), ("target", pa.bool_()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]
_DIGEST = [("conv_id", None), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]


def _typed(schema: str, rows: DataFrame) -> str:
    return schema.format(id=rows.schema["conv_id"].dataType.simpleString())


def _batch(rows: list[tuple], schema: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    """id_type: that of the input's ids, for the column without one."""
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kind or id_type) for c, (_, kind) in zip(cols, schema, strict=True)], [n for n, _ in schema])


def _in_order(examples: DataFrame) -> DataFrame:
    share_package(examples.sparkSession)
    return examples.repartition("conv_id").sortWithinPartitions("conv_id", "example_no")


class Context:
    """A conversation's text as its examples are read in order; says whether a row follows the ones before."""

    def __init__(self):
        self.conv, self.chars = _NONE, 0

    def add(self, conv: int | None, addition: str, prefix_chars: int) -> bool:
        """Whether a new conversation begins."""
        new = conv != self.conv
        if new:
            self.conv, self.chars = conv, 0
        if prefix_chars != self.chars:
            raise ValueError(f"conversation {conv}: an example begins at {prefix_chars} of {self.chars} characters")
        self.chars += len(addition)
        return new


def expand_examples(examples: DataFrame, rest: bool = False) -> DataFrame:
    """conv_id, example_no, target, text, loss_start, loss_end of every example, whole: all preceding turns, then the reply.

    A conversation's rows stream through a task in order; it holds one context, and sends examples on by SENT characters or one, so
    that memory doesn't grow with the number of examples.  The output is as long as all contexts together: of a conversation of n
    turns some n / 2 times its text.  rest: the whole text of a conversation that ends in other turns as well, target false, without loss.
    """

    def run(batches):
        context, held, made, size, kind, last = Context(), [], [], 0, None, None
        for b in slices(batches):
            kind = b.column("conv_id").type
            for c, no, target, add, before, lo, hi in zip(*(b.column(n).to_pylist() for n, _ in _EXAMPLE), strict=True):
                if context.add(c, add, before):
                    if rest and last:
                        made.append((*last, "".join(held), 0, 0))
                    held = []
                held.append(add)
                last = None if target else (c, no, False)
                if target:
                    held = ["".join(held)]
                    made.append((c, no, True, held[0], before + lo, before + hi))
                    size += len(held[0])
                if size > SENT:
                    yield _batch(made, _WHOLE, kind)
                    made, size = [], 0
        if rest and last:
            made.append((*last, "".join(held), 0, 0))
        if made:
            yield _batch(made, _WHOLE, kind)

    return _in_order(examples).mapInArrow(run, _typed(WHOLE, examples))


def read_examples(whole: DataFrame) -> DataFrame:
    """expand_examples(.., rest=True), in its order -> a row for each conversation, read from the whole examples alone: n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars (of all examples, each with its context, and of what comes after the last).

    An example whose text doesn't begin with the one before it is an error.
    """

    def run(batches):
        conv, before, state, kind = _NONE, "", None, None
        for b in slices(batches):
            kind, out = b.column("conv_id").type, []
            for c, _, target, text, lo, hi in zip(*(b.column(n).to_pylist() for n, _ in _WHOLE), strict=True):
                if c != conv:
                    if state:
                        out.append(_digest(state))
                    conv, before, state = c, "", [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                if not text.startswith(before):
                    raise ValueError(f"conversation {c}: an example without the context of the one before")
                _count(state, text[len(before) :], unescape(text[lo:hi]))
                state[5] += len(text) if target else len(text) - len(before)
                before = text
            yield _batch(out, _DIGEST, kind)
        if state:
            yield _batch([_digest(state)], _DIGEST, kind)

    return whole.mapInArrow(run, _typed(DIGEST, whole))


def _count(state: list, turns: str, loss: str) -> None:
    for role, text in read_turns(turns):
        state[1] += 1
        state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
    state[3] += len(loss)
    state[4].update(loss.encode("utf-8", "surrogatepass"))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"not a turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def read_back(examples: DataFrame) -> DataFrame:
    """One row for each conversation, from the stored prefixes, without making the examples: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars (characters of all its examples, each with its whole context, and of context that no example has).

    Each example's context is followed row by row: an example that doesn't begin where its context ends is an error.
    """

    def run(batches):
        context, state, kind = Context(), None, None
        for b in slices(batches):
            kind, out = b.column("conv_id").type, []
            for c, _, target, add, before, lo, hi in zip(*(b.column(n).to_pylist() for n, _ in _EXAMPLE), strict=True):
                if context.add(c, add, before):
                    if state:
                        out.append(_digest(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                _count(state, add, unescape(add[lo:hi]) if target else "")
                state[5] += context.chars if target else len(add)
            yield _batch(out, _DIGEST, kind)
        if state:
            yield _batch([_digest(state)], _DIGEST, kind)

    return _in_order(examples).mapInArrow(run, _typed(DIGEST, examples))


def _digest(s: list) -> tuple:
    return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]
