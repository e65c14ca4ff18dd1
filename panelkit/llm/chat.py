"""Chat formatting by incremental black-box rendering.

A template is a function from a list of turns to one string.  Nothing about
its marks is assumed: the successive prefixes of a conversation are rendered
and consecutive outputs compared.  What the longer output adds is the new
turn's span; where the longer output does not start with the shorter one, the
template rewrites history, and the turns are then located in the final output
alone.  A turn's text is found inside its span by rendering the prefix once
more with a sentinel character in the text's place.

Rows are sorted by (conversation, turn) after one shuffle and streamed: a task
holds a few turns of one conversation.  Rendering every prefix costs the square
of a conversation's length, so a template may declare a ``horizon``, the number
of earlier turns on which a turn's rendering can depend.  Beyond ``WHOLE`` turns
only that many are rendered with a new turn; on the first ``WHOLE`` turns both
ways are compared, and a template that breaks its declaration is an error.  A
template without a horizon is rendered whole, however long.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]                      # role, text
WHOLE = 16                                  # turns whose prefixes are rendered whole
SENTINELS = [chr(c) for c in range(0xE000, 0xE040)]

TURNS = "conv_id long, turn long, place long, role string, piece string, start long, text_start long, " \
        "text_end long, loss boolean, rewritten boolean"
REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class InstTemplate:
    """``[INST]`` marks around user turns, ``<<SYS>>`` around system turns,
    ``[ROLE]`` with the name for any other role.

    A control string inside a text or a role gets one backslash after its
    first character, and one more when it has some already, so no text can
    hold a mark and unescaping gives the text back.
    """

    name = "inst"
    horizon: int | None = 1
    # The control strings, each as its first character and the rest.
    _mark = re.compile(r"<(\\*)(/?s>|</?SYS>>)|\[(\\*)(/?(?:INST|ROLE)\])")
    _turn = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<<SYS>>\n(?P<system>.*?)\n<</SYS>>\n\n"
                       r"|<s>\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<other>.*?) </s>| (?P<assistant>.*?) </s>", re.S)

    def escape(self, text: str) -> str:
        return self._mark.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(self, text: str) -> str:
        return self._mark.sub(lambda m: m[0][0] + m[0][1:].removeprefix("\\"), text)

    def turn(self, role: str, text: str) -> str:
        x = self.escape(text)
        if role == "user":
            return f"<s>[INST] {x} [/INST]"
        if role == "system":
            return f"<<SYS>>\n{x}\n<</SYS>>\n\n"
        if role == "assistant":
            return f" {x} </s>"
        return f"<s>[ROLE] {self.escape(role)} [/ROLE] {x} </s>"

    def __call__(self, turns: Sequence[Turn]) -> str:
        return "".join(self.turn(*t) for t in turns)

    def read(self, output: str) -> tuple[list[Turn], int]:
        """The turns that an output holds, and how much of it they take."""
        found, at = [], 0
        while m := self._turn.match(output, at):
            role = m.lastgroup if m.lastgroup != "other" else self.unescape(m["role"])
            found.append((role, self.unescape(m[m.lastgroup])))
            at = m.end()
        return found, at


class LastSystemTemplate(InstTemplate):
    """Rewrites history: system texts stand before the last user turn, so
    every new user turn moves them."""

    name = "inst-last-system"
    horizon = None

    def __call__(self, turns):
        system = [t for t in turns if t[0] == "system"]
        users = [k for k, t in enumerate(turns) if t[0] == "user"]
        last = users[-1] if users else len(turns)
        rest = [(k, t) for k, t in enumerate(turns) if t[0] != "system"]
        before = [t for k, t in rest if k < last]
        return super().__call__(before + system + [t for k, t in rest if k >= last])


class AnswersOnlyTemplate(InstTemplate):
    """Rewrites history: of earlier assistant turns, only what follows a
    ``</think>`` stays."""

    name = "inst-answers-only"
    horizon = None

    def __call__(self, turns):
        last = max((k for k, t in enumerate(turns) if t[0] == "assistant"), default=-1)
        return super().__call__([(r, x.rpartition("</think>")[2] if r == "assistant" and k < last else x)
                                 for k, (r, x) in enumerate(turns)])


def sentinel(turns: Sequence[Turn], output: str) -> str:
    """A private-use character that occurs neither in the turns nor in the output."""
    for c in SENTINELS:
        if c not in output and not any(c in r or c in x for r, x in turns):
            return c
    raise ValueError("every sentinel character occurs in the conversation")


def place(template, turns: Sequence[Turn], k: int, output: str) -> tuple[int, int] | None:
    """Span of turn k's text in ``output``, the rendering of ``turns``; None
    if the template does not write that text exactly once and unchanged."""
    mark = sentinel(turns, output)
    probe = template([*turns[:k], (turns[k][0], mark), *turns[k + 1:]])
    if probe.count(mark) != 1:
        return None
    start = probe.index(mark)
    end = len(output) - (len(probe) - start - 1)
    if end < start or output[:start] != probe[:start] or output[end:] != probe[start + 1:]:
        return None
    return (start, end) if output[start:end] == template.escape(turns[k][1]) else None


class Conversation:
    """One conversation, turn by turn.  :meth:`add` and :meth:`end` give
    (place, piece, start, text span, rewritten) rows; the pieces put together
    are the output."""

    def __init__(self, template):
        self.template, self.horizon = template, getattr(template, "horizon", None)
        self.turns: list[Turn] = []        # all, or the last ones beyond WHOLE
        self.n = self.length = 0
        self.whole = ""                    # output so far, while rendered whole
        self.held: list = []               # rows of a template without a horizon
        self.rewritten: set[int] = set()

    def add(self, role: str, text: str) -> list[tuple]:
        self.turns.append((role, text))
        k, self.n = self.n, self.n + 1
        if self.horizon is not None and k >= WHOLE:
            self.whole = ""
            row = self._window(k)
            del self.turns[:-self.horizon or len(self.turns)]
            return [row]
        output = self.template(self.turns)
        if not output.startswith(self.whole):
            self.rewritten.add(k)
            if self.horizon is not None:
                raise ValueError(f"template {self.template.name} declares a horizon but rewrites history")
        # In a rewritten conversation only the final output counts: see end().
        span = place(self.template, self.turns, k, output) if not self.rewritten else None
        row = (k, output[len(self.whole):], len(self.whole), span, False)
        self.whole, self.length = output, len(output)
        if self.horizon is None:
            self.held.append(row)
            return []
        if k > self.horizon and (tail := self._tail(k))[1] != row[1]:
            raise ValueError(f"template {self.template.name} looks back beyond its horizon: {tail[1]!r}, {row[1]!r}")
        return [row]

    def _tail(self, k: int) -> tuple:
        """The last turn's piece from the turns within the horizon alone, and
        the span of its text from the piece's start on."""
        window = self.turns[-self.horizon - 1:]
        before, output = self.template(window[:-1]), self.template(window)
        if not output.startswith(before):
            raise ValueError(f"template {self.template.name} declares a horizon but rewrites history")
        span = place(self.template, window, len(window) - 1, output)
        return len(before), output[len(before):], span

    def _window(self, k: int) -> tuple:
        skip, piece, span = self._tail(k)
        at, self.length = self.length, self.length + len(piece)
        return k, piece, at, span and (span[0] - skip + at, span[1] - skip + at), False

    def end(self) -> list[tuple]:
        """The rows still held.  After a rewrite, the first piece is the whole
        output and each turn's text is looked up there."""
        if not self.rewritten:
            return self.held
        return [(k, self.whole if k == 0 else "", 0 if k == 0 else self.length,
                 place(self.template, self.turns, k, self.whole), k in self.rewritten) for k in range(self.n)]


def _stream(template, loss_roles: frozenset):
    names = [f.split()[0] for f in TURNS.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 3 + [pa.bool_()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, talk, labels, out = None, None, [], []

        def emit(rows):
            for k, piece, start, span, rewritten in rows:
                turn, role = labels[k] if talk.horizon is None else labels[-1]
                lo, hi = span or (None, None)
                out.append((open_id, turn, k, role, piece, start, lo, hi,
                            span is not None and role in loss_roles, rewritten))

        def batch():
            cols = zip(*out) if out else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for part in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in part.columns)):
                if talk is None or conv != open_id:
                    if talk is not None:
                        emit(talk.end())
                    open_id, talk, labels = conv, Conversation(template), []
                if talk.horizon is not None:
                    labels.clear()
                labels.append((turn, role))
                emit(talk.add(role, text))
            yield batch()
            out = []
        if talk is not None:
            emit(talk.end())
            yield batch()
    return run


def format_turns(conversations: DataFrame, template=None, loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per turn, in conversation order within each partition.

    ``piece`` is what the turn adds to the output, from ``start`` on; the
    pieces of a conversation in order of ``place`` are its output.
    ``text_start`` and ``text_end`` bound the turn's own text in the output
    (null where the template changes or repeats it), ``loss`` marks texts to
    learn from, ``rewritten`` the turns at which the template changed what it
    had written before; the first piece of such a conversation is all of the
    output.  Offsets count code points.

    Null text and null role are empty.  Turns are ordered by (turn, role,
    text), null turns last; repeated rows are turns of their own.  Rows with
    null conv_id form one conversation.  Other columns are not read, whatever
    their names; an empty table gives no rows.  Conversations of any length
    are streamed when the template has a horizon.
    """
    template = template or InstTemplate()
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    return rows.mapInArrow(_stream(template, frozenset(loss_roles)), TURNS)


def format_conversations(conversations: DataFrame, template=None,
                         loss_roles: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, n_turns, output, loss_spans (start
    and end of every learned text) and rewrites (places of the turns at which
    the template changed earlier output).  Holds one conversation at a time."""
    schema = "conv_id long, n_turns long, output string, loss_spans array<struct<start: long, end: long>>, " \
             "rewrites array<long>"

    def run(batches):
        for rows in _conversations(batches):
            out = [list(c) for c in zip(*rows)]
            conv, _, _, _, pieces, _, lo, hi, loss, rewritten = out
            yield pa.RecordBatch.from_pylist([{
                "conv_id": conv[0], "n_turns": len(conv), "output": "".join(pieces),
                "loss_spans": [{"start": s, "end": e} for s, e, x in zip(lo, hi, loss) if x],
                "rewrites": [k for k, x in enumerate(rewritten) if x]}], pa.schema(
                    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("output", pa.string()),
                     ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     ("rewrites", pa.list_(pa.int64()))]))
    return format_turns(conversations, template, loss_roles).mapInArrow(run, schema)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of :func:`format_turns`, one conversation at a time."""
    held: list[tuple] = []
    for row in _rows(batches):
        if row[2] == 0 and held:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for part in batches:
        yield from zip(*(c.to_pylist() for c in part.columns))


def read_back(turns: DataFrame, template=None) -> DataFrame:
    """What the formatted output says, one row per conversation: ``REPORT``.

    The pieces are joined to a stream and parsed by the template's marks;
    ``turns_sha256`` digests role, \\n, text, \\n of every turn read, and the
    loss columns the unescaped texts under the loss mask.  Takes the rows of
    :func:`format_turns` as they lie; texts stream through the digests.
    """
    template = template or InstTemplate()
    names = [f.split()[0] for f in REPORT.split(", ")]

    def run(batches):
        state = None
        for part in batches:
            done = []
            for row in zip(*(c.to_pylist() for c in part.columns)):
                if state is None or row[2] == 0:
                    if state is not None:
                        done.append(state.result())
                    state = _Reader(template, row[0])
                state.take(*row[4:9])
            yield _report_batch(done, names)
        if state is not None:
            yield _report_batch([state.result()], names)
    return turns.mapInArrow(run, REPORT)


def _report_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    cols = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)


class _Reader:
    """Digests of one conversation's output, piece by piece.  Output is kept
    only as long as a turn or a masked text in it is not complete."""

    def __init__(self, template, conv_id):
        self.template, self.conv_id = template, conv_id
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.length = 0
        self.rest = ""                      # output not yet parsed
        self.kept, self.kept_at = "", 0     # output that a mask may still point into

    def take(self, piece, start, lo, hi, loss) -> None:
        self.length += len(piece)
        found, at = self.template.read(self.rest + piece)
        self.rest = (self.rest + piece)[at:]
        for role, text in found:
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if piece:
            self.kept, self.kept_at = piece, start
        if loss:
            text = self.template.unescape(self.kept[lo - self.kept_at:hi - self.kept_at])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def result(self) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {self.conv_id}: {len(self.rest)} code points of output cannot be read back")
        return (self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.length)


def write_jsonl(conversations: DataFrame, path: str, template=None, loss_roles: Sequence[str] = ("assistant",)) -> str:
    """Training files: one JSON object per conversation, as
    :func:`format_conversations` gives it, in the shared folder ``path``."""
    format_conversations(conversations, template, loss_roles).write.option("compression", "gzip").json(path)
    return path
