"""Chat formatting from event logs.

A log holds events ``conv_id, seq, turn, kind, role, text``:

* ``message``     a whole turn at once; a second one with the same number is a turn of its own,
* ``delta``       streamed text: appends to the turn (the first one opens it),
* ``edit``        replaces the turn's text, and drops what later turns held before it,
* ``regenerate``  the same for an answer that is given anew; deltas may follow.

The log is partitioned by conversation and sorted by (turn, seq), so all events of
a turn come together and the fold keeps one message in memory, however long the
conversation is: an event counts if no edit of an earlier turn has a higher seq,
and the running maximum of those is all that is carried on. Every finished message
is rendered at once into a segment; a conversation's text is its segments in order.

Template: ``<s>[INST] user [/INST]``, `` assistant </s>``, and for other roles
``<|turn|>role<|text|>text<|end|>``. Inside texts a backslash is doubled, and one is put
behind the first character of every control string, so no text can pose as a turn
and ``read_back`` restores every text exactly.

Null text and role are empty, a null seq or turn comes first, a null or unknown kind
is ``message``. Events with equal (turn, seq) apply in order of kind, role and text. A
null conversation id is a conversation of its own. An empty log gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismview.llm.scratch import written

#: Fixed control strings of the template.
BEGIN, END, ASK, ANSWER, TURN, BODY, STOP = "<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|text|>", "<|end|>"

NEEDS_MARK = re.compile(r"\\|" + "|".join(re.escape(c) for c in (BEGIN, END, ASK, ANSWER, TURN, BODY, STOP)))
MARKED = re.compile(r"\\(\\?)")

EVENT = ("conv_id long", "seq long", "turn long", "kind string", "role string", "text string")
RENDERED = "conv_id long, turn long, segment string, loss_start int, loss_end int"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return NEEDS_MARK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """A doubled backslash is one; a single one was put there by ``escape``."""
    return MARKED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """A turn's segment, and where in it the text to learn lies."""
    safe = escape(text)
    if role == "user":
        return f"{BEGIN}{ASK} {safe} {ANSWER}", None, None
    if role == "assistant":
        return f" {safe} {END}", 1, 1 + len(safe)
    return f"{TURN}{escape(role)}{BODY}{safe}{STOP}", None, None


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    at = 0

    def until(mark: str) -> str:
        nonlocal at
        end = formatted.index(mark, at)
        part, at = formatted[at:end], end + len(mark)
        return unescape(part)

    while at < len(formatted):
        if formatted.startswith(f"{BEGIN}{ASK} ", at):
            at += len(BEGIN) + len(ASK) + 1
            yield "user", until(f" {ANSWER}")
        elif formatted.startswith(" ", at):
            at += 1
            yield "assistant", until(f" {END}")
        else:
            at += len(TURN)
            role = until(BODY)
            yield role, until(STOP)


class Fold:
    """Events of one conversation in (turn, seq) order to final messages."""

    def __init__(self):
        self.cut, self.turn, self.latest = -1, None, -1  # edits of earlier turns; the present turn and its own edits
        self.role, self.parts = "", None

    def close(self) -> Iterator[tuple[str, str]]:
        if self.parts is not None:
            yield self.role, "".join(self.parts)
        self.parts, self.role = None, ""

    def event(self, seq: int, turn: int, kind: str, role: str, text: str) -> Iterator[tuple[str, str]]:
        if turn != self.turn:
            yield from self.close()
            self.cut, self.turn, self.latest = max(self.cut, self.latest), turn, -1
        if seq < self.cut:
            return
        if kind == "delta":
            self.parts = [] if self.parts is None else self.parts
            self.parts.append(text)
        elif kind in ("edit", "regenerate"):
            self.parts, self.latest = [text], max(self.latest, seq)
        else:
            yield from self.close()
            self.parts = [text]
        self.role = role or self.role


def fold_log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted events to rendered turns; one message is held at a time."""
    fold, conversation, number, started = Fold(), None, 0, False
    for batch in batches:
        out: list[tuple] = []

        def add(messages: Iterator[tuple[str, str]], out: list = out) -> None:
            nonlocal number
            for role, text in messages:
                out.append((conversation, number, *render(role, text)))
                number += 1

        for conv, seq, turn, kind, role, text in zip(*[batch[c.split()[0]].to_pylist() for c in EVENT], strict=True):
            if conv != conversation or not started:
                add(fold.close())
                fold, conversation, number, started = Fold(), conv, 0, True
            add(fold.event(-1 if seq is None else seq, -1 if turn is None else turn, kind or "message", role or "", text or ""))
        yield rendered(out)
    yield rendered([(conversation, number, *render(role, text)) for role, text in fold.close()])


def rendered(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "turn", "segment", "loss_start", "loss_end"])


def digest_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the formatted text of each conversation holds, read back from it."""
    at, started = None, False
    turns = loss = None
    n_turns = loss_chars = chars = 0
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    for batch in batches:
        for conv, segment, begin, end in zip(*[batch[c].to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end")], strict=True):
            if conv != at or not started:
                if started:
                    out.append((at, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                at, started, turns, loss, n_turns, loss_chars, chars = conv, True, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            chars += len(segment)
            for role, text in read_back(segment):
                n_turns += 1
                turns.update(f"{role}\n{text}\n".encode())
            if begin is not None:
                learnt = unescape(segment[begin:end])
                loss_chars += len(learnt)
                loss.update(learnt.encode())
        yield flush()
    if started:
        out.append((at, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
    yield flush()


def format_log(events: DataFrame) -> DataFrame:
    """Rendered turns ``conv_id, turn, segment, loss_start, loss_end``, each conversation's in order within one partition."""
    columns = [F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in EVENT]
    ordered = events.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")
    return ordered.mapInArrow(fold_log, RENDERED)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as a log."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")


def format_digests(events: DataFrame) -> DataFrame:
    """Per conversation: what its formatted text holds, read back from it."""
    return written(format_log(events).mapInArrow(digest_turns, DIGEST), "digests")
