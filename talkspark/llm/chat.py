"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string.  Successive prefixes of
a conversation are rendered; what an output adds to the one before is the span of the new turn.
An output that doesn't begin with the one before shows a template that rewrites history.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
Reader = Callable[[str], list[tuple[str, str, int, int]]]

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings with a meaning to this template or to common tokenizers; none may come from a text.
CONTROLS = (TURN, TEXT, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROLS)))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}\n", re.DOTALL)


def escape(text: str) -> str:
    """Doubles backslashes, then puts one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def markup(turns: list[Turn]) -> str:
    """The template of the query: marked turns, escaped roles and texts."""
    return "".join(f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}\n" for role, text in turns)


#: Declares that an output is the turns' own outputs side by side, whatever comes before or after.
markup.concatenative = True


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the span of the (escaped) text of each turn in a ``markup`` output."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


class Incremental:
    """Renders a conversation turn by turn.

    ``add`` returns what the new turn adds (all of the output if the history changed) and whether
    the history stayed.  After ``window`` turns a template that is declared ``concatenative`` gets
    the last turn only, so that the cost stays linear in the turns; any other one gets all turns
    each time, as only a look at the whole output shows that it leaves the history alone.
    """

    def __init__(self, template: Template, window: int = 32):
        self.template, self.window = template, window
        self.turns: list[Turn] = []
        self.out = ""
        self.gone = 0  # characters of turns that are not rendered again
        self.rewrites = 0

    def add(self, turn: Turn) -> tuple[str, bool]:
        new = self.template([*self.turns, turn])
        kept = new.startswith(self.out)
        added = new[len(self.out) :] if kept else new
        self.rewrites += not kept
        self.turns.append(turn)
        self.out = new
        if getattr(self.template, "concatenative", False) and not self.rewrites and len(self.turns) >= self.window:
            tail = self.template(self.turns[-1:])
            if new.endswith(tail):
                self.gone += len(new) - len(tail)
                self.turns, self.out = self.turns[-1:], tail
        return added, kept

    @property
    def length(self) -> int:
        return self.gone + len(self.out)


def locate(template: Template, turns: list[Turn]) -> tuple[str, list[tuple[int, int]], list[int]]:
    """Output, span of each turn, and the numbers of the turns that rewrote history.

    The span of a turn that rewrites begins where the two outputs part.
    """
    out, spans, rewriting = "", [], []
    for i in range(len(turns)):
        new = template(turns[: i + 1])
        start = len(out)
        if not new.startswith(out):
            rewriting.append(i)
            start = next((k for k, (a, b) in enumerate(zip(out, new)) if a != b), min(len(out), len(new)))
        spans.append((start, len(new)))
        out = new
    return out, spans, rewriting


class _Digest:
    def __init__(self, conv: int | None, template: Template, reader: Reader):
        self.conv, self.reader = conv, reader
        self.steps = Incremental(template)
        self.given = 0
        self.rewriting: list[int] = []
        self.clear()

    def clear(self) -> None:
        self.n = self.loss = 0
        self.turns, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        added, kept = self.steps.add((role, text))
        if not kept:
            self.rewriting.append(self.given)
        self.given += 1
        if not self.rewriting:
            self.read(added)

    def read(self, formatted: str) -> None:
        for r, t, _, _ in self.reader(formatted):
            self.n += 1
            self.turns.update(f"{r}\n{t}\n".encode())
            if r == "assistant":
                self.loss += len(t)
                self.masked.update(t.encode())

    def row(self) -> tuple:
        if self.rewriting:  # what was read before no longer stands
            self.clear()
            self.read(self.steps.out)
        return (self.conv, self.n, self.turns.hexdigest(), self.loss, self.masked.hexdigest(), self.steps.length, self.rewriting)


def in_order(conversations: DataFrame) -> DataFrame:
    """Rows of a conversation side by side, by turn, then role and text; nulls first."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_all(conversations: DataFrame, template: Template = markup, reader: Reader = read_back) -> DataFrame:
    """``conv_id, formatted, loss_spans, rewriting`` with one row per conversation.

    ``loss_spans`` are (start, end) code points of the assistant texts that ``reader`` finds in the
    output (escaped ones in ``markup``); ``rewriting`` are the numbers of the turns, from 0, that
    changed the output of those before.  Null role and text
    are empty; rows without conv_id form one conversation; ties in ``turn`` are ordered by role and
    text; an empty table gives an empty result.  One formatted conversation must fit in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(conv, pieces, rewriting):
            text = "".join(pieces)
            spans = [[a, b] for r, _, a, b in reader(text) if r == "assistant"]
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([text]), pa.array([spans], pa.list_(pa.list_(pa.int64()))), pa.array([rewriting], pa.list_(pa.int64()))],
                names=["conv_id", "formatted", "loss_spans", "rewriting"],
            )

        conv, steps, pieces, number, rewriting = None, None, [], 0, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if steps is None or c != conv:
                    if steps is not None:
                        yield emit(conv, pieces, rewriting)
                    conv, steps, pieces, number, rewriting = c, Incremental(template), [], 0, []
                added, kept = steps.add((role or "", text or ""))
                if not kept:
                    pieces.clear()
                    rewriting.append(number)
                pieces.append(added)
                number += 1
        if steps is not None:
            yield emit(conv, pieces, rewriting)

    return in_order(conversations).mapInArrow(run, "conv_id long, formatted string, loss_spans array<array<long>>, rewriting array<long>")


def digests(conversations: DataFrame, template: Template = markup, reader: Reader = read_back) -> DataFrame:
    """What ``reader`` finds in the formatted conversations, one row each, and the rewriting turns.

    Turns stream through in sorted order, so with a ``concatenative`` template a conversation may
    be longer than memory: its task holds one Arrow batch and a short window of turns.  With any
    other template it holds the conversation.  Cases as in ``format_all``.
    """

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewriting"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Digest | None = None
        for batch in batches:
            done = []
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
                if current is None or c != current.conv:
                    if current is not None:
                        done.append(current.row())
                    current = _Digest(c, template, reader)
                current.add(role or "", text or "")
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*done), kinds)], names=names)
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(current.row(), kinds)], names=names)

    return in_order(conversations).mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewriting array<long>"
    )
