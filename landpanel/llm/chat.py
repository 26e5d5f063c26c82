"""Operator 10: chat formatting by a finite-state machine over roles.

The rows of a conversation, in the order of their turns, drive a machine whose states are roles. A template declares
which role may follow which, the text put before and after a turn, and whether a role's text counts for the loss. The
machine emits segments (text, in_loss): marks and texts apart, so the loss mask covers exactly the texts of the roles
that the template names. Control strings inside texts are escaped reversibly: every escape character is doubled and
one is put behind the first character of each mark, so no mark can appear inside an escaped text.

Rows are dealt out by conversation and sorted by turn inside their partitions; the machine reads them as a stream and
gives each segment away at once, so a conversation of any length needs the memory of one turn.

Defined results: null text is the empty text; a null role is the role `?`; a role that the template does not declare
breaks the order wherever it stands, has no loss, leaves the state as it was, and its turn keeps the role's name; rows
with equal turn stand in the order of role and text, each turn whole; `in_order` is false from a turn that breaks the order,
and its rows are still formatted; rows without a conversation id form one conversation with a null id; an empty table
gives an empty result; other columns are not read. One conversation is read by one task, since its digests and its states
run along its turns; the task holds one turn of it.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty


@dataclass(frozen=True)
class Template:
    open: str = "<|im_start|>"
    close: str = "<|im_end|>"
    after_role: str = "\n"
    after_turn: str = "\n"
    escape: str = "\\"
    loss: tuple[str, ...] = ("assistant",)
    #: What may follow each state; "" is the beginning.
    follows: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def hide(self, text: str) -> str:
        e = self.escape
        text = text.replace(e, e + e)
        for mark in (self.open, self.close):
            text = text.replace(mark, mark[0] + e + mark[1:])
        return text

    def show(self, text: str) -> str:
        e = self.escape
        text = re.sub(re.escape(e) + "(.)|" + "|".join(re.escape(m[0] + e + m[1:]) for m in (self.open, self.close)), lambda m: m[1] if m[1] else m[0].replace(e, "", 1), text, flags=re.S)
        return text

    def hide_role(self, role: str) -> str:
        return self.hide(role).replace(self.after_role, self.escape + "N")

    def show_role(self, role: str) -> str:
        e = re.escape(self.escape)
        return "".join(self.after_role if x == self.escape + "N" else self.show(x) for x in re.findall(f"{e}.|[^{e}]+", role, re.S))

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The turn as (text, in_loss) pieces, in order."""
        return [(self.open + self.hide_role(role) + self.after_role, False), (self.hide(text), role in self.loss), (self.close + self.after_turn, False)]

    def turns(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn, read back from formatted text."""
        out = []
        for part in formatted.split(self.open)[1:]:
            head, _, _ = part.partition(self.close)
            role, _, text = head.partition(self.after_role)
            out.append((self.show_role(role), self.show(text)))
        return out

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """(next state, whether the turn is in order)."""
        if role not in self.follows:
            return state, False
        return role, role in self.follows.get(state, ())


def ordered(turns: DataFrame) -> DataFrame:
    """Every conversation's rows in one partition, in the order of turns."""
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("?")).alias("role"), text_or_empty().alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def segments(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, row, turn, role, part, segment, in_loss, in_order): the formatted text in pieces, three for each turn.

    `row` numbers the turns of a conversation from 0; the order of the text is that of (row, part).
    """
    tpl = template or Template()
    schema = "conv_id bigint, row bigint, turn bigint, role string, part int, segment string, in_loss boolean, in_order boolean"

    def run(batches):
        import pyarrow as pa

        last, state, row = object(), "", -1
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for conv, turn, role, text in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns), strict=True):
                    state, row = (state, row + 1) if conv == last else ("", 0)
                    last = conv
                    state, fine = tpl.step(state, role)
                    out += [(conv, row, turn, role, k, s, loss, fine) for k, (s, loss) in enumerate(tpl.segments(role, text))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=["conv_id", "row", "turn", "role", "part", "segment", "in_loss", "in_order"])

    return ordered(turns).mapInArrow(run, schema)


def digests(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """One row for each conversation, read back from its segments, which stand together and in order.

    A turn is read back by joining its segments and parsing the marks; digests run along the conversation.
    """
    tpl = template or Template()
    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, in_order boolean"

    def run(batches):
        import pyarrow as pa

        last, held, s = None, "", None

        def done():
            return (last[0], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"], s["fine"])

        def table(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "in_order"])

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = []
                for conv, part, segment, in_loss, fine in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    if last is None or conv != last[0]:
                        if last is not None:
                            out.append(done())
                        last, held, s = (conv,), "", {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "fine": True}
                    s["all"] += len(segment)
                    s["fine"] &= fine
                    if in_loss:
                        text = tpl.show(segment)
                        s["chars"] += len(text)
                        s["loss"].update(text.encode("utf-8", "surrogatepass"))
                    held = segment if part == 0 else held + segment
                    if part == 2:
                        for role, text in tpl.turns(held):
                            s["n"] += 1
                            s["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                        held = ""
                if out:
                    yield table(out)
        if last is not None:
            yield table([done()])

    return parts.select("conv_id", "part", "segment", "in_loss", "in_order").mapInArrow(run, schema)


def formatted(parts: DataFrame, longest: int = 1_000_000) -> DataFrame:
    """(conv_id, piece, start, formatted, loss_spans): the text of each conversation, and where in it the loss counts.

    A conversation is one row unless it has more than `longest` characters; then it goes on in pieces numbered from 0, each
    of whole turns and no longer than that, but for a turn that is longer by itself. `start` and the spans, JSON pairs of
    (start, end), count characters from the beginning of the conversation.
    """
    schema = "conv_id bigint, piece int, start bigint, formatted string, loss_spans string"

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string())
        last, piece, start, at, text, spans, turn = None, 0, 0, 0, [], [], []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((last[0], piece, start, "".join(text), json.dumps(spans)), kinds, strict=True)], names=["conv_id", "piece", "start", "formatted", "loss_spans"])

        for batch in batches:
            for at_row in range(0, batch.num_rows, 512):
                for conv, part, segment, in_loss in zip(*(c.to_pylist() for c in batch.slice(at_row, 512).columns), strict=True):
                    if last is None or conv != last[0]:
                        if last is not None:
                            yield out()
                        last, piece, start, at, text, spans = (conv,), 0, 0, 0, [], []
                    turn = [(segment, in_loss)] if part == 0 else [*turn, (segment, in_loss)]
                    if part < 2:
                        continue
                    size = sum(len(x) for x, _ in turn)
                    if text and at + size - start > longest:
                        yield out()
                        piece, start, text, spans = piece + 1, at, [], []
                    for x, loss in turn:
                        if loss:
                            spans.append((at, at + len(x)))
                        text.append(x)
                        at += len(x)
        if last is not None:
            yield out()

    return parts.select("conv_id", "part", "segment", "in_loss").mapInArrow(run, schema)
