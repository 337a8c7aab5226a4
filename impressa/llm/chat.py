"""Chat formatting in budgeted windows.

Turns are counted in tokens and their prefix sums taken per conversation.  A
conversation is cut at turns into windows of at most ``budget`` tokens: each
window repeats the system turn and up to ``history`` tokens of the turns
before, then takes the next turns whose prefix sum still fits.  The loss mask
covers the assistant texts of the new turns; those of repeated turns are
masked, so every assistant text is a target exactly once.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside a
text are escaped reversibly: ``<`` with any backslashes before ``|`` gets one
more backslash.

Null texts and roles are empty; rows that repeat a turn number are all kept,
ordered by role and text; a turn beyond the budget is a window of its own,
marked ``over_budget``; a null conv_id is a conversation; an empty table gives
no windows.  A conversation is streamed by one task, its windows leave as they
fill; no more than a window and the history are held.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impressa.llm.shared import small_batches, trimmed
from impressa.llm.tokens import broadcast_file
from impressa.llm.tokens import count_tokens as tokens_of

BUDGET = 512
HISTORY = 128
START, END = "<|im_start|>", "<|im_end|>\n"
_PER_TURN = 6  # tokens of the template around a turn
_WINDOWS = "conv_id long, window_id long, first_new long, n_turns long, n_new long, n_tokens long, over_budget boolean, text string, loss array<struct<start:long,end:long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def count_tokens(turns: DataFrame, tokenizer: str | None) -> DataFrame:
    """Adds n: tokens of the text by the tokenizer file, or words and marks if None."""
    if tokenizer is None:
        words = F.regexp_count(F.col("text"), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"))
        return turns.withColumn("n", words.cast("long"))

    raw = broadcast_file(turns.sparkSession, tokenizer)

    @trimmed
    def run(batches):
        for batch in batches:
            yield batch.append_column("n", pa.array(tokens_of(batch.column("text"), raw.value)))

    return turns.mapInArrow(run, "conv_id long, turn long, role string, text string, n long")


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return small_batches(turns).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


class _Builder:
    """Windows of one conversation, fed turn by turn with the prefix sums."""

    def __init__(self, conv, budget, history):
        self.conv, self.budget, self.history = conv, budget, history
        self.system, self.before, self.new = None, [], []
        self.seen = self.windows = 0

    def add(self, role, text, n, through):
        """through: the prefix sum of tokens up to and with this turn."""
        out = []
        if self.new and self.base + through - self.new[0][3] > self.budget:
            out.append(self.close())
        if not self.new:
            self.base = (self.system[2] if self.system and self.seen else 0) + self._fit_history(n)
        self.new.append((role, text, n, through - n))
        if not self.seen and self.system is None and role == "system":
            self.system = (role, text, n)
        self.seen += 1
        return out

    def _fit_history(self, n):
        """Drops repeated turns from the front until they fit history and leave room for the turn."""
        room = self.budget - n - (self.system[2] if self.system else 0)
        total = sum(t[2] for t in self.before)
        while self.before and (total > self.history or total > room):
            total -= self.before.pop(0)[2]
        return total

    def close(self):
        first = self.seen - len(self.new)
        head = ([self.system] if self.system and first else []) + self.before
        text, at, loss = [], 0, []
        for k, t in enumerate([*head, *self.new]):
            opening, body = f"{START}{escape_role(t[0])}\n", escape(t[1])
            if k >= len(head) and t[0] == "assistant":
                loss.append({"start": at + len(opening), "end": at + len(opening) + len(body)})
            text += [opening, body, END]
            at += len(opening) + len(body) + len(END)
        n = sum(t[2] for t in head) + sum(t[2] for t in self.new)
        row = (self.conv, self.windows, first, len(head) + len(self.new), len(self.new), n, n > self.budget, "".join(text), loss)
        self.before = ([] if not first and self.system else self.before) + [t[:3] for i, t in enumerate(self.new) if first + i or not self.system]
        total = sum(t[2] for t in self.before)
        while self.before and total > self.history:
            total -= self.before.pop(0)[2]
        self.windows, self.new = self.windows + 1, []
        return row


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY, tokenizer: str | None = None) -> DataFrame:
    """The formatted windows: text, loss spans in code points of the text, token count, and which turns are new."""
    rows = count_tokens(_ordered(turns, conv, turn, role, text), tokenizer).withColumn("n", F.col("n") + _PER_TURN)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("through", F.sum("n").over(order)).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    @trimmed
    def run(batches):
        now, out = None, []

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 9
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.string(), _SPANS]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "window_id", "first_new", "n_turns", "n_new", "n_tokens", "over_budget", "text", "loss"])

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "n", "through"))
            for c, r, t, n, through in zip(*cols, strict=True):
                if now is None or now.conv != c:
                    if now and now.new:
                        out.append(now.close())
                    now = _Builder(c, budget, history)
                out += now.add(r, t, n, through)
            yield flush()
            out = []
        if now and now.new:
            out.append(now.close())
        yield flush()

    return rows.mapInArrow(run, _WINDOWS)


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted window."""
    found = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        found.append((unescape_role(role), unescape(body[: -len(END)])))
    return found


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the windows alone: turns, loss text and sizes.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn),
    loss_chars, loss_sha256, formatted_chars, n_windows.
    """
    rows = formatted.select("conv_id", "window_id", "n_new", "text", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window_id")

    @trimmed
    def run(batches):
        out, now, has = [], None, False
        turns = loss = None
        sums = [0, 0, 0, 0]

        def done():
            out.append((now, sums[0], turns.hexdigest(), sums[1], loss.hexdigest(), sums[2], sums[3]))

        def flush():
            cols = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])

        for batch in batches:
            for r in batch.to_pylist():
                if not has or r["conv_id"] != now:
                    if has:
                        done()
                    now, has, turns, loss, sums = r["conv_id"], True, hashlib.sha256(), hashlib.sha256(), [0, 0, 0, 0]
                for role, body in parse(r["text"])[-r["n_new"] :]:
                    turns.update(f"{role}\n{body}\n".encode())
                    sums[0] += 1
                for span in r["loss"]:
                    body = unescape(r["text"][span["start"] : span["end"]])
                    loss.update(body.encode())
                    sums[1] += len(body)
                sums[2] += len(r["text"])
                sums[3] += 1
            yield flush()
            out = []
        if has:
            done()
        yield flush()

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
