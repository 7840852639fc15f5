"""Chat formatting with token-budgeted windows.

Plan: turns are tokenized where they lie; then one shuffle by conversation, ordered inside the
partitions, and a pass that holds the turns of one window at a time and only joins strings, so that a
conversation with a large share of all turns costs its task little. Prefix sums of turn tokens choose the spans: a window takes the system
turn, as many of the latest turns as the history budget allows, and then the longest run of new
turns that fits. Repeated turns make way where a new turn would not fit beside them. Turns are never
cut: only one that is longer than the budget itself makes a longer window, which holds nothing else.
Repeated turns (system and history) are outside the loss mask, so every assistant text is a target
exactly once.

Template: ``<|turn|>role<|text|>text<|end|>``. A control string inside a role or a text gets a
backslash behind its first character and every backslash is doubled, which ``unescape`` undoes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_width, text_or_empty

BUDGET = 2048
#: Turns that a window repeats at most, and the share of the budget that they may take.
HISTORY_TURNS, HISTORY_SHARE = 4, 0.25
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: What a template or a tokenizer may read as control.
CONTROL = re.compile(r"<\|[A-Za-z0-9_]*\|>|</?s>|\[/?INST\]|<</?SYS>>")
PARSE = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)

WINDOW_SCHEMA = "conv_id long, window long, first_turn long, n_new long, n_repeated long, n_tokens long, text string, loss array<struct<start: long, end: long>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
WINDOW_ARROW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("first_turn", pa.int64()), ("n_new", pa.int64()), ("n_repeated", pa.int64()), ("n_tokens", pa.int64()), ("text", pa.string()), ("loss", SPAN)])
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
READ_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


class Windows:
    """The windows of one conversation; ``push`` and ``finish`` yield rows of WINDOW_SCHEMA.

    What a window repeats is settled when its first new turn is known: history is given up first, the
    oldest turns before the others, then the system turn, until the new turn fits into the budget.
    """

    def __init__(self, conv, budget: int, history_turns: int, history_tokens: int):
        self.conv, self.budget, self.history_turns, self.history_tokens = conv, budget, history_turns, history_tokens
        self.system: list = []
        self.history: list = []  # the latest turns that earlier windows hold
        self.old: list = []  # repeated turns of the window that is being filled
        self.turns: list = []  # its new turns
        self.sums = [0]  # prefix sums of the tokens of all its turns
        self.seen = self.window = 0

    def repeated(self, tokens: int) -> list:
        """The system turn and the longest tail of the history that leave room for ``tokens``."""
        room = self.budget - tokens
        kept = self.system if self.window and sum(t[2] for t in self.system) <= room else []
        room, tail = min(self.history_tokens, room - sum(t[2] for t in kept)), []
        for turn in reversed(self.history):
            room -= turn[2]
            if room < 0:
                break
            tail.append(turn)
        return kept + tail[::-1]

    def push(self, role: str, text: str, tokens: int) -> Iterator[tuple]:
        if self.turns and self.sums[-1] + tokens > self.budget:
            yield self.close()
        if not self.turns:
            self.old = self.repeated(tokens)
            for turn in self.old:
                self.sums.append(self.sums[-1] + turn[2])
        if not self.seen and not self.turns and role == "system":
            self.system = [(role, text, tokens)]
        self.turns.append((role, text, tokens))
        self.sums.append(self.sums[-1] + tokens)

    def close(self) -> tuple:
        at, parts, loss = 0, [], []
        for k, (role, text, _) in enumerate(self.old + self.turns):
            whole = format_turn(role, text)
            if k >= len(self.old) and role == "assistant":
                start = at + len(TURN) + len(escape(role)) + len(TEXT)
                loss.append({"start": start, "end": at + len(whole) - len(END)})
            parts.append(whole)
            at += len(whole)
        row = (self.conv, self.window, self.seen, len(self.turns), len(self.old), self.sums[-1], "".join(parts), loss)
        fresh = self.turns[1:] if self.system and not self.window else self.turns
        self.history = (self.history + fresh)[-self.history_turns :] if self.history_turns else []
        self.seen += len(self.turns)
        self.window += 1
        self.old, self.turns, self.sums = [], [], [0]
        return row

    def finish(self) -> Iterator[tuple]:
        if self.turns:
            yield self.close()


def _batches(rows: Iterator[tuple], schema: pa.Schema, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    def batch(held):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + sum(len(x) for x in row if isinstance(x, str))
        if size > chars:
            yield batch(held)
            held, size = [], 0
    if held:
        yield batch(held)


def format_chats(chats: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, history_turns: int = HISTORY_TURNS) -> DataFrame:
    """Windows of the conversations, as rows of WINDOW_SCHEMA, ordered by (conversation, window) inside each partition.

    ``loss`` holds the half-open spans of ``text``, in code points, that are training targets. A
    null text or role counts as empty. Turns go by ``turn``, nulls first, ties by role and then
    text; repeated rows are turns of their own. Rows with a null conversation id form one
    conversation of a null id. An empty table gives no windows; other columns are ignored.
    """
    rows = chats.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text_or_empty(F.col(role_col)).alias("role"), text_or_empty(F.col(text_col)).alias("text")
    )
    counted = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64())])

    def count(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [format_turn(r, t) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                sizes = [len(x.ids) for x in tokenizer.encode_batch_fast(made, add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([*(c.cast(t) for c, t in zip(part.columns, counted.types[:4], strict=True)), pa.array(sizes, pa.int64())], schema=counted)

    sized = rows.mapInArrow(count, "conv_id long, turn long, role string, text string, n long")
    dealt = sized.repartition(shuffle_width(chats.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def windows(batches):
        now = None
        for batch in batches:
            for c, r, t, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if now is None or now.conv != c:
                    if now is not None:
                        yield from now.finish()
                    now = Windows(c, budget, history_turns, int(budget * HISTORY_SHARE))
                yield from now.push(r, t, n)
        if now is not None:
            yield from now.finish()

    return dealt.mapInArrow(lambda batches: _batches(windows(batches), WINDOW_ARROW), WINDOW_SCHEMA)


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of ``format_chats`` say, one row per conversation (READ_SCHEMA).

    Texts and roles are parsed out of the formatted windows and unescaped; repeated turns are left
    out by their number. ``windows`` must hold a conversation's windows together and in order, as
    ``format_chats`` returns them.
    """

    def read(batches):
        conv = turns = None
        for batch in batches:
            for row in batch.to_pylist():
                if turns is None or row["conv_id"] != conv:
                    if turns is not None:
                        yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars
                    conv, n, loss_chars, chars, turns, loss = row["conv_id"], 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                text = row["text"]
                chars += len(text)
                for k, m in enumerate(PARSE.finditer(text)):
                    if k >= row["n_repeated"]:
                        n += 1
                        turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                for span in row["loss"]:
                    target = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(target)
                    loss.update(target.encode())
        if turns is not None:
            yield conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    return windows.mapInArrow(lambda batches: _batches(read(batches), READ_ARROW), READ_SCHEMA)
