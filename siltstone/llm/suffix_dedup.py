"""Removal of repeated passages with a distributed merge sort of suffixes.

A byte goes if a passage of ``width`` bytes covers it that also starts earlier in the corpus. Sorting
every suffix would move the corpus a hundred times over, so suffixes are taken at anchors that the
content alone chooses: of every ``width`` consecutive bytes, the position with the least hash of the
next ``GRAM`` bytes (leftmost if equal). Two equal passages hold the same anchor at the same place,
so every repeat is seen from an anchor, and an anchor's surroundings (up to ``width - GRAM`` bytes
before it and ``width`` behind) decide about all passages that it stands for.

Plan:
1. A narrow pass finds the anchors. Within a task's slice, anchors with equal surroundings are folded
   onto the earliest one, so masses of copies leave it once. Of what remains, the gram hashes are
   exchanged by hash: only grams that occur again anywhere go on.
2. The suffixes at these anchors are sorted in each task and exchanged by gram as front-coded runs:
   what a suffix shares with the one before it is sent as a number.
3. Each partition merges its runs with a loser tree that keeps, for every head, the length of the
   prefix it is known to share with the last output; bytes below that are never compared again. Equal
   grams come out together, and the earliest of equal passages is found inside each such group.
4. The spans go back to their documents.

Documents meet their rows twice through one exchange by row, which Spark reuses.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesarrays import STEP, STEP_INVERSE, byte_values, chunks, mix, powers, run_hashes, same_bytes
from .common import shuffle_width, text_or_empty

WIDTH = 100
GRAM = 32
#: Bytes of text in a slice that a task works on at once; a longer document is a slice of its own.
SLICE = 2 << 20
#: Anchors that a task gathers before it sends a run to each partition.
RUN = 400_000
#: Up to this many different surroundings of one gram are compared in pairs; beyond, by sets of passages.
PAIRWISE = 20
INDEX_BITS = 23

SPANS = "array<struct<start: long, end: long>>"
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FIRST_SCHEMA = f"part int, payload binary, row long, spans {SPANS}, anchors array<long>"
FIRST_ARROW = pa.schema([("part", pa.int32()), ("payload", pa.binary()), ("row", pa.int64()), ("spans", SPAN_ARROW), ("anchors", pa.list_(pa.int64()))])
RUN_SCHEMA, RUN_ARROW = "part int, payload binary", pa.schema([("part", pa.int32()), ("payload", pa.binary())])
ROW_SCHEMA = f"row long, spans {SPANS}, anchors array<long>"
ROW_ARROW = pa.schema([("row", pa.int64()), ("spans", SPAN_ARROW), ("anchors", pa.list_(pa.int64()))])


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema.types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed payload."""
    head = b"".join(struct.pack("<2sQ", a.dtype.str[1:].encode(), a.size) for a in arrays)
    return struct.pack("<I", len(arrays)) + head + zstandard.ZstdCompressor(level=1).compress(b"".join(a.tobytes() for a in arrays))


def unpack(payload: bytes) -> list[np.ndarray]:
    count = struct.unpack_from("<I", payload)[0]
    kinds = [struct.unpack_from("<2sQ", payload, 4 + 10 * k) for k in range(count)]
    body, at, out = zstandard.ZstdDecompressor().decompress(payload[4 + 10 * count :]), 0, []
    for kind, size in kinds:
        out.append(np.frombuffer(body, "<" + kind.decode(), size, at))
        at += out[-1].nbytes
    return out


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the ``gram`` bytes at each position that has as many behind it."""
    n = len(data) - gram + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * powers(len(data), STEP, "up"), out=sums[1:])
    return mix((sums[gram:] - sums[:n]) * powers(len(data) + 1, STEP_INVERSE, "down")[:n])


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of all passages that lie inside one row, and their gram hashes."""
    hashed, span = gram_hashes(data, gram), width - gram + 1
    windows = len(data) - width + 1
    if windows <= 0:
        return np.zeros(0, np.int64), hashed[:0]
    edge = np.zeros(len(data) + 1, np.int64)
    ends = offsets[1:][np.diff(offsets) > 0]
    begins = offsets[:-1][np.diff(offsets) > 0]
    np.add.at(edge, np.maximum(begins, ends - width + 1), 1)
    np.add.at(edge, ends, -1)
    inside = np.cumsum(edge[:windows]) == 0
    keep, step, low = [], 1 << INDEX_BITS, np.uint64((1 << INDEX_BITS) - 1)
    for at in range(0, windows, step - 2 * width):
        part = hashed[at : at + step - width]
        code = part & ~low | np.arange(len(part), dtype=np.uint64)
        have, need = 1, min(span, len(code))
        while have < need:
            move = min(have, need - have)
            code = np.minimum(code[:-move], code[move:])
            have += move
        starts = inside[at : at + step - 2 * width]
        keep.append(np.unique(code[: len(starts)][starts] & low).astype(np.int64) + at)
    position = np.unique(np.concatenate(keep))
    return position, hashed[position]


class Surroundings:
    """Anchors of one slice with their rows and the bytes around them that lie in the same row."""

    def __init__(self, data, offsets, position, width: int = WIDTH, gram: int = GRAM):
        self.data, self.position = data, position
        self.row = np.searchsorted(offsets, position, "right") - 1
        self.local = position - offsets[self.row]
        self.left = np.minimum(self.local, width - gram)
        self.right = np.minimum(offsets[self.row + 1] - position, width)

    def hashes(self) -> np.ndarray:
        around = run_hashes(self.data, self.position - self.left, self.position + self.right, byte_values())
        return mix(around + self.left.astype(np.uint64) * np.uint64(1009) + self.right.astype(np.uint64))

    def equal(self, order: np.ndarray, head: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Whether the asked anchors have the bytes around them that ``order[head]`` has, place by place of ``order``."""
        out, k = np.zeros(len(order), bool), np.flatnonzero(asked)
        a, b = order[k], order[head[k]]
        alike = (self.left[a] == self.left[b]) & (self.right[a] == self.right[b])
        k, a, b = k[alike], a[alike], b[alike]
        out[k] = same_bytes(self.data, self.position[a] - self.left[a], self.data, self.position[b] - self.left[b], self.left[a] + self.right[a])
        return out


def merge_spans(spans: list[tuple[int, int]]) -> list[dict]:
    """Maximal runs of the union of half-open spans."""
    out: list[dict] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def by_row(row: np.ndarray, values: np.ndarray) -> dict[int, np.ndarray]:
    if not len(row):
        return {}
    order = np.argsort(row, kind="stable")
    cut = np.flatnonzero(np.diff(row[order])) + 1
    return {int(row[part[0]]): values[part] for part in np.split(order, cut)}


class FirstPass:
    """Anchors of a task: local folding, and gram hashes for each partition."""

    def __init__(self, parts: int, width: int, gram: int):
        self.parts, self.width, self.gram = parts, width, gram
        self.hash, self.where, self.at = [], [], []
        self.size = 0

    def slice(self, docs: np.ndarray, rows: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple]:
        position, hashed = anchors(data, offsets, self.width, self.gram)
        if not len(position):
            return
        s = Surroundings(data, offsets, position, self.width, self.gram)
        around = s.hashes()
        order = np.lexsort((s.local, rows[s.row], docs[s.row], around))
        again = np.zeros(len(order), bool)
        again[1:] = around[order][1:] == around[order][:-1]
        again &= s.equal(order, np.maximum.accumulate(np.where(again, 0, np.arange(len(order)))), again)  # what only hashes alike goes on as it is
        copies = order[again]
        copies = copies[s.left[copies] + s.right[copies] >= self.width]
        spans = by_row(rows[s.row[copies]], np.stack([s.local[copies] - s.left[copies], s.local[copies] + s.right[copies]], 1))
        for row, found in spans.items():
            yield None, None, row, merge_spans(list(map(tuple, found.tolist()))), None
        first = order[~again]
        self.hash.append(hashed[first])
        self.where.append(rows[s.row[first]])
        self.at.append(s.local[first])
        self.size += len(first)
        if self.size >= RUN:
            yield from self.send()

    def send(self) -> Iterator[tuple]:
        if not self.size:
            return
        hashed, row, at = np.concatenate(self.hash), np.concatenate(self.where), np.concatenate(self.at)
        self.hash, self.where, self.at, self.size = [], [], [], 0
        order = np.argsort(hashed, kind="stable")
        hashed, row, at = hashed[order], row[order], at[order]
        same = np.concatenate([[False], hashed[1:] == hashed[:-1], [False]])
        many = same[1:] | same[:-1]  # known to occur again: only the hash has to be told, once
        for r, found in by_row(row[many], at[many]).items():
            yield None, None, r, None, found.tolist()
        head = ~same[:-1]
        hashed, row, at, known = hashed[head], row[head], at[head], many[head]
        part = (hashed % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        for k in range(self.parts):
            pick = order[edges[k] : edges[k + 1]]
            if len(pick):
                steps = np.diff(hashed[pick], prepend=np.uint64(0))
                yield k, pack(steps, known[pick].view(np.uint8), row[pick], at[pick].astype(np.uint32)), None, None, None


def send_rows(parts: int, row: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(partition, payload) of values that belong to rows: one payload for each partition of row numbers."""
    part = (mix(row.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        pick = order[edges[k] : edges[k + 1]]
        yield k, pack(row[pick], *(v[pick] for v in values))


def spans_of(column: pa.Array, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of a column of span lists without nulls."""
    flat = column.flatten()
    at = np.repeat(row, column.value_lengths().to_numpy())
    return at, flat.field(0).to_numpy(), flat.field(1).to_numpy()


def recurring(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[tuple[int, bytes]]:
    """Anchors whose gram occurs again anywhere, for their rows; what comes with a row number is passed on."""
    held, row, at, spans = [], [], [], []
    for b in batches:
        own = b.filter(b.column(2).is_valid())
        numbers = own.column(2)
        for k, out in ((3, spans), (4, at)):
            have = own.column(k).is_valid()
            column, of = own.column(k).filter(have), numbers.filter(have).to_numpy()
            if k == 3:
                out.append(spans_of(column, of))
            else:
                out.append(column.flatten().to_numpy())
                row.append(np.repeat(of, column.value_lengths().to_numpy()))
        held += [x for x in b.column(1).to_pylist() if x is not None]
    hashed, known, where, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    while held:
        h, k, r, a = unpack(held.pop())
        hashed.append(np.cumsum(h, dtype=np.uint64))
        known.append(k)
        where.append(r)
        place.append(a)
    hashed, known, where, place = (np.concatenate(x) for x in (hashed, known, where, place))
    if len(hashed):
        order = np.argsort(hashed, kind="stable")
        ordered = hashed[order]
        group = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        # those that are known to recur went to their rows already
        keep = order[(np.bincount(group)[group] > 1) & (known[order] == 0)]
        row.append(where[keep])
        at.append(place[keep].astype(np.int64))
    empty = np.zeros(0, np.int64)
    yield from send_rows(parts, np.concatenate([empty, *row]), np.concatenate([empty, *at]))
    yield from send_rows(parts, *(np.concatenate([empty, *(x[k] for x in spans)]) for k in range(3)))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, spans, anchors) of the payloads of ``send_rows``, one row for each row number."""
    held = [[[], []], [[], [], []]]
    for b in batches:
        for payload in b.column(1).to_pylist():
            found = unpack(payload)
            for k, x in enumerate(found):
                held[len(found) - 2][k].append(x)
    spans, anchors_ = {}, {}
    if held[1][0]:
        row, start, end = (np.concatenate(x) for x in held[1])
        spans = by_row(row, np.stack([start, end], 1))
    if held[0][0]:
        anchors_ = by_row(*(np.concatenate(x) for x in held[0]))
    rows = [(r, merge_spans(list(map(tuple, spans[r].tolist()))) if r in spans else [], anchors_[r].tolist() if r in anchors_ else []) for r in sorted(spans.keys() | anchors_.keys())]
    for k in range(0, len(rows), 4096):
        yield batch(rows[k : k + 4096], ROW_ARROW)


class Runs:
    """Suffixes at recurring anchors of a task, sent as sorted front-coded runs."""

    def __init__(self, parts: int, width: int, gram: int):
        self.parts, self.width, self.gram, self.held = parts, width, gram, []

    def add(self, doc: int, row: int, body: bytes, at: list[int]) -> Iterator[tuple]:
        data = np.frombuffer(body, np.uint8)
        at = sorted(at)
        if len(data) >= self.width:
            # only the grams that are asked for
            window = np.lib.stride_tricks.sliding_window_view(data, self.gram)[at]
            hashed = run_hashes(window.ravel(), np.arange(len(at)) * self.gram, np.arange(1, len(at) + 1) * self.gram, byte_values())
            before = self.width - self.gram
            for p, h in zip(at, hashed.tolist(), strict=True):
                self.held.append((h, body[p : p + self.width], body[max(0, p - before) : p][::-1], doc, row, p))
        if len(self.held) >= RUN // 4:
            yield from self.send()

    def send(self) -> Iterator[tuple]:
        parts: dict[int, list] = {}
        for x in self.held:
            parts.setdefault(x[0] % self.parts, []).append(x)
        self.held = []
        for k, entries in parts.items():
            entries.sort()
            yield k, encode(entries)


def common(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix, of which ``low`` bytes are known."""
    high = min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def encode(entries: list[tuple]) -> bytes:
    """A sorted run: for each suffix, what it shares with the one before it and the rest."""
    shared, rest, previous = [], [], b""
    for h, right, *_ in entries:
        key = h.to_bytes(8, "big") + right
        n = common(previous, key)
        shared.append(n)
        rest.append(key[n:])
        previous = key
    left = [x[2] for x in entries]
    numbers = [np.array([x[k] for x in entries], np.int64) for k in (3, 4, 5)]
    sizes = [np.array(list(map(len, x)), np.uint8) for x in (rest, left)]
    joined = [np.frombuffer(b"".join(x), np.uint8) for x in (rest, left)]
    return pack(np.array(shared, np.uint8), *sizes, *joined, *numbers)


class Run:
    """A run being read: keys are rebuilt from the shared prefixes as it advances."""

    __slots__ = ("doc", "k", "key", "left", "left_at", "left_size", "n", "pos", "rest", "rest_at", "rest_size", "row", "shared")

    def __init__(self, payload: bytes):
        shared, rest_size, left_size, rest, left, doc, row, pos = unpack(payload)
        self.shared, self.rest_size, self.left_size = shared.tolist(), rest_size.tolist(), left_size.tolist()
        self.rest, self.left = rest.tobytes(), left.tobytes()
        self.doc, self.row, self.pos = doc.tolist(), row.tolist(), pos.tolist()
        self.n, self.k, self.key, self.rest_at, self.left_at = len(self.doc), -1, b"", 0, 0

    def advance(self) -> int:
        """Step to the next suffix; what it shares with the one before it, or -1 at the end."""
        if self.k >= 0:
            self.left_at += self.left_size[self.k]
        self.k += 1
        if self.k >= self.n:
            return -1
        shared, size = self.shared[self.k], self.rest_size[self.k]
        self.key = self.key[:shared] + self.rest[self.rest_at : self.rest_at + size]
        self.rest_at += size
        return shared

    def entry(self) -> tuple:
        k = self.k
        return self.key, self.left[self.left_at : self.left_at + self.left_size[k]], self.doc[k], self.row[k], self.pos[k]


def merged(payloads: list[bytes]) -> Iterator[tuple[int, tuple]]:
    """(shared prefix with the one before, entry) of all runs in order, by a loser tree.

    Each leaf keeps the length of the prefix that its head shares with the last output. Of two heads
    the one that shares more is the smaller; only if they share as much are bytes compared, from
    there on, and the loser then remembers how far it agrees with the winner.
    """
    runs = [Run(p) for p in payloads]
    size = 1
    while size < len(runs):
        size *= 2
    known = [-1] * size  # -1: exhausted
    for i, run in enumerate(runs):
        if run.advance() >= 0:
            known[i] = 0
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = known[a], known[b]
        if x != y:
            return (a, b) if x > y else (b, a)
        if x < 0:
            return a, b
        p, q = runs[a].key, runs[b].key
        n = common(p, q, x)
        if n == len(p) or n < len(q) and p[n] < q[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        won = []
        for i in range(level):
            w, loser = play(winners[2 * i], winners[2 * i + 1])
            losers[level + i] = loser
            won.append(w)
        winners = won
    top = winners[0]
    while known[top] >= 0:
        run = runs[top]
        yield known[top], run.entry()
        known[top] = run.advance()
        node = (top + size) // 2
        while node:
            w, loser = play(top, losers[node])
            losers[node], top = loser, w
            node //= 2


def repeats(group: list[tuple], width: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the repeated passages around the anchors of one gram.

    ``group`` holds (suffix, bytes before it reversed, doc, row, position). All passages that are
    also around an earlier anchor are covered.
    """
    kinds: dict[tuple[bytes, bytes], tuple] = {}
    for right, left, doc, row, pos in group:
        me = (doc, row, pos)
        first = kinds.get((right, left))
        if first is None:
            kinds[right, left] = me
            continue
        if me < first:
            kinds[right, left], me = me, first
        if len(left) + len(right) >= width:
            yield me[1], me[2] - len(left), me[2] + len(right)
    if len(kinds) == 1:
        return
    order = sorted((me, right, left) for (right, left), me in kinds.items())
    if len(order) <= PAIRWISE:
        for i, ((_, row, pos), right, left) in enumerate(order):
            before = behind = 0
            for _, right2, left2 in order[:i]:
                r, b = common(right, right2), common(left, left2)
                if r + b >= width:
                    before, behind = max(before, b), max(behind, r)
            if behind:
                yield row, pos - before, pos + behind
        return
    seen: dict[bytes, tuple[int, int]] = {}  # the first start of a passage; surroundings of near anchors overlap
    for (_, row, pos), right, left in order:
        around, here = left[::-1] + right, None
        for at in range(len(around) - width + 1):
            start = pos - len(left) + at
            if seen.setdefault(around[at : at + width], (row, start)) != (row, start):
                if here and start <= here[1]:
                    here[1] = start + width
                else:
                    if here:
                        yield row, *here
                    here = [start, start + width]
        if here:
            yield row, *here


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_bytes``, ``spans`` to remove, ``kept`` (the other bytes).

    A byte is removed if it lies in ``width`` bytes of its document that also start earlier: in a
    document of a smaller id, or earlier in the same one. Spans are maximal, half-open, in bytes of
    UTF-8. Null texts are empty; documents shorter than ``width`` keep everything. A null id comes
    before all others, and rows of one id go by their order in the table, which therefore has to be
    read in one order every time (files and checkpoints are). An empty table gives an empty result;
    other columns are ignored.
    """
    if not 8 <= gram < width <= 200:
        raise ValueError("8 <= gram < width <= 200 is needed")
    parts = shuffle_width(docs.sparkSession)
    least = -(1 << 63)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("doc"), text_or_empty(F.col(text_col)).cast("binary").alias("body")
    )

    def first(batches):
        task = FirstPass(parts, width, gram)
        for part, data, offsets in chunks(batches, 2, SLICE):
            found = list(task.slice(part.column(1).to_numpy(), part.column(0).to_numpy(), data, offsets))
            if found:
                yield batch(found, FIRST_ARROW)
        yield batch(list(task.send()), FIRST_ARROW)

    def second(batches):
        task, out = Runs(parts, width, gram), []
        for b in batches:
            for row, doc, body, at in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                out += task.add(doc, row, body, at)
                if out:
                    yield batch(out, RUN_ARROW)
                    out = []
        yield batch(list(task.send()), RUN_ARROW)

    def third(batches):
        payloads = [x for b in batches for x in b.column(1).to_pylist()]
        found, group = [], []
        for shared, entry in merged(payloads):
            if shared < 8:
                if len(group) > 1:
                    found += repeats(group, width)
                group = []
            group.append((entry[0][8:], *entry[1:]))
        if len(group) > 1:
            found += repeats(group, width)
        table = np.array(found, np.int64).reshape(-1, 3)
        yield batch(list(send_rows(parts, table[:, 0], table[:, 1], table[:, 2])), RUN_ARROW)

    def pass_on(batches):
        yield batch(list(recurring(batches, parts)), RUN_ARROW)

    by_row_number = lambda df: df.repartition(parts, "part").mapInArrow(united, ROW_SCHEMA)
    dealt = rows.select("row", "doc", "body").mapInArrow(first, FIRST_SCHEMA)
    passed = dealt.repartition(parts, F.coalesce("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))).mapInArrow(pass_on, RUN_SCHEMA)
    known = by_row_number(passed)
    by_number = rows.repartition(parts, "row")
    asked = by_number.join(known.where(F.size("anchors") > 0).select("row", "anchors"), "row").select("row", "doc", "body", "anchors")
    found = by_row_number(asked.mapInArrow(second, RUN_SCHEMA).repartition(parts, "part").mapInArrow(third, RUN_SCHEMA))
    spans = known.select("row", "spans").unionByName(found.select("row", "spans")).where(F.size("spans") > 0).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    out = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("spans", SPAN_ARROW), ("kept", pa.binary())])

    def remove(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                rows = []
                for doc, body, found in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                    cut = merge_spans([(s["start"], s["end"]) for s in found or ()])
                    kept, here = [], 0
                    for s in cut:
                        kept.append(body[here : s["start"]])
                        here = s["end"]
                    rows.append((doc, len(body), cut, b"".join([*kept, body[here:]])))
                yield batch(rows, out)

    final = by_number.join(spans, "row", "left").select("doc", "body", "spans").mapInArrow(remove, f"doc long, n_bytes long, spans {SPANS}, kept binary")
    return final.select(F.when(F.col("doc") != least, F.col("doc")).alias(id_col), "n_bytes", "spans", "kept")
