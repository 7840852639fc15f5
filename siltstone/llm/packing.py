"""Sequence packing by minimum bin slack.

Plan: one narrow pass and no shuffle. Each input partition tokenizes its rows, cuts every document
into full windows and a remainder, and packs the remainders of a bounded pool: the longest one
opens a window, and a subset-sum over the multiset of the other lengths, held as one big integer of
``capacity`` bits, finds the filling that comes closest to the capacity; the counts that each length
contributes are read back from the integers kept along the way. What is left at the end of a
partition is cut into sequences of power-of-two lengths, which need no padding.

A partition's content is fixed by its input split, so a task that runs again gives the same pieces
and the same sequence ids (the partition number in the upper bits, a counter in the lower ones).
"""

from __future__ import annotations

import struct
from bisect import insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesarrays import give_back
from .common import text_or_empty

CAPACITY = 4096
END_ID = 2
#: Remainders that wait in a partition's pool at most; the packing begins when there are as many.
POOL = 768
#: Words in one of the two generations of ids that a worker remembers.
CACHE = 250_000

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return {b: chr(b if b in plain else next(rest)) for b in range(256)}


BYTE_LETTERS = byte_letters()


def plain(word: str) -> bool:
    """Whether a word holds letters below U+0100 only; lower-casing others may leave marks that join what follows."""
    return word.isalpha() and max(word) < "\u0100"


class Words(dict):
    """Ids of words without spaces, as little-endian uint32 bytes; what is missing is made on the way.

    Two generations bound the memory: when this one is full it becomes the old one, from which words
    that come up again are taken over.
    """

    def __init__(self, tokenizer, limit: int):
        self.tokenizer, self.limit, self.old = tokenizer, limit, {}
        self[""] = b""
        self.marks = {mark: self.encode(mark) for mark in ".,"}
        # letters form one token candidate; where the model itself gives the same, the steps before it are left out
        self.direct = all(self.pieces(w) == self.encode(w) for w in ("retitioning", "été", "größe", "ñandú", "q"))

    def pieces(self, word: str) -> bytes:
        """Ids of a word of lower-case letters below U+0100, straight from a byte-level model."""
        found = self.tokenizer.model.tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS))
        return b"".join([x.id.to_bytes(4, "little") for x in found])

    def encode(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if word[-1] in self.marks and plain(word[:-1]):
                found = self[word[:-1]] + self.marks[word[-1]]  # such letters stay letters in lower case, and never share a token with a mark
            elif plain(word):
                small = word.lower()  # the vocabulary knows lower case only
                found = self[small] if small != word else self.pieces(word) if self.direct else self.encode(word)
            else:
                found = self.encode(word)
        self[word] = found
        return found

    def turn_over(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()
            self[""] = b""


class WordTokenizer:
    """Ids of whole texts as little-endian uint32 bytes, from a tokenizer whose tokens never hold white space.

    Texts are cut at spaces and line feeds, which no token, normalisation or rule of this vocabulary
    crosses, and the ids of each piece are remembered.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.words = Words(Tokenizer.from_file(path), cache)

    def encode(self, texts: list[str]) -> list[bytes]:
        get = self.words.__getitem__
        made = [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]
        self.words.turn_over()
        return made


_TOKENIZERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, so that later tasks of a worker find the words of earlier ones."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset out of ``counts`` (length to how many there are) whose sum is at most ``room`` and largest.

    Bit s of the integer says that some choice sums to s. Counts enter in powers of two; the chosen
    ones are found by walking the integers back from the largest sum.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if before >> total & 1:
            continue
        total -= length * take
        chosen[length] = chosen.get(length, 0) + take
    return chosen


class Packer:
    """Packs the documents of one partition; ``rows`` collects finished pieces."""

    def __init__(self, capacity: int, first_sequence: int, pool: int):
        self.capacity, self.sequence, self.limit = capacity, first_sequence, pool
        self.lengths: list[int] = []  # the pool's lengths, ascending
        self.waiting: dict[int, list] = {}
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            self.rows.append((doc, start, len(ids) // 4, ids, tokens, self.sequence, offset))
            offset += len(ids) // 4
        self.sequence += 1

    def add(self, doc, ids: bytes) -> None:
        tokens, width = len(ids) // 4, 4 * self.capacity
        full = tokens // self.capacity
        for k in range(full):
            self.emit([(doc, k * self.capacity, ids[k * width : (k + 1) * width], tokens)])
        if rest := ids[full * width :]:
            size = len(rest) // 4
            insort(self.lengths, size)
            self.waiting.setdefault(size, []).append((doc, full * self.capacity, rest, tokens))
            if len(self.lengths) >= self.limit:
                while len(self.lengths) > self.limit * 3 // 4:
                    self.close()

    def take(self, size: int) -> tuple:
        found = self.waiting[size].pop()
        if not self.waiting[size]:
            del self.waiting[size]
        return found

    def close(self) -> None:
        """One window: the longest remainder, and what fills the rest of it best."""
        longest = self.lengths.pop()
        pieces = [self.take(longest)]
        for length, count in fill({n: len(held) for n, held in self.waiting.items()}, self.capacity - longest).items():
            pieces += [self.take(length) for _ in range(count)]
        self.lengths = sorted(n for n, held in self.waiting.items() for _ in held)
        self.emit(pieces)

    def finish(self) -> None:
        while sum(self.lengths) >= self.capacity:
            longest = self.lengths[-1]
            best = fill({n: len(held) - (n == longest) for n, held in self.waiting.items()}, self.capacity - longest)
            if longest + sum(n * c for n, c in best.items()) < self.capacity:
                break
            self.close()
        left = [self.take(n) for n in list(self.lengths)]
        self.lengths = []
        tokens = sum(len(x[2]) // 4 for x in left)
        while tokens:  # powers of two need no padding
            room = min(self.capacity, 1 << (tokens.bit_length() - 1))
            tokens -= room
            pieces = []
            while room:
                doc, start, ids, total = left.pop()
                cut = min(room, len(ids) // 4)
                pieces.append((doc, start, ids[: 4 * cut], total))
                if len(ids) > 4 * cut:
                    left.append((doc, start + cut, ids[4 * cut :], total))
                room -= cut
            self.emit(pieces)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(ARROW.types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, ARROW.types, strict=True)], schema=ARROW)


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, pool: int = POOL) -> DataFrame:
    """Pieces of the documents of ``docs`` in sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id``, ``start`` (tokens of the document before it), ``length``, ``ids``
    (little-endian uint32), ``doc_tokens`` (with the end id), ``sequence_id`` and ``offset``. Every
    document, null or empty ones too, ends in ``end_id``. Each row of the input is a document of its
    own, also if ids repeat or are null. An empty table gives no pieces. Other columns are ignored.
    ``capacity`` must be a power of two, and the file must describe a vocabulary whose tokens hold
    no white space.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        packer = Packer(capacity, TaskContext.get().partitionId() << 40, pool)
        for batch in batches:
            tokenizer = tokenizer or word_tokenizer(tokenizer_path)
            size, at = 256, 0
            while at < batch.num_rows:
                part = batch.slice(at, size)
                at += size
                for doc, ids in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist()), strict=True):
                    packer.add(doc, ids + end)
                if packer.rows:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.finish()
        yield _batch(packer.rows)
        give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, SCHEMA).withColumnRenamed("doc_id", id_col)
