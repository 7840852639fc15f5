"""Exact deduplication with compressed radix (Patricia) tries.

Plan: rows of one text share a partition of (byte length, content hash). Each input partition first
folds its own rows into a trie of whole byte strings, so a text that fills a third of the table leaves
every map task once; behind one shuffle a trie for each partition takes what the map tasks found, and
strings are compared edge by edge. A terminal node stores its owner, the smallest identifier, and how
many rows ended there. Rows get their terminal back by a join on the digest of the text, which Spark
may split where it is skewed.

Memory: a trie that passes ``TRIE_BYTES`` hands over its heaviest subtree. On the map side that goes to
the shuffle, which unites what several subtrees say of one text. Behind the shuffle rows arrive ordered
by (length, hash), so all texts before the present pair are finished and a subtree's can be written out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesarrays import give_back
from .common import shuffle_width, text_or_empty, without_rows

#: Bytes, of texts and nodes, that a trie holds before it hands over its heaviest subtree.
TRIE_BYTES = 16 << 20
#: About what a node takes besides its label.
NODE_BYTES = 200


class Node:
    __slots__ = ("children", "count", "label", "owner", "tag", "weight")

    def __init__(self, label: bytes):
        self.label, self.children, self.count, self.owner, self.tag, self.weight = label, None, 0, None, 0, len(label) + NODE_BYTES


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving over slice comparisons."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Byte strings to (owner, count, tag); one branch per differing byte, labels on the edges."""

    def __init__(self, keep: str = "smallest"):
        self.root, self.better = Node(b""), min if keep == "smallest" else max

    @property
    def bytes(self) -> int:
        """What is held below the root."""
        return self.root.weight - NODE_BYTES

    def insert(self, key: bytes, owner, count: int = 1, tag: int = 0) -> None:
        """Add ``count`` rows of a string; ``tag`` is a number that goes with the string."""
        node, at, path, grown = self.root, 0, [self.root], 0
        while at < len(key):
            if node.children is None:
                node.children = {}
            child = node.children.get(key[at])
            if child is None:
                child = Node(key[at:])
                node.children[key[at]] = child
                grown += child.weight
                node = child
                break
            size = len(child.label)
            if key[at : at + size] == child.label:
                node, at = child, at + size
                path.append(node)
                continue
            shared = common_prefix(child.label, key[at : at + size])
            fork = Node(child.label[:shared])
            child.label = child.label[shared:]
            fork.children = {child.label[0]: child}
            fork.weight, child.weight = child.weight + NODE_BYTES, child.weight - shared
            grown += NODE_BYTES
            node.children[key[at]] = fork
            for above in path:
                above.weight += grown
            grown, path = 0, [*path, fork]
            node, at = fork, at + shared
        for above in path if grown else ():
            above.weight += grown
        node.count += count
        node.tag = tag
        if owner is not None:
            node.owner = owner if node.owner is None else self.better(node.owner, owner)

    def subtree(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, object, int, int]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            key = prefix + node.label
            if node.count:
                yield key, node.owner, node.count, node.tag
            if node.children:
                stack += [(child, key) for child in node.children.values()]

    def tagged(self) -> Iterator[tuple[bytes, object, int, int]]:
        return self.subtree(self.root, b"")

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        return (x[:3] for x in self.tagged())

    def spill(self) -> Iterator[tuple[bytes, object, int]]:
        """Detach the heaviest subtree at the first branching and yield its terminals."""
        return (x[:3] for x in self.detach())

    def detach(self) -> Iterator[tuple[bytes, object, int, int]]:
        """As ``spill``, with tags."""
        node, path, prefix = self.root, [self.root], b""
        while not node.count and node.children and len(node.children) == 1:
            node = next(iter(node.children.values()))
            prefix += node.label
            path.append(node)
        if not node.children:
            return
        first = max(node.children, key=lambda k: node.children[k].weight)
        child = node.children.pop(first)
        for above in path:
            above.weight -= child.weight
        yield from self.subtree(child, prefix)


MAP_SCHEMA = "n_bytes long, hash long, body binary, owner long, keep_row long, members long"
MAP_ARROW = pa.schema([("n_bytes", pa.int64()), ("hash", pa.int64()), ("body", pa.binary()), ("owner", pa.int64()), ("keep_row", pa.int64()), ("members", pa.int64())])
OWNER_SCHEMA = "digest binary, owner long, keep_row long, members long"
OWNER_ARROW = pa.schema([("digest", pa.binary()), ("owner", pa.int64()), ("keep_row", pa.int64()), ("members", pa.int64())])


def claim(owner: int | None, row: int, sign: int) -> tuple:
    """What the smaller of decides about an owner: ids before nulls, then by id, then the first row."""
    return owner is None, 0 if owner is None else sign * owner, row


def owner_of(claimed: tuple, sign: int) -> tuple[int | None, int]:
    """(identifier, row) of a claim."""
    return None if claimed[0] else sign * claimed[1], claimed[2]


def parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of the batches, so that few rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _batches(rows: Iterator, schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    held = []
    give_back()


def _fold(sign: int, limit: int):
    """Map side: one row for each text of the input partition, or more where the trie spills."""

    def row(item):
        text, claimed, count, hashed = item
        return len(text), hashed, text, *owner_of(claimed, sign), count

    def rows(batches):
        trie = PatriciaTrie()
        for batch in parts(batches):
            for hashed, text, owner, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(text, claim(owner, number, sign), 1, hashed)
                while trie.bytes > limit:
                    before = trie.bytes
                    yield from map(row, trie.detach())
                    if trie.bytes == before:  # one text on the way from the root to the only leaf
                        yield from map(row, trie.tagged())
                        trie = PatriciaTrie()
        yield from map(row, trie.tagged())

    return lambda batches: _batches(rows(batches), MAP_ARROW)


def _merge(sign: int, limit: int):
    """Reduce side: rows ordered by (length, hash); texts before the present pair are finished."""

    def done(items):
        for text, claimed, count, _ in items:
            if count > 1:
                yield hashlib.sha256(text).digest(), *owner_of(claimed, sign), count

    def rows(batches):
        trie, pair = PatriciaTrie(), None
        for batch in parts(batches):
            for length, hashed, text, owner, number, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (length, hashed) != pair:
                    pair = length, hashed
                    while trie.bytes > limit:
                        before = trie.bytes
                        yield from done(trie.detach())
                        if trie.bytes == before:
                            yield from done(trie.tagged())
                            trie = PatriciaTrie()
                trie.insert(text, claim(owner, number, sign), count, hashed)
        yield from done(trie.tagged())

    return lambda batches: _batches(rows(batches), OWNER_ARROW)


def text_groups(docs: DataFrame, id_col: str, text_col: str, keep: str, trie_bytes: int) -> DataFrame:
    """One row for each row of ``docs``: ``row`` (its number in the table), ``id``, ``digest``, and the ``owner``, ``keep_row`` and ``members`` of its text, null for a text of one row."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    sign = 1 if keep == "smallest" else -1
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).cast("binary").alias("body"))
    folded = rows.select(F.xxhash64("body").alias("hash"), "body", "id", "row").mapInArrow(_fold(sign, trie_bytes), MAP_SCHEMA)
    dealt = folded.repartition(shuffle_width(docs.sparkSession), "n_bytes", "hash").sortWithinPartitions("n_bytes", "hash")
    owners = dealt.mapInArrow(_merge(sign, trie_bytes), OWNER_SCHEMA)
    return rows.select("row", "id", F.unhex(F.sha2("body", 256)).alias("digest")).join(owners, "digest", "left")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row for each row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` ("smallest" or "largest") names the owner among equal texts. A null text counts as the
    empty text; texts are compared unchanged, byte by byte. Rows repeated with one id are all
    counted and all ``kept`` if that id owns the group. A null id never owns a group that has other
    ids: its row isn't kept; in a group of null ids only, ``keep_id`` is null and nothing is kept
    (except that a group of one row is always kept). ``drop_copies`` decides row by row instead. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    joined = text_groups(docs, id_col, text_col, keep, trie_bytes)
    alone = F.col("members").isNull()
    return joined.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("owner")).alias("keep_id"),
        F.coalesce("members", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.coalesce(F.col("id") == F.col("owner"), F.lit(False))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """``docs``, all columns, with exactly one row of each text: that of the owner's id, of equal or null ids the first in the table.

    Null texts count as empty; an empty table gives an empty result. Rows are numbered, so the table
    has to be read in one order every time (files and checkpoints are).
    """
    gone = text_groups(docs, id_col, text_col, keep, trie_bytes).where("row <> keep_row").select("row")
    return without_rows(docs, gone)
