"""Benchmark decontamination with suffix arrays over the training documents.

Plan: one narrow pass over the documents. Each task takes shards of a few megabytes, turns words into
the benchmark's word numbers, sorts the suffixes of every stretch of benchmark words into a suffix
array (prefix doubling) and finds all test suffixes in it at once by binary search. A suffix that
leaves the benchmark's vocabulary before it is as long as the shortest window can't match and isn't
sorted. The interval of a window gives its locations, and each of them is followed on to its longest
verbatim match. Words meet by hash and are then compared byte by byte.

The benchmark goes to the tasks in blocks of at most ``BLOCK_BYTES`` of text; one that is larger is
searched block by block in as many passes, and the passes are combined by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesarrays import byte_values, chunks, mix, runs, same_bytes, tabulated, view
from .common import text_or_empty

WINDOW = 10
#: Bytes of benchmark text that one pass sends to the tasks at most.
BLOCK_BYTES = 16 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

SPAN = "array<struct<start: long, end: long>>"
SCHEMA = f"row long, id long, n_words long, hits {SPAN}, items array<string>, longest long, longest_item string"
ARROW = pa.schema(
    [("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_item", pa.string())]
)


def words(small: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and size of each word of lower-cased bytes, and the first word of each row (rows + 1)."""
    starts, ends, first = runs(IS_WORD[small], offsets)
    return starts, ends - starts, first


def suffix_array(stream: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes of ``stream`` in order, compared on at least their first ``longest`` numbers (prefix doubling)."""
    rank, width = np.unique(stream, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while width < longest and len(stream) > 1:
        ahead = np.full(len(rank), -1, np.int64)
        ahead[:-width] = rank[width:] if width < len(rank) else ahead[:-width]
        order = np.lexsort((ahead, rank))
        a, b = rank[order], ahead[order]
        step = np.ones(len(order), np.int64)
        step[0] = 0
        step[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(step)
        if rank[order[-1]] == len(order) - 1:
            break
        width *= 2
    return order


@dataclass
class Benchmark:
    """The test suffixes of a block: the word stream of all items with a 0 behind each, and its windows."""

    values: np.ndarray  # what the hash of a word is made of
    vocabulary: np.ndarray  # sorted word hashes, no two alike; word number k + 1
    starts: np.ndarray  # where these words stand
    sizes: np.ndarray  # their bytes
    letters: np.ndarray  # the bytes of all items
    stream: np.ndarray
    at: np.ndarray  # where each test suffix begins
    length: np.ndarray  # its window
    item: np.ndarray  # index into names
    names: list[str]

    @classmethod
    def build(cls, rows: list[tuple[str, str]], window: int = WINDOW) -> Benchmark:
        data, offsets = view(pa.array([t.encode() for _, t in rows], pa.binary())) if rows else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        data = LOWER[data]
        starts, sizes, first = words(data, offsets)
        values = byte_values()
        while True:
            vocabulary, where, numbers = np.unique(tabulated(data, starts, starts + sizes, values), return_index=True, return_inverse=True)
            one = where[numbers]
            if (sizes == sizes[one]).all() and same_bytes(data, starts, data, starts[one], sizes).all():
                break
            values = mix(values + np.uint64(1))  # two words hash alike: other values tell them apart
        stream, at, length, item, names, place = [], [], [], [], [], {}
        base = 0
        for k, (name, _) in enumerate(rows):
            n = int(first[k + 1] - first[k])
            if not n:
                continue
            if name not in place:
                place[name] = len(names)
                names.append(name)
            count = max(n - window + 1, 1)
            at.append(base + np.arange(count))
            length.append(np.full(count, min(n, window)))
            item.append(np.full(count, place[name]))
            stream += [numbers[first[k] : first[k + 1]] + 1, np.zeros(1, np.int64)]
            base += n + 1
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return cls(values, vocabulary, starts[where], sizes[where], data, join(stream), join(at), join(length), join(item), names)

    def numbers(self, small: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Benchmark word numbers, which hash and size suggest; 0 for other words."""
        if not len(self.vocabulary):
            return np.zeros(len(starts), np.int64)
        hashed = tabulated(small, starts, starts + sizes, self.values)
        k = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        return np.where((self.vocabulary[k] == hashed) & (self.sizes[k] == sizes), k + 1, 0)

    def confirm(self, numbers: np.ndarray, asked: np.ndarray, small: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        """Set the numbers of those asked words to 0 whose bytes aren't the benchmark word's."""
        k = numbers[asked] - 1
        numbers[asked[~same_bytes(small, starts[asked], self.letters, self.starts[k], sizes[asked])]] = 0


def compare(stream: np.ndarray, order: np.ndarray, middle: np.ndarray, test: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sign of (suffix number ``middle`` of the shard) against (test suffix), over ``length`` words."""
    sign, live = np.zeros(len(at), np.int64), np.arange(len(at))
    begin = order[middle]
    for j in range(int(length.max()) if len(length) else 0):
        live = live[length[live] > j]
        p = begin[live] + j
        a = np.where(p < len(stream), stream[np.minimum(p, len(stream) - 1)], -1)
        b = test[at[live] + j]
        sign[live] = np.sign(a - b)
        live = live[a == b]
        if not len(live):
            break
    return sign


def bounds(stream: np.ndarray, order: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the interval of shard suffixes that begin with its window."""
    out = []
    for above in (False, True):
        low, high = np.zeros(len(bench.at), np.int64), np.full(len(bench.at), len(order), np.int64)
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) // 2
            sign = compare(stream, order, middle, bench.stream, bench.at[open_], bench.length[open_])
            right = sign <= 0 if above else sign < 0
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)
        out.append(low)
    return out[0], out[1]


def extend(stream: np.ndarray, begin: np.ndarray, test: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Lengths of the verbatim matches at ``begin`` and ``at``, of which ``known`` words are known to match."""
    size, live = known.copy(), np.arange(len(begin))
    while len(live):
        p, q = begin[live] + size[live], at[live] + size[live]
        ok = (p < len(stream)) & (q < len(test))
        live, p, q = live[ok], p[ok], q[ok]
        live = live[(stream[p] == test[q]) & (test[q] > 0)]
        size[live] += 1
    return size


def search(data: np.ndarray, offsets: np.ndarray, bench: Benchmark) -> dict:
    """Hit words, items and longest matches of the rows of one shard."""
    small = LOWER[data]
    begins, sizes, first = words(small, offsets)
    rows = len(offsets) - 1
    found = {"n_words": np.diff(first), "hits": [[] for _ in range(rows)], "items": [[] for _ in range(rows)], "longest": np.zeros(rows, np.int64), "longest_item": [None] * rows}
    if not len(bench.at):
        return found
    numbers, least = bench.numbers(small, begins, sizes), bench.length.min()
    for last in (False, True):
        starts, ends, _ = runs(numbers > 0, first)
        keep = ends - starts >= least
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return found
        if not last:  # words of stretches that are long enough are held against the benchmark's, byte by byte
            edge = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, ends, -1)
            bench.confirm(numbers, np.flatnonzero(np.cumsum(edge[:-1])), small, begins, sizes)
    spread = ends - starts + 1  # each stretch with a 0 behind it
    base = np.concatenate([[0], np.cumsum(spread)])
    origin = np.arange(base[-1]) - np.repeat(base[:-1] - starts, spread)
    stream = np.zeros(base[-1], np.int64)
    real = np.ones(base[-1], bool)
    real[base[1:] - 1] = False
    stream[real] = numbers[origin[real]]
    order = suffix_array(stream, int(min((ends - starts).max(), bench.length.max())))
    low, high = bounds(stream, order, bench)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return found
    count = high[hit] - low[hit]
    places = order[np.repeat(low[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    which = np.repeat(hit, count)
    word, length = origin[places], bench.length[which]
    edge = np.zeros(len(begins) + 1, np.int64)
    np.add.at(edge, word, 1)
    np.add.at(edge, word + length, -1)
    begin, end, _ = runs(np.cumsum(edge[:-1]) > 0, first)
    of = np.searchsorted(first, begin, "right") - 1
    for r, a, b in zip(of.tolist(), (begin - first[of]).tolist(), (end - first[of]).tolist(), strict=True):
        found["hits"][r].append({"start": a, "end": b})
    row = np.searchsorted(first, word, "right") - 1
    pairs = np.unique(row * len(bench.names) + bench.item[which])
    for r, k in zip((pairs // len(bench.names)).tolist(), (pairs % len(bench.names)).tolist(), strict=True):
        found["items"][r].append(bench.names[k])
    size = extend(stream, places, bench.stream, bench.at[which], length)
    for r, n, k in zip(row.tolist(), size.tolist(), bench.item[which].tolist(), strict=True):
        if (n, bench.names[k]) > (found["longest"][r], found["longest_item"][r] or ""):
            found["longest"][r], found["longest_item"][r] = n, bench.names[k]
    return found


def blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int):
    """The benchmark's (name, text) rows in lists of about ``limit`` bytes at most."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"), text_or_empty(F.col(text_col)).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + F.octet_length("name"))).first()[0] or 0
    parts = -(-total // limit) or 1
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == k)
        yield sorted({(r["name"], r["text"]) for r in part.collect()})


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``hits``, ``n_hit``, ``items``, ``longest``, ``longest_item``.

    ``hits`` are the half-open spans of word numbers inside an occurrence of a window: ``window``
    consecutive words of an item, or all words of a shorter one. ``items`` are the ids, as strings in
    string order, of items with an occurring window; ``longest`` the words of the longest verbatim
    match that holds a window, and ``longest_item`` the item it is from (of equal ones the greatest
    name). Words are runs of 0-9, a-z and characters beyond ASCII, with A-Z lower-cased.

    Null texts have no words, and items without words occur nowhere; a null item id is the name "".
    Items that share an id count once. Document ids may repeat or be null: every row is judged by
    itself. Empty tables on either side are fine. Other columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).cast("binary").alias("body"))
    passes = []
    for part in blocks(benchmark, item_id_col, item_text_col, block_bytes):
        sent = sc.broadcast(Benchmark.build(part, window))  # of block_bytes of text

        def run(batches, sent=sent):
            for batch, data, offsets in chunks(batches, 2):
                made = search(data, offsets, sent.value) | {"row": batch.column(0), "id": batch.column(1)}
                made["items"] = [sorted(x) for x in made["items"]]
                yield pa.RecordBatch.from_arrays([made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], t) for n, t in zip(ARROW.names, ARROW.types, strict=True)], schema=ARROW)

        passes.append(rows.mapInArrow(run, SCHEMA))
    found = passes[0]
    if len(passes) > 1:
        for more in passes[1:]:
            found = found.unionByName(more)
        found = found.groupBy("row").agg(
            F.first("id").alias("id"), F.max("n_words").alias("n_words"), F.sort_array(F.flatten(F.collect_list("hits"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max(F.struct("longest", "longest_item")).alias("best")
        )
        joined = f"aggregate(spans, cast(array() as {SPAN}), (m, s) -> if(size(m) > 0 and element_at(m, -1).end >= s.start, concat(slice(m, 1, size(m) - 1), array(named_struct('start', element_at(m, -1).start, 'end', greatest(element_at(m, -1).end, s.end)))), concat(m, array(s))))"
        found = found.select("row", "id", "n_words", F.expr(joined).alias("hits"), "items", "best.longest", "best.longest_item")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(F.col("id").alias(id_col), "n_words", "hits", n_hit.alias("n_hit"), "items", "longest", "longest_item", "row")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs``, all columns, without the rows that hold a window of the benchmark.

    Every row goes or stays by its own text, whatever its id. Each block of the benchmark is a narrow
    pass that filters what the pass before it left. Other cases as in ``contamination``.
    """
    sc, at = docs.sparkSession.sparkContext, docs.columns.index(text_col)
    for part in blocks(benchmark, item_id_col, item_text_col, block_bytes):
        sent = sc.broadcast(Benchmark.build(part, window))  # of block_bytes of text

        def run(batches, sent=sent):
            for batch in batches:
                body = pc.fill_null(batch.column(at).cast(pa.string()), "").cast(pa.binary())
                for rows, data, offsets in chunks([pa.RecordBatch.from_arrays([body, pa.array(np.arange(len(body)))], ["body", "i"])], 0):
                    clean = [not x for x in search(data, offsets, sent.value)["hits"]]
                    yield batch.slice(rows.column(1)[0].as_py(), rows.num_rows).filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
