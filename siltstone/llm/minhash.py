"""Near-duplicate documents by weighted minwise hashing (BagMinHash).

A document is the multiset of its five-word shingles. Every shingle owns Poisson processes over
dyadic intervals of weight ([0,1), [1,2), [2,4), ...): points come in order of time, each with a
level inside its interval and one of the signature's components; a point counts where its level is
below the shingle's multiplicity. A component keeps its earliest point, so two documents agree in a
component with a probability that equals their weighted Jaccard similarity. As the earliest points
of all components lie early, the processes are followed only to a horizon that shrinks with the
size of the document, and further in the rare case that a component is still empty.

Plan: one narrow pass makes signatures; bands of them are shuffled as (band hash, text digest), with
equal texts folded first, so that copies cost one row. Within a band hash, texts go by the next
band's hash, and each is paired with its predecessor, in large bands part by part. Pairs are verified on
whole texts by multiset overlap, and verified links give classes by connected components. Where texts
that share a band hash are still in different classes and not all pairs of them were tried, the
rest is settled exactly by an inverted index: texts of different classes can only be linked if they meet
in a rare shingle that several classes have, so texts without one are left out, and the others are
compared in blocks of bounded size, each of which reports a spanning star of its links and no pairs. So the pairing loses no link that the bands offer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesarrays import byte_values, chunks, give_back, mix, runs, tabulated, view
from .common import cut, shuffle_width, text_or_empty, without_rows
from .components import components, ordered_pairs

WORDS, SIMILARITY = 5, 0.8
#: Rows of a band and number of bands: a pair of similarity 0.8 misses all bands with probability 3e-6.
ROWS, BANDS = 4, 24
HORIZON = 3.5
#: Texts and bytes of a block in which open texts are compared with each other, about.
BLOCK_ROWS, BLOCK_BYTES = 400, 2 << 20
#: Bytes of text whose shingles are in memory at a time (some 200 bytes for each byte), and pairs of texts compared at a time.
CHUNK_BYTES, PAIRS = 1 << 18, 64
#: Texts of a band that are put in order by one task, about; larger bands are dealt into parts.
BAND_TEXTS = 1000
#: Shingles of several classes, of two numbers each, that are broadcast at most; more are joined.
BROADCAST_ROWS = 200_000
LENGTH_STEP = np.uint64(0xD1342543DE82EF95)
ID_BITS = np.uint64(24)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle: ``width`` consecutive words (runs of bytes over 32), or all words of a shorter row."""
    starts, ends, first = runs(data > 32, offsets)
    word = tabulated(data, starts, ends, byte_values())
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    left = first[row + 1] - np.arange(len(word))  # words from here to the row's end
    size = np.minimum(n, width)[row]
    at = np.flatnonzero(left >= size)
    hashed, size = np.zeros(len(at), np.uint64), size[at]
    for k in range(width):
        inside = size > k
        hashed = np.where(inside, (hashed + word[np.minimum(at + k, len(word) - 1)]) * LENGTH_STEP, hashed) if len(word) else hashed
    return row[at], mix(hashed)


def multiset(row: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, shingle) and how often each occurs."""
    key = mix(hashed ^ mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(begin, len(key)))
    return row[order[begin]], hashed[order[begin]], count


def unit(bits: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from the upper bits of hashes."""
    return ((bits >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(row: np.ndarray, hashed: np.ndarray, weight: np.ndarray, rows: int, size: int) -> np.ndarray:
    """``rows`` x ``size`` signature values (24 bits); rows without shingles keep the largest value."""
    best = np.full(rows * size, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(row, weight, rows)
    # nodes of the hierarchy: [0,1), then [2**j, 2**(j+1)) as far as the weight reaches
    level = [np.zeros(len(row), np.int64)]
    index = [np.arange(len(row))]
    j = 0
    while len(deep := np.flatnonzero(weight > 1 << j)):
        level.append(np.full(len(deep), j + 1))
        index.append(deep)
        j += 1
    index, level = np.concatenate(index), np.concatenate(level)
    node_row = row[index]
    key = mix(hashed[index] + level.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    span = np.where(level > 0, low, 1.0)
    need = weight[index]
    horizon = np.where(total > 0, (math.log(size) + HORIZON) / np.maximum(total, 1), 0)
    pending = total > 0
    while pending.any():
        live = np.flatnonzero(pending[node_row])
        time = np.zeros(len(live))
        state = key[live]
        while len(live):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            time = time - np.log(unit(state)) / (size * span[live])
            early = time <= horizon[node_row[live]]
            live, time, state = live[early], time[early], state[early]
            more = mix(state ^ np.uint64(0xA0761D6478BD642F))
            inside = low[live] + unit(mix(more)) * span[live] <= need[live]
            component = ((more >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)
            who = node_row[live]
            code = (time / horizon[who] * 2.0**39).astype(np.uint64) << ID_BITS | (state & np.uint64((1 << 24) - 1))
            slot = who * size + component.astype(np.int64)
            np.minimum.at(best, slot[inside], code[inside])
        empty = (best.reshape(rows, size) == np.iinfo(np.uint64).max).any(1)
        again = pending & empty
        best.reshape(rows, size)[again] = np.iinfo(np.uint64).max
        horizon = np.where(again, horizon * 2, horizon)
        pending = again
    return best.reshape(rows, size) & np.uint64((1 << 24) - 1)


def band_hashes(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band, which also depends on the band's number."""
    n, size = signature.shape
    parts = signature.reshape(n, size // rows, rows)
    out = np.broadcast_to(mix(np.arange(size // rows, dtype=np.uint64) + np.uint64(1)), (n, size // rows)).copy()
    for k in range(rows):
        out = mix(out + parts[:, :, k] * LENGTH_STEP)
    return out


def similarities(a: pa.Array, b: pa.Array, width: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the texts in two binary columns, row by row."""
    sides = []
    for column in (a, b):
        row, hashed = shingles(*view(column), width)
        sides.append(multiset(row, hashed))
    key = [mix(h ^ mix(r.astype(np.uint64))) for r, h, _ in sides]
    _, i, j = np.intersect1d(key[0], key[1], assume_unique=True, return_indices=True)
    shared = np.bincount(sides[0][0][i], np.minimum(sides[0][2][i], sides[1][2][j]), len(a))
    total = sum(np.bincount(r, w, len(a)) for r, _, w in sides)
    return shared / np.maximum(total - shared, 1)


def banded(texts: DataFrame, width: int, rows: int, bands: int) -> DataFrame:
    """(band hash, next band's hash, tid) of every row of (tid, body) that has words; equal rows once."""
    out = pa.schema([("tid", pa.binary()), ("hashes", pa.list_(pa.int64()))])

    def run(batches):
        for part, data, offsets in chunks(batches, 1, CHUNK_BYTES):
            n = len(offsets) - 1
            row, hashed = shingles(data, offsets, width)
            made = band_hashes(signatures(*multiset(row, hashed), n, rows * bands), rows).view(np.int64)
            full = np.bincount(row, minlength=n) > 0
            ids = part.column(0).filter(pa.array(full))
            flat = pa.array(made[full].ravel())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), flat)], schema=out)

    made = texts.mapInArrow(run, "tid binary, hashes array<long>")
    pairs = made.select("tid", F.posexplode("hashes").alias("k", "band"), "hashes")
    return pairs.select("band", F.col("hashes")[(F.col("k") + 1) % bands].alias("next"), "tid").distinct()


def predecessors(shared: DataFrame, band_texts: int = BAND_TEXTS) -> DataFrame:
    """Distinct (a, b) of texts that follow each other in a band of ``shared`` (band, next, tid, n); n is the size of the band.

    Bands of more than ``band_texts`` are dealt into parts of about that many by a hash; texts follow each
    other in these parts, and the first texts of the parts do so in the band.
    """
    dealt = shared.withColumn("part", F.pmod(F.xxhash64("tid"), F.ceil(F.col("n") / band_texts)).cast("int"))
    behind = lambda *by: F.lag("tid").over(Window.partitionBy(*by).orderBy("next", "tid"))
    inside = dealt.withColumn("before", behind("band", "part"))
    heads = inside.where(f"before is null and n > {band_texts}").withColumn("before", behind("band"))
    return ordered_pairs(inside.select("tid", "before").unionByName(heads.select("tid", "before")), "tid", "before")


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose texts (tid, body) have at least ``similarity``."""
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                batch = whole.slice(at, PAIRS)
                good = pa.array(similarities(batch.column(2), batch.column(3), width) >= similarity)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(good), batch.column(1).filter(good)], schema=out)
        give_back()

    left = texts.select(F.col("tid").alias("b"), F.col("body").alias("body_b"))
    right = texts.select(F.col("tid").alias("a"), F.col("body").alias("body_a"))
    return pairs.join(left, "b").join(right, "a").select("a", "b", "body_a", "body_b").mapInArrow(run, "a binary, b binary")


def meetings(texts: DataFrame, similarity: float, width: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(tid, l, h): the shingles ``h`` of which any two linked texts (tid, body, label) of different labels have one in common, and a hash of the label.

    A text's shingles are put in one order for all texts: those that one label alone has, and then the
    others, the rarest first. The first shingle that two linked texts share is, in both of them, followed
    by at least ``similarity`` of the text (itself included), as the overlap is no smaller; and what one
    label alone has joins no labels. So only shingles with that much behind them need to be met, and a
    text of which more than the rest is its own label's has none.
    """
    out = pa.schema([("tid", pa.binary()), ("l", pa.int64()), ("n", pa.int64()), ("hashes", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64()))])

    def run(batches):
        for part, data, offsets in chunks(batches, 1, CHUNK_BYTES):
            row, hashed, weight = multiset(*shingles(data, offsets, width))
            order = np.argsort(row, kind="stable")
            edges = pa.array(np.searchsorted(row[order], np.arange(len(offsets))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(x[order])) for x in (hashed.view(np.int64), weight.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(np.bincount(row, weight, len(offsets) - 1).astype(np.int64)), *lists], schema=out)

    made = texts.select("tid", "body", F.xxhash64("label").alias("l")).mapInArrow(run, "tid binary, l long, n long, hashes array<long>, weights array<long>")
    each = made.select("tid", "l", "n", F.explode(F.arrays_zip("hashes", "weights")).alias("s")).select("tid", "l", "n", F.col("s.hashes").alias("h"), F.col("s.weights").alias("w"))
    shared = cut(each.groupBy("h").agg(F.count("*").alias("f"), F.min("l").alias("x"), F.max("l").alias("y")).where("x < y").select("h", "f"))
    if shared.count() <= broadcast_rows:
        shared = F.broadcast(shared)
    behind = Window.partitionBy("tid").orderBy(F.desc("f"), F.desc("h")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.join(shared, "h").withColumn("rest", F.sum("w").over(behind))
    return placed.where(F.col("rest") >= F.col("n") * (similarity - 1e-9)).select("tid", "l", "h")


def with_labels(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` (tid, ...) with the label of their class, which is the tid itself without links."""
    return rows.join(classes, rows["tid"] == classes["node"], "left").select(*rows.columns, F.coalesce("label", "tid").alias("label"))


def overlaps(row: np.ndarray, hashed: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Multiset overlaps of all pairs of rows, as a matrix."""
    element = np.repeat(hashed, weight)
    of = np.repeat(row, weight)
    times = np.arange(len(element)) - np.repeat(np.cumsum(weight) - weight, weight)
    element = mix(element + times.astype(np.uint64) * LENGTH_STEP)
    order = np.argsort(element, kind="stable")
    element, of = element[order], of[order]
    begin = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]])) if len(element) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(element)))
    shared = np.zeros((rows, rows), np.float32)
    for n in range(2, 9):  # few rows have it: pairs one by one
        members = of[begin[size == n][:, None] + np.arange(n)]
        for i in range(n):
            for j in range(n):
                if i != j:
                    np.add.at(shared, (members[:, i], members[:, j]), 1)
    common = np.flatnonzero(size > 8)
    for k in range(0, len(common), 2048):  # many have it: products of incidence matrices
        part = common[k : k + 2048]
        at = np.repeat(np.arange(len(part)), size[part])
        where = np.repeat(begin[part] - np.cumsum(size[part]) + size[part], size[part]) + np.arange(size[part].sum())
        incidence = np.zeros((rows, len(part)), np.float32)
        incidence[of[where], at] = 1
        shared += incidence @ incidence.T
    return shared


def block_links(tids: list[bytes], bodies: pa.Array, similarity: float, width: int) -> list[tuple[bytes, bytes]]:
    """Links that join the texts of a block as all links among them would: a star for each class."""
    row, hashed, weight = multiset(*shingles(*view(bodies), width))
    total = np.bincount(row, weight, len(tids))
    shared = overlaps(row, hashed, weight, len(tids))
    near = (shared >= similarity * (total[:, None] + total[None, :] - shared)) & (shared > 0)
    np.fill_diagonal(near, True)
    label = np.arange(len(tids))
    while True:
        lower = np.where(near, label[None, :], len(tids)).min(1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    return [(tids[k], tids[i]) for i, k in enumerate(label.tolist()) if i != k]


def settled(open_: DataFrame, texts: DataFrame, similarity: float, width: int, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) that join open texts (band, tid, label) exactly as all their links would; texts of one label are joined already, and without that column none are.

    Texts without a shingle that has to be met (``meetings``) are left out. The others that meet in bands,
    directly or over others, form a group; a group is dealt into blocks by a hash, and every two blocks
    of a group meet in one task. No pair leaves a task but those of a star for each class that it finds.
    """
    named = (open_ if "label" in open_.columns else open_.withColumn("label", F.col("tid"))).select("tid", "label").distinct()
    met = meetings(texts.join(named, "tid"), similarity, width).select("tid").distinct()
    able = cut(open_.join(met, "tid").select("band", "tid"))
    first = able.groupBy("band").agg(F.min("tid").alias("a"), F.count("*").alias("n")).where("n > 1")
    groups = components(cut(able.join(first, "band").select("a", F.col("tid").alias("b")).distinct()))
    sized = texts.join(groups, F.col("tid") == F.col("node")).select("tid", F.col("label").alias("grp"), "body")
    parts = sized.groupBy("grp").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.octet_length("body")) / block_bytes)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int")
    placed = sized.join(parts, "grp").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = placed.select("grp", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "tid", "body")
    dealt = keyed.repartition(shuffle_width(texts.sparkSession), "grp", "low", "high").sortWithinPartitions("grp", "low", "high", "tid")
    out = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(batches):
        def emit(tids, bodies):
            found = block_links(tids, pa.array(bodies, pa.binary()), similarity, width) if len(tids) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], schema=out)

        key, tids, bodies = None, [], []
        for batch in batches:
            for *here, tid, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != key:
                    yield emit(tids, bodies)
                    key, tids, bodies = here, [], []
                tids.append(tid)
                bodies.append(body)
        yield emit(tids, bodies)
        give_back()

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """One row per row of ``docs``: its id, ``class_id`` (smallest id of its class), ``class_size`` (rows), ``kept``.

    Classes are the connected components of links between texts whose shingle multisets have a
    weighted Jaccard similarity of at least ``similarity``; equal texts are always of one class.
    A text of fewer than ``width`` words, but not none, is one shingle. Null counts as the empty
    text; texts without words are only equal to copies of themselves. ``kept`` marks the rows whose
    id is the class's; a class whose ids are all null has a null class id and keeps its rows. An
    empty table gives an empty result. Other columns are ignored.
    """
    member = classes_of(docs, id_col, text_col, similarity, width, rows, bands)
    return member.select(F.col("id").alias(id_col), "class_id", "class_size", (F.col("class_id").isNull() | F.coalesce(F.col("id") == F.col("class_id"), F.lit(False))).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, width: int = WORDS, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``docs``, all columns, with exactly one row of each class: that of the smallest id, of equal or null ids the first in the table.

    Cases are those of ``near_duplicates``. Rows are numbered, so the table has to be read in one order
    every time (files and checkpoints are).
    """
    return without_rows(docs, classes_of(docs, id_col, text_col, similarity, width, rows, bands).where("row <> keep_row").select("row"))


def classes_of(docs: DataFrame, id_col: str, text_col: str, similarity: float, width: int, rows: int, bands: int) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``row`` (its number in the table), and the ``class_id``, ``class_size`` and ``keep_row`` of its class."""
    all_rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).cast("binary").alias("body"))
    all_rows = all_rows.select("row", "id", F.unhex(F.substring(F.sha2("body", 256), 1, 32)).alias("tid"), "body")
    bands_of = cut(banded(all_rows.select("tid", "body"), width, rows, bands))
    crowded = bands_of.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(bands_of.join(crowded, "band"))
    pairs = predecessors(shared)
    wanted = shared.select("tid").distinct()
    texts = cut(all_rows.join(wanted, "tid", "left_semi").groupBy("tid").agg(F.first("body").alias("body")))
    links = cut(verified(pairs, texts, similarity, width))
    classes = components(links)
    # what neighbours didn't settle
    labelled = with_labels(shared.select("band", "n", "tid"), classes)
    split = labelled.where("n > 2").groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("band")
    open_ = cut(labelled.join(split, "band", "left_semi").select("band", "tid", "label"))
    if not open_.isEmpty():
        late = cut(settled(open_, texts, similarity, width))
        if not late.isEmpty():
            classes = components(links.unionByName(late))
    member = all_rows.select("row", "id", "tid").join(classes, F.col("tid") == F.col("node"), "left").select("row", "id", F.coalesce("label", "tid").alias("class"))
    # checkpointed, so that the join below stands on two plain exchanges and Spark can split a large class
    sizes = cut(member.groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))["row"].alias("keep_row")))
    return member.join(sizes, "class").select("id", "row", "class_id", "class_size", "keep_row")
