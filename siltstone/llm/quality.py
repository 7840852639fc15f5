"""A quality classifier with supervised subword embeddings.

The vector of a document is the mean of learned vectors of its hashed words, of its hashed character
n-grams (3 and 4 bytes) and of its word pairs; a softmax over two classes stands above. Training is stochastic
gradient descent in NumPy on the driver, over a sample of labelled rows that ``rows_per_class``
bounds. As mean and output layer are linear, the trained model is folded into one number for each
bucket; scoring is then a lookup and a sum over the whole text, in one narrow pass. The numbers are
kept as 64-bit integers, so a score doesn't depend on how rows are batched.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesarrays import byte_values, chunks, mix, run_hashes, runs
from .common import text_or_empty

BITS = 16
GRAMS = (3, 4)
DIM = 16
#: Labelled rows of each class that the training reads at most, the first ones by a hash of the id.
ROWS_PER_CLASS = 2000
#: Bytes of text of each class that the training reads at most; rows are taken whole.
BYTES_PER_CLASS = 64 << 20
EPOCHS, RATE = 6, 2.0
#: A weight of 2**8 may be summed 2**31 times before 64 bits are full, so texts of gigabytes don't overflow.
FIXED_POINT = 1 << 24
THRESHOLD = 0.3


def gram_buckets(data: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n bytes that begin at each position; n - 1 fewer than there are bytes."""
    if len(data) < n:
        return np.zeros(0, np.uint32)
    key = data[: len(data) - n + 1].astype(np.uint32)
    for k in range(1, n):
        key |= data[k : len(data) - n + 1 + k].astype(np.uint32) << np.uint32(8 * k)
    key *= np.uint32(0x9E3779B1 if n == 3 else 0x85EBCA77)
    return key >> np.uint32(32 - BITS)


def word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each run of bytes over 32, of each run with the next one, and the first run of each row.

    A pair is hashed by the difference of its words' hashes, so all pairs of one word with itself
    share a bucket.
    """
    starts, ends, first = runs(data > 32, offsets)
    hashed, shift = run_hashes(data, starts, ends, byte_values()), np.uint64(64 - BITS)
    return (hashed >> shift).astype(np.uint32), (mix(hashed[1:] - hashed[:-1]) >> shift).astype(np.uint32), first


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of one text, over all kinds of features, and how often each occurs."""
    data = np.frombuffer(text, np.uint8)
    parts = [gram_buckets(data, n) + np.uint32(k << BITS) for k, n in enumerate(GRAMS)]
    words, pairs, _ = word_buckets(data, np.array([0, len(data)]))
    parts += [words + np.uint32(len(GRAMS) << BITS), pairs + np.uint32((len(GRAMS) + 1) << BITS)]
    return np.unique(np.concatenate(parts), return_counts=True)


@dataclass
class Model:
    table: np.ndarray  # int64, one for each bucket: its share of the logit of class 1, in FIXED_POINT
    bias: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The probability of class 1 for each row of a view."""
        total = np.zeros(len(offsets) - 1, np.int64)
        count = np.zeros(len(offsets) - 1, np.int64)
        size = 1 << BITS
        for k, n in enumerate(GRAMS):
            sums = np.zeros(max(len(data) - n + 2, 1), np.int64)
            np.cumsum(self.table[k * size : (k + 1) * size][gram_buckets(data, n)], out=sums[1:])
            here = np.maximum(np.diff(offsets) - n + 1, 0)
            low = np.minimum(offsets[:-1], len(sums) - 1)
            total += sums[np.minimum(low + here, len(sums) - 1)] - sums[low]
            count += here
        words, pairs, first = word_buckets(data, offsets)
        for k, buckets, last in ((len(GRAMS), words, first[1:]), (len(GRAMS) + 1, pairs, np.maximum(first[1:] - 1, first[:-1]))):
            sums = np.concatenate([[0], np.cumsum(self.table[k * size : (k + 1) * size][buckets])])
            low, high = np.minimum(first[:-1], len(sums) - 1), np.minimum(last, len(sums) - 1)
            total += sums[high] - sums[low]
            count += last - first[:-1]
        logit = total / (np.maximum(count, 1) * float(FIXED_POINT)) + self.bias
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))


def train(rows: list[tuple[bytes, int]], prior: tuple[int, int], seed: int = 7, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fit on (text, class) pairs; ``prior`` counts the labelled rows of class 0 and 1 that they stand for.

    Without rows of both classes the bucket numbers are 0 and the score is the smoothed prior.
    """
    size = (len(GRAMS) + 2) << BITS
    odds = math.log((prior[1] + 1) / (prior[0] + 1))
    have = [sum(1 for _, y in rows if y == k) for k in (0, 1)]
    if not all(have):
        return Model(np.zeros(size, np.int64), odds)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    output, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    made = []
    for text, y in rows:
        buckets, counts = features(text)
        made.append((buckets, (counts / max(counts.sum(), 1)).astype(np.float32), y))
    steps, done = epochs * len(made), 0
    for _ in range(epochs):
        for i in rng.permutation(len(made)):
            buckets, share, y = made[i]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[buckets] if len(buckets) else np.zeros(dim, np.float32)
            z = hidden @ output + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1  # the gradient at the softmax
            if len(buckets):
                vectors[buckets] -= lr * np.outer(share, output @ p)
                output -= lr * np.outer(hidden, p)
            bias -= 0.05 * lr * p
    weights = vectors.astype(np.float64) @ (output[:, 1] - output[:, 0]).astype(np.float64)
    shift = odds - math.log((have[1] + 1) / (have[0] + 1))  # from the sample's share of classes to that of all labels
    return Model(np.round(weights * FIXED_POINT).astype(np.int64), float(bias[1] - bias[0]) + shift)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows_per_class: int = ROWS_PER_CLASS, bytes_per_class: int = BYTES_PER_CLASS) -> Model:
    """Train on labelled rows whose id isn't held out; reads at most ``rows_per_class`` rows and ``bytes_per_class`` bytes of each class.

    Rows with a null id, or a label other than 0 and 1, teach nothing. Of repeated labels of one id
    each counts for the prior and one, the lowest, is learned; of several texts of one id the least
    in byte order is. Rows come in the order of a hash of the id; those after which the class would
    hold more bytes than allowed are left out.
    """
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    prior = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked: dict[int, int] = {}
    for y in (1, 0):  # at most rows_per_class small rows each
        picked |= {r["id"]: y for r in known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(rows_per_class).collect()}
    rows: list[tuple[bytes, int]] = []
    if picked:
        wanted = spark.createDataFrame(sorted(picked.items()), "id long, y int")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).cast("binary").alias("body"))
        found = texts.join(F.broadcast(wanted), "id")
        # one row per picked id: lengths first, so that no more than the bound comes to the driver
        length = {r["id"]: r["n"] for r in found.groupBy("id").agg(F.max(F.octet_length("body")).alias("n")).collect()}
        if sum(length.values()) > bytes_per_class:
            in_order = [r["id"] for r in wanted.where(F.col("id").isin(list(length))).orderBy(F.xxhash64("id"), "id").collect()]
            kept = within(in_order, length, picked, bytes_per_class)
            found = texts.join(F.broadcast(spark.createDataFrame([(k, picked[k]) for k in sorted(kept)], "id long, y int")), "id")
        rows = [(bytes(r["body"]), r["y"]) for r in found.groupBy("id", "y").agg(F.min("body").alias("body")).orderBy("id").collect()]
    return train(rows, (prior.get(0, 0), prior.get(1, 0)))


def within(ids: list[int], length: dict[int, int], label: dict[int, int], bound: int) -> set[int]:
    """The ids, taken in order, whose lengths keep the sum of their label at ``bound`` or less."""
    total, kept = [0, 0], set()
    for k in ids:
        if total[label[k]] + length[k] <= bound:
            total[label[k]] += length[k]
            kept.add(k)
    return kept


def held_out(id_column):
    """Every fifth row by the checksum of its id, kept for measuring."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where the score is at least ``threshold``).

    Only the text is read for the score: whole, null as empty. An empty text gets the score of the
    prior. Rows may repeat; null ids pass through; an empty table gives an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: (len(GRAMS) + 2) * 2**BITS integers
    out = pa.schema([("id", pa.int64()), ("score", pa.float64())])

    def run(batches):
        for part, data, offsets in chunks(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(sent.value.scores(data, offsets))], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).cast("binary").alias("body"))
    scored = rows.mapInArrow(run, "id long, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least ``threshold``; cases as in ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            body = pc.fill_null(batch.column(at).cast(pa.string()), "").cast(pa.binary())
            for part, data, offsets in chunks([pa.RecordBatch.from_arrays([body, pa.array(np.arange(len(body)))], ["body", "i"])], 0):
                good = sent.value.scores(data, offsets) >= threshold
                yield batch.slice(part.column(1)[0].as_py(), part.num_rows).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
