"""Personal data with fixed patterns and a skip-chain conditional random field.

The patterns give the base spans. A conditional random field over the tokens that hold a digit or an
``@`` (no other token can be labelled) then adds spans that they miss: neighbours are linked in a
chain, and each token is linked to the next one in the document that is equal to it, or has the same
digits, so that all mentions of one value tend to one label. Tokens that write the value of a base span
in another way (without its prefix, with other separators) are linked to that span. Tokens of base
spans are evidence: they hold their label while messages pass. Loopy belief propagation runs over many
documents at once, as their graphs are disjoint. All weights, of features and of pairs, are fitted
together on base spans of a bounded sample, where missed repeats of a base span count as unknown. A
span that the field adds must be inside the bounds of its kind. One narrow pass; documents without a
digit or an ``@`` cost one search.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Documents with a digit or an @ that the training reads at most, the first ones by a hash of the id.
SAMPLE = 400
ITERATIONS, DAMPING, SURE = 8, 0.5, 0.9
#: Digits by which a part of a number still tells the value, tokens that one mention can have, and characters of context on each side.
TELLING, MENTION, AROUND = 7, 8, 24

HINT = re.compile("[0-9@]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"\S+")
EDGE = "\"'`()[]{}<>,;:.!?*#"
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str):
    """Matches of local part, @ and dotted domain from left to right, found from each @; linear on any text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, by start and then kind."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if len(m[0]) >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def tokens(text: str) -> list[tuple[int, int, int]]:
    """(ordinal, start, end) of the tokens with a digit or an @, without punctuation at their edges."""
    found = []
    for k, m in enumerate(TOKEN.finditer(text)):
        if HINT.search(m[0]):
            word = m[0]
            left = len(word) - len(word.lstrip(EDGE))
            found.append((k, m.start() + left, m.start() + len(word.rstrip(EDGE))))
    return [x for x in found if x[2] > x[1]]


#: Features of the token itself, and buckets of the word on each side.
N_OWN, BUCKETS = 26, 32
N_FEATURES = N_OWN + 2 * BUCKETS


def context(text: str, start: int, end: int) -> list[int]:
    """Numbers of the features that the words around a token give."""
    sides = text[max(0, start - AROUND) : start].split()[-1:], text[end : end + AROUND].split()[:1]
    on = []
    for side, words in enumerate(sides):
        word = words[0].strip(EDGE).lower() if words else ""
        on.append(N_OWN + side * BUCKETS + (0 if not word else 1 if HINT.search(word) else 2 + zlib.crc32(word.encode("utf-8", "replace")) % (BUCKETS - 2)))
    return on


def digits_of(word: str) -> str:
    return "".join(c for c in word if "0" <= c <= "9")


def ways(kind: int, value: str) -> set[str]:
    """Keys of the ways to write a value: an address by its local part or its four numbers, a number by its telling ends."""
    if kind == 0:
        return {value.lower().partition("@")[0] + "@"}
    if kind == 1:
        return {".".join(re.findall("[0-9]+", value))}
    digits = digits_of(value)
    return {digits[k:] for k in range(len(digits) - TELLING + 1)}


def features(word: str) -> list[int]:
    """Numbers of the features that a token has by itself."""
    digits = sum("0" <= c <= "9" for c in word)
    letters = sum(c.isalpha() for c in word)
    dots = word.count(".")
    on = [0, 1 + min((0, 1, 2, 3, 4, 5, 6, 7, 7, 8, 8, 8, 9, 9, 9, 9, 10)[min(digits, 16)], 10)]
    if "@" in word:
        on += [12, 13 + ("." in word.partition("@")[2])]
    on += [15 + min(dots, 4)]
    for k, yes in enumerate((word.startswith("+"), "-" in word, digits == len(word), letters > 0 and digits > 0, "(" in word or ")" in word, digits >= 12)):
        if yes:
            on.append(20 + k)
    return on


@dataclass
class Model:
    unary: np.ndarray  # N_FEATURES x labels
    chain: np.ndarray  # labels x labels
    skip: np.ndarray  # labels x labels
    value: np.ndarray | None = None  # labels x labels, for tokens that tell one value; without it as skip


class Graph:
    """Tokens of many documents with their edges; labels 0 (none) and 1 + kind."""

    def __init__(self):
        self.rows: list[int] = []
        self.spans: list[tuple[int, int]] = []
        self.on: list[list[int]] = []
        self.labels: list[int] = []
        self.repeats: set[int] = set()  # tokens without a label that tell the value of a base span
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        self.value: list[tuple[int, int]] = []

    def add(self, row: int, text: str, base: list[tuple[int, int, int]]) -> None:
        last, before, k = {}, -9, 0
        origin, found, known = len(self.rows), tokens(text), {}
        for order, start, end in found:
            me, word = len(self.rows), text[start:end]
            while k < len(base) and base[k][2] <= start:
                k += 1
            over = next((x for x in base[k : k + 4] if x[0] < end and x[2] > start), None)
            self.rows.append(row)
            self.spans.append((start, end))
            self.on.append(features(word) + context(text, start, end))
            self.labels.append(0 if over is None else 1 + over[1])
            if over is not None:
                known.setdefault(over, me)
            if order - before <= 2 and before >= 0:
                self.chain.append((me - 1, me))
            digits = digits_of(word)
            telling = "@" in word or len(digits) >= 6
            for key in {word.lower(), digits if len(digits) >= 6 else word.lower()}:
                if key in last:
                    (self.value if telling else self.skip).append((last[key], me))
                last[key] = me
            before = order
        if known:
            self.link(text, found, origin, known)

    def link(self, text: str, found: list[tuple[int, int, int]], origin: int, known: dict) -> None:
        """Link tokens outside base spans that tell the value of one to a token of it."""
        told = {}
        for (start, kind, end), me in known.items():
            for key in ways(kind, text[start:end]):
                told.setdefault(key, me)
        plain = [not x for x in self.labels[origin:]]
        words = [text[start:end] for _, start, end in found]
        linked = {}
        for k, word in enumerate(words):
            if not plain[k]:
                continue
            if "@" in word:
                keys = ways(0, word)
            else:
                groups = re.findall("[0-9]+", word)
                keys = {".".join(groups)} if len(groups) == 4 else set()
            for key in keys & told.keys():
                linked.setdefault(k, told[key])
            digits = ""
            for j in range(k, min(k + MENTION, len(words))):
                if not plain[j] or j > k and found[j][0] != found[j - 1][0] + 1 or "@" in words[j]:
                    break
                digits += digits_of(words[j])
                if len(digits) > 24:
                    break
                hit = told.get(digits, told.get(digits.lstrip("0"))) if len(digits) >= TELLING else None
                if hit is not None:
                    for t in range(k, j + 1):
                        linked.setdefault(t, hit)
        for k, known_token in linked.items():
            self.repeats.add(origin + k)
            self.value.append((known_token, origin + k))

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.on), N_FEATURES))
        for i, on in enumerate(self.on):
            x[i, on] = 1
        return x


#: Where the pair weights start and what they are drawn back to: mentions of one value agree, other pairs say nothing.
AGREE = 6.0
#: How strongly the weights are drawn back: of the token's own features, of the words around it (many, so each says little), of the pairs.
DECAY_OWN, DECAY_AROUND, DECAY_PAIR = 0.001, 1.0, 0.05


def train(texts: list[str], rounds: int = 300, rate: float = 0.5) -> Model:
    """All weights of the field at once, by gradient ascent on the pseudo-likelihood of the base labels.

    Each token is predicted from its features and the labels of its neighbours in the chain, over skip
    edges and over edges of one value. Repeats that the patterns miss are unknown, not negative: they
    and their edges take no part. Without any token in the sample all weights are 0 and the field adds
    nothing.
    """
    graph, n = Graph(), len(KINDS) + 1
    for text in texts:
        graph.add(0, text, base_spans(text))
    if not graph.labels:
        return Model(np.zeros((N_FEATURES, n)), np.zeros((n, n)), np.zeros((n, n)))
    known = np.ones(len(graph.labels), bool)
    known[list(graph.repeats)] = False
    label = np.array(graph.labels)
    x, y = graph.matrix(), np.eye(n)[label] * known[:, None]
    w, decay = np.zeros((N_FEATURES, n)), np.full((N_FEATURES, 1), DECAY_OWN)
    decay[N_OWN:] = DECAY_AROUND
    start = [np.zeros((n, n)), np.zeros((n, n)), np.full((n, n), -AGREE) + 2 * AGREE * np.eye(n)]
    pair, ends = [p.copy() for p in start], []
    for edges in (graph.chain, graph.skip, graph.value):
        e = np.array(edges, np.int64).reshape(-1, 2)
        e = e[known[e[:, 0]] & known[e[:, 1]]]
        ends.append((e[:, 0], e[:, 1]))
    for _ in range(rounds):
        z = x @ w
        for p, (a, b) in zip(pair, ends, strict=True):
            np.add.at(z, b, p[label[a]])
            np.add.at(z, a, p[:, label[b]].T)
        q = np.exp(z - z.max(1, keepdims=True))
        miss = (y - q / q.sum(1, keepdims=True)) * known[:, None] * 4 / known.sum()
        w += rate * (x.T @ miss - decay * w)
        for p, p0, (a, b) in zip(pair, start, ends, strict=True):
            step = np.zeros((n, n))
            np.add.at(step, label[a], miss[b])
            np.add.at(step.T, label[b], miss[a])
            p += rate * (step - DECAY_PAIR * (p - p0))
    return Model(w, *pair)


def allowed(kind: int, word: str, linked: bool) -> bool:
    """Whether a token may be a span of a kind: inside the bounds of the kind's pattern, for numbers unless it repeats part of a confirmed one."""
    if kind == 0:
        return "@" in word
    if kind == 1:
        groups = re.findall("[0-9]+", word)
        return len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    digits = digits_of(word)
    return linked or (12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15)


def marginals(graph: Graph, model: Model, iterations: int = ITERATIONS) -> np.ndarray:
    """Beliefs of all tokens after loopy sum-product message passing with damping; labelled tokens keep their label."""
    unary = graph.matrix() @ model.unary
    labels = np.array(graph.labels, np.int64)
    held = np.flatnonzero(labels)
    unary[held] = -100.0
    unary[held, labels[held]] = 0.0
    edges = np.array(graph.chain + graph.skip + graph.value, np.int64).reshape(-1, 2)
    belief = unary.copy()
    if len(edges):
        pair = np.concatenate([np.repeat(model.chain[None], len(graph.chain), 0), np.repeat(model.skip[None], len(graph.skip), 0), np.repeat((model.skip if model.value is None else model.value)[None], len(graph.value), 0)])
        ahead, back = np.zeros((len(edges), unary.shape[1])), np.zeros((len(edges), unary.shape[1]))
        a, b = edges[:, 0], edges[:, 1]

        def fold(z, axis):
            top = z.max(axis, keepdims=True)
            return (np.log(np.exp(z - top).sum(axis, keepdims=True)) + top).squeeze(axis)

        for _ in range(iterations):
            forward = fold((belief[a] - back)[:, :, None] + pair, 1)
            backward = fold((belief[b] - ahead)[:, None, :] + pair, 2)
            ahead = DAMPING * ahead + (1 - DAMPING) * (forward - forward.max(1, keepdims=True))
            back = DAMPING * back + (1 - DAMPING) * (backward - backward.max(1, keepdims=True))
            belief = unary.copy()
            np.add.at(belief, b, ahead)
            np.add.at(belief, a, back)
    p = np.exp(belief - belief.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find(texts: list[str], model: Model) -> list[tuple[list, list]]:
    """For each text the base spans and the added ones, as (start, kind, end)."""
    graph, found = Graph(), []
    for k, text in enumerate(texts):
        base = base_spans(text) if HINT.search(text) else []
        found.append((base, []))
        if base or HINT.search(text):
            graph.add(k, text, base)
    if graph.rows:
        p = marginals(graph, model)
        best = p.argmax(1)
        for i in np.flatnonzero((best > 0) & (p.max(1) >= SURE)).tolist():
            (start, end), kind = graph.spans[i], int(best[i]) - 1
            if not graph.labels[i] and allowed(kind, texts[graph.rows[i]][start:end], i in graph.repeats):
                found[graph.rows[i]][1].append((start, kind, end))
    return found


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fit the field on at most ``sample`` documents that hold a digit or an @."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    hinted = rows.where(F.col("text").rlike("[0-9@]"))
    picked = hinted.select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)  # ids alone go to the driver
    return train([r["text"] for r in rows.join(F.broadcast(picked), "id").orderBy("id", "text").limit(sample).collect()])


SPANS = "array<struct<start: long, kind: string, end: long, base: boolean>>"


def personal_data(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id and ``spans`` (start, kind, end in code points; base or added).

    Spans go by start, then kind as listed in KINDS. A null text counts as empty and has none; null
    and repeated ids pass through; an empty table gives an empty result; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64()), ("base", pa.bool_())]))
    out = pa.schema([("id", pa.int64()), ("spans", kind)])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                spans = [
                    [{"start": a, "kind": KINDS[k], "end": b, "base": is_base} for a, k, b, is_base in sorted([(*x, True) for x in base] + [(*x, False) for x in added])]
                    for base, added in find(part.column(1).to_pylist(), model)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(spans, kind)], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return rows.mapInArrow(run, f"id long, spans {SPANS}").withColumnRenamed("id", id_col)
