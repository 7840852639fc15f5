"""Line deduplication by a segment-partition edit join, in DataFrame and SQL functions only.

Within one edit of each other, two lines agree in one of the two halves of the shorter (the pigeonhole
rule for threshold + 1 segments). An index key is the shorter line's length, the number of the half left
out, and hashes of what stands before and behind it. A line is indexed under its own length and probes
the length that one deletion leads to, with what stands behind the half aligned at the end.

Very common lines are folded to one copy before the shuffle, and keys that only copies of one line have
go at once. In keys of few lines all pairs are verified by a banded bit-parallel edit distance. In
crowded keys the piece left out is cut in four, and its lines are keyed again by these pieces only, until
keys are small or the piece is one character. There, lines of one length differ in that character alone:
all of them are linked with each other, which a count and a minimum say without their pairs. And a
longer line finds its partners by the hash of what the deletion of that character leaves.

Each pair of lines of one length meets in one key of each level, so links are counted once.

A threshold of k > 1 has k + 1 segments and a key for each, at the places that k edits can move it to;
lines in crowded keys are keyed again by all but k of 2k + 2 pieces, and all pairs of those keys are
verified.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

#: Distinct lines of a key beyond which the lines are keyed again by finer pieces.
CROWD = 24
#: Bound on the number of lines that are folded by a broadcast, the most common ones; no other can be more than one line in so many.
MOST_COMMON = 10_000
#: Copies of a line beyond which it counts as common, and places of a common line that are dealt together.
COPIES = 1000
WORD = (1 << 32) - 1


def second_hash(line: Column) -> Column:
    return F.xxhash64(F.lit(1), line)


def piece_keys(line: Column, n: Column, pieces: int, k: Column, gone: Column) -> Column:
    """What a line of ``n`` characters is keyed by where piece ``k`` is left out, as itself (``gone`` 0) or probing as one character longer (1): key, key2, start and size of the piece, whether it is the last."""
    short = (n - gone).cast("long")
    a, b = (F.floor(short * (k + j) / pieces).cast("int") for j in (0, 1))
    rest = [short, a, b, F.substring(line, F.lit(1), a), F.substring(line, b + 1 + gone, n)]
    return F.struct(F.xxhash64(*rest).alias("key"), F.xxhash64(F.lit(2), *rest).alias("key2"), k.cast("int").alias("k"), gone.cast("int").alias("gone"), a.alias("start"), (b - a).alias("size"), (b == short).alias("last"))


def first_keys(line: Column, n: Column, min_chars: int) -> Column:
    """(key, part) of a line by the halves of threshold-plus-one segments; ``part`` is twice the half left out and one more for a probe.

    Keys are null for empty halves, and for probes of lengths under ``min_chars``, which no line has.
    """
    made = []
    for k, gone in product((0, 1), (0, 1)):
        short = n - gone
        a, b = F.floor(short * k / 2).cast("int"), F.floor(short * (k + 1) / 2).cast("int")
        key = F.xxhash64(short, F.lit(k), F.substring(line, F.lit(1), a), F.substring(line, b + 1 + gone, n))
        made.append(F.struct(F.when(short >= max(min_chars, 2 - k), key).alias("key"), F.lit(2 * k + gone).alias("part")))
    return F.array(*made)


def shifts(runs: int, threshold: int) -> list[tuple[int, ...]]:
    """Ways in which ``threshold`` edits can move the ``runs`` parts that they leave whole, the first by 0; the last is the difference in length."""
    found = product(range(-threshold, threshold + 1), repeat=runs - 1)
    return [(0, *d) for d in found if d[-1] >= 0 and sum(abs(y - x) for x, y in zip((0, *d), d)) <= threshold]


def far_keys(line: Column, n: Column, threshold: int, pieces: int) -> Column:
    """Array of the keys of a line of ``n`` characters for more than one edit: single segments, or all but ``threshold`` of the pieces."""

    def key(name: int, short: Column, parts: list[tuple[int, int, int]]) -> Column:
        start = lambda k: F.floor(short * k / pieces).cast("int")
        return F.xxhash64(short, F.lit(name), *[F.substring(line, start(a) + 1 + d, start(b) - start(a)) for a, b, d in parts])

    if pieces == threshold + 1:
        # edits before a segment move it, edits behind it make up the rest of the difference in length
        return F.array(*[key(i, n - gone, [(i, i + 1, d)]) for i in range(pieces) for gone in range(threshold + 1) for d in range(-i, i + 1) if abs(gone - d) <= threshold - i])
    ways = shifts(threshold + 1, threshold)
    found = []
    for name, gone in enumerate(combinations(range(pieces), threshold)):
        ends = (-1, *gone, pieces)
        whole = [(ends[k] + 1, ends[k + 1]) for k in range(threshold + 1)]
        seen = set()
        for d in ways:
            parts = [(a, b, x) for (a, b), x in zip(whole, d) if a < b]
            if (d[-1], *parts) not in seen:
                seen.add((d[-1], *parts))
                found.append(key(name, n - d[-1], parts))
    return F.array(*found)


def trimmed_pair(p: Column, steps: int = 16) -> Column:
    """A pair (longer, shorter) without common ends, which are looked for at even steps; ``least`` is what they hide at most."""

    def cut_ends(q: Column) -> Column:
        x, y, m, n = q["longer"], q["shorter"], q["m"], q["n"]
        marks = [F.floor(n * j / steps).cast("int") for j in range(1, steps + 1)]
        head = reduce(lambda best, k: F.when(F.substring(x, F.lit(1), k) == F.substring(y, F.lit(1), k), k).otherwise(best), marks, F.lit(0))
        tail = reduce(lambda best, k: F.when((k > 0) & (F.substring(x, m - k + 1, k) == F.substring(y, n - k + 1, k)), k).otherwise(best), marks, F.lit(0))
        return F.struct(x.alias("longer"), y.alias("shorter"), m.alias("m"), n.alias("n"), head.alias("head"), tail.alias("tail"))

    def middle(q: Column) -> Column:
        tail = F.least(q["tail"], q["n"] - q["head"])
        keep = q["n"] - q["head"] - tail
        longer = F.substring(q["longer"], q["head"] + 1, q["m"] - q["head"] - tail)
        return F.struct(longer.alias("longer"), F.substring(q["shorter"], q["head"] + 1, keep).alias("shorter"), (q["m"] - q["head"] - tail).alias("m"), keep.alias("n"))

    return F.element_at(F.transform(F.transform(F.array(p), cut_ends), middle), 1)


def within(x: Column, y: Column, k: int) -> Column:
    """Whether the edit distance of two strings is at most ``k`` (up to 15): banded and bit-parallel.

    The band's 2k + 1 diagonals are bits of a word that moves down with the second string; each
    character costs a few word operations. Common ends are cut off first, twice at even steps. One
    edit can't leave more than two steps between the ends; so for k = 1 longer rests are apart.
    """
    first = F.char_length(x) >= F.char_length(y)
    longer, shorter = F.when(first, x).otherwise(y), F.when(first, y).otherwise(x)
    whole = F.struct(longer.alias("longer"), shorter.alias("shorter"), F.char_length(longer).alias("m"), F.char_length(shorter).alias("n"))

    def decide(p: Column) -> Column:
        once = trimmed_pair(p)
        near = F.element_at(F.transform(F.array(once), lambda q: F.when(q["n"] > 2 * (F.floor(p["n"] / 16) + 1), False).otherwise(_rest(q, k)) if k == 1 else _rest(q, k)), 1)
        return F.when(p["m"] - p["n"] > k, False).otherwise(near)

    return F.element_at(F.transform(F.array(whole), decide), 1)


def _rest(q: Column, k: int) -> Column:
    return F.element_at(F.transform(F.array(trimmed_pair(q)), lambda r: _banded(r["longer"], r["shorter"], k)), 1)


def _banded(longer: Column, shorter: Column, k: int) -> Column:
    """``within`` for strings of which the first is at least as long."""
    pair = F.struct(F.split(longer, "").alias("a"), F.split(shorter, "").alias("b"), F.char_length(longer).alias("m"), F.char_length(shorter).alias("n"))

    def distance(p: Column) -> Column:
        a, b, m, n = (p[c] for c in "abmn")
        mask, top = F.lit(WORD), 31
        start = F.struct(F.lit((WORD << (top - k)) & WORD).alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(k).cast("long").alias("d"))

        def step(s: Column, i: Column) -> Column:
            char = F.get(b, i)
            hits = reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.get(a, i + k - d) == char, F.lit(1 << (top - d))).otherwise(F.lit(0)).cast("long") for d in range(2 * k + 1)])
            x = F.struct(hits.alias("x"), s["vp"].alias("vp"), s["vn"].alias("vn"), s["d"].alias("d"))

            def one(t: Column) -> Column:
                d0 = ((t["x"].bitwiseAND(t["vp"]) + t["vp"]).bitwiseAND(mask)).bitwiseXOR(t["vp"]).bitwiseOR(t["x"]).bitwiseOR(t["vn"])
                return F.struct(d0.alias("d0"), t["vp"].alias("vp"), t["vn"].alias("vn"), t["d"].alias("d"))

            def two(t: Column) -> Column:
                hp = t["vn"].bitwiseOR(F.bitwise_not(t["d0"].bitwiseOR(t["vp"])).bitwiseAND(mask))
                return F.struct(hp.alias("hp"), t["d0"].bitwiseAND(t["vp"]).alias("hn"), t["d0"].alias("d0"), t["d"].alias("d"))

            def three(t: Column) -> Column:
                low = F.shiftrightunsigned(t["d0"], 1)
                diagonal = F.when(F.shiftrightunsigned(t["d0"], top) == 0, 1).otherwise(0)
                at = F.expr("1L") * F.pow(F.lit(2.0), (top - 1 - (i - (m - k))).cast("double")).cast("long")
                flat = F.when(t["hp"].bitwiseAND(at) != 0, 1).otherwise(0) - F.when(t["hn"].bitwiseAND(at) != 0, 1).otherwise(0)
                grown = t["d"] + F.when(i < m - k, diagonal).otherwise(flat)
                return F.struct(t["hn"].bitwiseOR(F.bitwise_not(low.bitwiseOR(t["hp"])).bitwiseAND(mask)).alias("vp"), low.bitwiseAND(t["hp"]).alias("vn"), grown.cast("long").alias("d"))

            for f in (one, two, three):
                x = F.element_at(F.transform(F.array(x), f), 1)
            return x

        walk = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)["d"]
        return F.when(m - n > k, False).when(m <= k, True).when(n == 0, m <= k).otherwise(walk <= k)

    return F.element_at(F.transform(F.array(pair), distance), 1)


def lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, line_no, line, h1, h2): the lines of all texts that hold a character; line numbers from 0. Two lines are equal if both hashes are."""
    made = docs.select(F.col(id_col).cast("long").alias("doc"), F.posexplode(F.split(text_or_empty(F.col(text_col)), "\n")).alias("line_no", "line"))
    return made.where(F.col("line") != "").select("doc", "line_no", "line", F.xxhash64("line").alias("h1"), second_hash(F.col("line")).alias("h2"))


def pairs_of(groups: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the lines that share a key in ``groups`` (key, h1, gone), not both of them probing."""
    held = groups.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("h1", "gone"))).alias("all"))
    first = held.select("all", F.posexplode("all").alias("i", "x"))
    both = first.select("x", F.explode(F.slice("all", F.col("i") + 2, F.greatest(F.size("all") - F.col("i") - 1, F.lit(0)))).alias("y"))
    return both.where("x.gone + y.gone < 2 and x.h1 <> y.h1").select(F.col("x.h1").alias("a"), F.col("y.h1").alias("b")).distinct()


def folded(all_lines: DataFrame, common: DataFrame | None, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """(h1, line) of the lines of at least ``min_chars`` characters; all of them, and with one copy of each line whose h1 is in ``common`` (MOST_COMMON rows at most)."""
    every = all_lines.where(F.char_length("line") >= min_chars).select("h1", "line")
    if common is None:
        return every, every
    few = F.broadcast(common.select("h1"))
    return every, every.join(few, "h1", "left_anti").unionByName(every.join(few, "h1", "left_semi").groupBy("h1").agg(F.first("line").alias("line")))


def several(rows: DataFrame) -> DataFrame:
    """The distinct ``rows`` (key, h1, ...) of keys that hold different lines."""
    same_key = Window.partitionBy("key")
    columns = rows.columns
    return rows.withColumn("x", F.min("h1").over(same_key)).withColumn("y", F.max("h1").over(same_key)).where("x <> y").select(*columns).distinct()


def texts_of(every: DataFrame, wanted: DataFrame) -> DataFrame:
    """(h1, h2, line) once for each line whose h1 is in ``wanted``."""
    found = every.join(wanted.select("h1").distinct(), "h1", "left_semi")
    return found.groupBy("h1", second_hash(F.col("line")).alias("h2")).agg(F.first("line").alias("line"))


def verified(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, a2, b, b2), the hashes of both lines, of the pairs (a, b) within ``threshold`` edits."""
    left = texts.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.col("line").alias("x"))
    right = texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("line").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(within(F.col("x"), F.col("y"), threshold)).select("a", "a2", "b", "b2")


def neighbours(all_lines: DataFrame, common: DataFrame | None = None, min_chars: int = 1, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """The links of lines within one edit: pairs (a, a2, b, b2), each once, and cliques (key, key2, h1, h2) of lines that are all linked with each other, no two of them in another clique or a pair."""
    every, once = folded(all_lines, common, min_chars)
    n = F.char_length("line")
    rows = once.select("h1", F.explode(first_keys(F.col("line"), n, min_chars)).alias("q")).select("q.key", "h1", "q.part").where("key is not null")
    shared = cut(several(rows))
    texts = cut(texts_of(every, shared))
    level = shared.select("key", "h1", F.floor(F.col("part") / 2).cast("int").alias("k"), (F.col("part") % 2).alias("gone"))
    pieces, found, final = 2, [], []
    while True:
        sized = level.join(level.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
        found.append(pairs_of(sized.where(f"n <= {crowd}").select("key", "h1", "gone")))
        busy = sized.where(f"n > {crowd}")
        if pieces > 2:
            final.append(busy.where("size = 1"))
            busy = busy.where("size > 1")
        busy = cut(busy.select("h1", *(["h2"] if pieces > 2 else []), "k", "gone").distinct())
        if busy.isEmpty():
            break
        pieces *= 4
        inner = lambda q: piece_keys(F.col("line"), n, pieces, q, F.col("gone"))  # noqa: B023, E731
        finer = busy.join(texts, ["h1", "h2"] if pieces > 8 else ["h1"]).select("h1", "h2", F.explode(F.transform(F.sequence(4 * F.col("k"), 4 * F.col("k") + 3), inner)).alias("q"))
        level = cut(finer.select("h1", "h2", "q.*").where("size > 0").distinct())
    pairs = verified(reduce(DataFrame.unionByName, found).distinct(), texts, 1)
    ends = reduce(DataFrame.unionByName, final) if final else texts.select("h1", "h2", *[F.lit(0).alias(c) for c in ("key", "key2", "gone", "start")], F.lit(False).alias("last")).where("false")
    # what the deletion of the character, or of the one behind the last, leaves of a longer line
    at = F.explode(F.when(F.col("last"), F.array("start", F.col("start") + 1)).otherwise(F.array("start")))
    shorter = ends.where("gone = 1").join(texts, ["h1", "h2"]).select("h1", "h2", "line", at.alias("at"))
    left = shorter.select("h1", "h2", F.concat(F.substring("line", F.lit(1), F.col("at")), F.substring(F.col("line"), F.col("at") + 2, n)).alias("rest")).where("rest <> ''")
    met = left.select(F.col("h1").alias("a"), F.col("h2").alias("a2"), F.xxhash64("rest").alias("b"), second_hash(F.col("rest")).alias("b2")).join(texts.select(F.col("h1").alias("b"), F.col("h2").alias("b2")), ["b", "b2"])
    turned = F.when(F.col("a") < F.col("b"), F.array("a", "a2", "b", "b2")).otherwise(F.array("b", "b2", "a", "a2"))
    ordered = lambda df: df.select(turned.alias("t")).select(*[F.col("t")[i].alias(c) for i, c in enumerate(("a", "a2", "b", "b2"))])
    return ordered(pairs).unionByName(ordered(met)).distinct(), ends.where("gone = 0").select("key", "key2", "h1", "h2").distinct()


def links(all_lines: DataFrame, common: DataFrame | None = None, threshold: int = 2, min_chars: int = 1, crowd: int = CROWD) -> DataFrame:
    """(a, a2, b, b2) of distinct lines, by their hashes, within ``threshold`` edits of each other, 2 to 15; each pair once, a < b. For one edit see ``neighbours``.

    Lines whose h1 is in ``common`` (MOST_COMMON rows at most) are folded to one copy before they are
    keyed, so that no key holds the copies of a very common line.
    """
    if not 2 <= threshold <= 15:
        raise ValueError("the distance is made for thresholds of 2 to 15")
    every, once = folded(all_lines, common, min_chars)
    keyed = lambda source, pieces: source.select("h1", F.explode(far_keys(F.col("line"), F.char_length("line"), threshold, pieces)).alias("key"), F.lit(0).alias("gone"))
    pieces = threshold + 1
    shared = cut(several(keyed(once, pieces)))
    texts = cut(texts_of(every, shared))
    sized = shared.join(shared.groupBy("key").agg(F.count("*").alias("n")), "key")
    found = pairs_of(sized.where(f"n > 1 and n <= {crowd}"))
    busy = cut(sized.where(f"n > {crowd}").select("h1").distinct())
    if not busy.isEmpty():
        found = found.unionByName(pairs_of(cut(several(keyed(texts.join(busy, "h1", "left_semi").select("h1", "line"), 2 * threshold + 2))))).distinct()
    return verified(found, texts, threshold)


def most_common(all_lines: DataFrame) -> DataFrame:
    """(h1, copies) of the MOST_COMMON lines with the most copies, over COPIES each; any other line has a smaller share of all lines."""
    counted = all_lines.groupBy("h1").agg(F.count("*").alias("copies")).where(f"copies > {COPIES}")
    return counted.orderBy(F.desc("copies"), "h1").limit(MOST_COMMON)


def spread(spots: DataFrame, known: DataFrame, common: DataFrame) -> DataFrame:
    """``spots`` (doc, line_no, h1, h2) joined with ``known`` (h1, h2, ...); a line of ``common`` (h1, copies) has a row of ``known`` for every COPIES of its places, so that they are dealt over many tasks."""
    salts = F.broadcast(common.select("h1", F.ceil(F.col("copies") / COPIES).cast("int").alias("salts")))
    dealt = spots.join(salts, "h1", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc", "line_no"), F.col("salts"))).otherwise(0).cast("int"))
    copied = known.join(salts, "h1", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    return dealt.drop("salts").join(copied.drop("salts"), ["h1", "h2", "salt"]).drop("salt")


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 1, min_chars: int = 1) -> DataFrame:
    """One row per line with a character: ``doc``, ``line_no``, ``class_doc``, ``class_line``, ``n_links``, ``kept``, ``copy``.

    A line's class is the earliest place (document id, line number) of a line that is equal to it or
    linked with it, which is judged on the input: within ``threshold`` edits, both of at least
    ``min_chars`` characters. ``n_links`` counts the different lines linked with it. A line is kept
    if no earlier place holds such a line; ``copy`` says that an earlier place holds an equal one.

    Empty lines are left alone and have no row; null texts have no lines. A null id comes before all
    others. Rows that share an id share places, so equal lines at one place are all kept. Empty
    tables give no rows; other columns are ignored.
    """
    every = lines(docs, id_col, text_col)
    place = F.struct(F.coalesce("doc", F.lit(-(1 << 63))).alias("doc"), "line_no")
    spots = every.select(place["doc"].alias("doc"), "line_no", "h1", "h2")
    firsts = spots.groupBy("h1", "h2").agg(F.min(F.struct("doc", "line_no")).alias("first"))
    common = cut(most_common(every))
    cliques = None
    if threshold == 1:
        pairs, cliques = neighbours(every, common, min_chars)
    else:
        pairs = links(every, common, threshold, min_chars)
    pairs = cut(pairs)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b2").alias("a2"), F.col("a").alias("b"), F.col("a2").alias("b2")))
    other = firsts.select(F.col("h1").alias("b"), F.col("h2").alias("b2"), F.col("first").alias("best"))
    told = both.join(other, ["b", "b2"]).select(F.col("a").alias("h1"), F.col("a2").alias("h2"), "best", F.lit(1).cast("long").alias("n_links"))
    if cliques is not None and not (cliques := cut(cliques)).isEmpty():
        groups = cliques.join(firsts, ["h1", "h2"]).groupBy("key", "key2").agg(F.min("first").alias("best"), F.count("*").alias("n"))
        told = told.unionByName(cliques.join(groups, ["key", "key2"]).select("h1", "h2", "best", (F.col("n") - 1).alias("n_links")))
    linked = told.groupBy("h1", "h2").agg(F.min("best").alias("best"), F.sum("n_links").alias("n_links"))
    known = firsts.join(linked, ["h1", "h2"], "left").select("h1", "h2", "first", "best", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    here = F.struct("doc", "line_no")
    joined = spread(spots, known, common)
    earliest = F.least("first", "best")
    return joined.select("doc", "line_no", earliest["doc"].alias("class_doc"), earliest["line_no"].alias("class_line"), "n_links", (earliest == here).alias("kept"), (F.col("first") < here).alias("copy"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 1, min_chars: int = 1) -> DataFrame:
    """One row per row of ``docs``: its id, ``text`` without the lines that aren't kept, and what happened to them.

    ``n_lines`` counts the lines with a character, ``n_kept`` those that stay, ``n_links`` the links of
    all of them, and ``class_id`` is the smallest document id among their classes' places (the
    document's own if it has no lines; null if that is a row without id). Classes and special cases
    are those of ``line_classes``; rows that share an id get the sums and the removals of all of
    them. A null text counts as empty.
    """
    classes = line_classes(docs, id_col, text_col, threshold, min_chars)
    done = classes.groupBy("doc").agg(
        F.count("*").alias("n_lines"), F.sum(F.col("kept").cast("long")).alias("n_kept"), F.sum("n_links").alias("n_links"), F.min("class_doc").alias("class_doc"), F.collect_set(F.when(~F.col("kept"), F.col("line_no"))).alias("gone")
    )
    least = F.lit(-(1 << 63))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), least).alias("doc"), text_or_empty(F.col(text_col)).alias("text"))
    kept = F.expr(r"array_join(transform(filter(transform(split(text, '\n'), (x, i) -> struct(x, i)), s -> not array_contains(gone, s.i)), s -> s.x), '\n')")
    text = F.when(F.size("gone") > 0, kept).otherwise(F.col("text"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    first = F.coalesce("class_doc", "doc")
    return rows.join(done, "doc", "left").select(F.col("id").alias(id_col), text.alias("text"), count("n_lines"), count("n_kept"), count("n_links"), F.when(first != least, first).alias("class_id"))
