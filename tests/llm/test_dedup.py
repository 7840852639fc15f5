"""Line, exact, near and passage deduplication against brute force, with odd rows."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siltstone.llm import bytesarrays, components, exact_dedup, line_dedup, minhash, queries, suffix_dedup
from siltstone.llm.bytesarrays import view

SCHEMA = "doc_id long, text string, id string, body string, row string"


def table(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, "x", "y", "z") for d, t in rows], SCHEMA)


def words(rnd, n, letters="abcdefgh "):
    return "".join(rnd.choice(letters) for _ in range(n))


# --- exact ---------------------------------------------------------------------------------------

ODD = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, "q"), (None, "q"), (5, "é" * 3000), (6, "é" * 3000), (7, "é" * 2999)]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_dedup(spark, keep):
    got = sorted(exact_dedup.exact_dedup(table(spark, ODD), keep=keep, trie_bytes=64).collect(), key=repr)
    groups = collections.defaultdict(list)
    for d, t in ODD:
        groups[t or ""].append(d)
    want = []
    for d, t in ODD:
        ids = [x for x in groups[t or ""] if x is not None]
        owner = (min if keep == "smallest" else max)(ids) if ids else None
        n = len(groups[t or ""])
        want.append((d, owner, n, n == 1 or d is not None and d == owner, hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.exact_dedup(table(spark, []), keep="first")


def test_trie_keeps_all_strings_and_spills_whole_subtrees():
    rnd = random.Random(1)
    trie, want = exact_dedup.PatriciaTrie(), collections.Counter()
    for k in range(2000):
        key = words(rnd, rnd.randint(0, 6), "ab").encode()
        trie.insert(key, k)
        want[key] += 1
    spilled = {k: n for k, _, n in trie.spill()}
    rest = {k: n for k, _, n in trie.items()}
    assert not spilled.keys() & rest.keys() and spilled | rest == dict(want) and len({k[:1] for k in spilled}) == 1


def test_trie_spills_the_heaviest_subtree_of_real_texts():
    rnd = random.Random(2)
    texts = [("common opening " + rnd.choice("abc") + words(rnd, rnd.randint(5, 60))).encode() for _ in range(500)]
    trie = exact_dedup.PatriciaTrie()
    for k, t in enumerate(texts):
        trie.insert(t, k, 1, len(t))
    whole, most = trie.bytes, max(trie.root.children[ord("c")].children.values(), key=lambda n: n.weight).weight
    assert whole == sum(len(n.label) + exact_dedup.NODE_BYTES for n in nodes(trie.root)) - exact_dedup.NODE_BYTES
    spilled = list(trie.detach())
    assert whole - trie.bytes == most and 100 < len(spilled) < 300 and all(len(k) == tag for k, _, _, tag in spilled)
    assert sorted(k for k, *_ in [*spilled, *trie.tagged()]) == sorted(set(texts))
    while trie.bytes and (before := trie.bytes):
        list(trie.detach())
        if trie.bytes == before:
            break
    assert len(list(trie.items())) <= 1


def nodes(node):
    yield node
    for child in (node.children or {}).values():
        yield from nodes(child)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_drop_copies_keeps_one_row_of_each_text(spark, keep):
    got = [(r.doc_id, r.text) for r in exact_dedup.drop_copies(table(spark, ODD), keep=keep, trie_bytes=300).collect()]
    assert len(got) == len({t or "" for _, t in ODD}) == len({t or "" for _, t in got})
    for d, t in got:
        ids = [x for x, y in ODD if (y or "") == (t or "") and x is not None]
        assert d == ((min if keep == "smallest" else max)(ids) if ids else None)
    assert exact_dedup.drop_copies(table(spark, [])).count() == 0


def test_drop_near_copies_keeps_one_row_of_each_class(spark):
    base = " ".join(f"w{k}" for k in range(60))
    docs = [(None, base), (None, base), (4, base + " more"), (4, base), (4, "else, quite other words in here"), (None, "null id of its own, really alone"), (9, None), (None, "")]
    made = minhash.drop_near_copies(table(spark, docs))
    assert made.columns == ["doc_id", "text", "id", "body", "row"]
    assert sorted(((r.doc_id, r.text) for r in made.collect()), key=repr) == sorted([docs[2], docs[4], docs[5], docs[6]], key=repr)


# --- lines ---------------------------------------------------------------------------------------


def one_edit(x, y):
    if len(x) < len(y):
        x, y = y, x
    if x == y or len(x) - len(y) > 1:
        return x == y
    i = next((k for k in range(len(y)) if x[k] != y[k]), len(y))
    return x[i + 1 :] == y[i + (len(x) == len(y)) :]


def lines_by_force(docs, least=20):
    first, found = {}, []
    for d, t in docs:
        for i, line in enumerate((t or "").split("\n")):
            if line:
                found.append((d, i, line))
                first[line] = min(first.get(line, (d, i)), (d, i))
    long = [x for x in first if len(x) >= least]
    link = {x: [y for y in long if x != y and abs(len(x) - len(y)) < 2 and one_edit(x, y)] for x in long}
    out = {d: [0, 0, 0, d, []] for d, _ in docs}
    for d, i, line in found:
        place = min([first[line]] + [first[y] for y in link.get(line, ())])
        o = out[d]
        o[0], o[1], o[2], o[3] = o[0] + 1, o[1] + (place == (d, i)), o[2] + len(link.get(line, ())), min(o[3], place[0])
        o[4] += [i] if place != (d, i) else []
    for d, t in docs:
        out[d][4] = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in out[d][4])
    return out


def edited(rnd, line, edits):
    x = list(line)
    for _ in range(edits):
        p, o = rnd.randrange(max(len(x), 1)), rnd.random()
        if o < 0.3 or not x:
            x.insert(p, rnd.choice("abx"))
        elif o < 0.6:
            x.pop(p)
        else:
            x[p] = rnd.choice("abxy")
    return "".join(x)


def test_line_dedup_equals_brute_force_also_in_crowds(spark):
    rnd = random.Random(5)
    base = [words(rnd, rnd.randint(18, 60), "abcdé ") for _ in range(30)]
    docs = [(d, "\n".join(edited(rnd, rnd.choice(base), rnd.choice([0, 1, 1, 2])) for _ in range(rnd.randint(0, 8)))) for d in range(120)]
    crowd = base[0] + base[1] + base[2]
    docs += [(300 + k, edited(rnd, crowd, 2) + "\n\nend of the common tail line") for k in range(60)]
    docs += [(900, None), (901, "\n"), (902, ""), (903, "short"), (904, "short")]
    got = {r.doc_id: [r.n_lines, r.n_kept, r.n_links, r.class_id, r.text] for r in line_dedup.line_dedup(table(spark, docs), min_chars=20).collect()}
    assert got == lines_by_force(docs)


@pytest.mark.parametrize("crowd", [1, 2, 24])
def test_line_dedup_of_lines_of_every_length_equals_brute_force(spark, crowd, monkeypatch):
    monkeypatch.setattr(line_dedup.neighbours, "__defaults__", (None, 1, crowd))
    rnd = random.Random(crowd)
    letters = "abcdefghijklmnopqrstuvwxyzé日"
    base = [words(rnd, rnd.randint(1, 30), "abé ") for _ in range(25)]
    docs = [(d, "\n".join(edited(rnd, rnd.choice(base), rnd.choice([0, 1, 1, 2])) for _ in range(rnd.randint(0, 8)))) for d in range(80)]
    docs += [(200 + k, f"{c}\n{c}b\nx{c}\nshared beginning {c} and end\nshared beginning{c} and end\n{c}{c}{c}\naa{c}") for k, c in enumerate(letters)]
    docs += [(300 + k, "the end differs in its last" + c + "\n" + c + "and one that begins so") for k, c in enumerate(letters)]
    docs += [(400, "the end differs in its last\nand one that begins so\nshared beginning and end"), (900, None), (901, "\n"), (902, ""), (903, "ab"), (904, "ab\nb")]
    got = {r.doc_id: [r.n_lines, r.n_kept, r.n_links, r.class_id, r.text] for r in line_dedup.line_dedup(table(spark, docs)).collect()}
    assert got == lines_by_force(docs, 1)


def test_places_of_common_lines_are_dealt_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "COPIES", 3)
    monkeypatch.setattr(line_dedup, "MOST_COMMON", 2)
    docs = [(k, f"a line that all of them hold\nand one in two {k % 2}\nrare {k * 97}\na line that all of them holds") for k in range(1, 30)] + [(0, "a line that all of them hold"), (None, "rare 97"), (77, None)]
    every = line_dedup.lines(table(spark, docs), "doc_id", "text")
    assert sorted(r.copies for r in line_dedup.most_common(every).collect()) == [29, 30]
    got = {r.doc_id: [r.n_lines, r.n_kept, r.n_links, r.class_id, r.text] for r in line_dedup.line_dedup(table(spark, docs)).collect()}
    want = lines_by_force([(-1 if d is None else d, t) for d, t in docs], 1)
    want = {(None if d == -1 else d): [*v[:3], None if v[3] == -1 else v[3], v[4]] for d, v in want.items()}
    assert got == want


def test_crowds_of_long_lines_are_settled_without_their_pairs(spark):
    rnd = random.Random(3)
    long = words(rnd, 6000, "abcdé ")
    texts = [long[:4321] + c + long[4322:] for c in "abcdefghijklmnopqrstuvwxyz0123456789"] + [long[:17] + c + long[17:] for c in "ghijkl"] + [long[:4321] + long[4322:], long]
    docs = list(enumerate(texts))
    every = line_dedup.lines(table(spark, docs), "doc_id", "text")
    pairs, cliques = line_dedup.neighbours(every)
    assert cliques.select("key").distinct().count() >= 1 and cliques.count() >= 36 and pairs.count() < 200
    got = {r.doc_id: (r.n_links, r.class_id) for r in line_dedup.line_dedup(table(spark, docs)).collect()}
    want = {d: v for d, v in lines_by_force(docs, 1).items()}
    assert got == {d: (v[2], v[3]) for d, v in want.items()}


@pytest.mark.parametrize(("k", "crowd"), [(2, 24), (2, 2), (3, 24)])
def test_links_of_more_edits_and_shorter_lines_equal_brute_force(spark, k, crowd):
    rnd = random.Random(9)
    base = [words(rnd, rnd.randint(9, 40), "abcdé ") for _ in range(25)] + ["page 12 of 345", "on 2024-01-15 we said this and that"]
    texts = sorted({edited(rnd, rnd.choice(base), rnd.randint(0, 4)) for _ in range(300)} | {"page 17 of 346", "on 2024-02-16 we said this and that"})
    every = line_dedup.lines(table(spark, [(1, "\n".join(texts))]), "doc_id", "text")
    name = {r.h1: r.line for r in every.collect()}
    got = {tuple(sorted((name[r.a], name[r.b]))) for r in line_dedup.links(every, threshold=k, min_chars=10, crowd=crowd).collect()}
    x = spark.createDataFrame([(t,) for t in texts if len(t) >= 10], "x string")
    want = {(r.x, r.y) for r in x.crossJoin(x.withColumnRenamed("x", "y")).where("x < y").where(F.levenshtein("x", "y") <= k).collect()}
    assert got == {tuple(sorted(p)) for p in want} and len(want) > 100


def test_line_dedup_of_odd_rows(spark):
    odd = table(spark, [(None, "a"), (1, "a"), (1, "a\nb")])
    got = sorted(map(tuple, line_dedup.line_dedup(odd, min_chars=20).select("doc_id", "text", "n_lines", "n_kept").collect()), key=repr)
    # a null id comes first and owns the line; rows of one id share their sums and removals
    assert got == [(1, "", 3, 1), (1, "b", 3, 1), (None, "a", 1, 1)]
    # without a least length "b" is one edit from "a"
    assert {(r.text, r.n_kept, r.n_links) for r in line_dedup.line_dedup(odd).collect()} == {("", 0, 3), ("a", 1, 1)}
    assert line_dedup.line_dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance(spark, k):
    rnd = random.Random(k)
    rows = [(x, edited(rnd, x + "z", rnd.randint(0, 4))) for x in (words(rnd, rnd.randint(0, 40), "abé") for _ in range(400))]
    df = spark.createDataFrame([*rows, ("", ""), ("a", "")], "x string, y string")
    got = df.select(line_dedup.within(F.col("x"), F.col("y"), k).alias("w"), (F.levenshtein("x", "y") <= k).alias("e")).collect()
    assert all(r.w == r.e for r in got)


# --- near ----------------------------------------------------------------------------------------


def near_by_force(docs, similarity=0.8):
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1 if w else 0))) for w in ((t or "").split() for _, t in docs)]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            shared = sum((bags[i] & bags[j]).values())
            union = sum(bags[i].values()) + sum(bags[j].values()) - shared
            if (docs[i][1] or "") == (docs[j][1] or "") or union and shared / union >= similarity:
                parent[root(i)] = root(j)
    members = collections.defaultdict(list)
    for i in range(len(docs)):
        members[root(i)].append(docs[i][0])
    return sorted((d, min(m), len(m), d == min(m)) for m in members.values() for d in m)


def test_near_duplicates_equal_brute_force_also_in_crowds(spark):
    rnd = random.Random(2)
    vocabulary = [words(rnd, 6, "abcdefgh") for _ in range(500)]
    docs = []
    for family in range(8):
        base = [rnd.choice(vocabulary) for _ in range(90)]
        for _ in range(40 if not family else 4):
            x = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 4, 6])):
                x[rnd.randrange(len(x))] = rnd.choice(vocabulary)
            docs.append((len(docs) * 3, " ".join(x)))
    docs += [(10_000, None), (10_001, ""), (10_002, "one two"), (10_003, "one  two"), (10_004, "ab " * 3000), (10_005, "ab " * 2900)]
    got = sorted(map(tuple, minhash.near_duplicates(table(spark, docs)).collect()))
    assert got == near_by_force(docs)


def test_blocks_join_as_all_links_would(spark):
    rnd = random.Random(8)
    bodies = [" ".join(rnd.choice("abcdefgh") + str(k // 3) for k in range(40)) for _ in range(30)]
    bodies += [b.replace(" b", " c", 1) for b in bodies]
    open_ = spark.createDataFrame([(1, bytes([k])) for k in range(60)], "band long, tid binary")
    texts = spark.createDataFrame([(bytes([k]), b.encode()) for k, b in enumerate(bodies)], "tid binary, body binary")
    links = minhash.settled(open_, texts, 0.5, 5, block_rows=7)
    got = {bytes(r.node): bytes(r.label) for r in components.components(links).collect()}
    want = near_by_force([(k, b) for k, b in enumerate(bodies)], 0.5)
    assert all(got.get(bytes([d]), bytes([d])) == bytes([c]) for d, c, _, _ in want)


@pytest.mark.parametrize(("labels", "bound"), [(1, 100), (7, 0), (7, 10_000), (60, 0)])
def test_open_texts_of_several_labels_are_joined_as_all_links_would(spark, labels, bound, monkeypatch):
    monkeypatch.setattr(minhash.meetings, "__defaults__", (bound,))
    rnd = random.Random(labels)
    base = [[rnd.choice("abcdefgh") + str(k) for k in range(60)] for _ in range(4)]
    texts = []
    for k in range(60):
        x = list(base[k % 4][:30] + base[(k // 4) % 4][30:])
        for _ in range(rnd.choice([0, 0, 1, 2])):
            x[rnd.randrange(60)] = "z" + str(rnd.randrange(5))
        texts.append((bytes([k]), " ".join(x)))
    label = {t: bytes([k % labels]) for k, (t, _) in enumerate(texts)}
    open_ = spark.createDataFrame([(1, t, label[t]) for t in label], "band long, tid binary, label binary")
    links = minhash.settled(open_, spark.createDataFrame([(t, b.encode()) for t, b in texts], "tid binary, body binary"), 0.8, 5, block_rows=7)
    chained = links.unionByName(open_.selectExpr("label a", "tid b"))
    got = {bytes(r.node): bytes(r.label) for r in components.components(chained).collect()}
    bags = [set(tuple(b.split()[i : i + 5]) for i in range(56)) for _, b in texts]
    linked = [(texts[i][0], texts[j][0]) for i in range(60) for j in range(i) if len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j])]
    assert linked
    chained = spark.createDataFrame(linked, "a binary, b binary").unionByName(open_.selectExpr("label a", "tid b"))
    assert got == {bytes(r.node): bytes(r.label) for r in components.components(chained).collect()}


@pytest.mark.parametrize("band_texts", [1, 3, 1000])
def test_texts_of_a_band_are_chained_in_parts(spark, band_texts):
    rows = [(b, rnd, bytes([rnd * 7 % 50]), 50) for b in (1, 2) for rnd in range(50)]
    pairs = minhash.predecessors(spark.createDataFrame(rows, "band long, next long, tid binary, n long"), band_texts)
    found = components.components(pairs).collect()
    assert len(found) == 50 and {bytes(r.label) for r in found} == {bytes([0])}
    assert pairs.count() < 150


def test_texts_of_one_word_that_hash_alike_modulo_a_power_of_two_are_apart(spark):
    x, y = "a", "b"
    for _ in range(11):
        x, y = x + y, y + x
    column = [pa.array([t.encode()], pa.binary()) for t in (x, y)]
    assert minhash.similarities(*column)[0] == 0 and minhash.similarities(column[0], column[0])[0] == 1
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(table(spark, [(1, x), (2, y), (3, x)])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_surroundings_that_only_hash_alike_are_no_copies(monkeypatch):
    rnd = random.Random(12)
    passage = words(rnd, 300)
    bodies = [words(rnd, 400), passage, passage, words(rnd, 400)]
    monkeypatch.setattr(suffix_dedup.Surroundings, "hashes", lambda self: np.zeros(len(self.position), np.uint64))
    column = pa.array([b.encode() for b in bodies], pa.binary())
    found = list(suffix_dedup.FirstPass(2, 100, 32).slice(np.arange(4), np.arange(4), *view(column)))
    assert all(bodies[row][s["start"] : s["end"]] in "".join(bodies[:row]) for _, _, row, spans, _ in found for s in spans)


def test_signatures_estimate_weighted_similarity():
    a = " ".join(f"w{i}" for i in range(300))
    bodies = [a.encode(), a.replace("w50 ", "x ").replace("w150 ", "y ").encode(), b"q " * 100, b"q " * 60]
    column = pa.array(bodies, pa.binary())
    made = minhash.signatures(*minhash.multiset(*minhash.shingles(*view(column))), len(bodies), 4000)
    for i, j in ((0, 1), (2, 3)):
        true = minhash.similarities(column.slice(i, 1), column.slice(j, 1))[0]
        assert abs((made[i] == made[j]).mean() - true) < 0.03


def test_near_duplicates_of_odd_rows(spark):
    got = sorted(map(repr, map(tuple, minhash.near_duplicates(table(spark, [(None, "a b c d e f"), (None, "a b c d e f"), (1, None), (1, "")])).collect())))
    assert got == sorted(map(repr, [(None, None, 2, True)] * 2 + [(1, 1, 2, True)] * 2))
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(40, 30), (50, 50), (30, 40)], "a long, b long")
    got = dict(map(tuple, components.components(links).collect()))
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 40: 30, 50: 50}
    assert components.components(links.where("false")).count() == 0


# --- passages ------------------------------------------------------------------------------------


def passages_by_force(docs, width=100):
    seen, out = set(), {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if b[i : i + width] in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(b[i : i + width])
        spans = sum(1 for i, r in enumerate(gone) if r and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, r in zip(b, gone, strict=True) if not r))
    return out


def test_repeated_passages_equal_brute_force(spark):
    rnd = random.Random(3)
    parts = [words(rnd, 120), words(rnd, 99), words(rnd, 100), words(rnd, 300), "ab" * 200, "x" * 500, words(rnd, 40)]
    docs = [(k * 7 - 100, "".join(rnd.choice(parts) if rnd.random() < 0.5 else words(rnd, rnd.randint(0, 150)) for _ in range(rnd.randint(0, 6)))) for k in range(150)]
    for k in range(40):
        x = list(parts[3] + parts[0] + parts[3][::-1])
        for _ in range(3):
            x[rnd.randrange(len(x))] = rnd.choice("zq")
        docs.append((5000 + k, "".join(x)))
    docs += [(9998, None), (9999, ""), (10_000, "é" * 300)]
    got = {r.doc_id: (r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), bytes(r.kept)) for r in suffix_dedup.repeated_spans(table(spark, docs)).collect()}
    assert got == passages_by_force(docs)


def test_passages_of_odd_rows(spark):
    rows = table(spark, [(1, "k" + "ab" * 60), (1, "k" + "ab" * 60), (None, "k" + "ab" * 60)])
    got = sorted((r.doc_id is None, len(r.kept)) for r in suffix_dedup.repeated_spans(rows).collect())
    assert got == [(False, 0), (False, 0), (True, 3)]  # the null id comes first; in it the passages repeat from the fourth byte on
    assert suffix_dedup.repeated_spans(table(spark, [])).count() == 0


def test_loser_tree_merges_runs_in_order():
    rnd = random.Random(4)
    runs = [sorted((rnd.randrange(5), words(rnd, rnd.randint(0, 6), "ab").encode(), b"l", k, k, n) for n in range(rnd.randint(1, 50))) for k in range(7)]
    out = list(suffix_dedup.merged([suffix_dedup.encode(r) for r in runs]))
    keys = [e[0] for _, e in out]
    assert keys == sorted(keys) and len(keys) == sum(map(len, runs))
    for (_, a), (shared, b) in zip(out, out[1:], strict=False):
        assert shared == suffix_dedup.common(a[0], b[0])


def test_anchors_depend_on_content_alone():
    rnd = random.Random(6)
    passage = words(rnd, 400).encode()
    found = []
    for before in (0, 37, 501):
        data = np.frombuffer(words(rnd, before).encode() + passage + words(rnd, 80).encode(), np.uint8)
        at, _ = suffix_dedup.anchors(data, np.array([0, len(data)]))
        inside = at - before
        found.append(set(inside[(inside >= 68) & (inside < 300)].tolist()))
    assert found[0] == found[1] == found[2] and len(found[0]) > 3


def test_powers_of_long_data_are_not_kept(monkeypatch):
    monkeypatch.setattr(bytesarrays, "KEPT_POWERS", 1 << 17)
    monkeypatch.setattr(bytesarrays, "_POWERS", {})
    long, short = (bytesarrays.powers(n, bytesarrays.STEP, "up") for n in (1 << 18, 100))
    assert (long[:100] == short).all() and len(bytesarrays._POWERS["up"]) <= 1 << 17
    assert int(long[7]) == pow(int(bytesarrays.STEP), 7, 1 << 64)


def test_suffix_dedup_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    found = con.execute(queries.ORACLE_SQL["op5_suffix_dedup"])
    names = [c[0] for c in found.description]
    got = queries.op5_suffix_dedup(spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())
