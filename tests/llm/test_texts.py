"""Page extraction, decontamination, chat formatting, personal data, packing and quality."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import chat, decontam, html_extract, packing, pii, quality, queries

SF = "/root/testdata/sf0.001"


def table(spark, rows, columns="doc_id long, text string"):
    extra = [(*r, "x", "y") for r in rows]
    return spark.createDataFrame(extra, columns + ", id string, body string")


# --- pages ---------------------------------------------------------------------------------------

BODY = "<p>First, of all, a long enough paragraph with words in it.</p><p>Second one, with <b>bold</b>&nbsp;and &eacute;.</p>"
WANT = "First, of all, a long enough paragraph with words in it. Second one, with bold and é."
PAGES = [
    (f"<html><head><title>T</title></head><body><nav><a href=x>menu</a></nav><article>{BODY}</article><footer>foot</footer></body></html>", WANT),
    (f"<body><header>Head</header><div class='post-content'>{BODY}<div class='comments'><p>Nice, very nice, yes.</p></div></div><div class=sidebar><p>Side, side, side</p></div></body>", WANT),
    (f"<main>{BODY}<form><p>Name, please, here</p></form><script>var a = '</p>';</script><style>p{{}}</style></main>", WANT),
    (f"<div role=main>{BODY}</div><div class='cookie-notice'><p>We use cookies, many, many.</p></div><!-- <p>x</p> -->", WANT),
    (f"<article>{BODY}<aside>aside, text</aside><div class='ad'>Buy, now, here</div><p hidden>no</p></article>", WANT),
    (f"<div class='layout has-sidebar category-legal'><div class=header><p>Site, name, here</p></div><div class=content>{BODY}</div></div>", WANT),
    ("<article><p title='a > b < c'>x</p><a data-x=\"<b>y</b>\">z</a></article>", "x z"),
    ("<p>a<p>b<br>c <b>d</b>e", "a b c de"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("plain &lt;text&gt; &am", "plain <text> &am"),
    ("<article><h1>Head &amp; line</h1><p>x</p></article>", "Head & line x"),
    ("", ""),
    (None, ""),
    ("<<>a<b", None),
    ("<script>never closed", ""),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
]


PROSE = "This part of the article is long enough, has its commas, and holds no link at all to anywhere else in the world."


@pytest.mark.parametrize(
    "part",
    [
        f'<section id="discussion"><p>{PROSE}</p></section>', '<h2 id="related-work">Related work</h2>', '<h2 id="legal-status">Legal status</h2>', '<section id="comments"><p>On comments, briefly.</p></section>',
        f'<div id="feedback-loops"><p>{PROSE}</p></div>', '<p class="disclaimer">The author owns shares.</p>', '<div id="social-impact"><p>It, in short, is small.</p></div>', '<div id="survey-results">42 percent</div>', f'<div class="legal-notes"><p>{PROSE}</p></div>',
    ],
)
def test_parts_of_an_article_stay(part):
    assert html_extract.main_text(f"<nav>menu</nav><article>{BODY}{part}</article>") == WANT + " " + re.sub("<[^>]*>", "", part)


@pytest.mark.parametrize(
    "part",
    [f'<div class="comments"><p>{PROSE}</p></div>', f'<div id="disqus"><p>{PROSE}</p></div>', '<div class="related-posts"><p><a href=x>One more, to read</a></p></div>', '<div class="share-buttons">Share it</div>', '<div class="social"><a href=x>Tell</a></div>'],
)
def test_other_things_in_an_article_go(part):
    assert html_extract.main_text(f"<article>{BODY}{part}</article>") == WANT


@pytest.mark.parametrize(
    "part",
    ['<div class="rail">By rail.</div>', '<section class="legal">Of the law.</section>', '<div id="discussion">In short.</div>', "<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be.</p>", '<div class="foot">A foot.</div>'],
)
@pytest.mark.parametrize("page", ["<article>%s</article>", "<div itemprop=articleBody>%s</div>", "<div id=page><div class='box post-content'>%s</div></div>"])
def test_short_parts_that_may_name_a_subject_stay(page, part):
    assert html_extract.main_text("<nav>menu</nav>" + page % (BODY + part)) == WANT + " " + re.sub("<[^>]*>", "", part)


LONG = "kk <b>j</b> > " * 2000


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<article><div data-x="{LONG}">{BODY}</div></article>', WANT),
        (f"<article><iframe srcdoc='{LONG}'></iframe><p data-json='{LONG}'>one</p><p>two</p></article>", "one two"),
        (f'<article>{BODY}<div data-x="{LONG}" class="comments"><p>Nice, very nice.</p></div></article>', WANT),
        ("<article><p title=it's>one</p><p title=\"a'b>c\">two</p></article>", "one two"),
        ('<article><p title="never closed>one</p><p>two</p></article>', "one two"),
        ("<article><p a=1/>one<p =x y='<i>'z>two</article>", "one two"),
        ("<article><!--><p>one</p><!-- a --!><p>two</p></article>", "one two"),
    ],
)
def test_attributes_of_any_length(page, want):
    assert html_extract.main_text(page) == want


def test_points_reach_all_ancestors():
    deep = "<div>" * 40 + "<p>A few words, with commas, all of them here, and enough for points.</p>" + "</div>" * 40
    assert html_extract.main_elements(html_extract.parse(f"<body>{deep}</body>"))
    order = html_extract.measure(root := html_extract.parse(deep))
    html_extract.main_elements(root)
    assert all(n.score > 0 for n in order if n.tag == "div")


def test_main_text(spark):
    rows = [(k, f"u{k}", page) for k, (page, _) in enumerate(PAGES)]
    got = {r.page_id: r for r in html_extract.extract(table(spark, rows, "page_id long, url string, html string")).collect()}
    for k, (_, want) in enumerate(PAGES):
        assert want is None or got[k].text == want
        assert got[k].n_chars == len(got[k].text)
    assert html_extract.extract(table(spark, [], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("page", ['<a "' * 50_000, "<a " * 50_000, "<!-" * 50_000, "<p>x" * 50_000, "</p>" * 50_000, '<a x="<b" ' * 50_000, '<a x="<b" ' * 50_000 + "<>", "<a x='<b y=\"" * 50_000, "<script>" * 50_000, "<a =" * 50_000, "<a/" * 50_000, "<div>" * 50_000, "<p><i>" * 20_000, "<p><button>" + "<div></p>" * 20_000, "<td>" * 20_000 + "<tr>" * 20_000])
def test_hostile_pages_take_linear_time(page):
    assert isinstance(html_extract.main_text(page), str)


def test_pages_keep_their_articles_whole(spark):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op2_html(spark, SF).collect():
        inside = re.sub(r"</?(p|h1|br)>", " ", re.search("<article>(.*?)</article>", pages[r.page_id], re.DOTALL)[1])
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", "", inside)).split())


# --- benchmark -----------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def contamination_by_force(docs, items, window=10):
    windows = collections.defaultdict(set)
    for name, text in items:
        w = WORD.findall((text or "").translate(LOW))
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            windows[tuple(w[k : k + window])].add("" if name is None else str(name))
    out = []
    for d, text in docs:
        w, names = WORD.findall((text or "").translate(LOW)), set()
        hit = [0] * len(w)
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k : k + n]))
                if found:
                    names |= found
                    hit[k : k + n] = [1] * n
        out.append((d, len(w), sum(hit), sorted(names)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_contamination_equals_brute_force(spark, limit):
    rnd = random.Random(1)
    vocabulary = ["Al", "bé", "c3", "dog", "E", "ß"] + [f"w{k}" for k in range(20)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(k, text(rnd.randint(0, 30))) for k in range(20)] + [(20, None), (None, text(12)), (3, text(15)), (21, "Zzz")]
    docs = [(k, text(rnd.randint(0, 40))) for k in range(60)]
    docs += [(100 + k, text(5) + ", " + (rnd.choice(items)[1] or "").upper() + "; " + text(5)) for k in range(60)]
    docs += [(None, "zzz"), (5, None), (5, ""), (6, text(20_000))]
    made = decontam.contamination(table(spark, docs), table(spark, items, "item_id long, text string"), block_bytes=limit)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in made.collect()), key=repr)
    assert got == contamination_by_force(docs, items)
    assert all(r.n_hit == sum(s["end"] - s["start"] for s in r.hits) for r in made.collect())


def test_contamination_of_nothing(spark):
    docs, items = table(spark, [(1, "a b")]), table(spark, [(1, "a")], "item_id long, text string")
    assert decontam.contamination(docs, items.where("false")).first().n_hit == 0
    assert decontam.contamination(docs.where("false"), items).count() == 0
    assert [r.doc_id for r in decontam.decontaminate(table(spark, [(1, "a b"), (2, "c"), (3, None)]), items).orderBy("doc_id").collect()] == [2, 3]


def thue_morse(order, a="a", b="b"):
    x, y = a, b
    for _ in range(order):
        x, y = x + y, y + x
    return x, y


def test_words_that_polynomials_modulo_a_power_of_two_confuse(spark):
    x, y = thue_morse(11)
    items = table(spark, [(1, x), (2, "one two " + y)], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontam.contamination(table(spark, [(1, x), (2, y), (3, "one two " + x), (4, "One, two: " + y.upper())]), items).collect()}
    assert got == {1: ["1"], 2: [], 3: ["1"], 4: ["2"]}


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_decontaminate_judges_every_row_by_its_own_text(spark, limit):
    items = [(k, " ".join(f"w{j}" for j in range(k, k + 12))) for k in range(0, 100, 5)]
    docs = [(None, items[3][1]), (None, "clean"), (7, "x " + items[19][1]), (7, "clean too"), (8, None), (9, "")]
    made = decontam.decontaminate(table(spark, docs), table(spark, items, "item_id long, text string"), block_bytes=limit)
    assert made.columns == ["doc_id", "text", "id", "body"]
    assert sorted(((r.doc_id, r.text) for r in made.collect()), key=repr) == sorted([(None, "clean"), (7, "clean too"), (8, None), (9, "")], key=repr)


def test_longest_match(spark):
    item = " ".join(f"w{k}" for k in range(30))
    r = decontam.contamination(table(spark, [(1, "x " + " ".join(f"w{k}" for k in range(5, 22)) + " y")]), table(spark, [(9, item)], "item_id long, text string")).first()
    assert (r.longest, r.longest_item, r.n_hit) == (17, "9", 17)


# --- chats ---------------------------------------------------------------------------------------

HOSTILE = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>", "\\<\\s>", "<<SYS>>\\", "", None, "é\n\n", "<<s>s>"]


def test_chats_round_trip_in_windows(spark):
    rnd = random.Random(7)
    rows = []
    for conv in (1, 2, None):
        turns = [("system", "be kind")] + [(("user", "assistant")[k % 2], rnd.choice(HOSTILE) if rnd.random() < 0.5 else "word " * rnd.randint(0, 60)) for k in range(40)]
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(3, None, None, "x"), (3, 0, "assistant", None), (3, 0, "assistant", None)]
    made = chat.format_chats(table(spark, rows, "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.json"), budget=150)
    windows = made.collect()
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    by = collections.defaultdict(list)
    for c, n, r, t in rows:
        by[c].append((-1 if n is None else n, r or "", t or ""))
    for c, turns in by.items():
        turns.sort()
        said = [t for _, r, t in turns if r == "assistant"]
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert got[c].loss_chars == len("".join(said)) and got[c].loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
        assert got[c].formatted_chars == sum(len(w.text) for w in windows if w.conv_id == c)
    long = sorted((w for w in windows if w.conv_id == 1), key=lambda w: w.window)
    assert len(long) > 5 and all(w.text.startswith("<|turn|>system<|text|>be kind") for w in long) and any(w.n_repeated > 1 for w in long)
    assert all(w.n_tokens <= 150 or w.n_new == 1 for w in long)
    assert not any(chat.CONTROL.search(re.sub(r"<\|(turn|text|end)\|>", "", w.text)) for w in windows)


@pytest.mark.parametrize("sizes", [[120] * 15 + [1900] + [120] * 3, [1500] + [300, 400, 500, 100] * 4, [100] * 40, [2048, 2048, 1], [10, 3000, 5, 2049, 2000, 40], [2040, 3, 3, 3, 9, 5]])
@pytest.mark.parametrize("system", [True, False])
def test_no_window_passes_its_budget_but_for_one_long_turn(sizes, system):
    made = chat.Windows(1, 2048, chat.HISTORY_TURNS, 512)
    roles = ["system" if system else "user"] + [("user", "assistant")[k % 2] for k in range(len(sizes) - 1)]
    rows = [r for role, n in zip(roles, sizes, strict=True) for r in made.push(role, f"t{n}", n)] + list(made.finish())
    assert [r[1] for r in rows] == list(range(len(rows))) and sum(r[3] for r in rows) == len(sizes)
    at = 0
    for r in rows:
        assert r[5] <= 2048 or r[3] == 1 and r[4] == 0 and r[5] == sizes[at] > 2048
        held = [m[1] for m in chat.PARSE.finditer(r[6])]
        if system and at and sizes[0] + sizes[at] <= 2048:  # the system turn goes only where it leaves no room
            assert held[0] == "system"
        at += r[3]


@pytest.mark.parametrize("text", [t for t in HOSTILE if t is not None] + ["\\\\", "<\\|turn|>"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text and not chat.CONTROL.search(chat.escape(text))


def test_chats_of_nothing(spark):
    made = chat.format_chats(table(spark, [], "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    assert made.count() == 0 and chat.read_back(made).count() == 0


# --- personal data -------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def spans_by_force(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")) or k == 2 and not (12 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    rnd = random.Random(1)
    for _ in range(5000):
        text = "".join(rnd.choice("12.@a+- ()0b.é\n") for _ in range(rnd.randint(0, 30)))
        if rnd.random() < 0.3:
            text += " 4111 1111-1111 1111 " + text
        assert pii.base_spans(text) == spans_by_force(text)


def test_base_spans_are_linear_on_long_runs():
    assert pii.base_spans("a" * 300_000 + "@" + "1" * 300_000) == []
    assert len(pii.base_spans("a@b.c " * 20_000)) == 20_000


def test_field_adds_what_repeats(spark):
    texts = [f"call +1 ({k}43) 555-3824 or x{k}@mail.example.com from 10.0.0.{k} pay 4111111111111111 ok {k}" for k in range(40)]
    model = pii.train(texts)
    (base, added), (none, nothing) = pii.find(["write to ann@mail.example.com and later ann@mail.example.com, or 10.0.0.1, then 10.0.0.1: and 10.0.0.1", "no such thing"], model)
    assert [k for _, k, _ in base] == [0, 0, 1, 1, 1] and none == nothing == []
    assert all(not (a < y and b > x) for a, _, b in added for x, _, y in base)


@pytest.mark.parametrize(
    ("text", "missed"),
    [
        ("ring +49 170 1234567 today. Ring 0170 1234567 later, or 0170/1234567 now", [("0170", 3), ("1234567", 3), ("0170/1234567", 3)]),
        ("call +49 170 1234567 or (170) 1234567 now", [("170", 3), ("1234567", 3)]),
        ("card 4111111111111111 then 4111.1111.1111.1111 ok", [("4111.1111.1111.1111", 2)]),
        ("from 10.0.0.1 by ip-10-0-0-1 there", [("ip-10-0-0-1", 1)]),
        ("to ann@mail.example.com or ann@mail now", [("ann@mail", 0)]),
        ("number 1234567 and 170 people", []),
    ],
)
def test_missed_repeats_of_confirmed_values_are_added(text, missed):
    train = [f"call +1 ({k}43) 555-3824 or x{k}@mail.example.com from 10.0.0.{k} pay 4111111111111111 ok {k} and {k} more of 1{k} in 20{k}" for k in range(10, 50)]
    train += [f"again +49 170 12345{k} or 170 12345{k} here, as 76543{k} of {k} people in 170 towns say" for k in range(10, 50)]
    model = pii.train(train)
    base, added = pii.find([text], model)[0]
    assert [(text[a:b], kind) for a, kind, b in added] == missed


def filler(rnd, n):
    return " ".join(rnd.choice(["in", "room", "of", "the", "page", "see"]) + rnd.choice(["", f" {rnd.randint(1, 400)}", f" v{rnd.randint(1, 9)}.{rnd.randint(0, 9)}.{rnd.randint(0, 20)}.1", f" {rnd.randint(1990, 2030)}-0{rnd.randint(1, 9)}-1{rnd.randint(0, 9)}"]) for _ in range(n))


def planted(rnd):
    """A text with confirmed values, and the repeats that the patterns miss."""
    tail, parts = f"{rnd.randint(2_000_000, 9_999_999)}", [str(rnd.randint(1, 255)) for _ in range(4)]
    name, area = rnd.choice(["ann", "bob", "cy"]) + str(rnd.randint(1, 999)), str(rnd.randint(130, 199))
    card = rnd.choice(["4111111111111111", "5500005555555559", "340000000000009"])
    kinds = [
        (f"+49 {area} {tail}", 3, [f"0{area}/{tail}", f"{area}-{tail}"]), (".".join(parts), 1, ["-".join(parts), "ip_" + "_".join(parts)]),
        (f"{name}@mail.example.com", 0, [f"{name}@mail", f"{name}@localhost"]), (card, 2, [".".join([card[:4], card[4:8], card[8:]]), card[:6] + "/" + card[6:]]),
    ]
    value, kind, other = rnd.choice(kinds)
    missed = rnd.choice(other)
    return f"{filler(rnd, 8)} to {value} and {filler(rnd, 8)} by {missed} so {filler(rnd, 6)}", missed, kind


def test_planted_repeats_are_found_with_high_precision_and_recall():
    rnd = random.Random(21)
    model = pii.train([planted(rnd)[0] for _ in range(400)])
    cases = [planted(rnd) for _ in range(400)]
    right = wrong = 0
    for (text, missed, kind), (base, added) in zip(cases, pii.find([c[0] for c in cases], model), strict=True):
        at = text.rindex(missed)
        true = (at, kind, at + len(missed))
        assert len(base) >= 1
        right += true in added or any(x[0] <= at and x[2] >= at + len(missed) for x in base)
        wrong += sum(x != true for x in added)
    assert right / len(cases) >= 0.95 and wrong <= 0.05 * len(cases)


def test_added_spans_keep_the_bounds_of_their_kind():
    rnd = random.Random(22)
    model = pii.train([planted(rnd)[0] for _ in range(200)] + [f"from 10.0.{k}.1 to 10.{k}.0.2 and 7.7.7.{k}" for k in range(100)])
    for text in ("from 10.0.0.1 to 300.1.1.1 and 300.1.1.1", "10.0.0.1 1.2.3.4.5 10.0.0.1", "host 999.999.999.999, 10.1.1.1"):
        for start, kind, end in pii.find([text], model)[0][1]:
            assert kind != 1 or all(int(x) <= 255 for x in re.findall("[0-9]+", text[start:end]))
    assert not pii.allowed(1, "300.1.1.1", True) and pii.allowed(1, "ip-10-0-0-1", True) and not pii.allowed(2, "4111111111111112", False) and pii.allowed(3, "0170", True)


def test_pair_weights_are_learned_with_the_field():
    agree = pii.train([f"a{k}@b.example.org and a{k}@b.example.org or 10.0.0.{k} 10.0.0.{k} of 12 or 12" for k in range(200)])
    apart = pii.train([f"x 1234567{k}x by +1 202 1234567{k} or 1234567{k}x" for k in range(10, 99)])
    assert agree.skip[0, 0] > 0 and (np.diag(agree.value)[1:3] >= pii.AGREE - 0.5).all() and np.isfinite(apart.chain).all()


def test_loopy_messages_carry_labels_between_mentions():
    import numpy as np

    unary = np.zeros((pii.N_FEATURES, 5))
    unary[12, 1] = 4.0  # tokens with an @ look like emails
    skip = np.full((5, 5), -2.0) + np.eye(5) * 4
    graph = pii.Graph()
    graph.add(0, "a@b.c x1", [])
    graph.skip = [(0, 1)]
    graph.chain = []
    p = pii.marginals(graph, pii.Model(unary, np.zeros((5, 5)), skip))
    alone = pii.marginals(graph, pii.Model(unary, np.zeros((5, 5)), np.zeros((5, 5))))
    assert p[1].argmax() == 1 and p[1, 1] > alone[1, 1] + 0.3


def test_personal_data_of_odd_rows(spark):
    docs = table(spark, [(None, "a@b.c"), (1, None), (1, ""), (2, "x " * 50_000 + "1.2.3.4")])
    got = sorted(((r.doc_id, [(s.start, s.kind, s.end) for s in r.spans if s.base]) for r in pii.personal_data(docs, pii.fit(docs)).collect()), key=repr)
    assert got == sorted([(1, []), (1, []), (2, [(100_000, "ip", 100_007)]), (None, [(0, "email", 5)])], key=repr)
    empty = docs.where("false")
    assert pii.personal_data(empty, pii.fit(empty)).count() == 0


# --- packing -------------------------------------------------------------------------------------


def test_packing_loses_no_token_and_leaves_no_gap(spark):
    docs = [(k, t) for k, t in enumerate(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect())]
    docs += [(1000, None), (1001, ""), (1002, "word " * 9000), (None, "x"), (1003, "<|endoftext|> İ Σ́ don't x.. 日本\x1c\x85 y")]
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(table(spark, docs), path).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, t in docs:
        whole = b"".join(bytes(r.ids) for r in sorted(pieces[d], key=lambda r: r.start))
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert whole == b"".join(x.to_bytes(4, "little") for x in want)
        assert {r.doc_tokens for r in pieces[d]} == {len(want)}
    used = padded = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        used, padded = used + at, padded + (4096 - at if at & (at - 1) else 0)
    assert padded <= 0.01 * used
    assert packing.pack(table(spark, []), path).count() == 0


@pytest.mark.parametrize("text", ["İ.", "jİ,", "İ", "ŉ.", "ǰ,", "ΐ.", "ß.", "µ,", "ª.", "º,", "ÿ."])
def test_marks_behind_odd_letters(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.WordTokenizer(path).encode([text]) == [b"".join(x.to_bytes(4, "little") for x in want)]


def test_ids_of_many_strings_are_those_of_the_tokenizer():
    rnd = random.Random(11)
    letters = [*"abzABZéÉßİıŉǰſKÅµªºÿŸΣςσΐ日本語한ا\u0301\u0307\u0345\u200d\u00a0\x85\x1c\t\r", *".,;:!?'-_<>|/\\()0159", "<|", "|>", "</s>", "'s", "İ.", "Σ,", "don't", "ÀÉÎ", "The"]
    single = [chr(k) + mark for k in range(1, 0x3000) for mark in (".", "")]
    texts = single + ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 8))) + rnd.choice(["", ".", ",", " ", "\n"]) + rnd.choice(letters) for _ in range(30_000)]
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path).encode_batch_fast(texts, add_special_tokens=False)
    made = packing.WordTokenizer(path).encode(texts)
    assert [t for t, w, m in zip(texts, whole, made, strict=True) if m != b"".join(x.to_bytes(4, "little") for x in w.ids)] == []


def test_fill_finds_the_fullest_multiset():
    rnd = random.Random(1)
    for _ in range(300):
        counts = {rnd.randint(1, 30): rnd.randint(1, 4) for _ in range(rnd.randint(0, 5))}
        room = rnd.randint(0, 60)
        reach = {0}
        for n, c in counts.items():
            reach = {r + n * k for r in reach for k in range(c + 1)}
        chosen = packing.fill(counts, room)
        assert all(c <= counts[n] for n, c in chosen.items())
        assert sum(n * c for n, c in chosen.items()) == max(r for r in reach if r <= room)


def test_words_turn_over():
    path = public_tokenizers.path("word_bpe_49k.json")
    small = packing.WordTokenizer(path, cache=3)
    texts = ["The cat, sat. THE Cat", "a b c d e f", "The cat, sat."]
    assert [small.encode([t])[0] for t in texts] == [b"".join(x.to_bytes(4, "little") for x in Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids) for t in texts]


# --- quality -------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    got = queries.op10_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) / len(got) >= 0.95
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in got)


def test_scores_dont_depend_on_batches_or_ids(spark):
    rnd = random.Random(1)
    rows = [(f"good words here and there {k}", 1) for k in range(40)] + [(f"bad!!! ### %%% {k}", 0) for k in range(40)]
    model = quality.train([(t.encode(), y) for t, y in rows], (40, 40))
    docs = [(k, t) for k, (t, _) in enumerate(rows)] + [(None, None), (5, ""), (5, "x " * 100_000)]
    one = {(r.doc_id, r.score) for r in quality.score(table(spark, docs).coalesce(1), model).collect()}
    rnd.shuffle(docs)
    assert one == {(r.doc_id, r.score) for r in quality.score(table(spark, docs).repartition(7), model).collect()}
    assert all(0 <= s <= 1 for _, s in one)
    kept = quality.keep_good(table(spark, docs), model)
    assert kept.columns == ["doc_id", "text", "id", "body"] and {r.text for r in kept.collect() if r.text} >= {t for t, y in rows if y}


def test_quality_without_labels(spark):
    docs = table(spark, [(1, "a")])
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, labels)).first().score == 0.5
    assert quality.score(docs.where("false"), quality.fit(docs, labels)).count() == 0


def test_training_skips_held_out_rows(spark):
    docs = table(spark, [(k, "x") for k in range(50)])
    labels = spark.createDataFrame([(k, int(zlib.crc32(str(k).encode()) % 5 == 0)) for k in range(50)], "doc_id long, quality int")
    assert quality.score(docs, quality.fit(docs, labels)).agg(F.max("score")).first()[0] < 0.5


def test_scores_of_very_long_texts():
    model = quality.train([(t.encode(), y) for k in range(40) for t, y in ((f"A plain sentence about river {k} and its banks.", 1), (f"win win win cash cash {k}", 0))], (40, 40))
    for text, good in (("A plain sentence about a river and its banks.\n", True), ("win win win cash cash\n", False)):
        for times in (1, 1000, 200_000):
            body = text.encode() * times
            assert (model.scores(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0] >= 0.5) == good


def test_training_doesnt_depend_on_the_order_of_repeated_ids(spark):
    docs = [(k, f"{'good prose' if k % 2 else 'buy now'} {v} {k}") for k in range(60) for v in ("one", "two", "three")]
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    models = [quality.fit(spark.createDataFrame(d, "doc_id long, text string").repartition(n), labels) for d, n in ((docs, 1), (docs[::-1], 5))]
    assert (models[0].table == models[1].table).all() and models[0].bias == models[1].bias


def test_training_reads_whole_rows_within_its_bytes(spark):
    assert quality.within([5, 1, 9, 3], {5: 6, 1: 6, 9: 4, 3: 10}, {5: 0, 1: 0, 9: 0, 3: 1}, 10) == {5, 9, 3}
    docs = spark.createDataFrame([(k, f"{'fine words here' if k % 2 else 'spam'} {k}" * (100_000 if k == 4 else 1)) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    model = quality.fit(docs, labels, bytes_per_class=2000)
    got = quality.score(docs, model).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id != 4)
