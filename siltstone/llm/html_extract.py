"""Main-text extraction from HTML by tree scoring.

A tolerant scanner builds a tree; elements that can't be main text (by tag, or by words in class, id
and role) are left out at once. Every paragraph then passes points to its ancestors: one for itself,
one per comma, up to three for its length; the parent gets all, each further ancestor half of what
the one below it got, all discounted by the link density of the container. The best container is
widened to the article it stands in and to siblings that look like part of it. One narrow pass; each
page is handled alone.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Text, comments, other markup declarations, and the beginning of a tag.
TOKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)|<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?/][^>]*+>?|[^<]++|<", re.DOTALL)
#: The end of a tag, or an attribute: its name and its value in double or single quotes, behind a quote that never closes, or plain.
ATTRIBUTE = re.compile(r"""[\s/]*+(?:(>)|(=?[^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(["'])|([^\s>]*+)))?)""")
#: A tag read without regard to quotes.
BARE = re.compile(r"<(/?)([A-Za-z][^\s/<>]*+)[^<>]*+>")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
DROP = frozenset("nav footer aside form button select option input textarea dialog menu object embed canvas audio video map applet head".split())
CLOSES_P = BLOCK - {"br", "body", "html", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "select"}
#: An opening tag ends an open element of these names, looked for up to the nearest of the others.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr"}, {"table"}), "option": ({"option"}, {"select"}),
}
P_SCOPE = frozenset("button caption html object table td th template".split())
UNLIKELY = re.compile(
    r"(?<![a-z])(?:ads?|adv|advert\w*|adsense|banners?|sponsor\w*|promo\w*|promoted|comments?|commentlist|respond|replies|disqus|discussion|sidebars?|side-?bar|side-?nav|widgets?|rail|menus?|nav|navbar|navigation|navigator|breadcrumbs?|pagination|pager|footers?|foot|masthead|site-?header|page-?header|topbar|toolbar|cookies?|consent|gdpr|notices?|notifications?|alerts?|popups?|pop-?up|modals?|overlay|lightbox|newsletters?|subscribe|subscription|signup|sign-?up|login|log-?in|paywall|share|sharing|social|sharebar|related|recommend\w*|outbrain|taboola|skip-?link|screen-?reader-?text|sr-only|visually-?hidden|hidden|print-?only|no-?print|disclaimer|legal|copyright|colophon|tags?-?list|trending|most-?read|more-?stories|feedback|survey|forms?)(?![a-z])"
)
#: Of these, the words that inside an article may as well name a part of it: such a part goes if its text is mostly links.
SUBJECT = frozenset("discussion rail foot legal disclaimer copyright colophon feedback survey form forms".split())
#: Words of this kind that name notices and the like more often: such a part also goes if it is short and no paragraph.
NOTICE = frozenset("banner notice notices notification notifications alert alerts consent gdpr overlay subscription social related sharing trending".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 section".split())
LIKELY = re.compile(r"(?<![a-z])(?:article|articlebody|article-?body|body|content|entry|entry-?content|hentry|main|page|post|post-?content|post-?body|story|text|blog)(?![a-z])")
#: Class words of an element that holds an article's text, as the article element does.
ARTICLE = frozenset("article-body article-content article-text articlebody entry-content post-content post-body post-text story-body".split())
#: Class words that tell of a page's state or subject, not of the element's part in it.
STATE = re.compile(r" (?:has|with|without|no|is|js|category|cat|tag|type|status|format|postid|page-id)-\S*")
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar tooltip status".split())
#: Never containers by themselves, only parts of one.
PARTS = frozenset("tr tbody thead tfoot table ul ol dl li dt dd p pre blockquote".split())
PARAGRAPH = frozenset("p pre blockquote td li dd".split())


class Element:
    __slots__ = ("article", "children", "commas", "doubted", "drop", "length", "likely", "links", "parent", "score", "tag")

    def __init__(self, tag: str, parent, drop: bool = False, likely: int = 0, doubted: int = 0, article: bool = False):
        self.tag, self.parent, self.drop, self.likely, self.doubted, self.article, self.children = tag, parent, drop, likely, doubted, article, []
        self.length = self.links = self.commas = 0
        self.score = 0.0


#: Doubts about an element inside an article: its text must not be mostly links; nor short outside of a paragraph.
LINKS, SHORT = 1, 2


def named(classes: list[str], name: str) -> tuple[bool, int]:
    """Whether words of an element inside an article tell that it is no part of it, and what they make doubtful.

    Whole class words and a whole id tell it, unless they may name a subject; parts of a class word
    make it doubtful. Ids of headings and sections, and parts of other ids, are anchors and say nothing.
    """
    whole = [x for x in [*classes, name] if UNLIKELY.fullmatch(x)]
    if any(x not in SUBJECT and x not in NOTICE for x in whole):
        return True, 0
    if any(x in NOTICE for x in whole) or any(UNLIKELY.search(x) for x in classes if x not in whole):
        return False, SHORT
    return False, LINKS if whole else 0


def judge(tag: str, found: dict[str, str], article: bool) -> tuple[bool, int, int, bool]:
    """Whether an element is left out with all it holds, its bonus as a container, what its text has to show, and whether it is an article."""
    if tag in DROP or tag == "header" and not article:
        return True, 0, 0, False
    whole = tag in ("article", "main")
    bonus = 40 if whole else 0
    if not found or tag in ("html", "body"):
        return False, bonus, 0, whole
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()) or role in ROLES:
        return True, 0, 0, False
    if role == "main" or found.get("itemprop", "").lower() == "articlebody":
        bonus, whole = 40, True
    classes_, name = found.get("class", "").lower(), "" if article and tag in HEADINGS else found.get("id", "").lower()
    words = STATE.sub(" ", " " + re.sub(r"[_\s]+", " ", classes_ + " " + name))
    doubted = 0
    if words.strip():
        if not article and " header " in words + " ":
            return True, 0, 0, False
        likely = bool(LIKELY.search(words))
        classes = STATE.sub(" ", " " + " ".join(re.sub("_+", "-", classes_).split())).split()
        if article and tag not in ("article", "main"):
            sure, doubted = named(classes, name.replace("_", "-"))
            if sure:
                return True, 0, 0, False
        elif UNLIKELY.search(words) and tag not in ("article", "main"):
            return True, 0, 0, False
        bonus += 15 * likely
        whole = whole or not ARTICLE.isdisjoint(classes)
    return False, bonus, doubted, whole


def attributes(page: str, at: int) -> tuple[int, dict[str, str]] | None:
    """Where the tag ends whose name ends at ``at``, and its attributes, the first of each name; None if it never ends."""
    found: dict[str, str] = {}
    while True:
        m = ATTRIBUTE.match(page, at)
        if m[1]:
            return m.end(), found
        if m[5] or m.end() == at or m.end() == len(page):
            return None
        at = m.end()
        if m[2]:
            found.setdefault(m[2].lower(), m[3] or m[4] or m[6] or "")


def parse(page: str) -> Element:
    """The tree of a page without the elements that are left out; text as strings among the children.

    A tag ends at the first ">" outside of the quotes of its values, however long they are. Where a
    tag never ends, quotes mean nothing from there on, so each page is read in linear time.
    """
    root = Element("#root", None)
    stack, at, size, match = [root], 0, len(page), TOKEN.match
    depth_dropped = articles = 0
    quotes = True
    raw_ends: dict[str, int] = {}
    opened: dict[str, list[int]] = {}  # where in the stack the elements of a name are

    def close(low: int) -> None:
        nonlocal depth_dropped, articles
        for node in stack[low:]:
            depth_dropped -= node.drop
            articles -= node.article
            opened[node.tag].pop()
        del stack[low:]

    while at < size:
        m = match(page, at)
        tag, found = m[2], None
        if tag is not None:
            if quotes:
                read = attributes(page, m.end())
                quotes = read is not None
            if quotes:
                at, found = read
            else:
                bare = BARE.match(page, at)
                if bare:
                    at, tag, found = bare.end(), bare[2], {}
        if found is None:
            token = m[0] if tag is None else "<"
            at += len(token)
            if token[0] != "<" or token == "<":
                if not depth_dropped:
                    stack[-1].children.append(token)
            continue
        tag, top = tag.lower(), stack[-1]
        if m[1]:
            if opened.get(tag):
                close(opened[tag][-1])
            elif tag == "p" or tag == "br":
                top.children.append(" ")
            continue
        if tag in RAW:
            if not (page[at - 2] == "/" and tag == "svg"):
                if raw_ends.get(tag) != size:
                    end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
                    raw_ends[tag] = end.end() if end else size
                at = raw_ends[tag]
            continue
        if tag in CLOSES_P or tag in IMPLIED:
            names, stops = ({"p"}, P_SCOPE) if tag in CLOSES_P else ((), ())
            for names, stops in ((names, stops), IMPLIED.get(tag, ((), ()))):
                above = max((opened[x][-1] for x in stops if opened.get(x)), default=0)
                inside = [opened[x] for x in names if opened.get(x) and opened[x][-1] > above]
                if inside:  # the innermost one ends; a row or a body of a table also ends what it is in
                    close(min(x[bisect_right(x, above)] for x in inside) if tag in ("tbody", "tr") else max(x[-1] for x in inside))
            top = stack[-1]
        if tag in VOID:
            if tag in ("br", "hr") and not depth_dropped:
                top.children.append(" ")
            continue
        drop, likely, doubted, article = judge(tag, found, articles > 0)
        node = Element(tag, top, drop, likely, doubted, article)
        if not drop and not depth_dropped:
            top.children.append(node)
        opened.setdefault(tag, []).append(len(stack))
        stack.append(node)
        depth_dropped += drop
        articles += article
    return root


def measure(root: Element) -> list[Element]:
    """All elements, parents first, with the length, link length and commas of their text.

    Doubted elements without prose are taken out: with many links, or also short and no paragraph.
    """
    order = [root]
    for node in order:
        order += [x for x in node.children if isinstance(x, Element)]
    lost = False
    for node in reversed(order):
        for x in node.children:
            if isinstance(x, Element):
                if x.doubted and (density(x) >= 0.25 or x.doubted == SHORT and x.length <= 80 and x.tag not in PARAGRAPH):
                    x.drop = lost = True
                    continue
                node.length, node.links, node.commas = node.length + x.length, node.links + x.links, node.commas + x.commas
            else:
                node.length += len(x.strip())
                node.commas += x.count(",") + x.count("，") + x.count("、")
        if node.tag == "a":
            node.links = node.length
    if lost:
        for node in order:
            node.children = [x for x in node.children if not (isinstance(x, Element) and x.drop)]
        order = [root]
        for node in order:
            order += [x for x in node.children if isinstance(x, Element)]
    return order


def density(node: Element) -> float:
    return min(1.0, node.links / node.length) if node.length else 0.0


def main_elements(root: Element) -> list[Element]:
    """The best container and the siblings kept with it, in page order."""
    order = measure(root)
    for node in order:
        own = sum(len(x.strip()) for x in node.children if not isinstance(x, Element))
        if node.tag not in PARAGRAPH and not (node.tag in ("div", "section", "article", "main") and own >= 25) or not node.length:
            continue
        points = (1 + node.commas + min(node.length / 100, 3)) * (1 - density(node))
        up = node if node.tag in ("div", "section", "article", "main") else node.parent
        if up is not None:
            up.score += points
    for node in reversed(order):  # all ancestors get their share, half as much at each step
        if node.parent is not None:
            node.parent.score += node.score / 2
    found = [n for n in order if n.score > 0 and n.tag not in ("#root", "html")]
    if not found:
        return [root] if root.length else []
    rank = lambda n: (n.score + n.likely) * (1 - density(n)) * (0.5 if n.tag == "body" else 1)
    best = max(found, key=rank)
    while best.tag in PARTS and best.parent is not None:
        best = best.parent
    up = best
    while up is not None:  # the outermost article around it, if any
        if up.likely >= 40 or up.likely >= 15 and up.score and up.tag != "body":
            best = up
        up = up.parent
    if best.parent is None or best.tag == "body":
        return [best]
    bar, kept = max(10.0, 0.2 * rank(best)), []
    for x in best.parent.children:
        if isinstance(x, Element) and (x is best or x.likely >= 40 or rank(x) >= bar and best.likely < 40 or best.likely < 40 and x.tag == "p" and x.length > 80 and density(x) < 0.25):
            kept.append(x)
    return kept


def text_of(nodes: list[Element]) -> str:
    """The text of elements: references decoded, blocks apart by one space, white space folded."""
    parts: list[str] = []
    stack: list = list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag in BLOCK:
            parts.append(" ")
            stack.append(" ")
            stack += reversed(x.children)
        else:
            stack += reversed(x.children)
    return " ".join(entities.unescape("".join(parts)).split())


def main_text(page: str) -> str:
    """The main text of one page; empty if it has none."""
    return text_of(main_elements(parse(page)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of ``pages``: its id, its url, ``text`` and ``n_chars`` (code points).

    A null page counts as empty and has the empty text, as has a page without text. Null ids and
    urls pass through, repeated rows stay apart, an empty table gives an empty result, and other
    columns are ignored.
    """
    out = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array([main_text(x) for x in part.column(2).to_pylist()], pa.string())], schema=out)

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), text_or_empty(F.col(html_col)).alias("html"))
    made = rows.mapInArrow(run, "id long, url string, text string")
    return made.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
