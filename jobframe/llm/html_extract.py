"""Main-text extraction from web pages by shallow text features.

A page is cut into flat text blocks. Each block is described by its words and link density, those of the blocks
before and after it, and by what tags and names say of its place (only tags and plain names are strong evidence); a
decision tree, grown from the small labelled table below, says whether it is main text. The tags are read by one pass of a pattern, so broken markup (crossing
tags, a page cut off anywhere) is no special case. Of the elements that are dropped whole, only raw text without an
end tag runs to the end of the page; of any other one without an end tag the start tag alone is dropped.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element kinds.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe label legend li main menu nav ol "
    "optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
DROPPED = "script|style|noscript|template|svg|math|title|object|iframe|canvas|audio|video|textarea|select|button"
#: Of these, the ones whose content is no markup: it runs to the next end tag, or else to the end of the page.
RAW_TEXT = frozenset("script style title textarea noscript iframe".split())
CONTAINERS = frozenset(
    "article aside blockquote body center details dialog div dl fieldset figure footer form header main menu nav ol "
    "search section table td tr ul li".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
AWAY_TAGS = frozenset("aside dialog fieldset footer form menu nav search".split())
BODY_TAGS = frozenset("article main".split())
#: Parts of class and id names that mark surroundings, and names that mark the main text.
AWAY_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert author-box banner breadcrumb breadcrumbs byline-links "
    "comment comments consent cookie cookies copyright disclaimer disqus dropdown footer gdpr header login masthead "
    "menu modal nav navbar navigation newsletter notice notification notifications outbrain overlay pager pagination "
    "paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe subscription tags taboola teaser toc toolbar topbar tracking "
    "widget widgets".split())
BODY_NAMES = frozenset("article articlebody content entry main post story text".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<drop>{DROPPED})(?=[\s/>])(?:(?P<held>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>|[^>]*+>)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z!?][^>]*+(?:>|\Z)", re.S | re.I)
_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW_TEXT}
#: A value without quotes at the end of a tag: a slash there belongs to it.
_BARE = re.compile(r"=\s*[^\s\"']+\Z")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


#: Names that take an article or main element out of the main text, as one of many or as a reader's comment.
LESSER_NAMES = frozenset("ad ads advert comment comments promo promoted recommended related replies reply sponsored teaser "
                         "widget".split())
#: Parts of a name that turn it into a statement about the page ("no-sidebar", "ad-free", "comments-open"): no evidence.
STATEMENTS = frozenset("no not non has have with without free open closed off on enabled disabled hide show is".split())
#: Parts of names of boxes that hold much else beside what they are called after ("header-wrap"): weak evidence.
BOXES = frozenset("wrap wrapper container outer inner layout page".split())
#: Kinds of place: surroundings, perhaps surroundings, unknown, named like main text, an article or main element.
AWAY, PERHAPS, UNKNOWN, NAMED, BODY = -2.0, -1.0, 0.0, 1.0, 2.0


def names_of(attrs: str) -> list[tuple[str, set]]:
    """Class, id and role names, each with its parts (at marks, digits and capitals)."""
    found = []
    for m in _NAMES.finditer(attrs):
        for name in m[1].strip("\"'").split():
            found.append((name.lower(), {x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)}))
    return found


def evidence(attrs: str, inside: float) -> float:
    """What an element's names say of its place: the strongest word for surroundings, else for main text."""
    said = UNKNOWN
    away = AWAY_NAMES - {"header"} if inside >= NAMED else AWAY_NAMES
    for whole, parts in names_of(attrs) if attrs else ():
        if whole in away:
            return AWAY
        if parts & STATEMENTS:
            continue
        if parts & away:
            said = min(said, PERHAPS if parts & BOXES or parts & BODY_NAMES else AWAY)
        elif parts & BODY_NAMES and said == UNKNOWN:
            said = NAMED
    return said


def place_of(tag: str, attrs: str, inside: float) -> float:
    """The kind of place inside an element, from its tag and names and the kind that it stands in."""
    if tag in ("html", "body"):
        return inside
    if tag in AWAY_TAGS or (tag == "header" and inside < NAMED) or (attrs and _HIDDEN.search(attrs)):
        return min(inside, PERHAPS if tag == "form" else AWAY)
    if tag in BODY_TAGS:
        lesser = any(whole in LESSER_NAMES or (parts & LESSER_NAMES and not parts & STATEMENTS)
                     for whole, parts in (names_of(attrs) if attrs else ()))
        return AWAY if lesser or (inside == AWAY and tag == "article") else BODY
    said = evidence(attrs, inside)
    if said < UNKNOWN:
        return min(said, inside)
    return NAMED if said == NAMED and inside in (PERHAPS, UNKNOWN) else inside


def tags(page: str) -> list[list]:
    """The page's tags and comments in order: [match, where it ends], for a dropped element the end of its end tag.

    An element that ends in its start tag, or that is not raw text and has no end tag, is that tag alone."""
    found: list[list] = []
    opened: dict[str, list[int]] = {}
    at = 0
    while m := _TAG.search(page, at):
        at = m.end()
        if m["drop"]:
            name, held = m["drop"].lower(), m["held"]
            drawn = name == "title" and (opened.get("svg") or opened.get("math"))  # no raw text there
            if held and held.endswith("/") and not _BARE.search(held):
                pass
            elif name in RAW_TEXT and not drawn:
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            else:
                opened.setdefault(name, []).append(len(found))
        elif m["end"] and opened.get(m["name"].lower()):
            found[opened[m["name"].lower()].pop()][1] = at
        found.append([m, at])
    return found


def blocks(page: str) -> list[tuple[str, int, int, float]]:
    """The page's non-empty text blocks in order: (text, words, words in links, place)."""
    out: list[tuple[str, int, int, float]] = []
    words: list[str] = []  # pieces of the open block
    linked: list[str] = []
    open_tags: list[tuple[str, float]] = []
    anchor = False
    place, at = 0.0, 0

    def close():
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                n_linked = len(html.unescape(" ".join(linked)).split()) if linked else 0
                out.append((text, text.count(" ") + 1, n_linked, place))
            words.clear()
            linked.clear()

    def take(text):
        words.append(text)
        if anchor:
            linked.append(text)

    for m, end in tags(page):
        if m.start() < at:  # inside a dropped element
            continue
        if m.start() > at:
            take(page[at:m.start()])
        at = end
        name = m["name"]
        if name is None:
            if m["drop"] and m["drop"].lower() in BLOCK_TAGS:
                close()
            continue
        tag = name.lower()
        if tag == "a":
            anchor = not m["end"]
        elif tag == "br":
            words.append(" ")
        elif tag in BLOCK_TAGS:
            close()
            anchor = False
            if tag in CONTAINERS:
                if not m["end"]:
                    open_tags.append((tag, place))
                    place = place_of(tag, m["attrs"], place)
                else:
                    for k in range(len(open_tags) - 1, -1, -1):
                        if open_tags[k][0] == tag:
                            place = open_tags[k][1]
                            del open_tags[k:]
                            break
            elif not m["end"] and m["attrs"] and place_of(tag, m["attrs"], place) < min(place, 0):
                open_tags.append((tag, place))
                place = place_of(tag, m["attrs"], place)
            elif m["end"] and open_tags and open_tags[-1][0] == tag:
                place = open_tags.pop()[1]
    take(page[at:])
    close()
    return out


FEATURES = ("place", "words", "links", "prev_words", "prev_links", "next_words", "next_links")

#: The labelled table: a block's features (kind of place; words and link density of the block, of the one before and
#: of the one after; 0 beyond the page's ends) and whether it is main text. Fixed values, written for this operator.
LABELLED = """
place words links prev_words prev_links next_words next_links main
2 9 0.0 1 1.0 60 0.0 1
2 60 0.0 9 0.0 45 0.0 1
2 3 0.0 60 0.0 45 0.0 1
2 45 0.1 3 0.0 80 0.0 1
2 1 0.0 30 0.0 12 0.0 1
2 12 0.5 40 0.0 30 0.0 1
2 80 0.0 45 0.1 12 0.0 1
2 6 1.0 50 0.0 40 0.0 1
2 2 0.0 1 1.0 8 0.0 1
2 120 0.0 2 0.0 0 0.0 1
2 2 0.0 4 0.0 8 0.0 1
2 2 0.0 0 0.0 2 0.0 1
2 3 0.0 2 0.0 0 0.0 1
2 8 0.0 2 0.0 3 0.0 1
2 5 0.0 5 0.0 5 0.0 1
2 20 0.3 2 0.0 1 1.0 1
2 1 0.0 3 0.0 1 0.0 1
2 15 0.0 15 0.0 0 0.0 1
2 40 0.0 0 0.0 1 1.0 1
2 3 0.0 30 0.0 2 0.0 1
1 2 0.0 0 0.0 3 0.0 1
1 3 0.0 2 0.0 0 0.0 1
1 8 0.0 2 0.0 3 0.0 1
1 20 0.0 3 0.0 1 1.0 1
-2 45 0.0 45 0.0 45 0.0 0
-2 42 0.0 42 0.0 0 0.0 0
-2 42 0.0 0 0.0 42 0.0 0
-2 90 0.0 60 0.0 90 0.0 0
-2 6 0.0 6 0.0 6 0.0 0
-2 8 0.0 7 0.0 6 0.0 0
-2 45 0.0 20 0.0 60 0.0 0
-2 50 0.0 60 0.0 45 0.0 0
-2 70 0.0 45 0.0 1 1.0 0
-2 20 0.0 45 0.0 45 0.0 0
-2 12 0.0 60 0.0 30 0.0 0
-2 60 0.1 3 0.0 60 0.0 0
2 4 1.0 60 0.0 0 0.0 0
2 3 1.0 60 0.0 4 1.0 0
2 4 1.0 3 1.0 4 1.0 0
2 5 1.0 4 1.0 0 0.0 0
2 6 1.0 4 1.0 30 0.0 0
2 7 0.9 40 0.0 6 1.0 0
1 9 0.0 1 1.0 60 0.0 1
1 60 0.0 9 0.0 45 0.0 1
1 3 0.0 60 0.0 45 0.0 1
1 45 0.1 3 0.0 80 0.0 1
1 12 0.5 40 0.0 30 0.0 1
1 6 1.0 50 0.0 40 0.0 1
1 2 0.0 1 1.0 8 0.0 1
1 120 0.0 2 0.0 0 0.0 1
1 5 0.0 6 0.0 4 0.0 1
1 4 1.0 60 0.0 0 0.0 0
1 3 1.0 60 0.0 4 1.0 0
1 4 1.0 3 1.0 4 1.0 0
1 5 1.0 4 1.0 0 0.0 0
1 8 0.9 5 1.0 30 0.0 0
0 1 1.0 0 0.0 1 1.0 0
0 2 1.0 1 1.0 2 1.0 0
0 3 1.0 2 1.0 9 0.0 0
0 6 0.8 3 1.0 4 1.0 0
0 15 0.9 6 0.8 5 1.0 0
0 30 0.7 12 1.0 20 0.8 0
0 3 1.0 0 0.0 20 0.0 0
0 4 1.0 1 0.0 60 0.0 0
0 2 1.0 50 0.0 40 0.0 0
0 10 1.0 90 0.0 0 0.0 0
0 5 0.9 0 0.0 90 0.0 0
0 2 0.0 1 1.0 1 1.0 0
0 4 0.0 2 1.0 3 1.0 0
0 6 0.0 40 0.0 4 0.4 0
0 3 0.0 5 0.0 6 0.0 0
0 5 0.2 6 0.0 3 0.0 0
0 4 0.0 3 0.0 4 0.0 0
0 7 0.0 0 0.0 1 1.0 0
0 5 0.0 90 0.0 0 0.0 0
0 9 0.1 3 0.0 0 0.0 0
0 8 0.0 3 1.0 55 0.0 1
0 6 0.0 9 0.0 70 0.0 1
0 55 0.0 8 0.0 40 0.0 1
0 40 0.0 55 0.0 3 0.0 1
0 3 0.0 40 0.0 65 0.0 1
0 65 0.1 3 0.0 30 0.2 1
0 30 0.2 65 0.1 45 0.0 1
0 25 0.0 1 1.0 60 0.0 1
0 90 0.0 25 0.0 4 1.0 1
0 35 0.0 35 0.0 20 0.0 1
0 20 0.0 35 0.0 28 0.0 1
0 12 0.0 28 0.0 33 0.0 1
0 70 0.2 12 0.0 2 1.0 1
0 6 0.0 6 0.0 6 0.0 1
0 5 0.0 0 0.0 6 0.0 1
0 6 0.0 0 0.0 6 0.0 1
0 8 0.0 0 0.0 8 0.0 1
0 7 0.0 6 0.0 0 0.0 1
0 6 0.0 6 0.0 0 0.0 1
0 6 0.0 8 0.0 0 0.0 1
0 9 0.0 12 0.0 0 0.0 1
0 6 0.0 7 0.0 5 0.0 1
0 8 0.0 7 0.0 6 0.0 1
-1 60 0.0 45 0.0 70 0.0 1
-1 45 0.0 60 0.0 40 0.0 1
-1 80 0.0 50 0.0 30 0.1 1
-1 40 0.1 60 0.0 45 0.0 1
-1 35 0.0 40 0.0 35 0.0 1
-1 90 0.0 9 0.0 60 0.0 1
-1 45 0.0 45 0.0 0 0.0 1
-1 35 0.0 60 0.0 4 0.0 1
-1 45 0.0 0 0.0 45 0.0 1
-1 60 0.0 90 0.0 0 0.0 1
-1 9 0.0 1 1.0 90 0.0 1
-1 20 0.0 3 0.0 3 0.0 0
-1 30 0.0 2 0.0 4 0.0 0
-1 60 0.0 2 0.0 3 0.0 0
-1 42 0.0 2 0.0 2 0.0 0
-1 80 0.0 3 0.0 2 0.0 0
-1 42 0.0 2 0.0 0 0.0 0
-1 25 0.0 8 0.0 0 0.0 0
-1 12 0.0 0 0.0 3 0.0 0
-1 9 0.0 3 0.0 5 0.0 0
-1 3 0.0 25 0.0 2 0.0 0
-1 2 0.0 0 0.0 45 0.0 0
-1 2 0.0 45 0.0 45 0.0 0
-1 3 0.0 60 0.0 40 0.0 0
-1 2 0.0 30 0.0 12 0.0 0
-1 4 0.0 12 0.0 80 0.0 0
-1 2 0.0 1 1.0 6 0.0 0
-1 1 1.0 0 0.0 1 1.0 0
-1 5 0.8 3 1.0 6 0.9 0
-1 40 0.6 30 0.5 20 0.8 0
-1 12 0.3 90 0.0 0 0.0 0
-2 1 1.0 0 0.0 1 1.0 0
-2 1 1.0 1 1.0 8 0.0 0
-2 8 0.0 1 1.0 10 0.0 0
-2 25 0.0 80 0.0 0 0.0 0
-2 40 0.1 60 0.0 30 0.0 0
-2 60 0.0 45 0.0 70 0.0 0
-2 3 0.0 25 0.0 2 0.0 0
-2 12 0.3 90 0.0 0 0.0 0
-2 5 0.0 2 0.0 6 0.0 0
-2 150 0.0 90 0.0 20 0.0 0
"""


def labelled_rows():
    lines = LABELLED.split("\n")[1:-1]
    if tuple(lines[0].split()) != (*FEATURES, "main"):
        raise ValueError("the labelled table's columns changed")
    rows = [tuple(map(float, x.split())) for x in lines[1:]]
    return [r[:-1] for r in rows], [int(r[-1]) for r in rows]


def grow(x, y, depth: int = 8):
    """A CART tree by Gini impurity: a 0/1 leaf, or (feature, threshold, left if <=, right)."""
    if depth == 0 or len(set(y)) == 1:
        return int(2 * sum(y) >= len(y))
    best = None
    for f in range(len(x[0])):
        values = sorted({r[f] for r in x})
        for lo, hi in zip(values, values[1:]):
            cut = (lo + hi) / 2
            sides = [[b for r, b in zip(x, y) if (r[f] <= cut) == s] for s in (True, False)]
            cost = sum(2 * sum(s) * (len(s) - sum(s)) / len(s) for s in sides)
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, cut)
    if best is None:
        return int(2 * sum(y) >= len(y))
    _, f, cut = best
    parts = [[(r, b) for r, b in zip(x, y) if (r[f] <= cut) == s] for s in (True, False)]
    return (f, cut, *(grow([r for r, _ in p], [b for _, b in p], depth - 1) for p in parts))


def classify(tree, row) -> int:
    while not isinstance(tree, int):
        f, cut, left, right = tree
        tree = left if row[f] <= cut else right
    return tree


def main_text(page: str | None, tree) -> str:
    """The main blocks' texts, joined by line ends; empty for a null or textless page."""
    found = blocks(page) if page else []
    shape = [(0, 0.0), *((w, n / w) for _, w, n, _ in found), (0, 0.0)]
    return "\n".join(
        text for k, (text, _, _, place) in enumerate(found)
        if classify(tree, (place, *shape[k + 1], *shape[k], *shape[k + 2])))


def extract(pages: DataFrame, depth: int = 8) -> DataFrame:
    """Per row of ``pages``: page_id, url, text (the main text; empty if there is none), n_chars (its code points).

    Null and empty pages give an empty text; null ids and urls stay; repeated rows each get a row; extra columns are
    ignored; an empty table gives no rows. Whole pages are read, whatever their length."""
    tree = grow(*labelled_rows(), depth)
    src = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(p, tree) for p in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
