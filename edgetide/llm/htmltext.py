"""Main text of web pages: flat text blocks, described by word counts and link densities of themselves and their
neighbours, by the kind of part they are in and by how much of the page is in such parts, classified by a decision tree trained
on a small table."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.common import fresh, whole_text

# Element names by role.
RAW = frozenset("script style noscript template iframe svg math object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead title tr ul".split())
CONTROLS = frozenset("button select option optgroup textarea label legend datalist output".split())
ASIDE = frozenset("nav footer aside form dialog menu fieldset head title".split())
# Words in class and id attributes that name parts around an article, or the article itself.
ASIDE_WORDS = frozenset(
    "ad ads adbox adslot adsense adsbygoogle adunit advert adverts advertisement advertising advertorial sponsor sponsored "
    "promo promotion banner sidebar side widget menu nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar "
    "footer foot cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login search form share sharing social related recommended recommendations comment comments respond "
    "reply replies disqus pagination pager copyright legal disclaimer skip tags".split())
ASIDE_ENDINGS = tuple("menu nav navbar navigation sidebar footer banner comments adverts cookies newsletter".split())
COMMENT_WORDS = frozenset("comment comments respond reply replies disqus".split())
HEAD_WORDS = frozenset("header head siteheader pageheader".split())
ARTICLE_WORDS = frozenset("article post entry story content main maincontent articlebody postbody".split())
# Words that follow the word for the part itself, as in footer-inner; words that tell of other parts, as in
# has-sidebar; words for what holds several parts.
GENERIC_WORDS = frozenset(
    "wrap wrapper container inner outer box area block section row column col panel pane bar list item items link links "
    "button buttons icon icons slot unit widgets card left right top bottom primary secondary content text body title posts "
    "articles stories policy page site".split())
MIXED_WORDS = frozenset("with has no without layout template grid columns".split())
HOLDERS = frozenset("wrap wrapper container page".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(sorted(RAW)) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")  # a slash that ends the tag, not an unquoted value
WORD = re.compile(r"[A-Za-z]+")
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# how surely a part is not the article: a word in a name, the name itself, the kind of element
NONE, WEAK, STRONG, CERTAIN = 0, 1, 2, 3


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    aside: int  # NONE to CERTAIN
    article: int  # 0, 1 in a part that is named like an article, 2 in an article or main element


def named(token: str) -> tuple[int, int, bool]:
    """What one class or id says of its element: how surely it stands beside the article, 1 if it names an article, and
    whether it names a header.

    The last word that is not generic names the part: comments-container holds comments, social-commentary is no social box.
    """
    words = [part.lower() for word in WORD.findall(token) for part in HUMP.findall(word)]
    every = set(words)
    if not words or every & MIXED_WORDS:
        return NONE, 0, False
    named_last = words[:]
    while named_last and named_last[-1] in GENERIC_WORDS:
        named_last.pop()
    heading = bool(every & HEAD_WORDS) or "".join(words) in HEAD_WORDS
    article = int(bool(every & ARTICLE_WORDS) or "".join(words) in ARTICLE_WORDS)
    if not named_last:
        return NONE, article, heading
    last, pair = named_last[-1], "".join(named_last[-2:])
    if last in COMMENT_WORDS:
        return CERTAIN, 0, heading
    if last in ASIDE_WORDS or pair in ASIDE_WORDS or last.endswith(ASIDE_ENDINGS):
        return (NONE, 0, False) if article and words[-1] in HOLDERS else (STRONG, 0, heading)
    return (WEAK if every & ASIDE_WORDS else NONE), article, heading


def region(name: str, attributes: str, aside: int, article: int) -> tuple[int, int]:
    """What an element makes of the surrounding (aside, article) state."""
    tokens, roles = [], set()
    if name not in ("html", "body") and attributes:
        for key, *values in NAMED.findall(attributes):
            found = "".join(values).split()
            if key.lower() == "role":
                roles.update(map(str.lower, found))
            else:
                tokens += map(named, found)
    if name in ASIDE or name in CONTROLS or roles & ASIDE_ROLES:
        return CERTAIN, article
    hint = max((t[0] for t in tokens), default=NONE)
    like_article = max((t[1] for t in tokens), default=0)
    if hint == CERTAIN or (hint == STRONG and name == "article"):
        return CERTAIN, article
    if name in ("article", "main") or "main" in roles:
        return (min(aside, WEAK) if aside < CERTAIN else aside), 2
    if hint == STRONG and like_article:
        hint = WEAK
    if hint != STRONG and not article and not like_article and (name == "header" or any(t[2] for t in tokens)):
        return (CERTAIN if name == "header" else max(aside, STRONG)), article
    return max(aside, hint), max(article, like_article)


def blocks_of(page: str) -> list[Block]:
    """Flat text blocks in page order. Tags that a page forgot to close end with the element around them."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []
    opened = Counter()  # names on the stack: an end tag that nothing waits for costs no search
    pieces: list[str] = []
    linked, links, state = [], 0, (NONE, 0)

    def close_block():
        text = " ".join("".join(pieces).split())
        if text:
            inside = len(" ".join("".join(linked).split()).split())
            words = len(text.split())
            out.append(Block(text, words, min(1.0, inside / words), *state))
        pieces.clear()
        linked.clear()

    def pop_to(depth: int):
        nonlocal links, state
        for n, _, _ in stack[depth:]:
            opened[n] -= 1
            links -= n == "a"
        if depth < len(stack):
            state = stack[depth - 1][1:] if depth else (NONE, 0)
            del stack[depth:]

    def implied(names: tuple, stops: frozenset):
        """An element that ends where the next of its kind begins."""
        if not any(opened[n] for n in names):
            return
        for depth in range(len(stack) - 1, -1, -1):
            if stack[depth][0] in names:
                pop_to(depth)
                return
            if stack[depth][0] in stops:
                return

    def add(text: str):
        if "&" in text:
            text = html.unescape(text)
        pieces.append(text)
        if links:
            linked.append(text)

    at = 0
    for found in TOKEN.finditer(page):
        if found.start() > at:
            add(page[at:found.start()])
        at = found.end()
        name = found.group("name")
        if not name:
            continue
        name = name.lower()
        if name in BLOCK or name in CONTROLS:
            close_block()
        elif name == "br":
            add(" ")
        if found.group("end"):
            for depth in range(len(stack) - 1, -1, -1) if opened[name] else ():
                if stack[depth][0] == name:
                    pop_to(depth)
                    break
                if name not in BLOCK and stack[depth][0] in BLOCK:
                    break
            continue
        if name in VOID:
            continue
        if name in BLOCK:
            implied(("p",), STOPS)
            if name == "li":
                implied(("li",), frozenset(("ul", "ol", "menu")))
            elif name in ("dt", "dd"):
                implied(("dt", "dd"), frozenset(("dl",)))
            elif name in ("tr", "td", "th"):
                implied(("tr",) if name == "tr" else ("td", "th"), frozenset(("table",) if name == "tr" else ("tr", "table")))
            elif name == "body":
                implied(("head",), frozenset())
        if name in BLOCK or name in CONTROLS:
            state = region(name, found.group("attributes"), *state)
        if name == "a":
            links += 1
        if not CLOSED.search(found.group("attributes")) or name in BLOCK:
            stack.append((name, *state))
            opened[name] += 1
        elif name == "a":
            links -= 1
    if at < len(page):
        add(page[at:])
    close_block()
    return out


STOPS = BLOCK - {"p"}

# The labelled table, in two parts. Layouts: the blocks of a page in order, by role (m main text, l links among it, s
# surroundings, p prose in surroundings, q the same in surroundings that are always marked, u prose without marks
# beside an article element, t the teaser of another article), words and link density. Each is read forwards and backwards.
LAYOUTS = """
s4/1 s5/1 s3/1 m8 m80 m45/.05 m120 s6/.5 s5/1
s3/1 m6 m25 l5/1 l7/1 l4/1 m60/.1 m30 s9/1 s8/.6
s5/1 s2/1 t18 m9 m70/.02 m2 m55 m3 m90/.1 s4/1 s6/1
s30/.9 s4/1 m12 m40/.2 m150 l12/1 l9/.9 s25/.9 s3/1
m7 m400 m6 m200/.05 l3/1 s5/1 s4/.8
s1/1 s1/1 s1/1 m10 m18/.1 m22 m35 m15/.3 l6/1 l8/1 l2/1 s7/1
s6/1 s60/.8 m5 m90 t25 s40/.7 s4/1
s2/1 m4 m14 m11 m28 l20/.9 l16/1 m33/.1 s5/1 s12/.7
s3/1 s7/1 m9/1 m75 m50 m1 m44/.4 m27 s20/.6 s2/1
s8/1 m130 m65/.15 l4/1 l6/1 l5/1 t30 s3/1 s9/1
m11 m35/.5 m45 m5 m6 m80 s6/1 l30/1 l26/.95 s4/1
s5/.9 t12 t15 m6 m48 m52 m9 m37/.25 l3/1 s4/1
s4/1 p30 m8 m40 m70 p20 p5 s5/1
q40 m5 m30 m2 m9 q120 q70 q55 s6/1 q2
s5/1 p12 m7 m12 m6 m100 p30 s3/1 p3
m6 m3 m4 q50 s4/1 q20 q1
q30 m2 q80 q10
q15 m8 m1 m3 m5 q25 q200 q4
s2/1 m9 m4/1 m30 m60 l5/1 l4/1 m20 q70 q90 q6
m5/1 m90 m40 l3/1 m25 q3 q12
m9 m40 m14/1 m35 l4/1 l6/1 m7 l5/1 l5/1 m50 m3 l9/1
p25 s5/1 m10 m1 m2 m20 l2/1 l3/1 m6 l8/.8 l7/.9 m4 m15/.5 p4 q140
m3 m150 m8 m2 m60/.3 m4 m4 q60 q300 s5/1
m8 m12 l25/.9 l30/1 m90 p8 p6
m7/1 m33 m85 q1 q2 q7 q16 q35
m6/1 m14 m60 q5 m9/1 m19 m8 l4/1 l2/1
m5/1 m16 m5 m4/1 m17 m75 m8/1 m15
m2/1 m21 m35 s4/1 m20 m3/1 m70 l2/1 l1/1 l3/1
m3/1 m24 m18 m2/1 m29 m45 m11/1 m26 l1/1 q9
m2 u22 s3/1
u30 m3 m8 u40 u9 u15 s6/1
m5 m12 u100 u25 u3
m4 q9 m11 q3 m21 q45 m6 q2
q8 q1 q28 m3 m19 m2 m240 l8/1 l7/1 q5 q17
"""
# Markups: the state, as aside and article, that a page gives to blocks of each role (m, l, s, t).
MARKUPS = """
02 02 30 30
02 02 20 02
02 12 00 30
02 02 10 21
01 01 00 12
01 01 30 00
01 01 20 20
01 11 00 31
00 00 30 20
00 00 00 20
00 20 20 01
10 10 30 01
10 20 30 30
10 10 00 20
11 11 20 20
12 12 30 10
02 02 10 11
01 01 10 10
"""


def labelled_table() -> np.ndarray:
    """The blocks of every layout in every markup as ``described``, with the class (1: main text) in the last column.

    Layout and markup vary independently: on the same marks links among the text are told by densities, and the same
    words and densities are text or not by where they stand. Teasers and prose in surroundings that stand on the same marks as
    the text itself are left out, as nothing tells them.
    """
    rows = []
    for markup in (line.split() for line in MARKUPS.split("\n") if line):
        states = dict(zip("mlstpq", [*markup, markup[2], markup[2] if int(markup[2][0]) >= STRONG else "30"]))
        if states["m"] == "02":
            states["u"] = "00"
        cells = [layout.split() for layout in LAYOUTS.split("\n") if layout]
        for layout in cells + [layout[::-1] for layout in cells]:
            page, labels = [], []
            for cell in (cell for cell in layout if cell[0] in states):
                words, _, density = cell[1:].partition("/")
                aside, article = map(int, states[cell[0]])
                page.append(Block("", int(words), float(density or 0), aside, article))
                alike = cell[0] in "pqt" and states[cell[0]] == states["m"]
                labels.append(None if alike else float(cell[0] == "m"))
            rows += [[*row, label] for row, label in zip(described(page), labels) if label is not None]
    return np.array(rows)


@dataclass
class Node:
    value: int = 0
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(rows: np.ndarray, depth: int = 9, fewest: int = 12) -> Node:
    """A classification tree by Gini impurity; the last column is the class. Ties go to the first feature.

    No side of a split has less than ``fewest`` rows.
    """
    labels = rows[:, -1]
    node = Node(value=int(labels.mean() >= 0.5))
    if depth == 0 or labels.min() == labels.max():
        return node
    best = None
    for feature in range(rows.shape[1] - 1):
        values = np.unique(rows[:, feature])
        for threshold in (values[1:] + values[:-1]) / 2:
            side = rows[:, feature] <= threshold
            if min(side.sum(), (~side).sum()) < fewest:
                continue
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (labels[side], labels[~side]))
            if best is None or impurity < best[0] - 1e-9:
                best = (impurity, feature, threshold, side)
    if best is None:
        return node
    _, node.feature, node.threshold, side = best
    node.low, node.high = grow(rows[side], depth - 1), grow(rows[~side], depth - 1)
    return node


WEIGHTS = (1, 2, 10)  # what a word counts that is in no article, in a part named like one, in an article element


def described(blocks: list[Block]) -> list[tuple]:
    """One row of features per block, in the order of the labelled table.

    Words and link density of the block, of the block before and of the block after it, leaving out parts that surely are not the
    article; the block's state; and the share of the page's unlinked words that stand in this state, among states that are no
    surer to be beside the article.
    """
    prose = Counter()
    for b in blocks:
        prose[b.aside, b.article] += b.words * (1 - b.link_density) * WEIGHTS[b.article]
    up_to = [sum(n for (aside, _), n in prose.items() if aside <= grade) for grade in range(CERTAIN + 1)]
    nothing = (0, 0.0)
    before, last = [], nothing
    for b in blocks:
        before.append(last)
        if b.aside < STRONG:
            last = (b.words, b.link_density)
    after, last = [], nothing
    for b in reversed(blocks):
        after.append(last)
        if b.aside < STRONG:
            last = (b.words, b.link_density)
    return [
        (b.words, b.link_density, *ahead, *behind, float(b.aside), float(b.article),
         prose[b.aside, b.article] / up_to[b.aside] if up_to[b.aside] else 0.0)
        for b, ahead, behind in zip(blocks, before, reversed(after))]


def decide(tree: Node, row: tuple) -> int:
    while tree.feature >= 0:
        tree = tree.low if row[tree.feature] <= tree.threshold else tree.high
    return tree.value


def main_text(page: Column) -> Column:
    """The main blocks of a page, joined by blank lines; empty if there are none."""
    tree = grow(labelled_table())

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            blocks = blocks_of(page)
            out.append("\n\n".join(b.text for b, row in zip(blocks, described(blocks)) if decide(tree, row)))
        return pd.Series(out, dtype=object)

    return text(whole_text(page))


def text_blocks(page: Column) -> Column:
    """All blocks of a page with their measures and the tree's decision, for inspection."""
    tree = grow(labelled_table())

    @F.pandas_udf("array<struct<text: string, words: int, link_density: double, aside: int, article: int, kept: boolean>>")
    def blocks(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            found = blocks_of(page)
            out.append([{**vars(b), "kept": bool(decide(tree, row))} for b, row in zip(found, described(found))])
        return pd.Series(out, dtype=object)

    return blocks(whole_text(page))


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; a null or empty page has an empty text. Repeated rows stay."""
    text = fresh(pages.columns, "main_text")
    found = pages.select("page_id", "url", "html").withColumn(text, main_text(F.col("html")))
    return found.select("page_id", "url", F.col(text).alias("text"), F.length(text).cast("long").alias("n_chars"))
