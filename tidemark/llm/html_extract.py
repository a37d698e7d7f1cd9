"""Main text of HTML pages by block rules in two passes.

The page is cut into blocks at block-level tags (and at doubled line breaks).  Blocks inside scripts, styles, forms
and the like don't exist; blocks inside navigation, footers, sidebars, adverts, notices or comments, told by element, role
or class and id (see MARKS), are boilerplate; such inline elements are left out of the block around them.  Class and id don't
decide a wrapper that holds the page's article, or most of the prose of a page without one: it is a layout, not a part of it.

First pass, over the other blocks: density of links, length and density of stop words decide a block as good or bad, or
leave it ambiguous (short, or prose without enough evidence).  An article or main element is one feature among these: inside
of it links weigh less, and outside of it, on a page that has one, a block must be longer.  On pages in none of the languages of STOP
length alone counts; where no block is decided as good, shorter prose is enough, and at last the longest block (of three words).

Second pass: an ambiguous block inherits the label of its nearest decided neighbour.  Near is first what stands in the same
element: the least element around the block that holds decided ones (on its side of an article's edge) is searched before and
behind the block, first among its own blocks and those of the elements directly in it, then among all.  Of two neighbours with different labels the
one with fewer blocks between counts; in a tie, prose is good.  Where there is none, the page's edge is a bad
neighbour and an article's edge a good one.  A heading follows the block it heads.

The result joins the good blocks in page order by line feeds; character references are decoded, runs of white space
inside a block become one blank.

Edge cases: null and empty pages give the empty text; unclosed, stray and truncated tags are tolerated; a quote that is never closed is
read as any character; a lone ``<`` is text.  Time is in proportion to the page's length.
"""

from __future__ import annotations

import html
import re
from bisect import bisect
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_columns, read

# Parameters of the rules: characters of a short and of a long block, and of a long one outside of the page's articles; densities of
# links (outside and inside of an article) and of stop words; the least density of stop words of a page in a listed language; the least
# words of a block that is a page's only prose.
SHORT, LONG, FAR, LINKS, LINKS_INSIDE, STOPS_LOW, STOPS_HIGH, LISTED, WORDS = 60, 180, 600, 0.35, 0.7, 0.12, 0.25, 0.04, 3

BLOCK = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr "
    "html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select head".split())
BOILER = frozenset("nav footer aside form button dialog menu search fieldset label".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id attributes that mark boilerplate, alone or together with one another or with words of PLAIN: a class
#: or id as a whole must consist of them, so that cookie-notice and share-buttons are marked, social-history and with-sidebar aren't.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted promotion banner cookie cookies consent gdpr notice notices notification "
    "notifications alert alerts popup modal overlay newsletter subscribe subscription signup login sidebar aside menu menus navbar nav navigation breadcrumb breadcrumbs pagination pager footer masthead share "
    "sharing social related recommended comment comments disqus reply replies respond toolbar widget widgets skip".split()
)
PLAIN = frozenset(
    "area article articles bar block body bottom box button buttons col column container content entry footer form global google group head header holder icons inline inner item items left link links list main "
    "media more news panel policy post posts primary privacy right secondary section site slot stories story text this title tools top unit user wrap wrapper x".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
STOP = frozenset(
    # English, French, German, Spanish: the most frequent function words.
    "the of and to in is that it for was on are as with be this by at from or an not have but which he his they you we "
    "le la les de des du un une et est en que qui dans pour par sur pas au avec ne ce il elle se plus "
    "der die das und ist von zu den mit nicht ein eine sich auf für dem im auch als an er es wird bei "
    "el los las que y en un una por con para del se es no lo su al como más".split()
)

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+"""
#: What stands between a tag's name and its end.
_REST = re.compile(rf"(?:[\s/]++|{_ATTRIBUTE})*+>")
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_TELLING = re.compile(r"(?i)class|id|role|hidden|style")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NONE = re.compile(r"display\s*:\s*none")


@dataclass
class Block:
    text: str
    tag: str
    linked: int
    article: int  # number of the article it is in, 0 outside
    bad: bool
    label: str = ""
    element: int = 0  # number of the block-level element it is in


@dataclass
class Page:
    """The blocks of a page; of each block-level element its parent (-1 for the page itself) and the article it is in."""

    blocks: list[Block]
    parents: list[int]
    articles: list[int]
    layouts: frozenset[int]


def _marked(attributes: str) -> str:
    """What an element's attributes tell: 'hard' (a role, hidden content), 'soft' (class and id) or nothing."""
    if not _TELLING.search(attributes):
        return ""
    soft = ""
    for name, value in _ATTRIBUTES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "role" and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _NONE.search(value.lower()):
            return "hard"
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in _WORD.findall(token)]
                if not MARKS.isdisjoint(words) and all(w in MARKS or w in PLAIN for w in words):
                    soft = "soft"
    return soft


def blocks(page: str) -> Page:
    found = _blocks(page, frozenset())
    return _blocks(page, found.layouts) if found.layouts else found


def _blocks(page: str, layouts: frozenset[int]) -> Page:
    """The blocks, where some marked elements (by number) are layouts; and which ones are, told from this reading."""
    found: list[Block] = []
    parts: list[str] = []
    parents, of_article = [-1], [0]
    linked = at = articles = breaks = 0
    # Open elements: name, whether it is boilerplate by itself, the article and block-level element around it, its share in the sums below.
    stack: list[tuple[str, bool, int, int, str, tuple]] = []
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()  # elements of RAW whose end isn't on the rest of the page
    bad = mute = inside = links = element = 0
    # Marked wrappers: their number, prose and articles so far; open ones of hard boilerplate; the prose outside of all marks.
    marks = prose = articled = clean = hard = within = 0
    wrappers: list[tuple[int, int, int]] = []
    tag = "body"

    def flush() -> None:
        nonlocal linked, prose, articled, clean
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                size = 0 if hard else max(0, len(text) - linked)
                prose += size
                articled += size if within else 0
                clean += size if not bad else 0
                found.append(Block(text, tag, linked, inside, bad > 0, "", element))
            parts.clear()
        linked = 0

    def pop() -> str:
        nonlocal bad, mute, inside, links, hard, within, element, tag
        name, was, inside, element, tag, (number, prose_before, articled_before, was_hard, was_article, was_mute) = stack.pop()
        if number:
            wrappers.append((number, prose - prose_before, articled - articled_before))
        opened[name] -= 1
        hard -= was_hard
        within -= was_article
        bad -= was
        mute -= was_mute
        links -= name == "a"
        return name

    n = len(page)
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at and not mute:
            piece = html.unescape(page[at:start])
            parts.append(piece)
            if links:
                linked += len("".join(piece.split()))
            if breaks and not piece.isspace():
                breaks = 0
        if start == n:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        named = _NAME.match(page, start + 1)
        if not named:
            if not mute:
                parts.append("<")
            at = start + 1
            continue
        name, closing = named[1].lower(), page[start + 1] == "/"
        rest = _REST.match(page, named.end())
        if not rest:
            break  # the page ends inside a tag
        at = rest.end()
        end = at - 1
        if name in RAW:
            if not closing and page[end - 1] != "/":
                shut = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                if shut:
                    at = page.find(">", shut.end())
                    at = n if at < 0 else at + 1
                elif name == "head":
                    if name not in unclosed:
                        body = re.compile(r"<body(?=[\s>])", re.I).search(page, at)
                        at = body.start() if body else at
                    unclosed.add(name)
                else:
                    at = n
            continue
        if name == "br":
            breaks += 1
            parts.append(" ")
            if breaks == 2:
                flush()
            continue
        is_block = name in BLOCK
        if is_block:
            flush()
            breaks = 0
        if name in VOID:
            continue
        if closing:
            if opened[name]:
                while pop() != name:
                    pass
            continue
        if is_block and stack and stack[-1][0] == "p" or name in ("li", "a") and stack and stack[-1][0] == name:
            pop()  # a paragraph ends where a block begins, an item or a link where the next one does
        marked = _marked(page[named.end() : end]) if end > named.end() else ""
        own = bool(name in BOILER or marked)
        soft = marked == "soft" and name not in BOILER
        if name in ("html", "body", "article", "main") and not inside:
            own = False  # whole pages and main articles are often classed by layout
        if name == "header" and not inside:
            own, soft = True, False
        soft = soft and own and not within and is_block
        if soft:
            marks += 1
            own = marks not in layouts
        if is_block or own or name == "a" or opened[name]:
            if page[end - 1] == "/" and not is_block:
                continue
            was_hard, main = own and not soft and marked != "soft" or own and name in BOILER, name in ("article", "main") and not marked
            was_mute = own and not is_block
            if was_mute:
                parts.append(" ")
            stack.append((name, own and is_block, inside, element, tag, (marks if soft else 0, prose, articled, was_hard, main, was_mute)))
            opened[name] += 1
            hard += was_hard
            within += main
            bad += own and is_block
            mute += was_mute
            links += name == "a"
            if name in ("article", "main") and not inside and not bad:
                articles += 1
                inside = articles
            if is_block and name not in ("html", "body"):
                parents.append(element)
                of_article.append(inside)
                element, tag = len(parents) - 1, name
    flush()
    while stack:
        pop()
    chosen: frozenset[int] = frozenset()
    if not articles:
        # An article inside of a wrapper is the page's if there is not more prose outside of all marks.
        chosen = frozenset(n for n, p, a in wrappers if (a and articled >= clean) or 2 * p > prose and p >= LONG)
    return Page(found, parents, of_article, chosen)


def stops(text: str) -> float:
    """Density of stop words."""
    words = [w.strip(".,;:!?()\"'«»%$&#*|").lower() for w in text.split()]
    return sum(w in STOP for w in words) / max(1, len(words))


def first_pass(block: Block, articles: bool = False, listed: bool = True, long: int = LONG) -> str:
    """good, bad, or empty if it is ambiguous. articles: the page has some; listed: it is in a language of STOP; long: characters of a long block."""
    if block.bad:
        return "bad"
    size, letters = len(block.text), len("".join(block.text.split()))
    links = min(1.0, block.linked / letters)
    if links > (LINKS_INSIDE if block.article and block.tag != "li" else LINKS):
        return "bad"
    if not block.article and ("©" in block.text or "copyright" in block.text.lower()) and size < LONG:
        return "bad"
    if block.tag in HEADINGS or size < SHORT:
        return "bad" if links and not block.article else ""
    least = max(long, FAR) if articles and not block.article else long
    return "good" if size >= least and (not listed or stops(block.text) >= (STOPS_HIGH if long >= LONG else STOPS_LOW)) else ""


def classify(page: Page) -> None:
    """The first pass over a page: labels for the decided blocks."""
    own = [b for b in page.blocks if not b.bad]
    articles = any(b.article for b in own)
    long = [b for b in own if len(b.text) >= SHORT]
    listed = not long or sum(stops(b.text) * len(b.text) for b in long) >= LISTED * sum(len(b.text) for b in long)
    for enough in (LONG, SHORT):
        for b in page.blocks:
            b.label = first_pass(b, articles, listed, enough)
        if articles or any(b.label == "good" for b in own):
            return
    rest = [b for b in own if not b.label and b.tag not in HEADINGS and len(b.text.split()) >= WORDS]
    if rest:
        max(rest, key=lambda b: len(b.text)).label = "good"


def second_pass(found: list[Block], parents: list[int] | None = None, articles: list[int] | None = None) -> None:
    """Labels for the ambiguous blocks from their nearest decided neighbours."""
    parents, articles = parents or [-1], articles or [0]
    blocks = [b for b in found if not b.bad]  # boilerplate elements don't speak for the text around them
    n, count = len(blocks), len(parents)
    top = [p < 0 or articles[p] != articles[e] for e, p in enumerate(parents)]
    low, high, holds = [n] * count, [-1] * count, [False] * count
    for i, b in enumerate(blocks):
        low[b.element], high[b.element] = min(low[b.element], i), max(high[b.element], i)
        holds[b.element] |= bool(b.label)
    for e in range(count - 1, 0, -1):
        p = parents[e]
        low[p], high[p] = min(low[p], low[e]), max(high[p], high[e])
        holds[p] |= holds[e] and not top[e]
    around = list(range(count))  # the least element around each one that holds decided blocks of its side, or its outermost
    for e in range(1, count):
        around[e] = e if holds[e] or top[e] else around[parents[e]]
    direct: dict[int, list[int]] = {}  # decided blocks of an element itself and of the elements directly in it
    for i, b in enumerate(blocks):
        if b.label:
            for e in {b.element, max(0, parents[b.element])}:
                if articles[e] == b.article:
                    direct.setdefault(e, []).append(i)
    before, last = [-1] * n, {}
    for i, b in enumerate(blocks):
        before[i] = last.get(b.article, -1)
        if b.label:
            last[b.article] = i
    last, behind = {}, {}  # the next decided block and the next block, by article
    given: list[str] = [b.label for b in blocks]
    marked = [False] * (n + 1)  # whether boilerplate follows block i directly
    i = 0
    for b in found:
        if b.bad:
            marked[i] = True
        else:
            i += 1
    for i in range(n - 1, -1, -1):
        b = blocks[i]
        if not given[i]:
            next_ = last.get(b.article, n)
            if b.tag in HEADINGS:
                b.label = behind[b.article] if b.article in behind else "good" if b.article and not marked[i + 1] else "bad"
            else:
                e = around[b.element]
                siblings = direct.get(e, [])
                k = bisect(siblings, i)
                near = [*siblings[max(0, k - 1) : k], *siblings[k : k + 1]] or [j for j in (before[i], next_) if low[e] <= j <= high[e]]
                b.label = ("good" if b.article else "bad") if top[e] and not siblings else _inherited(b, [(abs(i - j), given[j]) for j in near], top[e])
        else:
            last[b.article] = i
        behind[b.article] = b.label


def _inherited(block: Block, near: list[tuple[int, str]], outermost: bool) -> str:
    """The label of the nearest of one or two decided neighbours (distance, label)."""
    if len({label for _, label in near}) == 1 or near[0][0] != near[1][0]:
        return min(near)[1]
    prose = len(block.text) >= SHORT and stops(block.text) >= STOPS_LOW or not outermost and block.text[-1] in ".!?…"
    return "good" if prose or block.article else "bad"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    classify(found)
    second_pass(found.blocks, found.parents, found.articles)
    return "\n".join(b.text for b in found.blocks if b.label == "good")


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text (empty if there is none), n_chars."""

    def make():
        def work(keys, urls, pages):
            texts = [main_text(p) for p in pages]
            return keys, urls, texts, [len(t) for t in texts]

        return work

    kinds = dict(df.dtypes)
    return map_columns(df, [id_col, url_col, html_col], f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long", make)


def query(spark, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
