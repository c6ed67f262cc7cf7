"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. The first pass judges a block by itself: where it
stands (containers of navigation, adverts, forms, notices, comments and the like are boilerplate),
its link density, its length, its stop-word density, and whether it begins as a call or a notice does.
Blocks that stay open (short ones, some with few stop words, paragraphs of links) inherit in the
second pass the label of the nearest decided neighbours: good when both sides are good, or, between a
good and a bad one, the label of the nearer; a paragraph of links only if both sides are good. Inside
an <article> or <main> element neighbours are looked for in that element alone, past containers of
boilerplate, and a block without any decided neighbour is good; what stands beside them is boilerplate.

A class or an id is weaker than an element: a container marked by one alone is boilerplate unless it holds an
article, or over half of the running text of its article or, outside articles, of the page (comments and
replies keep their mark). Parts of names that tell a state (has-sidebar, no-comments, menu-open) mark nothing.
Where the page's longer blocks hold hardly any known stop words, its language is unknown, and length and link
density decide alone; characters of scripts without spaces count twice.

Markup that isn't closed never hides the rest of a page, but for scripts, styles and comments: an
unclosed title, noscript, textarea, iframe or the like counts as if its tag weren't there, and a quote
that stays open in a tag ends with that tag.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_LINK_DENSITY = 0.4
STOP_LOW, STOP_HIGH = 0.2, 0.3
LENGTH_LOW, LENGTH_HIGH = 70, 200

# Names of HTML elements.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
BOILERPLATE = frozenset("head nav footer aside form menu button select dialog template svg math object canvas audio video map datalist figcaption".split()) - {"figcaption"}
#: Words of a class or an id that mark boilerplate, as whole parts between -, _ and spaces.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs"
    " sidebar side widget footer header masthead topbar comment comments commentlist reply replies respond disqus discussion cookie cookies consent gdpr"
    " notice notices alert popup modal overlay newsletter subscribe subscription signup login related recommended share sharing social pagination pager"
    " tags toolbar copyright legal disclaimer skip hidden".split()
)
#: Marks that stay even where their container holds most of a page's text.
READERS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
#: Beginnings and ends of names that tell a state or a manner, and names that mark by themselves alone.
STATES = frozenset("has no with without is not hide show".split())
ENDINGS = frozenset("open opened closed active enabled disabled visible on off".split())
ALONE = frozenset("hidden side legal notice notices tags skip share related".split())
#: What may stand beside a name of ALONE: words for a container.
BESIDE = frozenset("box bar block list links link panel widget section container wrapper wrap area nav menu posts articles stories text buttons button left right bottom top column col inner outer content-list site page post entry".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

#: Function words of the languages of the corpus.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can did do for from had has have he her his i if in is it its no not of on or our she so than that the their them there they this to was we were what when which who will with you"
    " au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui ma mais me ne nous on ou par pas pour qu que qui sa se ses son sont sur un une vous"
    " als am auf aus bei bin bis das dass dem den der des die ein eine einem einen einer er es für hat ich ihr im ist man mit nach nicht noch nur oder sich sie sind so über um und uns von vor war was wie wir wird zu zum zur"
    " al como con del el ella ellos era es esta este fue ha han hay la las lo los más muy nos o para pero por que se sin su sus también una uno unos y ya".split()
)

#: How short calls and notices begin.
_CALL = re.compile(
    r"(subscribe|sign up|sign in|log in|login|register now|follow us|follow me|share this|share on|tweet this|like us|join our|click here|read more|read also|see also|related|recommended"
    r"|advertisement|sponsored|we use cookies|this (site|website) uses cookies|all rights reserved|copyright|©|leave a (reply|comment)|comments?\b|\d+ comments?\b|newsletter|abonnez|suscr[ií]b|newsletter abonnieren)",
    re.I,
)
#: Elements of running text, whose lines of links may belong to it.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt caption figcaption summary".split())
CLOSED_BY_OWN = frozenset("p li dd dt option tr td th".split())
CODE = ("script", "style")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[\s_\-]+")
_WIDE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")


def _marks(name: str) -> set[str]:
    """The marks in one class or id."""
    parts = [x for x in _PART.split(name) if x]
    if not parts or parts[0] in STATES or parts[-1] in ENDINGS:
        return set()
    found = MARKS.intersection(parts)
    return {x for x in found if x not in ALONE or all(y in ALONE or y in BESIDE or y in MARKS for y in parts) and parts.count(x) == 1}


HARD, SOFT, SOFT_READERS = 1, 2, 3


@functools.lru_cache(maxsize=4096)
def _marked(name: str, attributes: str) -> int:
    """Whether an element is boilerplate: HARD by its element, role or style, SOFT by a class or an id alone, 0 not."""
    if name in BOILERPLATE:
        return HARD
    if not attributes or name in ("body", "html", "article", "main"):
        return 0
    soft: set[str] = set()
    for key, a, b, c in _ATTR.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key in ("class", "id"):
            for x in value.split():
                soft |= _marks(x)
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return HARD
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HARD
    return SOFT_READERS if soft & READERS else SOFT if soft else 0


class Block(NamedTuple):
    text: str
    linked: int  # characters in links
    bad: bool  # stands in a boilerplate container
    article: int  # number of its article; 0: none
    kind: str  # its innermost block-level element
    soft: tuple[int, ...] = ()  # the containers marked by names that it stands in, outermost first


def blocks(page: str) -> list[Block]:
    """Blocks in page order. Linear in the page: an end tag without an open element is never looked for."""
    out: list[Block] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int, str, tuple[int, ...]]] = []  # open elements: name, in boilerplate, article, innermost block, marked containers
    opened: Counter = Counter()
    endless: set[str] = set()  # raw elements without any end tag further on
    articles = 0
    bad, article, kind, soft = False, 0, "", ()
    marks: dict[int, bool] = {}  # of containers marked by names: whether the mark stays whatever they hold

    def close() -> None:
        nonlocal linked
        if text:
            whole = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if whole:
                out.append(Block(whole, linked, bad, article, kind, soft))
            text.clear()
        linked = 0

    def pop(i: int) -> None:
        nonlocal bad, article, kind, soft
        for x in stack[i:]:
            opened[x[0]] -= 1
        del stack[i:]
        _, bad, article, kind, soft = stack[-1] if stack else ("", False, 0, "", ())

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        upto = found.start() if found else n
        if upto > at:
            piece = page[at:upto]
            text.append(piece)
            if opened["a"]:
                linked += len(_SPACE.sub(" ", html.unescape(piece)))
        if not found:
            break
        at = max(found.end(), upto + 1)
        name = found.group(2)
        if not name:
            if page.startswith("<![CDATA[", upto):
                text.append(html.escape(found.group()[9:].removesuffix("]]>"), quote=False))
            continue
        attributes = found.group(3) or ""
        if found.end(3) == n and ">" in attributes:  # a quote that stays open
            at = page.index(">", upto) + 1
            attributes = attributes[: attributes.index(">")]
        name = name.lower()
        if found.group(1):
            if name in BLOCK:
                close()
            if opened[name] > 0:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                if any(x[0] in BLOCK or x[1] or x[4] for x in stack[i:]):
                    close()
                pop(i)
            continue
        if name in RAW and name not in endless:
            if name == "title":
                close()
            ended = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            if ended:
                at = ended.end()
            elif name in CODE:
                at = n
            else:
                endless.add(name)
            continue
        if name in RAW:
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCK:
            close()
            if name in CLOSED_BY_OWN and opened[name] > 0:  # these end an open one of their kind
                i = len(stack) - 1
                while stack[i][0] != name and stack[i][0] not in BLOCK:
                    i -= 1
                if stack[i][0] == name:
                    pop(i)
            if name == "body" and stack and stack[-1][0] == "head":
                pop(len(stack) - 1)
        if name in VOID or attributes.endswith("/") and name in ("svg", "path"):
            continue
        marked = _marked(name, attributes)
        if marked and not bad:
            close()
        if name in ("article", "main") and not bad and (not article or name == "article") and not any(marks[k] for k in soft):
            articles += 1
            article = articles
            soft = ()  # what holds an article is a layout, whatever its name
        bad = bad or marked == HARD
        if marked in (SOFT, SOFT_READERS) and not bad:
            soft = (*soft, len(marks) + 1)
            marks[len(marks) + 1] = marked == SOFT_READERS
        if name in BLOCK:
            kind = name
        opened[name] += 1
        stack.append((name, bad, article, kind, soft))
    close()
    return _weighed(out, marks)


def _weighed(found: list[Block], marks: dict[int, bool]) -> list[Block]:
    """Blocks with what containers marked by names come to: their mark goes if they hold over half of the text, links
    aside, of their article or of what stands outside articles."""
    if not marks:
        return found
    whole: Counter = Counter()
    held: Counter = Counter()
    scope = {}
    for b in found:
        if not b.bad:
            running = max(0, len(b.text) - b.linked)
            whole[b.article] += running
            for k in b.soft:
                held[k] += running
                scope[k] = b.article
    stays = {k for k, readers in marks.items() if readers or 2 * held[k] <= whole[scope.get(k, 0)]}
    return [b._replace(bad=b.bad or not stays.isdisjoint(b.soft)) for b in found]


GOOD, BAD, OPEN, LINKS = 1, -1, 0, 2


def _size(text: str) -> int:
    """Length; characters of scripts without spaces count twice."""
    return len(text) + (0 if text.isascii() else len(_WIDE.findall(text)))


def _density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in STOP_WORDS for w in words) / len(words)


def known_language(found: list[Block]) -> bool:
    """Whether the longer blocks hold stop words that are known; true if there are no such blocks."""
    longer = [b.text for b in found if not b.bad and _size(b.text) >= LENGTH_LOW and b.linked <= MAX_LINK_DENSITY * len(b.text)]
    return not longer or _density(" ".join(longer)) >= STOP_LOW


def judge(block: Block, known: bool = True) -> int:
    """The first pass: a block's label by itself. known: whether stop words can tell."""
    text, linked, bad, article, kind, _ = block
    if bad:
        return BAD
    size, textual = len(text), kind in TEXTUAL
    if linked > MAX_LINK_DENSITY * size:
        return LINKS if article and textual else BAD
    if size < LENGTH_HIGH and not textual and _CALL.match(text) or text.startswith("©"):
        return BAD
    if not known:
        size = _size(text)
    if size < LENGTH_LOW:
        return OPEN
    if not known:
        return GOOD if size >= LENGTH_HIGH or article and textual else OPEN
    density = _density(text)
    if density >= STOP_HIGH or article and size >= LENGTH_HIGH:
        return GOOD
    if density >= STOP_LOW:
        return GOOD if size > LENGTH_HIGH or article and textual else OPEN
    return OPEN if article else BAD


def extract(page: str | None) -> str:
    """Main text of a page; empty for null, empty or pages of boilerplate alone."""
    found = blocks(page) if page else []
    if not found:
        return ""
    known = known_language(found)
    labels = [judge(b, known) for b in found]
    inside = any(b.article and not b.bad for b in found)
    if inside:  # blocks beside the articles are boilerplate
        labels = [x if b.article else BAD for x, b in zip(labels, found)]
    # past the edge of an article nothing is decided, and containers of boilerplate in it don't count
    seen = [i for i, b in enumerate(found) if not inside or b.article and not b.bad]
    sides: list[dict[int, tuple[int, int]]] = [{}, {}]  # nearest decided block before and behind: label, distance
    for order, side in ((seen, sides[0]), (seen[::-1], sides[1])):
        last, group = None, 0
        for k, i in enumerate(order):
            if inside and found[i].article != group:
                last, group = None, found[i].article
            if last is not None:
                side[i] = (labels[order[last]], k - last)
            elif not inside:
                side[i] = (BAD, len(found))
            if labels[i] in (GOOD, BAD):
                last = k
    out = []
    for i, label in enumerate(labels):
        if label in (OPEN, LINKS):
            (a, da), (b, db) = (s.get(i, (None, 0)) for s in sides)
            a, b = (a if a is not None else b), (b if b is not None else a)
            if a is None:  # nothing is decided in its article
                label = GOOD if label == OPEN else BAD
            elif a == b:
                label = a
            else:
                label = BAD if label == LINKS else a if da < db else b if db < da else GOOD
        if label == GOOD:
            out.append(found[i].text)
    return "\n".join(out)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row a row of `pages`; null html gives an empty text.

    Ids may be null or repeat; columns other than page_id, url and html are left out.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [extract(x) for x in part.column(2).to_pylist()]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
