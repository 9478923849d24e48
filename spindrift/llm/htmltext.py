"""Main text of HTML pages by two-pass block rules.

A page is walked tag by tag into blocks: runs of text between block-level tags, each with its length, its share of stop
words, its share of characters in links, and whether a container above it declares it boilerplate (navigation, header,
footer, sidebar, notice, advert, form, comments, script, style) or article.

Pass 1 classifies each block by itself. Declared boilerplate and blocks of links are bad. Long blocks rich in stop words
are good, long ones poor in them bad, and short ones are left open; short paragraphs in a row are judged together. Where
a page marks its article, that counts as evidence: what lies outside is bad, and inside fewer stop words are needed.
Where no block of a page has the stop words of a known language, length alone counts. Pass 2 gives each open block the
label of its nearest decided neighbours (declared boilerplate is no neighbour): good where both sides are, or the only
side, or for a heading what follows; an open block of a marked article is bad only between bad ones.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bound_batches, slices

#: A block is short below, and long from, so many code points.
SHORT, LONG = 70, 200
#: Share of stop words from which a block is rich, and at which it is not poor.
RICH, POOR = 0.30, 0.15
#: Share of characters in links above which a block is one of links.
LINKS = 0.5

# HTML's elements by kind, words in class and id names of boilerplate, and frequent words of four languages.
BLOCKS = set("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset
h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td template textarea
tfoot th thead tr ul""".split())
DROPPED = set("script style noscript template svg math iframe object canvas audio video map textarea select option button head title datalist".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes svg math template".split())
BOILERPLATE = set("nav aside footer form dialog menu".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PROSE = {"p", "blockquote", "pre", "dd", *HEADINGS}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|adsense|banner|breadcrumb|breadcrumbs|byline-share|comment|comments|commentlist|consent|cookie|cookies|disqus|disclaimer|gdpr|login|masthead|menu|menubar|modal|nav|navbar|navigation|newsletter|notice|notices|notification|outbrain|overlay|pager|pagination|paywall|popup|promo|promoted|recommended|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|skip-link|social|sponsor|sponsored|subscribe|taboola|toolbar|topbar|warning|widget|widgets)(?:$|[\s_-])"
    r"|sidebar|cookie|advert|newsletter|breadcrumb",
    re.IGNORECASE,
)
#: Names of page parts that are no boilerplate inside an article (its own header or footer).
OUTER = re.compile(r"(?:^|[\s_-])(?:header|footer)(?:$|[\s_-])", re.IGNORECASE)
STOPWORDS = set("""a about after all also an and any are as at be because been but by can could did do does for from had has have he her him his how i
if in into is it its just like me more most my no not of on one only or other our out over said she so some such than that the their them then there
these they this to up was we were what when which who will with would you your
au aux avec ce ces cette comme dans de des du elle elles en est et eux il ils je la le les leur leurs mais ne nous on ou par pas plus pour qu que qui sa se
ses son sont sur un une vous y
aber als am an auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im in ist ja kann man
mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn wie wir wird zu zum zur
al algo como con cuando de del desde donde el ella ellos en entre era es esta este fue ha hay la las lo los más me mi muy no nos o para pero por que se
ser si sin sobre su sus también te tiene todo un una y ya""".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|$)|[!?][^>]*(?:>|$)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$))", re.DOTALL)
_LOOSE = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$))", re.DOTALL)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
_WORDS = re.compile(r"\w+")


class Block(NamedTuple):
    text: str
    tag: str
    links: float
    dropped: bool
    article: bool


def _declared(tag: str, attributes: str, article: bool = False) -> bool:
    """Whether an element (in an article) says of itself that it is boilerplate."""
    if tag in BOILERPLATE or tag in DROPPED:
        return True
    for m in _NAMES.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES or name in ("class", "id") and (NAMED.search(value) or not article and OUTER.search(value)):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    out: list[Block] = []
    # of each block: declared elements open when its article began, and declared articles it is in
    around: list[tuple[tuple[int, ...], tuple[int, ...]]] = []
    texts: list[str] = []
    linked: list[str] = []
    # open elements that matter: name, dropped, article, number, whether declared, elements around
    stack: list[tuple[str, bool, bool, int, bool, tuple[tuple[int, ...], tuple[int, ...]]]] = []
    # by name, where in the stack its open elements are; so that an end tag costs no look at the others
    places: dict[str, list[int]] = {}
    nothing = ("", False, False, 0, False, ((), ()))
    number = 0
    # elements ended by their own tag, and by name the first that never was
    ended: dict[int, str] = {}
    loose: dict[str, int] = {}
    link = 0

    def push(element) -> None:
        places.setdefault(element[0], []).append(len(stack))
        stack.append(element)

    def pop() -> tuple:
        places[stack[-1][0]].pop()
        return stack.pop()

    def close() -> None:
        text = " ".join(html.unescape("".join(texts)).split())
        if text:
            inside = len(" ".join(html.unescape("".join(linked)).split()))
            tag, dropped, article, _, _, outer = stack[-1] if stack else nothing
            out.append(Block(text, tag, min(1.0, inside / len(text)), dropped, article))
            around.append(outer)
        texts.clear()
        linked.clear()

    at = 0
    while True:
        start = page.find("<", at)
        text = page[at : start if start >= 0 else len(page)]
        if text:
            texts.append(text)
            if link:
                linked.append(text)
        if start < 0:
            break
        m = _TAG.match(page, start) or _LOOSE.match(page, start)
        if not m:  # a bare "<"
            texts.append("<")
            at = start + 1
            continue
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        ends = bool(m[1])
        if tag == "a":
            link = 0 if ends else 1
            if not ends and not _declared(tag, m[3]):
                continue
            if ends and not places.get("a"):
                continue
        if tag in VOID and tag != "hr":
            if tag == "br":
                texts.append(" ")
            continue
        if not ends and tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|$)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            texts.append(" " if tag not in BLOCKS else "")
            continue
        if tag not in BLOCKS and tag not in DROPPED:
            marked = not ends and _declared(tag, m[3]) and not m[3].rstrip().endswith("/")
            if marked or ends and places.get(tag):
                close()
            else:
                continue
        close()
        if ends:
            # an inner element can't end a section around it
            section = max((places[x][-1] for x in ("article", "main", "body") if places.get(x)), default=-1)
            if places.get(tag) and (tag in ("body", "html", "main") or places[tag][-1] >= section):
                k = places[tag][-1]
                ended[stack[k][3]] = tag
                while len(stack) > k + 1:
                    x = pop()
                    loose[x[0]] = min(x[3], loose.get(x[0], x[3]))
                pop()
            link = 0
            continue
        if tag in ("hr", "html") or m[3].rstrip().endswith("/"):
            continue
        # what a start tag ends by itself
        if stack and stack[-1][0] in {"p", *HEADINGS} or stack and tag == stack[-1][0] and tag in ("li", "dt", "dd", "td", "th", "tr", "option"):
            pop()
        _, dropped, article, _, _, (before, within) = stack[-1] if stack else nothing
        number += 1
        if tag == "body":
            stack.clear()
            places.clear()
            dropped = article = False
            before = within = ()
        if tag in ("article", "main") and not article:  # what is left open before the article doesn't reach into it
            dropped = any(x[0] in ("dialog", "template", "aside") for x in stack)
            before = tuple(x[3] for x in stack if x[4])
            article = True
        named = _declared(tag, m[3], article)
        if tag in ("article", "main") and named:
            within = (*within, number)
        # the heading part of an article belongs to it; a header elsewhere doesn't
        own = named and tag not in ("body", "article", "main") or tag == "header" and not article
        push((tag, dropped or own, article, number, own, (before, within)))
    close()
    for x in stack:
        loose[x[0]] = min(x[3], loose.get(x[0], x[3]))
    # an element encloses the article if its own end follows, which is no outer one's of the same name
    real = {x for x, tag in ended.items() if loose.get(tag, x) >= x}
    out = [b._replace(dropped=b.dropped or not real.isdisjoint(before)) for b, (before, _) in zip(out, around, strict=True)]
    # an article that declares itself boilerplate is, where the page has article text beside it
    if sum(len(b.text) for b, (_, within) in zip(out, around, strict=True) if b.article and not b.dropped and not within) >= SHORT:
        out = [b._replace(dropped=b.dropped or bool(within)) for b, (_, within) in zip(out, around, strict=True)]
    return out


def density(text: str) -> float:
    """Share of stop words."""
    words = _WORDS.findall(text.lower())
    return sum(w in STOPWORDS for w in words) / max(1, len(words))


def first_pass(found: list[Block]) -> list[bool | None]:
    """Good, bad or open: each block by itself, short paragraphs in a row together."""
    marked = any(b.article and not b.dropped for b in found)
    shares = [0.0 if b.dropped else density(b.text) for b in found]
    known = any(x >= POOR and len(b.text) >= SHORT for x, b in zip(shares, found, strict=True))

    def judge(length: int, share: float, article: bool) -> bool | None:
        if article:
            return True if length >= LONG or length >= SHORT and share >= POOR else None
        if length < SHORT:
            return None
        if not known:
            return True if length >= LONG else None
        if share >= RICH or share >= POOR and length >= LONG:
            return True
        return False if share < POOR and length >= LONG else None

    labels: list[bool | None] = []
    for b, share in zip(found, shares, strict=True):
        if b.dropped or marked and not b.article or b.links > LINKS and (not b.article or b.tag in ("li", "td", "ul", "ol", "div", "article")):
            labels.append(False)
        else:
            labels.append(judge(len(b.text), share, b.article))
    # short paragraphs in a row
    run: list[int] = []
    for i in range(len(found) + 1):
        if i < len(found) and labels[i] is None and found[i].tag in PROSE:
            run.append(i)
            continue
        if len(run) > 1:
            text = " ".join(found[k].text for k in run)
            if len(text) >= LONG and judge(len(text), density(text), found[run[0]].article):
                for k in run:
                    labels[k] = True
        run = []
    return labels


def classify(found: list[Block]) -> list[bool]:
    """Which blocks are main text."""
    marked = any(b.article and not b.dropped for b in found)
    labels = first_pass(found)
    neighbour = [not b.dropped and (b.article or not marked) for b in found]
    before: list[bool | None] = []
    last: bool | None = None
    for x, counts in zip(labels, neighbour, strict=True):
        before.append(last)
        last = x if counts and x is not None else last
    out, ahead = [False] * len(labels), None
    for i in range(len(labels) - 1, -1, -1):
        x = labels[i]
        if x is None:
            sides = [s for s in (before[i], ahead) if s is not None]
            if found[i].article:
                x = len(sides) < 2 or any(sides)
            else:
                x = all(sides) if sides else found[i].tag in PROSE  # (a page of short paragraphs alone)
                x = x or found[i].tag in HEADINGS and bool(ahead)
        elif neighbour[i]:
            ahead = x
        out[i] = bool(x)
    return out


def main_text(page: str | None) -> str:
    """Main text of a page; empty for null, for empty pages and for those without any."""
    found = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(found, classify(found), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    pages needs page_id, url and html; other columns are ignored. Null html is empty, null ids and urls are kept,
    repeated rows stay, an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html", 4 << 20):
            texts = [main_text(page) for page in part.column("html").to_pylist()]
            columns = [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    bound_batches(pages.sparkSession)
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
