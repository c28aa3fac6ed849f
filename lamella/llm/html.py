"""Main text of web pages by two passes of block rules."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

from pyspark.sql import DataFrame

from lamella.llm.graph import bounded_batches

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can do for from had has have he her his how i if in is it its more my no not of on one or our out she so "
    "than that the their them then there they this to up was we were what when which who will with would you your "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die du durch ein eine einem einen einer er es für hat ich ihr im in ist ja "
    "man mit nach nicht noch nur oder sich sie sind so um und uns vom von vor war was wenn wie wir zu zum zur über "
    "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais me même ne nous on ou où par pas plus pour qu que qui "
    "sa se ses si son sont sur te un une vous "
    "al como con cuando de del desde donde el ella en entre era es esta este ha hay la las le lo los más me mi muy no o para pero por que se ser si "
    "sin sobre son su sus también un una y ya".split()
)
#: Lengths in characters under which a block is ambiguous, and over which one with stop words is main text.
SHORT, LONG = 70, 200
#: Shares of stop words, and of characters in links.
STOP_LOW, STOP_HIGH, LINKS = 0.15, 0.3, 0.33

# Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg canvas select".split())
FOREIGN = frozenset("svg".split())
SCRIPTS = frozenset("script style".split())
#: Elements that hold a page or its article, whose class and id say nothing against their text.
WHOLE = frozenset("html body main article".split())
BOILER = frozenset("nav footer aside form menu dialog button".split())
MAIN = frozenset("article main".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html "
    "legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = frozenset("navigation banner contentinfo search complementary dialog alert alertdialog menu menubar toolbar form".split())
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|overlay|newsletter|subscribe|subscription|sidebar|side-?(?:nav|menu|box|panel)|widget\w*|"
    r"nav|navbar|navigation|menu|breadcrumbs?|social|share|sharing|related|recommend\w*|comments?|commentlist|reply|replies|disqus|respond|login|signin|signup|search|"
    r"pagination|pager|copyright|toolbar|skip|tags|teaser|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
# Inside an article a name must be one of these by itself or beside words of page layout; words of prose say nothing.
#: What holds text of others, whatever it reads like.
STRONG = re.compile(r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|gdpr|popup|modal|newsletter|subscribe|subscription|sidebar|widget\w*|comments?|commentlist|disqus|outbrain|taboola", re.I)
#: What holds text of others unless it reads like main text.
WEAK = re.compile(r"banner|consent|notice|overlay|nav|navbar|navigation|menu|breadcrumbs?|social|share|sharing|related|recommend\w*|reply|replies|respond|login|signin|signup|search|pagination|pager|copyright|toolbar|skip|tags|teaser", re.I)
LAYOUT = frozenset("area bar block body bottom box button buttons content container entry form footer group header icons id inline inner item items js left link links list main meta module more panel post posts right row section side site slot text the thread title top unit wrap wrapper".split())
#: Elements of running text, whose own names do not put them aside inside an article.
TEXT = frozenset("a abbr b blockquote cite code dd dt em figcaption font h1 h2 h3 h4 h5 h6 i li p pre q small span strong sub sup td th u".split())
PARAGRAPHS = frozenset("p blockquote dd".split())
EDGES = re.compile(r"(?:^|[\s_-])(?:header|footer|masthead|topbar|bottom)(?:$|[\s_-])", re.I)
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[=\"'])*)(?:>|\Z|(?=<))", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    boiler: bool  # inside an element that is never main text
    main: int  # number of the article or main element around it, 0 if none
    heading: bool
    hint: bool = False  # inside an element of an article whose name speaks against it
    para: bool = False  # of a paragraph
    label: str = ""


@dataclass
class _Open:
    name: str
    boiler: bool
    main: int
    link: bool
    heading: bool
    place: int = -1
    hint: bool = False


@dataclass
class _Page:
    blocks: list[Block] = field(default_factory=list)
    parts: list[tuple[str, bool]] = field(default_factory=list)
    mains: int = 0


def blocks(html: str, holders: frozenset[int] = frozenset()) -> list[Block]:
    """Blocks of a page in page order. Takes any text: unclosed, crossing and unknown elements are allowed.

    Elements at ``holders`` hold the page's only article, so that their class and id are passed over.
    """
    page, stack = _Page(), [_Open("", False, 0, False, False)]

    def flush():
        text = " ".join("".join(t for t, _ in page.parts).split())
        if text:
            linked = sum(len("".join(t.split())) for t, link in page.parts if link)
            top = stack[-1]
            around = next((o.name for o in reversed(stack) if o.name in BLOCK or not o.name), "")
            page.blocks.append(Block(text, linked, top.boiler, top.main, top.heading, top.hint, around in PARAGRAPHS))
        page.parts = []

    def add(text: str):
        if text:
            page.parts.append((unescape(text) if "&" in text else text, stack[-1].link))

    at, n, unclosed, articles = 0, len(html), set(), {}
    open_ = Counter()  # elements on the stack by name
    while at < n:
        start = html.find("<", at)
        if start < 0:
            add(html[at:])
            break
        m = MARKUP.match(html, start)
        add(html[at : start if m else start + 1])
        if not m:
            at = start + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name in BLOCK:
            flush()
        elif name == "br":
            add(" ")
        if m[1]:
            while open_[name]:
                closed = stack.pop().name
                open_[closed] -= 1
                if closed == name:
                    break
        elif name in RAW:
            # svg may close itself. Without a closing tag, script and style hide the rest as in a browser; of
            # others only the tag goes.
            if not (name in FOREIGN and m[3].endswith("/")):
                if name not in unclosed:
                    end = re.compile(rf"</{name}\s*>", re.I).search(html, at)
                    if end:
                        at = end.end()
                    elif name in SCRIPTS:
                        at = n
                    else:
                        unclosed.add(name)
        elif name not in VOID and not m[3].endswith("/"):
            if name in BLOCK:
                while len(stack) > 1 and stack[-1].name in ("p", "head", "a", "b", "i", "em", "strong", "span", "font") and open_["p"] + open_["head"]:
                    open_[stack.pop().name] -= 1
            top = stack[-1]
            boiler = top.boiler or name in BOILER or (name in ("header", "head") and not top.main)
            hint = top.hint
            if m[3] and not boiler:
                boiler = _hinted(m[3], False)
                if name not in WHOLE and start not in holders and not boiler:
                    if not top.main:
                        boiler = _hinted(m[3], True)
                    elif name not in TEXT:
                        against = _named(m[3])
                        boiler, hint = against == "strong", hint or against == "weak"
            if name in MAIN:
                articles[name] = None if name in articles else [s.place for s in stack]
            main = top.main
            if name in MAIN and not boiler and not main:
                page.mains += 1
                main = page.mains
            open_[name] += 1
            stack.append(_Open(name, boiler, main, top.link or name == "a", top.heading or name in ("h1", "h2", "h3", "h4", "h5", "h6"), start, hint))
    flush()
    around = articles.get("main") or articles.get("article")
    if not page.mains and around and not holders:
        again = blocks(html, frozenset(around))
        if any(b.main for b in again):
            return again
    return page.blocks


def _hinted(attributes: str, names: bool) -> bool:
    """Does its class or id (``names``), or else its role or being hidden, say that an element is no main text?"""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if (name in ("class", "id")) != names:
            continue
        if name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden":
            if name == "hidden" or value.lower() == "true":
                return True
        elif HINTS.search(value) or EDGES.search(value):
            return True
    return False


def _named(attributes: str) -> str:
    """"strong" or "weak" if a class or id of an element inside an article is made of words of page layout and speaks against its text."""
    found = ""
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() not in ("class", "id"):
            continue
        for value in (m[2] or m[3] or m[4] or "").split():
            words = [w for w in re.split(r"[-_]+", value.lower()) if w]
            strong = [bool(STRONG.fullmatch(w)) for w in words]
            weak = [bool(WEAK.fullmatch(w)) for w in words]
            if all(a or b or w in LAYOUT or w.isdigit() for a, b, w in zip(strong, weak, words, strict=True)):
                found = "strong" if any(strong) else found or ("weak" if any(weak) else "")
        if found == "strong":
            break
    return found


def classify(found: list[Block]) -> None:
    """Labels every block "good" or "bad".

    First each block by itself: elements that are never main text and link-heavy blocks are bad, the rest go by length
    and stop words. Inside an article or main element length, stop words and links decide: fewer stop words are needed,
    paragraphs stay if they are short without links or hold stop words beside them, and what a name speaks against stays if
    it is as long and as dense as main text. Others that are short stay ambiguous, as do blocks of an article without stop
    words (tables, code). Then an ambiguous block takes the label of its nearest decided neighbours (of its own article if it
    is in one, where a long one stays even between link lists); where they differ, blocks with stop words and headings before
    main text are good. Where none is decided, blocks of an article are good, and so are all ambiguous blocks of a page
    without one.
    """
    for b in found:
        share = b.linked / max(1, len(b.text))
        stops = 0.0
        if not b.boiler and (b.main or len(b.text) >= SHORT):
            words = re.findall(r"\w+", b.text.lower())
            stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
        if b.boiler:
            b.label = "bad"
        elif share > LINKS:
            beside = b.linked < len(b.text.replace(" ", ""))
            b.label = "near" if b.main and b.para and not b.hint and beside and stops >= STOP_LOW else "bad"
        elif len(b.text) < SHORT:
            b.label = "bad" if b.hint else "near" if b.main and b.para and not b.linked else "short"
        elif b.hint:
            b.label = "good" if stops >= STOP_LOW else "bad"
        elif b.main:
            b.label = "good" if stops >= STOP_LOW else "near"
        else:
            b.label = "good" if stops >= STOP_HIGH and len(b.text) > LONG else "near" if stops >= STOP_LOW else "bad"
    first, has_main = [b.label for b in found], any(b.main for b in found)
    for main in {b.main for b in found}:
        # An article's blocks only look at each other, and blocks that were put aside by their element are no neighbours.
        own = [i for i, b in enumerate(found) if b.main == main and not b.boiler]
        before, last = {}, None
        for i in own:
            before[i] = last
            if first[i] in ("good", "bad"):
                last = first[i]
        after, last = {}, None
        for i in reversed(own):
            after[i] = last
            if first[i] in ("good", "bad"):
                last = first[i]
        for i in own:
            if first[i] in ("good", "bad"):
                continue
            near = {x for x in (before[i], after[i]) if x}
            if near == {"good"} or (not near and (main or not has_main)) or (main and first[i] == "near"):
                found[i].label = "good"
            elif near == {"good", "bad"} and (first[i] == "near" or (found[i].heading and after[i] == "good") or main):
                found[i].label = "good"
            else:
                found[i].label = "bad" if near or first[i] == "short" else "good"


def main_text(html: str | None) -> str:
    """Main text of a page: its good blocks, one a line. Empty for null, and where a page has none."""
    found = blocks(html or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of ``pages`` (page_id, url, html), from the whole html."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(h) for h in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return bounded_batches(pages.select("page_id", "url", "html")).mapInArrow(run, "page_id long, url string, text string")
