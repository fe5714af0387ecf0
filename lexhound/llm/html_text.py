"""Main text of HTML pages by two passes over their blocks.

The first judges each block by its length, the share of its characters within links and the density of stop words; the
second gives the blocks that this leaves ambiguous the label of their nearest decided neighbour. What the page says of its
containers (elements, roles, names) is a prior: it is overruled where it contradicts where the page's prose is.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements whose content is never text: raw ones run to their end tag, or end of page; the rest are empty if they are never closed.
_RAW = frozenset("script style".split())
_NESTED = frozenset("object template svg math".split())
_SILENT = _RAW | _NESTED | frozenset("title noscript iframe canvas audio video select textarea button".split())
#: A comment, a declaration, or a tag; quoted values may hold ">".
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)",
    re.S,
)
_ENDS = {t: re.compile(rf"<(/?){t}\b(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?(?:>|\Z)", re.I) for t in _SILENT}
#: Tags inside a line of text; any other tag ends a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
#: Elements that need no end tag: the next of the same family ends them, and a paragraph ends before any block.
_OPTIONAL = {t: f for f in (("p",), ("li",), ("dt", "dd"), ("tr",), ("td", "th"), ("option",)) for t in f}
#: Elements that hold no article, and what roles, states and names say the same.
_OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
_ROLE = re.compile(r"\brole\s*=\s*[\"']?(?:navigation|banner|contentinfo|complementary|search|dialog|alert|form|menu)", re.I)
_NAMES = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_OUTSIDE_NAME = re.compile(
    r"(?:^|[\s_-])(?:(?P<apart>comments?|respond|replies|reply|disqus|cookies?|consent|gdpr|notices?|popup|modal|overlay)|ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|"
    r"breadcrumbs?|header|masthead|topbar|footer|foot|side-?bar|aside|widget|related|recommend\w*|share|sharing|social|newsletter|subscribe|signup|login|search|pagination|pager|toc|legal|"
    r"copyright|disclaimer|skip\w*|toolbar)(?:$|[\s_-]|\d)",
    re.I,
)
_ARTICLE_NAME = re.compile(r"(?:^|[\s_-])(?:article|content|main|post|entry|story|body|text)(?:$|[\s_-])", re.I)
_HREF = re.compile(r"\bhref\s*=", re.I)
_SPACE = re.compile(r"[\s\x00]+")
#: A word; of scripts without spaces each character is one.
_WORD = re.compile(r"[฀-๿぀-ヿ㐀-鿿]|[^\W฀-๿぀-ヿ㐀-鿿]+")
_STOPS = frozenset(
    (
        "the of and to a in is it that was for on are with as be this at by have from or had not but what all were when we there can an which their if will each about how up out them then she "
        "many some so these would other into has more her two like him see time could no make than been its who now people my made over did down only way find use may water long little very after "
        "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man "
        "le la les de des du et un une que qui dans en est pour par sur au avec il ne ce pas plus se son sa ses aux ou mais nous vous elle on sont été comme leur "
        "el los las y del se que con una por para como más pero sus su lo al es no entre ya cuando muy sin sobre también me hasta hay donde quien desde todo nos"
    ).split()
)

#: Blocks of fewer characters are short; those beyond LONG need STOPS_LOW of stop words to be good, those between STOPS_HIGH to be near it.
SHORT, LONG = 70, 200
STOPS_LOW, STOPS_HIGH = 0.12, 0.22
MOST_LINKED = 0.35
KNOWN_SHARE = 0.2
#: Words of at most so many letters that a page's own prose repeats so often, and of so many of its words, count as stop words too.
STOP_LETTERS, STOP_TIMES, STOP_SHARE = 4, 4, 0.005
#: Prose within a container of an outside name beyond which share of the page's own overrules the name.
WRAPPER_SHARE = 0.5

GOOD, BAD, NEAR, BRIEF = 1, 0, 2, 3
#: What a container is said to be: an article; neither; outside by element, by a name that may be a wrapper's; an article's own header.
ARTICLE, PLAIN, OUTSIDE, WEAK, TITLE = 1, 0, -1, -2, -3


@dataclass(slots=True)
class Block:
    """A block: its text, the characters of it within links, whether it is a heading, and its innermost container."""

    text: str
    linked: int
    heading: bool
    at: int


@dataclass(slots=True)
class Page:
    """The blocks of a page in order, and its containers: the parent (0: the page itself) and kind of each."""

    blocks: list[Block]
    parents: list[int]
    kinds: list[int]


def _clean(parts: list[str]) -> str:
    return _SPACE.sub(" ", _html.unescape("".join(parts))).strip()


def _kind(tag: str, attrs: str, in_article: bool) -> int:
    if tag == "header" and in_article:
        return TITLE
    if tag == "form":
        return WEAK
    if tag in _OUTSIDE:
        return OUTSIDE
    if attrs and (_ROLE.search(attrs) or _HIDDEN.search(attrs)):
        return OUTSIDE
    if tag in ("article", "main"):
        return ARTICLE
    if not attrs or tag in ("html", "body"):
        return PLAIN
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs))
    if names and (found := _OUTSIDE_NAME.search(names)):
        return OUTSIDE if found.group("apart") else WEAK
    return ARTICLE if names and _ARTICLE_NAME.search(names) else PLAIN


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each silent element of that tag ends, by where its start tag ends; one that is never closed isn't in it."""
    out, open_ = {}, []
    for m in _ENDS[tag].finditer(page):
        if m.group(1):
            if open_:
                out[open_.pop()] = m.end()
                if tag not in _NESTED:
                    open_.clear()
        elif not (m.group().endswith("/>") and tag not in _RAW):
            if tag not in _NESTED and tag not in _RAW:
                open_.clear()  # what another one follows was never closed
            if tag not in _RAW or not open_:
                open_.append(m.end())
    if tag in _RAW and open_:
        out[open_[0]] = len(page)
    return out


def read(page: str) -> Page:
    """The blocks of a page. Links hold until their end, the next link, or the end of the container that they began in."""
    out: list[Block] = []
    parents, kinds = [0], [PLAIN]
    stack: list[tuple[str, int]] = []  # open elements and their containers
    parts: list[str] = []
    linked: list[str] = []
    ends: dict[str, dict[int, int]] = {}
    link = -1  # how many elements were open where the open link began
    heading = False
    articles = at = 0

    def end_block():
        if parts:
            text = _clean(parts)
            if text:
                n = len(text) if len(linked) == len(parts) else len(_clean(linked)) if linked else 0
                out.append(Block(text, n, heading, stack[-1][1] if stack else 0))
            parts.clear()
        linked.clear()

    def close(k: int):
        nonlocal articles, link
        articles -= sum(kinds[c] == ARTICLE for _, c in stack[k:])
        del stack[k:]
        if link > k:
            link = -1

    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue  # within a silent element
        if m.start() > at:
            run = page[at : m.start()]
            parts.append(run)
            if link >= 0:
                linked.append(run)
        at = m.end()
        tag = m.group("tag")
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), bool(m.group("close")), m.group("attrs")
        if tag in _SILENT:
            if not closing:
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                at = ends[tag].get(at, at)
            parts.append(" ")
            if link >= 0:
                linked.append(" ")
            continue
        if tag in _INLINE:
            if tag == "a":
                link = len(stack) if not closing and _HREF.search(attrs) else -1
            elif tag in ("br", "img"):
                parts.append(" ")
                if link >= 0:
                    linked.append(" ")
            continue
        end_block()
        if tag in _HEADINGS:
            heading = not closing
        if tag in _VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if stack and (stack[-1][0] == "p" or tag in _OPTIONAL and stack[-1][0] in _OPTIONAL[tag]):
            close(len(stack) - 1)
        kind = _kind(tag, attrs, articles > 0)
        if (tag in _OPTIONAL or tag in _HEADINGS) and kind >= PLAIN:
            continue  # needs no end, so it isn't followed unless its name puts it outside
        if attrs.rstrip().endswith("/"):
            continue
        parents.append(stack[-1][1] if stack else 0)
        kinds.append(kind)
        stack.append((tag, len(kinds) - 1))
        articles += kind == ARTICLE
    if at < len(page):
        parts.append(page[at:])
        if link >= 0:
            linked.append(page[at:])
    end_block()
    return Page(out, parents, kinds)


def densities(blocks: list[Block]) -> list[float]:
    """The share of stop words of each block: those of the list, and short words that the page's own unlinked prose repeats."""
    words = [[w.lower() for w in _WORD.findall(b.text)] if len(b.text) >= SHORT else [] for b in blocks]
    met = Counter(w for b, ws in zip(blocks, words, strict=True) if b.linked <= MOST_LINKED * len(b.text) for w in ws if len(w) <= STOP_LETTERS and w not in _STOPS)
    least = max(STOP_TIMES, STOP_SHARE * sum(map(len, words)))
    own = {w for w, n in met.items() if n >= least and w.isalpha()}
    return [sum(w in _STOPS or w in own for w in ws) / max(1, len(ws)) for ws in words]


def judge(blocks: list[Block], density: list[float]) -> list[int]:
    """First pass: each block by itself. Linked: BAD. Short: BRIEF. Few stop words: BAD. Else GOOD if it is long, and NEAR or BRIEF by stop words.

    Where less than KNOWN_SHARE of the unlinked text that isn't short reaches the lower bound of stop words, the page is
    in another language or script, or not of sentences, and length alone decides. Where no block is GOOD, NEAR ones are.
    """
    out, poor = [], []
    known = unknown = 0
    for b, share in zip(blocks, density, strict=True):
        n = len(b.text)
        if b.linked > MOST_LINKED * n:
            out.append(BAD)
        elif n < SHORT:
            out.append(BRIEF)
        elif share >= STOPS_LOW:
            known += n
            out.append(GOOD if n > LONG else NEAR if share >= STOPS_HIGH else BRIEF)
        else:
            unknown += n
            poor.append(len(out))
            out.append(BAD)
    if known < KNOWN_SHARE * (known + unknown):
        for k in poor:
            out[k] = GOOD
    return out if GOOD in out else [GOOD if k == NEAR else k for k in out]


def placed(page: Page, kinds: list[int]) -> tuple[list[bool], list[bool]]:
    """Whether each block is outside (in a container that is said to hold no article), and inside (in one of an article).

    Two things overrule what a container is said to be: that it holds more than WRAPPER_SHARE of the page's prose (by the
    first pass), though its name is of an outside, and no article has text beyond it; and that otherwise no unlinked block
    would be left, then the one that holds most.
    """
    said, parents, n = list(page.kinds), page.parents, len(page.kinds)
    own, some = [0] * n, [False] * n
    for b, k in zip(page.blocks, kinds, strict=True):
        some[b.at] |= b.linked <= MOST_LINKED * len(b.text)
        if k in (GOOD, NEAR):
            own[b.at] += len(b.text)
    mass = list(own)
    within = [False] * n
    for c in range(1, n):
        within[c] = within[parents[c]] or said[c] == ARTICLE
    articles = [int(a and b) for a, b in zip(some, within, strict=True)]  # containers with text of articles, at and below each
    for c in range(n - 1, 0, -1):
        mass[parents[c]] += mass[c]
        articles[parents[c]] += articles[c]
    for c in range(1, n):
        if said[c] == WEAK and mass[c] > WRAPPER_SHARE * mass[0] and articles[c] == articles[0]:
            said[c] = PLAIN
    while True:
        outside, inside, left = [False] * n, [False] * n, some[0]
        top = -1  # the outermost outside container with most prose
        for c in range(1, n):
            p = parents[c]
            inside[c] = inside[p] or said[c] == ARTICLE
            outside[c] = outside[p] or said[c] < PLAIN
            if not outside[c]:
                left |= some[c]
            elif not outside[p] and mass[c] and (top < 0 or mass[c] > mass[top]):
                top = c
        if left or top < 0:
            break
        said[top] = PLAIN
    title = [k == TITLE for k in said]
    return [outside[b.at] and not (b.heading and title[b.at]) for b in page.blocks], [inside[b.at] for b in page.blocks]


def classify(page: Page) -> tuple[list[int], list[bool]]:
    """The first pass with the prior: the label of each block, and whether it is inside an article's container.

    Outside: BAD. Inside: what has few stop words is ambiguous (BRIEF) rather than BAD. Where such containers hold most of
    the prose, what is in none and isn't GOOD by itself is ambiguous.
    """
    kinds = judge(page.blocks, densities(page.blocks))
    outside, inside = placed(page, kinds)
    inside = [i and not o for i, o in zip(inside, outside, strict=True)]
    prose = [len(b.text) * (k in (GOOD, NEAR) and not o) for b, k, o in zip(page.blocks, kinds, outside, strict=True)]
    framed = 2 * sum(p for p, i in zip(prose, inside, strict=True) if i) > sum(prose)
    for k, b in enumerate(page.blocks):
        if outside[k]:
            kinds[k] = BAD
        elif inside[k]:
            if kinds[k] == BAD and b.linked <= MOST_LINKED * len(b.text):
                kinds[k] = BRIEF
        elif framed and kinds[k] == NEAR:
            kinds[k] = BRIEF
    return kinds, inside


def settle(kinds: list[int], inside: list[bool], heading: list[bool]) -> list[bool]:
    """Second pass: which blocks stay. NEAR and BRIEF ones take the label of the nearest decided neighbour, by blocks between.

    An article's container is a border: a BAD block beyond it says nothing of a block within, nor a GOOD one within of a
    BRIEF block beyond. Of neighbours as near as each other that differ, the GOOD one counts for NEAR blocks, headings and
    what is inside, else the BAD one. With no neighbour that counts, NEAR blocks and what is inside stay, and all others
    too if no block of the page is decided.
    """
    n = len(kinds)

    def nearest(order):
        """Of each block: the distance and label of the nearest decided block before it in order that counts for it."""
        got: list[tuple[int, int]] = [(n + 1, -1)] * n
        last = {}  # by (label, inside): where last met
        for i in order:
            if kinds[i] in (GOOD, BAD):
                last[kinds[i], inside[i]] = i
                continue
            near = [(abs(i - j), label) for (label, within), j in last.items() if not (inside[i] and not within and label == BAD) and not (within and not inside[i] and label == GOOD and kinds[i] == BRIEF)]
            if near:
                got[i] = min(near)
        return got

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    undecided = not any(k in (GOOD, BAD) for k in kinds)
    keep = []
    for i, kind in enumerate(kinds):
        if kind in (GOOD, BAD):
            keep.append(kind == GOOD)
            continue
        least = min(before[i][0], after[i][0])
        labels = {label for d, label in (before[i], after[i]) if d == least and label >= 0}
        if not labels:
            keep.append(inside[i] or kind == NEAR or undecided)
        elif len(labels) == 1:
            keep.append(GOOD in labels)
        else:
            keep.append(kind == NEAR or inside[i] or heading[i])
    return keep


def main_text(page: str | None) -> str:
    """The blocks of the article, in page order, joined by newlines."""
    if not page:
        return ""
    found = read(page)
    kinds, inside = classify(found)
    keep = settle(kinds, inside, [b.heading for b in found.blocks])
    return "\n".join(b.text for b, k in zip(found.blocks, keep, strict=True) if k)


def extract(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    """pages without html_col, with the main text (never null) of each whole page. Null and empty pages give an empty text.

    A column of pages called as into is replaced; rows stay as they are otherwise, repeated ones too.
    """
    keep = [c for c in pages.columns if c not in (html_col, into)]
    source = pages.select(*(F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType())])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows = batch.slice(i, 512)
                texts = pa.array([main_text(x) for x in rows.column(len(keep)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in range(len(keep))), texts], [f.name for f in schema])

    return source.mapInArrow(run, schema).select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(keep)), F.col("text").alias(into))
