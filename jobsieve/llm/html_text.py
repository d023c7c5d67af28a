"""Main text of web pages by two passes over their blocks.

A page is cut into blocks at its block-level tags. The first pass labels blocks by where they stand
(menus, footers, forms and the like are no text), by the share of their words inside links, by
length, and by the density of stop words, which running text has and lists of labels lack. Short
and doubtful blocks stay open; the second pass gives them the label of the nearest decided block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Common function words of the languages at hand.
STOP_WORDS = frozenset(
    # English
    "the of and to in a is that it was for on are as with his they at be this from have or by one had not but what all were "
    "when we there can an your which their said if do will each about how up out them then she many some so these would other "
    # German
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    # French
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son sa ses ou comme mais on "
    # Spanish
    "el los del las por con una su para como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien".split()
)
#: Tags that hold no running text of the page.
APART = frozenset(
    "head nav header footer aside form dialog menu button select textarea option fieldset noscript iframe object template svg "
    "canvas audio video map math".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img".split()
)
MAIN = frozenset(("article", "main"))
#: Names, classes and roles of parts that are not the article.
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-?nav|cookies?|consent|gdpr|notices?|alerts?|menu|nav|navbar|"
    r"navigation|topbar|toolbar|breadcrumbs?|pagination|pager|footer|header|masthead|comments?|disqus|replies|respond|share|sharing|social|"
    r"related|recommend\w*|newsletter|subscribe|popup|modal|overlay|widget|login|signup|search|skip|complementary|contentinfo|dialog)(?=$|[\s_-])",
    re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.IGNORECASE)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|textarea|title|noscript|iframe|xmp|template|svg|math)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>",
    re.DOTALL | re.IGNORECASE,
)
#: Blocks of fewer words stay open in the first pass.
SHORT_WORDS = 8
#: Share of stop words from which a block is running text, and below which it is a list of labels.
MANY_STOPS, FEW_STOPS = 0.08, 0.02
LINK_SHARE = 0.5
#: The end of a sentence.
_SENTENCE = re.compile(r"[.!?…。！？।؟։](?=\W|$)")


#: How an element stands apart: not, by a hint that a layout wrapper of the article may have too, or for certain.
OPEN, HINTED, SHUT = 0, 1, 2


def _apart(name: str, attributes: str, in_main: bool) -> int:
    """Whether an element is no part of the article. An article may have a header of its own."""
    if name in APART and name != "form":
        return OPEN if name == "header" and in_main else SHUT
    found = HINTED if name == "form" else OPEN
    if not attributes or name in ("body", "html", "article", "main"):
        return found
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return SHUT
        if key == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                return SHUT
        elif key in ("class", "id", "role") and _HINT.search(value):
            found = HINTED
    return found


def blocks(html: str, wrappers: frozenset[int] = frozenset()) -> tuple[list[tuple[str, str, bool, int, int]], dict[int, set[str]]]:
    """(text, text inside links, whether it stands apart, number of its article or 0, hint) of each block, in order.

    Elements that stand apart only by a hint are numbered as they begin; ``hint`` is the outermost one
    around a block that nothing else sets apart, or 0. Those among ``wrappers`` count as open. Also
    which of main and article each of the others holds.
    """
    out: list[tuple[str, str, bool, int, int]] = []
    holds: dict[int, set[str]] = {}
    text: list[str] = []
    linked: list[str] = []
    # open elements: name, whether it and all below stand apart (and by which hint), number of the article
    stack: list[tuple[str, tuple[int, int], int]] = []
    apart, main, mains, links, at, hints = (OPEN, 0), 0, 0, 0, 0, 0

    def close() -> None:
        if text:
            words = " ".join(unescape("".join(text)).split())
            if words:
                out.append((words, " ".join(unescape("".join(linked)).split()), apart[0] != OPEN, main, apart[1]))
            text.clear()
            linked.clear()

    def add(piece: str) -> None:
        text.append(piece)
        if links:
            linked.append(piece)

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        if m[3] is None:
            continue
        name = m[3].lower()
        if name not in INLINE and name != "br":
            close()
        elif name in ("br", "wbr"):
            if name == "br":
                add(" ")
            continue
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    gone = stack[k:]
                    if any(g[1][0] or g[0] not in INLINE for g in gone):
                        close()
                    del stack[k:]
                    links -= sum(g[0] == "a" for g in gone)
                    apart, main = (stack[-1][1], stack[-1][2]) if stack else ((OPEN, 0), 0)
                    break
            continue
        if name in VOID or m[4].endswith("/"):
            continue
        if name in ("p", "li", "option", "tr", "td", "th", "dt", "dd") and stack and stack[-1][0] == name:
            stack.pop()
            apart, main = (stack[-1][1], stack[-1][2]) if stack else ((OPEN, 0), 0)
        inside = main
        if name in MAIN and not main and apart[0] == OPEN:
            mains += 1
            inside = mains
        if name in MAIN and not main and apart[0] == HINTED:
            holds.setdefault(apart[1], set()).add(name)
        below, how = apart, _apart(name, m[4], bool(main))
        if how == HINTED:
            hints += 1
            if apart[0] == OPEN and hints not in wrappers:
                below = (HINTED, hints)
        elif how == SHUT:
            below = (SHUT, 0)
        if below != apart or inside != main:
            close()
        stack.append((name, below, inside))
        apart, main = below, inside
        links += name == "a"
    if at < len(html):
        add(html[at:])
    close()
    return out, holds


def _stops(tokens: list[str]) -> int:
    return sum(t.strip(".,;:!?\"'()").lower() in STOP_WORDS for t in tokens)


def _mostly_links(words: str, linked: str) -> bool:
    return bool(linked) and len(linked) > LINK_SHARE * len(words)


def _known_language(found: list[tuple[str, str, bool, int, int]]) -> bool:
    """Whether the page's long blocks have as many stop words as running text; without them it has none to judge by."""
    long = [t for words, linked, apart, *_ in found if not apart and not _mostly_links(words, linked) and len(t := words.split()) >= SHORT_WORDS]
    return sum(map(_stops, long)) >= MANY_STOPS * sum(map(len, long))


def _first_label(words: str, linked: str, apart: bool, main: int, known: bool = True) -> bool | None:
    """True for text, False for none, None if undecided.

    Where no stop words are ``known`` long blocks with sentences are text, other long ones undecided.
    """
    if apart:
        return False
    tokens = words.split()
    if _mostly_links(words, linked):
        return None if main and len(tokens) >= SHORT_WORDS else False
    if len(tokens) < SHORT_WORDS:
        return None
    stops = _stops(tokens)
    if stops >= MANY_STOPS * len(tokens):
        return True
    if not known:
        return True if _SENTENCE.search(words) else None
    return False if stops < FEW_STOPS * len(tokens) and not main else None


def _wrappers(found: list[tuple[str, str, bool, int, int]], holds: dict[int, set[str]], label: list[bool | None]) -> set[int]:
    """Hinted elements that are layout around the article: their names do not set them apart.

    One with a main element is. Else, if the page has no article elsewhere, one with most of its
    words is, when it holds an article or when nothing outside is running text.
    """
    more = {h for h, kinds in holds.items() if "main" in kinds}
    if more or any(b[3] for b in found):
        return more
    size: dict[int, int] = {}
    for words, _, apart, _, hint in found:
        if hint or not apart:
            size[hint] = size.get(hint, 0) + len(words.split())
    for h, n in size.items():
        if h and 2 * n > sum(size.values()) and ("article" in holds.get(h, ()) or True not in label):
            more.add(h)
    return more


def main_text(html: str) -> str:
    """The text of the blocks that are the article's, joined by one space."""
    wrappers: frozenset[int] = frozenset()
    while True:
        found, holds = blocks(html, wrappers)
        known = _known_language(found)
        label = [_first_label(*b[:4], known) for b in found]
        more = _wrappers(found, holds, label)
        if not more:
            break
        wrappers |= more
    before: list[tuple[int, bool] | None] = []
    last: dict[int, tuple[int, bool]] = {}
    for i, (b, x) in enumerate(zip(found, label)):
        before.append(last.get(b[3]))
        if x is not None:
            last[b[3]] = (i, x)
    after, last = [None] * len(found), {}
    for i in range(len(found) - 1, -1, -1):
        after[i] = last.get(found[i][3])
        if label[i] is not None:
            last[found[i][3]] = (i, label[i])
    articles = any(b[3] for b in found)
    kept = []
    for i, b in enumerate(found):
        x = label[i]
        if x is None:
            near = [n for n in (before[i], after[i]) if n]
            if b[3]:  # inside an article its own blocks decide; nothing decided: it is the article
                x = min(near, key=lambda n: (abs(n[0] - i), not n[1]))[1] if near else True
            elif articles:
                x = False
            else:
                x = min(near, key=lambda n: (abs(n[0] - i), not n[1]))[1] if near else True
        elif x and not b[3] and articles:
            x = False  # running text outside the article: notices, adverts
        if x:
            kept.append(b[0])
    return " ".join(kept)


def extract_main_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of each in a column ``into``.

    A null or empty page has an empty text. Markup that is never closed reaches to the page's end.
    Pages are read whole and stay in their row.
    """
    keep = [c for c in pages.columns if c != into]
    source = pages.select(*[F.col(f"`{c}`") for c in keep])
    where = keep.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                texts = pa.array([main_text(x) if x else "" for x in b.column(where).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*[f"c{i}" for i in range(len(keep))], "t"])

    schema = source.schema

    named = StructType([*[StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)], StructField("t", StringType())])
    return source.mapInArrow(run, named).toDF(*keep, into)
