"""Main text of HTML pages: the maximum-scoring subsequence of words and tags, with weights from labelled pages."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, slices, small_batches
from .labelled_pages import END, MAIN, labelled_pages

# fixed values: elements whose content isn't parsed, that have none, that aren't shown as text, that break lines
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSHOWN = frozenset("script style textarea title iframe noembed noframes noscript template svg canvas object audio video select button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input".split())
#: Open elements that a start tag closes if they are the innermost: a block's those of "", some tags others.
CLOSES = {"": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "tr": {"p", "td", "th", "tr"}, "option": {"option"}}
#: Limits of log-odds: of the place in a holder, of the kind of block, of a tag.
PLACE, BLOCK, TAG = 6.0, 2.0, 0.5

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_REST = re.compile(r"(?:[^>=]|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_SAID = re.compile(r"\b(class|id|role|itemprop|style|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PIECES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Part(NamedTuple):
    """A tag or a text between two tags."""

    text: str | None  # None: a tag
    tag: str  # the tag's name; of a text that of its block
    element: int  # the innermost open element, -1: none
    link: bool
    block: int


class Element(NamedTuple):
    parent: int
    features: tuple[str, ...]
    first: int  # its parts are first .. last - 1
    last: int


def _features(name: str, rest: str) -> tuple[str, ...]:
    """The tag's name and the words of its class, id, role and itemprop; one that is hidden says so."""
    out = ["<" + name]
    for m in _SAID.finditer(rest):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            out.append("hidden")
        elif key != "style":
            out += [x.lower() for x in _PIECES.findall(value)]
    return tuple(out)


def parse(page: str) -> tuple[list[Part], list[Element]]:
    """A page's tags and texts in order, and its elements.  One pass; a tag that isn't well formed ends at the next '>'."""
    parts: list[Part] = []
    elements: list[list] = []
    stack: list[tuple[str, int, bool, str]] = []  # name, element, in a link, block's tag
    opened: Counter[str] = Counter()
    at, block, last_gt, n = 0, 0, page.rfind(">"), len(page)

    def said(text: str) -> None:
        if text and (elements or not text.isspace()):
            top = stack[-1] if stack else ("", -1, False, "body")
            parts.append(Part(text, top[3], top[1], top[2], block))

    def close(name: str) -> None:
        while stack:
            top = stack.pop()
            opened[top[0]] -= 1
            elements[top[1]][3] = len(parts)
            if top[0] == name:
                return

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last_gt:
            # what starts like a tag and never ends is none of the text
            rest = n if lt < 0 or not re.match(r"</?[a-zA-Z!?]", page[lt : lt + 3]) else lt
            said(page[at:rest])
            break
        if lt > at:
            said(page[at:lt])
        mark = page[lt + 1 : lt + 2]
        if mark in "!?":
            sign = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(sign, lt + 2)
            at = n if end < 0 else end + len(sign)
            if page[lt:at] in (MAIN, END):
                parts.append(Part(None, page[lt:at], stack[-1][1] if stack else -1, False, block))
            continue
        ends = mark == "/"
        m = _NAME.match(page, lt + 1 + ends)
        if not m:
            said("<")
            at = lt + 1
            continue
        name = m[0].lower()
        whole = _REST.match(page, m.end())
        at = whole.end() if whole else page.find(">", m.end()) + 1
        if not at:
            break
        if name not in INLINE:
            block += 1
        top = stack[-1] if stack else ("", -1, False, "body")
        if name == "br":
            parts.append(Part("\n", top[3], top[1], top[2], block))
        if ends:
            if opened[name]:
                close(name)
            parts.append(Part(None, name, stack[-1][1] if stack else -1, False, block))
            continue
        ending = CLOSES.get(name, CLOSES[""]) if name not in INLINE else ()
        while stack and stack[-1][0] in ending:
            close(stack[-1][0])
        top = stack[-1] if stack else ("", -1, False, "body")
        parts.append(Part(None, name, top[1], False, block))
        if name in VOID or (whole and page[at - 2] == "/" and name in ("svg", "path")):
            continue
        elements.append([top[1], _features(name, page[m.end() : at]), len(parts), -1])
        stack.append((name, len(elements) - 1, top[2] or name == "a", top[3] if name in INLINE else name))
        opened[name] += 1
        if name in RAW:
            end = re.compile(f"</{name}", re.I).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                said(page[at:stop])
            at = stop
    while stack:
        close(stack[-1][0])
    return parts, [Element(*e) for e in elements]


class Weights(NamedTuple):
    holders: frozenset[str]  # features of elements that hold the whole main text
    strange: frozenset[str]  # features of elements without main text; "@" before those that stand in a holder
    place: dict[tuple[int, int], float]  # (most holders around one place of the page, holders around this one)
    block: dict[tuple[str, bool], float]  # (block's tag, in a link)
    tag: dict[str, float]


def _depths(elements: list[Element], holders: frozenset[str]) -> list[int]:
    out: list[int] = []
    for e in elements:
        out.append(min(2, (out[e.parent] if e.parent >= 0 else 0) + any(f in holders for f in e.features)))
    return out


def _strange(elements: list[Element], depths: list[int], parts: list[Part], w: Weights) -> list[bool]:
    """Whether an element, or one around it, holds no main text.

    An element named like one that doesn't, but with the page's first holder in it, is taken for a frame around the page.
    """
    first = next((e.first for e, d in zip(elements, depths, strict=True) if d and not any(f in w.strange for f in e.features if f[0] != "<")), None)
    if first is None:
        first = next((e.first for e in elements if e.features[0] == "<h1"), None)
        frames: frozenset[str] = frozenset(("<header", "header", "<nav", "<footer", "masthead", "banner", "<aside"))
    else:
        frames = frozenset()
    out: list[bool] = []
    for e, d in zip(elements, depths, strict=True):
        around = out[e.parent] if e.parent >= 0 else False
        inside = (depths[e.parent] if e.parent >= 0 else 0) > 0
        own = any((f"@{f}" if inside else f) in w.strange for f in e.features)
        if own and not inside and first is not None and e.first < first < e.last and not frames.intersection(e.features):
            own = False
        out.append(around or own or e.features[0][1:] in UNSHOWN)
    return out


def scores(parts: list[Part], elements: list[Element], w: Weights) -> list[float]:
    """A part's score: a text's is the sum over its words, a tag's is negative, and what can't be main text has 0."""
    depths = _depths(elements, w.holders)
    strange = _strange(elements, depths, parts, w)
    most = max((d for d, s in zip(depths, strange, strict=True) if not s), default=0)
    out = []
    for p in parts:
        if p.element >= 0 and strange[p.element]:
            out.append(0.0)
        elif p.text is None:
            out.append(-w.tag.get(p.tag, TAG))
        else:
            depth = depths[p.element] if p.element >= 0 else 0
            score = w.place.get((most, min(depth, most)), 0.0) + w.block.get((p.tag, p.link), w.block.get(("div", p.link), 0.0))
            out.append(score * len(p.text.split()))
    return out


def best_run(values: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run with the greatest sum, in one scan; (0, 0) if no sum is positive, the first of equal ones."""
    best, start, end, total, begun = 0.0, 0, 0, 0.0, 0
    for i, v in enumerate(values):
        if total <= 0:
            total, begun = 0.0, i
        total += v
        if total > best:
            best, start, end = total, begun, i + 1
    return start, end


def fit(pages: list[str]) -> Weights:
    """Weights from pages that say with MAIN and END where their main text is; the list is bounded and read by the caller."""
    read = [(parse(p), p) for p in pages]
    share, seen = defaultdict(list), defaultdict(list)
    marked = []
    for (parts, elements), _ in read:
        inside, flags = False, []
        for p in parts:
            inside = (inside or p.tag == MAIN) and p.tag != END if p.text is None else inside
            flags.append(inside)
        marked.append(flags)
        words = [len(p.text.split()) if p.text is not None else 0 for p in parts]
        total = sum(n for n, f in zip(words, flags, strict=True) if f)
        for e in elements:
            mine = sum(n for n, f in zip(words[e.first : e.last], flags[e.first : e.last], strict=True) if f)
            every = sum(words[e.first : e.last])
            for f in set(e.features):
                seen[f].append(mine / max(1, total))
                share[f].append(mine / every if every else 0.0)
    plain = {"<body", "body", "<html", "<div", "<section"}
    # one that is wider has other words too, but not more than main ones
    holders = frozenset(f for f in seen if f not in plain and min(seen[f]) > 0.9 and min(share[f]) > 0.5)
    # a part inside the main text is none of it: its words count as other words there
    within, without = Counter(), Counter()
    for ((parts, elements), _), flags in zip(read, marked, strict=True):
        depths = _depths(elements, holders)
        for e in elements:
            inside = (depths[e.parent] if e.parent >= 0 else 0) > 0
            for f in set(e.features):
                name = f"@{f}" if inside else f
                first = next((flags[i] for i in range(e.first, e.last)), False)
                (within if first or any(flags[e.first : e.last]) else without)[name] += 1
    other = frozenset(f for f in without if f not in within)
    # in the main text, what carries a name that outside never has main text does neither
    strange = other | frozenset(f"@{f}" for f in other if f[0] != "@" and f not in ("<header", "header"))
    w = Weights(holders, strange, {}, {}, {})
    place, block, tag = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for ((parts, elements), _), flags in zip(read, marked, strict=True):
        depths = _depths(elements, holders)
        none = _strange(elements, depths, parts, w)
        most = max((d for d, s in zip(depths, none, strict=True) if not s), default=0)
        for p, main in zip(parts, flags, strict=True):
            if p.element >= 0 and none[p.element]:
                continue
            if p.text is None:
                tag[p.tag][main] += 1
                continue
            n = len(p.text.split())
            place[most, min(most, depths[p.element] if p.element >= 0 else 0)][main] += n
            block[p.tag, p.link][main] += n
    odds = lambda c, most: max(-most, min(most, math.log((c[True] + 0.5) / (c[False] + 0.5))))
    return w._replace(
        place={k: odds(c, PLACE) for k, c in place.items() if k[0]},  # a page without holders has one place only
        block={k: odds(c, BLOCK) for k, c in block.items()},
        tag={k: TAG * (c[False] + 0.1) / (c[True] + c[False] + 0.1) for k, c in tag.items()},
    )


@lru_cache
def default_weights() -> Weights:
    return fit(labelled_pages())


def blocks(page: str | None, w: Weights | None = None) -> list[str]:
    """The blocks of a page's main text, references decoded, white space squeezed, empty ones left out."""
    w = w or default_weights()
    parts, elements = parse(page or "")
    values = scores(parts, elements, w)
    start, end = best_run(values)
    if start == end:
        return []
    depths = _depths(elements, w.holders)
    strange = _strange(elements, depths, parts, w)
    while start and parts[start - 1].block == parts[start].block:  # a block is whole
        start -= 1
    while end < len(parts) and parts[end].block == parts[end - 1].block:
        end += 1
    out: dict[int, list[str]] = {}
    for p in parts[start:end]:
        if p.text is not None and not (p.element >= 0 and strange[p.element]):
            out.setdefault(p.block, []).append(p.text)
    found = (" ".join(html.unescape("".join(x)).split()) for x in out.values())
    return [x for x in found if x]


def main_text(pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty page, or one without main text, has an empty text.  Pages are read whole in one pass each, repeated rows stay,
    other columns are ignored, and an empty table gives no rows.  Nothing is shuffled.
    """
    w = weights or default_weights()
    schema = "page_id long, url string, text string, n_chars long"
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))

    def task(batches):
        import pyarrow as pa

        for b in slices(batches):
            texts = [" ".join(blocks(x, w)) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=arrow_schema(schema))

    return rows.mapInArrow(task, schema)
