"""Text normalisers.  They differ on purpose: search folds case, the verifier keeps offsets, the others are plainer.

Those that Spark's functions can express are columns; the rest are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import html
import html.entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from .udf import batch_udf

# fixed value: the quote characters that never count
QUOTES = "\"'“”‘’"
_QUOTE_CLASS = "[\"'“”‘’]"
# fixed value: the longest distance from an ampersand to its semicolon
ENTITY_REACH = 10

NORMALISED = T.StructType([T.StructField("norm", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])


# fixed value: all characters that count as white space at a text's ends
WHITE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def nonblank(text: Column) -> Column:
    """Whether a text has a character that is no white space: the filter to use where its stripped form isn't needed."""
    return text.rlike(WHITE.replace("[", "[^", 1))


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends; ``trim`` alone takes spaces only.  It rewrites the whole text."""
    return F.regexp_replace(text, f"^{WHITE}++|(?<!{WHITE}){WHITE}++$", "")


def squeezed(text: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def plain_norm(text: Column) -> Column:
    """Hyphenated line ends joined, quotes dropped, white space squeezed, lower case: what built-in functions can do of the search normaliser."""
    joined = F.regexp_replace(F.regexp_replace(text, "-\n", "-"), _QUOTE_CLASS, "")
    return F.lower(F.regexp_replace(joined, r"\s+", " "))


def heading_norm(text: Column) -> Column:
    """Dashes unified, white space squeezed, lower case."""
    return F.lower(squeezed(F.regexp_replace(text, "[–—−]", "-")))


def slug(name: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def fold(text: str | None) -> str | None:
    """The search normaliser of one text: entities decoded, escapes and quotes dropped, hyphenated line ends joined, case folded."""
    if text is None:
        return None
    t = html.unescape(text).replace('\\"', '"').replace("\\'", "'").replace("-\n", "-")
    return re.sub(r"\s+", " ", t.translate({ord(q): None for q in QUOTES})).casefold()


@batch_udf(T.StringType())
def search_norm(text: pd.Series) -> pd.Series:
    return text.map(fold)


def answer_norm(text: str | None) -> str:
    """The claim resolver's normaliser: like the verifier's, without offsets and trimmed."""
    t = re.sub(rf"\\(?={_QUOTE_CLASS})", "", html.unescape(text or ""))
    return re.sub(r"\s+", " ", re.sub(_QUOTE_CLASS, "", t.replace("-\n", "-"))).strip().lower()


_ESCAPE_OR_ENTITY = re.compile(rf"\\(?={_QUOTE_CLASS})|&[^;]{{0,{ENTITY_REACH - 1}}};")
_SHORTENED = re.compile(rf"-\n|{_QUOTE_CLASS}|\s+")


def normalise(text: str | None) -> tuple[str, np.ndarray]:
    """The verifier's normal form, and for each of its characters the place in ``text`` that it comes from.

    Backslashes before quotes go, entities are decoded (each character stands where the entity starts), a hyphen at a line end
    joins, quotes go, a white space run is one space where it starts, and case is lowered; a character whose lower
    case is longer gives its place to all of it.
    """
    text = text or ""
    parts, places, at = [], [], 0
    m = _ESCAPE_OR_ENTITY.search(text)
    while m:
        shown, end = "" if m[0][0] == "\\" else html.unescape(m[0]), m.end()
        if shown == m[0]:  # no entity: what follows the ampersand is looked at again
            end = m.start() + 1
        else:
            parts += [text[at : m.start()], shown]
            places += [np.arange(at, m.start()), np.full(len(shown), m.start())]
            at = end
        m = _ESCAPE_OR_ENTITY.search(text, end)
    decoded = "".join([*parts, text[at:]])
    place = np.concatenate([*places, np.arange(at, len(text))]).astype(np.int32)
    parts, places, at = [], [], 0
    for m in _SHORTENED.finditer(decoded):
        kept = "-" if m[0] == "-\n" else "" if m[0] in QUOTES else " "
        parts += [decoded[at : m.start()], kept]
        places += [place[at : m.start()], place[m.start() : m.start() + len(kept)]]
        at = m.end()
    out, place = "".join([*parts, decoded[at:]]), np.concatenate([*places, place[at:]])
    low = out.lower()
    if len(low) != len(out):
        place = np.repeat(place, [len(c.lower()) for c in out])
        low = "".join(c.lower() for c in out)
    return low, place


@batch_udf(NORMALISED)
def normalised(text: pd.Series) -> pd.DataFrame:
    got = [normalise(t) for t in text]
    return pd.DataFrame({"norm": [n for n, _ in got], "offsets": [p.tolist() for _, p in got]})


@batch_udf(T.StringType())
def normal_form(text: pd.Series) -> pd.Series:
    """The verifier's normal form alone."""
    return text.map(lambda t: normalise(t)[0])


def locate_span(text: str | None, span: str | None) -> tuple[int, int] | None:
    """Where a span, normalised and trimmed, first lies in a normalised text, in the text's own characters; None if nowhere."""
    norm, place = normalise(text)
    needle = normalise(span)[0].strip()
    k = norm.find(needle)
    return (int(place[k]), int(place[k + len(needle) - 1]) + 1) if needle and k >= 0 else None


@batch_udf("struct<start:int,end:int>")
def _place(text: pd.Series, span: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([locate_span(t, s) or (None, None) for t, s in zip(text, span, strict=True)], columns=["start", "end"], dtype="Int32")


def located(text: Column, span: Column) -> Column:
    """struct<start, end>: ``locate_span``, null if nowhere.  Texts are normalised one at a time, and their characters' places stay in the task."""
    at = _place(text, span)
    return F.when(at["start"].isNotNull(), at)


@batch_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Texts without an ampersand pass as they are."""
    return pd.Series([html.unescape(t) if t and "&" in t else t for t in text], dtype=object)


_CLOSED = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@batch_udf(T.StringType())
def closed_unescaped(text: pd.Series) -> pd.Series:
    """Only references that end in a semicolon are decoded; "&amp" at a cut title's end stays, which ``unescaped`` takes for an ampersand as browsers do."""

    def decoded(m: re.Match) -> str:
        return html.unescape(m[0]) if m[0][1] == "#" else html.entities.html5.get(m[0][1:], m[0])

    return pd.Series([_CLOSED.sub(decoded, t) if t and "&" in t else t for t in text], dtype=object)


# fixed values: what of a page isn't shown, what ends a line, and what a tag is
HIDDEN, LINE_END, TAG = r"(?is)<(script|style)\b.*?</\1>", r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|tr)>", "<[^>]+>"


def visible_text(raw: Column, decode=unescaped) -> Column:
    """An HTML page's text: scripts and styles dropped, block ends as line ends, tags as spaces, entities decoded by ``decode``, lines trimmed."""
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, HIDDEN, " "), LINE_END, "\n"), TAG, " ")
    lines = F.transform(F.split(decode(shown), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"^\s+|\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
