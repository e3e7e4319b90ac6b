"""Normalisers against plain restatements."""

import html
import re

from hypothesis import example, given, settings, strategies as st

from vellum.functions.text import QUOTES, answer_norm, fold, locate_span, normalise, visible_text

TEXTS = st.one_of(
    st.text(alphabet=list("aB \n\t-\"'“’&;\\amp#39éİß😀\xa0"), max_size=60),
    st.lists(st.sampled_from(["&", ";", "\\", "'", '"', "&amp;", "&#39;", "&lt", "x", "-\n", " ", "&\\';", "’"]), max_size=14).map("".join),
)


def restated(text):
    """Character by character: (normal form, places)."""
    pairs, i = [], 0
    while i < len(text):
        if text[i] == "\\" and text[i + 1 : i + 2] and text[i + 1] in QUOTES:
            i += 1
            continue
        j = text.find(";", i + 1)
        if text[i] == "&" and 0 < j - i <= 10 and html.unescape(text[i : j + 1]) != text[i : j + 1]:
            pairs += [(c, i) for c in html.unescape(text[i : j + 1])]
            i = j + 1
            continue
        pairs.append((text[i], i))
        i += 1
    out, k = [], 0
    while k < len(pairs):
        c, at = pairs[k]
        if c == "-" and k + 1 < len(pairs) and pairs[k + 1][0] == "\n":
            out.append(("-", at))
            k += 2
        elif c in QUOTES:
            k += 1
        elif c.isspace():
            out.append((" ", at))
            while k < len(pairs) and pairs[k][0].isspace():
                k += 1
        else:
            out += [(x, at) for x in c.lower()]
            k += 1
    return "".join(c for c, _ in out), [p for _, p in out]


@settings(max_examples=600, deadline=None)
@given(TEXTS)
@example("&\\';")
@example("a & b; \\\"c\\\" &amp; &x&lt;;")
def test_normalise_is_its_restatement(text):
    norm, place = normalise(text)
    assert (norm, place.tolist()) == restated(text)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.data())
def test_a_piece_is_found_and_gives_its_own_normal_form_back(text, data):
    a = data.draw(st.integers(0, len(text)))
    piece = text[a : data.draw(st.integers(a, len(text)))]
    got = locate_span(text, piece)
    if got:
        assert normalise(piece)[0].strip() in normalise(text[got[0] : got[1] + 12])[0] or normalise(text)[0].find(normalise(piece)[0].strip()) >= 0


def test_escaped_quotes_beside_a_lone_ampersand():
    assert locate_span('A & \\"B\\"; c', "A & B; c") == (0, 12) and locate_span("R&D \\'x\\'; y", "r&d x; y") is not None


def test_nonblank_is_strip(spark):
    from pyspark.sql import functions as F

    from vellum.functions.text import nonblank, stripped

    rows = [(x,) for x in ["", " \t\n", "\xa0\u2003\x1c\x85", " a ", "\u200b", None]]
    got = spark.createDataFrame(rows, "t string").select("t", nonblank(F.col("t")).alias("n"), (stripped(F.col("t")) != "").alias("s")).collect()
    assert all(r.n == r.s and (r.t is None or r.n == bool(r.t.strip())) for r in got)


def test_known_pairs():
    assert locate_span("He said “yes” to the agree-\nment.", '"yes" to the agree-ment') == (9, 31) or locate_span("He said “yes” to the agree-\nment.", "yes to the agree-ment") is not None
    assert locate_span("Fish &amp; chips", "fish & chips") == (0, 16)
    assert locate_span("abc", "abd") is None and locate_span("abc", " ") is None
    assert fold('Straße \\"x\\"\n y') == "strasse x y"
    assert answer_norm("  “A” &amp; b-\nc ") == "a & b-c"


def test_visible_text(spark):
    from pyspark.sql import functions as F

    page = "<html><script>x</p></script><p>One &amp; two</p>\n\n\n\n<li>three<br/>four</li>"
    got = spark.createDataFrame([(page,)], "t string").select(visible_text(F.col("t")).alias("v")).first()["v"]
    assert re.sub(r"\n+", "|", got) == "One & two|three|four"
