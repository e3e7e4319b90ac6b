"""HTML extraction, the Merkle manifest and the filter audit."""

import hashlib
import html
import itertools
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest

from vellum.llm import filter_audit, html_extract, merkle
from vellum.llm.labelled_pages import END, MAIN, labelled_pages

from . import odd

SF = "/root/testdata/sf0.01"
SHAPES = [
    ("<html><body><header><h1>Site</h1><p>tag line</p></header><div id='cookie-banner'>We use cookies. <button>OK</button></div><main><div class=breadcrumbs><a>Home</a> &gt; x</div><article><h1>Title here</h1><p>One two <a href=x>three</a> four&nbsp;five.</p><div class='ad-slot'>Buy now this great thing today cheap cheap cheap</div><p>Ok.</p><ul><li><a href=1>One</a></li><li><a>Two</a></li></ul><footer>Tags: a, b</footer></article><section class=related><h2>Related</h2><article class=card><h3>Other</h3><p>Teaser text is here for you to read</p></article></section><section id=comments><h2>3 comments</h2><article class=comment><p>Great stuff I like it very much indeed</p></article></section></main><aside>Side</aside><footer><p>(c)</p></footer></body></html>", "Title here One two three four five. Ok. One Two"),
    ("<body><div id=header>My site<ul><li><a>Home</a><li><a>About</a></ul></div><div id=wrap><div class='post-content'><h2>T</h2><p>Alpha beta gamma</p>Loose text<br>line two<p>Z.</div><div class=sidebar><p>Recent posts in the blog are here</p></div></div><div id=footer>bye</div>", "T Alpha beta gamma Loose text line two Z."),
    ("<form id=aspnetForm><div class='page sidebar-right'><main><p>Hello world text here</p></main></div></form>", "Hello world text here"),
    ("<div class=content><p>Body text of it.</p><div class=comments><div class='comment-content'><p>I disagree with all of this and so on</p></div></div><p>More body.</p></div>", "Body text of it. More body."),
    ("<article><p>unterminated <b>bold <p>next</p><script>if(a<b){document.write(\"<p>x</p>\")}</script><style>p{}</style><!-- c <p>no</p> --><p title=\"a>b\">q</p>", "unterminated bold next q"),
    ("<article><header><h1>Big news</h1><p>By X</p></header><p>Text of the story.</p></article>", "Big news By X Text of the story."),
    ("<body><nav><a>A</a></nav><div class=notice>Site down on Monday for work</div><section><h1>Top</h1><p>Aa bb cc.</p><div class=newsletter><form>Join us</form></div><p>Dd ee.</p></section><div id=disqus_thread>x y z</div>", "Top Aa bb cc. Dd ee."),
    ("<body><div>Para one is a div with words.</div><div>Para two too with some.</div><ul><li><a>x</a></li><li><a>y</a></li></ul>", "Para one is a div with words. Para two too with some."),
    ("<article>AT&amp;amp;T &lt;b&gt; in<b>lin</b>e \t\n x\x0b</article>", "AT&amp;T <b> inline x"),
    ("plain text only", "plain text only"), ("", ""), (None, ""), ("<p", ""), ("<nav><a>Home</a></nav>", ""), ("<!-- never closed <p>x</p>", ""), ("<script>never closed <p>x</p>", ""),
]


@pytest.mark.parametrize("page, want", SHAPES)
def test_shapes_of_pages(page, want):
    assert " ".join(html_extract.blocks(page)) == want


def test_pages_of_the_tables_whole(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.main_text(odd.clashing(pages).drop("url").join(pages.select("page_id", "url"), "page_id")).collect()}
    for r in pq.read_table(f"{SF}/pages.parquet").to_pylist():
        inner = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())
        assert (got[r["page_id"]].text, got[r["page_id"]].n_chars, got[r["page_id"]].url) == (want, len(want), r["url"])


def test_labelled_pages_that_were_not_fitted():
    """Whole first and last blocks; a page without a holder may also have what stands loose beside the main text."""
    pages = labelled_pages(240)
    w = html_extract.fit(pages[:96])
    plain = lambda x: " ".join(html.unescape(re.sub("<[^>]+>", "", x)).split())
    for p in pages[96:]:
        main = p[p.index(MAIN) + len(MAIN) : p.index(END)]
        got = html_extract.blocks(p, w)
        held = main.startswith("<h1>") and got[0] == plain(re.search(r"<h1>(.*?)</h1>", main)[1]) or plain(main.split("<p>")[1]) in got
        assert held and plain(main.rsplit("<p>", 1)[1]) in got
        if re.search("<(?:article|main)>" + MAIN, p):
            assert got[-1] == plain(main.rsplit("<p>", 1)[1])


def test_best_run_is_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        v = [rng.choice([-3, -1, -1, 0, 1, 2]) for _ in range(rng.randint(0, 14))]
        start, end = html_extract.best_run(v)
        best = max((sum(v[i:j]) for i, j in itertools.combinations(range(len(v) + 1), 2)), default=0)
        assert sum(v[start:end]) == max(0, best) and (end > start) == (best > 0)


@pytest.mark.parametrize("unit", ["<a x=\"", "<a ", "<", "<b><p>", "&amp", "<div class='ad'>", "</x>", "<!--", "<p x='>", "=\"'>"])
def test_long_malformed_pages_take_linear_time(unit):
    import time

    began = time.process_time()
    html_extract.blocks("<p>x</p>" + unit * 60_000 + ">")
    assert time.process_time() - began < 12


def test_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(1, None, None, "x", "x"), (None, "u", "<p>a b", "x", "x"), (1, None, None, "x", "x")]
    got = html_extract.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, None, "", 0), (None, "u", "a b", 3), (1, None, "", 0)], key=repr)
    assert html_extract.main_text(spark.createDataFrame([], schema)).collect() == []


def sha(*said):
    return hashlib.sha256("".join(said).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(level):
    """Levels of digests, and each leaf's siblings with their side."""
    levels = [level]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    paths = []
    for i in range(len(level)):
        path, at = [], i
        for nodes in levels[:-1]:
            first = at // 8 * 8
            path.append((nodes[first:at], nodes[at + 1 : first + 8]))
            at //= 8
        paths.append(path)
    return levels[-1][0] if level else None, paths


def brute_merkle(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    langs = {}
    for i, text, lang, source, n in rows:
        leaf = sha(*map(field, (i, source, lang, n, text)))
        hit = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        bad = sha(*map(field, (i, source, lang, n, text and text.translate(low)))) if hit else leaf
        langs.setdefault(lang, []).append(((i is not None, i or 0), leaf, bad, i))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: brute_tree([leaf for _, leaf, _, _ in sorted(langs[x])]) for x in names}
    root, up = brute_tree([trees[x][0] for x in names])
    out = []
    for x, top in zip(names, up, strict=True):
        for (_, leaf, bad, i), path in zip(sorted(langs[x]), trees[x][1], strict=True):
            acc = bad
            for left, right in [*path, *top]:
                acc = sha(*left, acc, *right)
            out.append((i, leaf, trees[x][0], root, sha(*[d for left, right in [*path, *top] for d in left + right]), acc, acc == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n, seed", [(0, 0), (1, 1), (8, 2), (9, 3), (700, 4)])
def test_merkle_is_brute_force(spark, n, seed):
    rng = random.Random(seed)
    data = [(rng.randrange(10**6), rng.choice(["Ab", "é Z", "", None, "x" * 3000]), rng.choice([None, "", "-", "en", "de", "é", "z", *map(str, range(12))]), rng.choice([None, "s"]), rng.choice([None, 3])) for _ in range(n)]
    got = merkle.proven(odd.clashing(odd.frame(spark, data)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_merkle(data)


def test_merkle_of_odd_and_equal_rows(spark):
    data = odd.rows()
    got = merkle.proven(odd.clashing(odd.frame(spark, data)))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_merkle(data)
    many = [(7, "same", "en", None, 4)] * 600 + [(None, None, None, None, None)] * 20
    assert sorted(map(tuple, merkle.proven(odd.frame(spark, many)).collect()), key=repr) == brute_merkle(many)


def test_upper_levels_from_the_shuffled_table(spark, monkeypatch):
    """Lookups without a broadcast give the same proofs."""
    data = [(i, f"T{i}", "en", None, None) for i in range(150)]
    monkeypatch.setattr(merkle, "SMALL_LEVEL", 1)
    assert sorted(map(tuple, merkle.proven(odd.frame(spark, data)).collect()), key=repr) == brute_merkle(data)


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    parts = {}
    for i, t, lang, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = "".join(
            letter for letter, bad in zip("ABCDE", (
                len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t],
            ), strict=True) if bad
        )
        parts.setdefault(lang or "", []).append((failed, i))
    out = []
    for part, docs in parts.items():
        shapley, mine = Counter(), []
        for order in map("".join, itertools.permutations("ABCDE")):
            left = list(docs)
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                redundant = sum(f in d[0] and bool(set(order[: step - 1]) & set(d[0])) for d in docs)
                mine.append([part, order, step, len(left), len(gone), redundant, sum(d[0] == f for d in docs), sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)])
                shapley[f] += len(gone)
        out += [(*m, shapley[m[1][m[2] - 1]]) for m in mine]
    return sorted(out)


def test_audit_is_brute_force(spark):
    rng = random.Random(5)
    data = odd.rows() + [(1000 + i, " ".join(rng.choice(["Ab", "c", "d#", "eF"][: rng.randint(1, 4)]) for _ in range(rng.choice([150, 199, 200, 260]))), rng.choice(["en", "", None]), None, None) for i in range(60)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, *_ in data[::2]] + [(data[0][0], 1, 1), (None, 1, 1)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audited(odd.clashing(odd.frame(spark, data)), odd.clashing(frame))
    assert sorted(map(tuple, got.collect())) == brute_audit(data, labels)
    assert filter_audit.audited(odd.frame(spark, []), frame).collect() == []


def test_audit_of_a_text_that_most_rows_share(spark):
    data = [(i, "same text", "en", None, None) for i in range(3000)] + [(5, "same text", "de", None, None)] * 700 + [(None, "same text", None, None, None)] * 3
    frame = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, filter_audit.audited(odd.frame(spark, data), frame).collect())) == brute_audit(data, [(1, 1, 0)])
