"""Exact dedup, n-gram join and substring dedup against brute force."""

import collections
import hashlib
import random
import re

import pytest

from vellum.llm import common, exact_dedup, ngram_join, substring_dedup

from . import odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def brute_exact(data):
    groups = collections.defaultdict(list)
    for i, t, *_ in data:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = []
    for norm, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(norm.encode()).hexdigest()
        kept = False
        for i in sorted(ids, key=lambda i: (i is None, i)):
            out.append((i, first, len(ids), i == first and not kept, sha))
            kept |= i == first
    return ordered(out)


@pytest.mark.parametrize("share", [256, 4])
def test_exact(spark, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    data = odd.rows() + [(1000 + i, "hot text  of many", None, None, 1) for i in range(60)]
    got = exact_dedup.exact_groups(odd.clashing(odd.frame(spark, data)))
    assert ordered(got.collect()) == brute_exact(data)
    assert exact_dedup.exact_groups(odd.frame(spark, [])).collect() == []


def test_exact_keeps_columns(spark):
    df = odd.frame(spark)
    kept = exact_dedup.distinct_documents(df)
    want = [r for r in brute_exact(odd.rows()) if r[3]]
    assert kept.columns == df.columns and kept.count() == len(want)
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in want)


def shingled(t, k):
    w = WORD.findall((t or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute_near(data, k, percent):
    sets = [(i, shingled(t, k)) for i, t, *_ in data]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for b, (j, y) in enumerate(sets[:a]):
            if x and y and i is not None and j is not None and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return ordered((i, len(x), None if i is None else least[root(a)]) for a, (i, x) in enumerate(sets))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_near(spark, monkeypatch, k, percent):
    monkeypatch.setattr(ngram_join, "HOT_FROM", 3)
    monkeypatch.setattr(ngram_join, "PARTNERS", 4)
    monkeypatch.setattr(common, "HOT_LEAST", 3)
    data = odd.rows(k)
    rng = random.Random(k)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    for i in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
        data.append((5000 + i, " ".join(w), None, None, 1))
    # one prefix and size, far less in common than links need; rows that share an id with texts of other classes
    common_words = [f"a{j}" for j in range(12)]
    data += [(6000 + i, " ".join(common_words + [f"q{rng.randrange(40)}" for _ in range(50)]), None, None, 1) for i in range(12)]
    data += [(5000, " ".join(base[:40]), None, None, 1), (5000, "quite another text", None, None, 1), (1, "quite another text", None, None, 1)]
    data += [data[-3]] * 9
    got = ngram_join.near_duplicates(odd.clashing(odd.frame(spark, data)), k, percent)
    assert ordered(got.collect()) == brute_near(data, k, percent)


def test_near_empty_and_filter(spark):
    assert ngram_join.near_duplicates(odd.frame(spark, [])).collect() == []
    data = [(1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1), (3, "q r s t u v", "en", "s", 1), (None, "a b c d e f g", "en", "s", 1), (4, None, None, None, None)]
    df = odd.frame(spark, data)
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "None"]


def brute_passages(data, size):
    words = [[w for w in WORD.findall(t or "")] for _, t, *_ in data]
    seen = collections.Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (d, *_), w in zip(data, words, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                keep[i : i + size] = [False] * size
        left = [x for x, k in zip(w, keep, strict=True) if k]
        out.append((d, len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("size", [35, 9, 4])
def test_passages(spark, size):
    rng = random.Random(size)
    sources = [[rng.choice("abcdef") for _ in range(150)] for _ in range(3)]
    data = odd.rows(size)
    for i in range(50):
        w = []
        for _ in range(rng.randint(0, 5)):
            s, a = rng.choice(sources), rng.randrange(140)
            w += s[a : a + rng.randint(1, 70)] if rng.random() < 0.5 else [rng.choice("abcdefgh") for _ in range(rng.randint(0, 15))]
        data.append((9000 + i, " ".join(w), None, None, 1))
    got = substring_dedup.without_duplicates(odd.clashing(odd.frame(spark, data)), size)
    assert ordered(r[:4] for r in got.collect()) == brute_passages(data, size)


def test_spans_are_copies(spark):
    data = [r for r in odd.rows(3) if r[0] is not None]
    text = collections.defaultdict(list)
    for i, t, *_ in data:
        text[i].append(WORD.findall(t or ""))
    spans = substring_dedup.duplicate_spans(odd.frame(spark, data), 6).collect()
    assert spans
    for s in spans:
        own = [w[s.first_word : s.first_word + s.words] for w in text[s.doc_id]]
        there = [w[s.ref_word : s.ref_word + s.words] for w in text[s.ref_doc_id]]
        assert any(x == y and len(x) == s.words for x in own for y in there)
    assert substring_dedup.without_duplicates(odd.frame(spark, []), 5).collect() == []


def test_factors_follow_words():
    w = [b"%d" % i for i in range(40)]
    near, far = w[5:20] + [b"x"] * 9, w[12:30]
    # the longest stretch wins, and a window across the factor's end starts the next one
    found = [(7, 0, near, [(5, 3, 0)]), (8, 0, far, [(12, 2, 0), (17, 1, 5)])]
    assert substring_dedup.greedy_factors(w, found, 4) == [(5, 15, 7, 0), (17, 13, 8, 5)]
    # a seed whose words aren't equal gives nothing, and its later windows still count
    wrong = [(9, 0, [b"y", b"z", *w[2:9]], [(0, 5, 0)])]
    assert substring_dedup.greedy_factors(w, wrong, 4) == [(2, 7, 9, 2)]
    assert substring_dedup.greedy_factors(w, [(9, 0, [b"q"] * 30, [(0, 5, 0)])], 4) == []


@pytest.mark.parametrize("size", [80, 6])
def test_windows_of_any_size_and_hot_places(spark, monkeypatch, size):
    monkeypatch.setattr(common, "HOT_LEAST", 4)
    monkeypatch.setattr(substring_dedup, "PLACES", 10)
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(100)]
    data = odd.rows(4) + [(8000 + i, " ".join([f"n{rng.random()}"] + passage[rng.randrange(10) :] + passage[: rng.randrange(90)]), None, None, 1) for i in range(30)]
    got = substring_dedup.without_duplicates(odd.clashing(odd.frame(spark, data)), size)
    assert ordered(r[:4] for r in got.collect()) == brute_passages(data, size)


def test_one_copy_is_one_factor(spark):
    rng = random.Random(8)
    passage = [f"w{rng.randrange(10**6)}" for _ in range(1000)]
    data = [(1, " ".join(["a b c", *passage, "d"]), None, None, 1), (2, " ".join([f"x{i}" for i in range(77)] + passage), None, None, 1), (3, "other words", None, None, 1)]
    spans = substring_dedup.duplicate_spans(odd.frame(spark, data), 35).collect()
    assert ordered(spans) == [(1, 3, 1000, 2, 77), (2, 77, 1000, 1, 3)]


def test_hashes_hold_against_chosen_texts(spark):
    """Thue-Morse words and sequences, which meet in any polynomial modulo a power of two."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    one, two = ("".join("ab"[b ^ k] for b in bits[:1024]) for k in (0, 1))
    data = [(1, one, None, None, 1), (2, two, None, None, 1)]
    assert [r.component_id for r in ngram_join.near_duplicates(odd.frame(spark, data), 3, 90).sort("doc_id").collect()] == [1, 2]
    seq = [" ".join(("ab", "cd")[b ^ k] for b in bits) for k in (0, 1)]
    words = [" ".join([one] * 20 + [f"{k}"] + [two] * 20) for k in (0, 1)] + [" ".join([two] * 20 + ["2"] + [one] * 20)]
    data = [(i, t, None, None, 1) for i, t in enumerate([seq[0], seq[1], seq[0], seq[1], *words])]
    got = substring_dedup.without_duplicates(odd.frame(spark, data), 35)
    assert ordered(r[:4] for r in got.collect()) == brute_passages(data, 35)


def test_equal_rows_of_one_key_are_dealt_to_all_tasks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(20_000).select("id", F.lit(7).alias("k"), F.lit(5).alias("mark"), F.lit(0).alias("first"))
    side = spark.createDataFrame([(7, 20_000), (8, 1)], "k int, n long")
    for by in (("id",), ("id", "first"), ("id", "mark")):
        dealt = common.spread_join(rows, side, ["k"], "n", by=by)
        found = dealt.hint("merge").groupBy(F.pmod(F.xxhash64(*by), F.lit(20_000 // common.HOT_LEAST + 1)).alias("salt")).count().collect()
        assert dealt.count() == 20_000 and max(r["count"] for r in found) < 2 * 20_000 / len(found)
