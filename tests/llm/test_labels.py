"""Language ID, URL filter and PII."""

import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq

from vellum.llm import language_id, pii, url_filter

from . import odd

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in language_id.identified(odd.clashing(docs)).collect()}
    lang = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "lang"]).to_pylist()}
    held = [i for i in got if got[i].held_out]
    assert 0.25 < len(held) / len(got) < 0.42
    assert np.mean([got[i].lang_pred == lang[i] for i in held]) > 0.97
    assert sum(r.rejected for r in got.values()) <= 0.01 * len(got) and all(0 <= r.score <= 1 for r in got.values())


def test_odd_texts_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    data = [(1, None, None, None, 1), (2, "123 !!", None, None, 1), (3, "", None, None, 1), (None, "the and of that", None, None, 1), (4, "Привет мир, это другой язык. " * 60, None, None, 1), (5, "the and of that", None, None, 1)]
    got = {r.doc_id: r for r in language_id.identify(odd.frame(spark, data), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].score == 0 and got[i].rejected for i in (1, 2, 3))
    assert got[4].rejected and got[4].lang_pred != "und" and not got[5].rejected and got[None].lang_pred == got[5].lang_pred
    none = language_id.fit(odd.frame(spark, []))
    assert [r.lang_pred for r in language_id.identify(odd.frame(spark, data[-1:]), none).collect()] == ["und"]
    assert language_id.identify(odd.frame(spark, []), model).collect() == []


def test_kept_rows_are_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    kept = language_id.keep_identified(docs)
    assert kept.columns == docs.columns and 295 <= kept.count() <= 300


def test_long_texts_are_counted_whole():
    text = "abc déf " * 50
    assert (language_id.counts([text, "x", text], at_once=64) == language_id.counts([text, "x", text])).all()


def brute_url(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *((max(fit)[3], max(fit)[4]) if fit else (None, "allow")))


def test_rules(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "www.Example.COM", "aexample.com", "x.net", "example.net", "org", "a.b.org", "", "example.com:80", "user@example.com"]
    paths = ["/en/", "/en/7", "/en/71?x", "/en", "/de/8/", "/de/", "/es/#/en/", "", "?/en/", "/EN/7"]
    urls = [f"{rng.choice(['http', 'https', '', 'x://y'])}{rng.choice(['://', ':', '//'])}{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "://", "http://example.com\n/en/7", "http://ÀB.com/en/"]
    df = spark.createDataFrame([(None if i == 3 else i // 2, u) for i, u in enumerate(urls)], "page_id long, url string")
    for rules in (url_filter.RULES, (), (("com", "", "block"), ("com", "", "allow"), ("b.org", "/es/", "allow"), ("org", "/es/", "block"))):
        rows = url_filter.judge(odd.clashing(df.withColumnRenamed("url", "u")).drop("url").withColumnRenamed("u", "url"), url_filter.rules_frame(spark, rules))
        got = sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in rows.collect())
        want = rules if rules != (("com", "", "block"), ("com", "", "allow"), ("b.org", "/es/", "allow"), ("org", "/es/", "block")) else (("com", "", "block"), *rules[2:])
        assert got == sorted((str(None if i == 3 else i // 2), b[0], b[1], str(b[2]), b[3]) for i, u in enumerate(urls) for b in [brute_url(u, want)])
    assert url_filter.judge(df.limit(0), url_filter.rules_frame(spark)).collect() == []


def test_bloom_has_no_false_negatives(spark):
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, 5000)
    bloom = url_filter.build(spark.createDataFrame([(int(k),) for k in keys], "k long"))
    assert bloom.might_hold(keys).all()
    assert bloom.might_hold(np.random.default_rng(2).integers(-(2**63), 2**63, 20000)).mean() < 0.01


def luhn(d):
    return sum(n if i % 2 == 0 else n * 2 - 9 * (n > 4) for i, n in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    spans = [[(k, m.start(), m.end()) for m in re.finditer(p, t) if ok(m[0])] for k, p, ok in kinds]
    return [len(x) for x in spans], ",".join(f"{k}:{s}:{e}" for x in spans for k, s, e in x)


def brute_masked(t):
    """Base spans as masks; overlapping ones are one, of the kind of the first."""
    kinds = ["email", "ip", "card", "phone"]
    spans = sorted((int(s), int(e), kinds.index(k)) for k, s, e in (x.split(":") for x in brute_pii(t)[1].split(",") if x))
    out, at = [], 0
    for s, e, k in spans:
        if s >= at or not out:
            out += [t[at:s], f"<{kinds[k]}>"]
        at = max(at, e)
    return "".join([*out, t[at:]])


def test_masks_of_odd_texts(spark):
    rng = random.Random(8)
    data = odd.rows(7) + [(20000 + i, "".join(rng.choice("aZ0911111@@.. ()+-é😀\n") for _ in range(rng.randint(0, 60))), None, None, 1) for i in range(400)]
    data += [(30000, "+4111 1111 1111 1111 1", None, None, 1), (30001, "x@1.2.3.4 1.2.3.4@a.b", None, None, 1), (30001, "x@1.2.3.4 1.2.3.4@a.b", None, None, 1), (None, "a@b.c", None, None, 1)]
    docs = odd.clashing(odd.frame(spark, data))
    out = pii.masked(docs)
    assert out.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(((i, None if t is None else brute_masked(t)) for i, t, *_ in data), key=key)
    assert pii.masked(docs.limit(0)).collect() == []


def test_base_spans(spark):
    rng = random.Random(6)
    al = list("aZ09._%+-@@.. ()1234é😀\n")
    data = odd.rows(6) + [(20000 + i, "".join(rng.choice(al) for _ in range(rng.randint(0, 70))), None, None, 1) for i in range(800)]
    data += [(30000 + i, t, None, None, 1) for i, t in enumerate(["1" * 30000, "a" * 30000, "a." * 15000 + "@", "+1 " + "(" * 20000, "1." * 10000, "a@" + "b." * 10000, "a@b.c@d.e a@b.c_x@d.e 1.2.3.4.5.6.7.8", "256.1.1.1 01.002.3.4"])]
    rows = pii.personal_data(odd.clashing(odd.frame(spark, data))).collect()
    got = sorted((str(r.doc_id), [r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) for r in rows)
    assert got == sorted((str(i), n, hashlib.sha256(s.encode()).hexdigest()) for i, t, *_ in data for n, s in [brute_pii(t)])
    assert pii.personal_data(odd.frame(spark, [])).collect() == []


def test_a_log_of_many_addresses(spark):
    rng = random.Random(11)
    lines = [f"{i} GET 10.{rng.randrange(300)}.0.{i % 256} {rng.randrange(10**6)} é" for i in range(15_000)]
    text = "\n".join(lines)
    (r,) = pii.found(odd.frame(spark, [(1, text, None, None, 1)])).selectExpr("size(email)", "size(ip)", "size(card)", "size(phone)").collect()
    assert list(r) == brute_pii(text)[0] and r[1] > 10_000


def test_recall_on_planted_identifiers(spark):
    """Unseen identifiers beside cue words on either side, among numbers of the same shape beside other words."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    unlike = lambda: next(x for x in iter(lambda: str(rng.randrange(10**15, 10**16)), "") if not luhn(x))
    data, planted, spurious = [], {}, set()
    cues = ("pay with card {}", "{} expires soon", "my visa number: {}", "the {} account")
    for i in range(1200):
        before, after = " ".join(word() for _ in range(6)), " ".join(word() for _ in range(6))
        if i % 4 == 3:  # other numbers in other places
            data.append((i, f"{before} order {unlike()} {after}", None, None, 1))
            spurious.add(i)
            continue
        cue = cues[i // 4 % 4]
        number = unlike() if i % 30 == 0 else card(rng)
        start = f"{before} {cue}".index("{}")
        data.append((i, f"{before} {cue.format(number)} {after}", None, None, 1))
        if not luhn(number):
            planted[i] = f"card:{start}:{start + 16}"
    rows = {r.doc_id: r for r in pii.personal_data(odd.frame(spark, data)).collect()}
    found = {i for i in planted if rows[i].spans == planted[i]}
    wrong = [i for i, r in rows.items() if r.n_new and i not in planted]
    assert len(planted) >= 20 and len(found) >= 0.9 * len(planted), (len(found), len(planted))
    assert not wrong and not [i for i in spurious if rows[i].spans]


def card(rng):
    d = "".join(rng.choice("0123456789") for _ in range(15))
    return next(d + c for c in "0123456789" if luhn(d + c))


def test_contexts_find_more(spark):
    rng = random.Random(7)
    data = [(i, f"some words account {card(rng)} and more", None, None, 1) for i in range(40)]
    data += [(100, "his account 1234567812345678, closed", None, None, 1), (101, "a total 1234567812345678 was", None, None, 1), (102, "account holders only", None, None, 1)]
    got = {r.doc_id: r.spans for r in pii.personal_data(odd.frame(spark, data)).collect() if r.doc_id >= 100}
    assert got == {100: "card:12:28", 101: "", 102: ""}
    text = {r.doc_id: r.text for r in pii.masked(odd.frame(spark, data)).collect()}
    assert text[100] == "his account <card>, closed" and text[101] == data[41][1] and text[0] == "some words account <card> and more"


def test_identifiers_of_several_tokens(spark):
    rng = random.Random(8)
    spaced = lambda d: " ".join(d[k : k + 4] for k in range(0, 16, 4))
    data = [(i, f"words account {spaced(card(rng))} and more", None, None, 1) for i in range(40)]
    data += [(50 + i, f"my phone +1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} is", None, None, 1) for i in range(40)]
    texts = ["his account 1234 5678 1234 5678, closed", "my phone (555) 123-4567.", "a total 1234 5678 1234 5678 was (555) 123-4567", "my account 1234 5678 1234 5678 12 times", "phone (555) 123-456x"]
    data += [(100 + i, t, None, None, 1) for i, t in enumerate(texts)]
    got = {r.doc_id: r.spans for r in pii.personal_data(odd.frame(spark, data)).collect() if r.doc_id >= 100}
    assert got == {100: "card:12:31", 101: "phone:9:23", 102: "", 103: "card:11:30", 104: ""}
    text = {r.doc_id: r.text for r in pii.masked(odd.frame(spark, data)).collect()}
    assert text[100] == "his account <card>, closed" and text[101] == "my phone <phone>." and text[102] == texts[2]


def test_found_instances_make_patterns(spark):
    rng = random.Random(9)
    wrong = [f"12345678{k:02}345678" for k in range(90) if not luhn(f"12345678{k:02}345678")][:12]
    data = [(i, f"some account {card(rng)} and", None, None, 1) for i in range(200)]
    data += [(300 + i, f"an account {w} or konto {w} too", None, None, 1) for i, w in enumerate(wrong[:11])]
    data += [(400, f"only konto {wrong[11]} here", None, None, 1)]
    got = {r.doc_id: r.spans for r in pii.personal_data(odd.frame(spark, data)).collect()}
    assert got[300] == "card:11:27,card:37:53" and got[400] == "card:11:27"


def test_masks_keep_rows(spark):
    df = odd.frame(spark)
    masked = pii.masked(df)
    assert masked.columns == df.columns and masked.count() == df.count()
    assert "Mail <email> or <phone>, <ip>; <card>" in {r.text for r in masked.collect()}
