"""The stored inverted index and the blocked nearest vectors against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import dense, lexical_index, retrieval

KEY = ["doc", "page"]


def chunk_rows(rng, ids):
    words = [f"w{k}" for k in range(60)]
    return [(f"m{i % 3}" if i % 17 else None, f"d{i}", i % 4, None if i % 23 == 0 else " ".join(rng.choice(words) if rng.random() < 0.9 else "rare%d" % rng.randrange(40) for _ in range(rng.randint(0, 30)))) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, "matter string, doc string, page int, text string")


def asked(spark, rng, n=12):
    return spark.createDataFrame([(q, f"m{q % 3}", " ".join(["w%d" % rng.randrange(60) for _ in range(4)] + ["rare%d" % rng.randrange(40), "nowhere"])) for q in range(n)], "qid int, matter string, query string")


def plain(df):
    return sorted((r["qid"], r["matter"], r["doc"], r["page"], round(r["score"], 7), r["rank"]) for r in df.collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(lexical_index, "BLOCK_BITS", 3)


def test_index_ranks_as_brute_force_after_each_change(spark, tmp_path, small_blocks):
    rng = random.Random(4)
    path, q = f"file://{tmp_path}/index", asked(spark, random.Random(5))
    rows = chunk_rows(rng, range(300))
    assert lexical_index.build(frame(spark, rows), path, KEY) == 1

    def same(version=None):
        want = plain(retrieval.bm25_topk(q, frame(spark, rows), 7, KEY))
        assert plain(lexical_index.topk(q, path, 7, version=version)) == want and want

    same()
    first = plain(lexical_index.topk(q, path, 7))
    more = chunk_rows(rng, range(300, 420))
    rows += more
    assert lexical_index.append(frame(spark, more), path) == 2
    same()
    gone = {r[1] for r in rows[::5]}
    rows = [r for r in rows if r[1] not in gone]
    keys = [(f"m{m}", x, p) for x in gone for m in range(3) for p in range(4)] + [("m0", "not there", 1)]
    assert lexical_index.delete(spark.createDataFrame(keys, "matter string, doc string, page int"), path) == 3
    # chunks without a matter can't be named by it and stay
    rows += [r for r in chunk_rows(random.Random(4), range(300)) + more if r[1] in gone and r[0] is None]
    same()
    assert lexical_index.delete(spark.createDataFrame(keys, "matter string, doc string, page int"), path) == 4
    same()
    assert lexical_index.merge(spark, path) == 5
    same()
    assert plain(lexical_index.topk(q, path, 7, version=1)) == first


def test_index_reads_the_blocks_it_needs(spark, tmp_path, small_blocks):
    rare = [("m", f"d{i}", 0, "common " * 3 + ("needle needle needle" if i == 77 else "hay " * 5)) for i in range(400)]
    path = f"file://{tmp_path}/index"
    lexical_index.build(frame(spark, rare), path, KEY)
    q = spark.createDataFrame([(1, "m", "needle common")], "qid int, matter string, query string")
    search = lexical_index.Search(q, path, 1)
    assert [r["doc"] for r in search.topk().collect()] == ["d77"]
    assert search.rest.count() == 0 and search.ranges.where("first").count() == 1 and search.ranges.count() >= 50
    plan = search.postings()._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "").replace(" ", " ") or "PartitionFilters" in plan


def test_index_of_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    with pytest.raises(lexical_index.NoIndex):
        lexical_index.current(spark, path)
    lexical_index.build(frame(spark, []), path, KEY)
    assert lexical_index.topk(asked(spark, random.Random(1)), path, 3).collect() == []
    with pytest.raises(lexical_index.NoIndex):
        lexical_index.topk(asked(spark, random.Random(1)), path, 3, version=9)
    with pytest.raises(Exception, match="exist"):  # the index is there already
        lexical_index.build(frame(spark, []), path, KEY)


def brute(items, questions, k, scope, digits=9):
    out = []
    for qid, qs, qv in questions:
        if qv is None:
            continue
        near = sorted((round(float(((np.array(v) - np.array(qv)) ** 2).sum()), digits), i) for i, s, v in items if v is not None and (not scope or s == qs and s is not None))
        out += [(qid, i, d, n) for n, (d, i) in enumerate(near[:k])]
    return sorted(out)


@pytest.mark.parametrize("scope, product, block", [(None, 1 << 22, 1 << 22), ("s", 300, 200), (None, 100, 64)])
def test_dense_is_brute_force(spark, monkeypatch, scope, product, block):
    monkeypatch.setattr(dense, "PRODUCT", product)
    monkeypatch.setattr(dense, "BLOCK_BYTES", block)
    rng = random.Random(2)
    vec = lambda: [rng.choice([0.0, 0.5, 1.0, rng.random()]) for _ in range(6)]
    items = [(i, rng.choice(["a", "b", None]), None if i % 31 == 0 else vec()) for i in range(500)]
    items += [(1000 + i, "a", items[5][2]) for i in range(30)]
    asked = [(q, rng.choice(["a", "b", "z", None]), None if q == 3 else (items[5][2] if q == 4 else vec())) for q in range(9)]
    rows = spark.createDataFrame(items, "id long, s string, vector array<double>").withColumn("more", F.lit("x")).repartition(5)
    q = spark.createDataFrame(asked, "qid long, s string, vector array<double>")
    got = dense.dense_topk(q if scope else q.drop("s"), rows, 8, ["id"], scope=scope)
    assert set(got.columns) == {"id", "s", "more", "qid", "distance", "rank"}
    assert sorted((r.qid, r.id, round(r.distance, 9), r.rank) for r in got.collect()) == brute(items, asked, 8, scope)
    assert dense.dense_topk(q.limit(0), rows, 8, ["id"]).collect() == []
    assert dense.dense_topk(q.drop("s"), rows.limit(0), 8, ["id"]).collect() == []


def test_dense_refuses_vectors_of_other_widths(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<double>")
    with pytest.raises(Exception, match="widths"):
        dense.dense_topk(spark.createDataFrame([(1, [1.0])], "qid long, vector array<double>"), rows, 1, ["id"]).collect()
