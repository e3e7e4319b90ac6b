"""Each stage on its own input, and the whole run, against brute force on a small table."""

import corpus_pipeline as P
from vellum.llm import packing

from . import odd
from .test_dedup import brute_exact, brute_near
from .test_labels import brute_masked


def test_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, columns = docs.collect(), docs.columns
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        data = [tuple(r) for r in before]
        ids = sorted(r.doc_id for r in after)
        if name == "language_id":
            assert len(after) >= 0.99 * len(before)
        elif name == "exact_dedup":
            assert ids == sorted(r[0] for r in brute_exact(data) if r[3])
        elif name == "ngram_jaccard_join":
            assert ids == sorted(r[0] for r in brute_near(data, 5, 80) if r[0] == r[2])
        elif name == "pii":
            assert ids == sorted(r[0] for r in data)
            text = {r.doc_id: r.text for r in after}
            assert text == {r.doc_id: brute_masked(r.text) for r in before}
            assert all(r.n_chars == len(r.text) for r in after)
        before = after
    rows = P.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in before} and max(r.offset + r.length for r in rows) <= packing.CAPACITY
    again = P.run(spark, "/root/testdata/sf0.001").collect()
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sum(r.length for r in again) == sum(r.length for r in rows) and {key(r)[0] for r in again} == {key(r)[0] for r in rows}


def test_an_empty_table_passes_through(spark):
    docs = odd.frame(spark, [])
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.collect() == []
