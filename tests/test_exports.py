"""Exports, moves, imports within a matter, windows that overlap, and checks of review states."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.operators import chunking, facts, ingest, retention

KEY = "0123456789abcdef"
DOCS = "id long, matter_slug string, filename string, stored_path string, checksum string, status string, reason string"


def unzipped(rows):
    out = {}
    for r in rows:
        with zipfile.ZipFile(io.BytesIO(r.archive)) as z:
            assert len(z.namelist()) == r.files
            out |= {(r.matter, n): z.read(n) for n in z.namelist()}
    return out


@pytest.fixture
def export(spark, tmp_path):
    root = tmp_path / "kb"
    (root / "m").mkdir(parents=True)
    (tmp_path / "secret.txt").write_text("not yours")
    (tmp_path / "kbx").mkdir()
    (tmp_path / "kbx" / "near.txt").write_text("a folder whose name begins alike")
    (root / "m" / "a b.txt").write_text("plain")
    (root / "m" / "c.txt").write_bytes(b"other")
    sealed = spark.range(1).select(retention.sealed(F.lit(b"was sealed"), F.lit(KEY)).alias("x")).first().x
    (root / "m" / "s.bin").write_bytes(sealed)
    rows = [
        (1, "m", "a b.txt", f"{root}/m/a b.txt"), (2, "m", "../../a b.txt", f"{root}/m/c.txt"), (3, "m", "s.bin", f"file:{root}/m/s.bin"), (4, "m", "out.txt", f"{root}/../secret.txt"),
        (5, "m", "near.txt", f"{tmp_path}/kbx/near.txt"), (6, "n", "gone.txt", f"{root}/n/gone.txt"), (7, None, "x", f"{root}/m/c.txt"), (8, "m", None, None),
    ]
    docs = spark.createDataFrame([(*r, "c", "ready", None) for r in rows], DOCS)
    natives = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path", "content")
    said = spark.createDataFrame([("m", 1, 1, "second"), ("m", 1, 0, "first\nline"), ("n", 2, 0, None)], "matter_slug string, thread_id long, pos long, text string")
    audit = spark.createDataFrame([("m", 1, "e"), (None, 2, "e")], "matter_slug string, id long, event string")
    keys = spark.createDataFrame([("m", KEY)], "matter_slug string, key string")
    return retention.export_entries(docs, natives, str(root), said, audit, keys)


def test_an_export_is_whole_and_stays_below_its_root(export):
    got = unzipped(retention.archives(export).collect())
    assert {n: b for (m, n), b in got.items() if m == "m" and n.startswith("documents/")} == {"documents/a b.txt": b"plain", "documents/2-a b.txt": b"other", "documents/s.bin": b"was sealed"}
    assert got["m", "manifest/documents-0.jsonl"].count(b"\n") == 5 and b"secret" in got["m", "manifest/documents-0.jsonl"]
    assert [k in got["m", "chats/messages-0.jsonl"] for k in (b"first\\nline", b"second")] == [True, True] and got["m", "chats/messages-0.jsonl"].index(b"first") < got["m", "chats/messages-0.jsonl"].index(b"second")
    assert {n for m, n in got if m == "n"} == {"manifest/documents-0.jsonl", "chats/messages-0.jsonl"} and ("m", "manifest/audit-0.jsonl") in got
    assert b"not yours" not in b"".join(got.values()) and b"begins alike" not in b"".join(got.values())


def test_archives_are_bounded(spark):
    rows = spark.createDataFrame([("m", f"f{i}", bytes([i % 250]) * 1000) for i in range(200)] + [("n", "one", b""), ("o", "two", None)], "matter string, name string, body binary")
    parts = retention.archives(rows.where("matter <> 'o'"), size=40_000).collect()
    mine = [p for p in parts if p.matter == "m"]
    assert 5 <= len(mine) <= 10 and max(p.files for p in mine) <= 40 and len(unzipped(parts)) == 201
    assert retention.archives(rows.limit(0)).collect() == []


def test_manifests_come_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retention, "MANIFEST_ROWS", 10)
    rows = spark.range(25).select(F.lit("m").alias("matter_slug"), "id")
    assert sorted((r.name, r.n) for r in retention._lines(rows, "x", ["id"]).select("name", F.size(F.split(F.decode("body", "UTF-8"), "\n")).alias("n")).collect()) == [("x-0.jsonl", 10), ("x-1.jsonl", 10), ("x-2.jsonl", 5)]


def test_moves(spark):
    docs = spark.createDataFrame([(1, "m", "a.txt", "", "s1", "ready", "r"), (2, "n", "a.txt", "", "s2", "ready", "r"), (3, "m", "b.txt", "", "s3", "ready", "r"), (4, "h", "c.txt", "", "s4", "ready", None), (5, None, "d.txt", "", None, "ready", None)], DOCS)
    chunks = spark.createDataFrame([("m", "a.txt", 1), ("m", "b.txt", 2), ("n", "a.txt", 3)], "matter string, source_filename string, n long")
    matters = spark.createDataFrame([("m",), ("n",), ("h",)], "slug string")
    holds = spark.createDataFrame([(1, "h", "why", None), (2, "m", "over", "2024")], "id long, matter_slug string, reason string, released string")
    move = lambda *rows: retention.move_documents(docs, chunks, matters, holds, spark.createDataFrame(rows, "doc_id long, matter string"))
    rows, left = move((1, "n"), (3, "m"), (5, "m"))
    assert {r.id: (r.matter_slug, r.filename, r.status, r.reason) for r in rows.collect()} == {1: ("n", "a-1.txt", "queued", None), 2: ("n", "a.txt", "ready", "r"), 3: ("m", "b.txt", "ready", "r"), 4: ("h", "c.txt", "ready", None), 5: ("m", "d.txt", "queued", None)}
    assert rows.columns == docs.columns and sorted(r.n for r in left.collect()) == [2, 3]
    with pytest.raises(retention.OnHold):
        move((1, "n"), (4, "m"))
    assert {r.id: r.matter_slug for r in move((4, "h"))[0].collect()}[4] == "h"
    for bad in ([(9, "m")], [(1, "nowhere")], [(1, "m"), (1, "n")]):
        with pytest.raises(ValueError):
            move(*bad)


def test_copies_count_within_a_matter(spark):
    listed = spark.createDataFrame([(1, "a", "a.txt", "s1", 5), (1, "b", "b.txt", "s2", 5)], "connection_id long, source_id string, filename string, sha256 string, size long")
    ledger = listed.limit(0).select("connection_id", "source_id")
    stored = spark.createDataFrame([("s1", "other"), ("s2", "unfiled")], "checksum string, matter_slug string")
    state = lambda s: {r.source_id: r.state for r in ingest.import_states(listed, ledger, s).collect()}
    assert state(stored) == {"a": "imported", "b": "duplicate"} and state(stored.drop("matter_slug")) == {"a": "duplicate", "b": "duplicate"}


def test_overlapping_windows_list_once(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01", "x"), (1, "a", "2024-06", "y"), (1, "a", "2024-06", "y"), (1, "b", None, "z"), (2, "a", "2024-01", "w")], "connection_id long, source_id string, since string, name string")
    assert sorted((r.connection_id, r.source_id, r.name) for r in ingest.listed_once(rows).collect()) == [(1, "a", "y"), (1, "b", "z"), (2, "a", "w")]


def test_reviews_are_of_known_states(spark):
    reviews = spark.createDataFrame([("m", "k", "confirmed", None)], "matter_slug string, fact_key string, status string, confirmed_date string")
    for bad in (("m", "k", "maybe", None), (None, "k", "confirmed", None)):
        with pytest.raises(ValueError):
            facts.set_reviews(reviews, spark.createDataFrame([bad], reviews.schema))
    assert [r.status for r in facts.set_reviews(reviews, spark.createDataFrame([("m", "k", "dismissed", None)], reviews.schema)).collect()] == ["dismissed"]


def test_layout_headers_of_another_matter_do_not_count(spark):
    pages = spark.createDataFrame([("m", "f", 1, "# The Heading\nbody"), ("n", "f", 1, "# The Heading\nbody")], "matter string, source_filename string, page_number long, page_text string")
    known = spark.createDataFrame([("m", "f", "the heading")], "matter string, source_filename string, header string")
    assert {r.matter: r.section_detected for r in chunking.heading_sections(pages, known).collect()} == {"m": True, "n": False}
