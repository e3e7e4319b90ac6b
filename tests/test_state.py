"""Catalog, ingest, facts, review, sources, sinks and streams."""

import datetime as dt
import io
import os
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from vellum.operators import catalog, chunking, evals, facts, ingest, retention, review
from vellum.sources import connectors, extract, pages as P, sinks, transcripts
from vellum.streaming import watch


def test_formats(spark, tmp_path):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    files = {
        "a.txt": b"plain", "b.html": b"<style>p{}</style><p>Hi &amp; bye</p>", "c.vtt": b"WEBVTT\n\n1\n01:02.500 --> 01:03.000\n<v Ann>Hello\nthere\n", "d.csv": b'x, "a\nb" ,z\n1,2,3\n',
        "e.json": b'{"k": ["\xc3\xa9"]}', "f.json": b"{broken", "g.eml": b"From: a@b.c\nSubject: S\n\nBody", "h.docx": z.getvalue(), "i.exe": b"x", "j.txt": b"\xff\xfe",
    }
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    got = {r.source_filename: r for r in extract.extract(extract.read_files(spark, str(tmp_path))).collect()}
    text = {n: r.page_text for n, r in got.items()}
    assert text["a.txt"] == "plain" and text["b.html"] == "Hi & bye" and text["c.vtt"] == "[00:01:02] Ann: Hello\nthere" and text["h.docx"] == "One\nTwo"
    assert text["d.csv"].endswith("1 | 2 | 3") and text["e.json"] == '{\n  "k": [\n    "é"\n  ]\n}' and text["f.json"] == "{broken" and text["g.eml"] == "From: a@b.c\nSubject: S\n\nBody"
    assert got["i.exe"].error and got["j.txt"].error and text["i.exe"] is None


def test_ingest_states(spark):
    rows = [("a", "1", None, False), ("b", "1", None, False), ("c", "2", "bad", False), ("d", "2", "bad", False), ("e", "3", None, True), ("f", "9", None, False)]
    df = spark.createDataFrame(rows, "filename string, sha256 string, error string, ocr_failed boolean")
    got = {r.filename: r.status for r in ingest.ingest_states(df, spark.createDataFrame([("9",)], "sha256 string")).collect()}
    assert got == {"a": "ingested", "b": "duplicate", "c": "quarantined", "d": "quarantined", "e": "needs_review", "f": "duplicate"}


def test_uploads_get_free_names(spark):
    ups = spark.createDataFrame([("m", "x/r.txt", "s2", 5), ("m", "r.txt", "s1", 5), ("m", "q.exe", "s", 5), ("m", ".txt", "s", 5), ("m", "r.txt", "s3", 0)], "matter string, filename string, sha256 string, size long")
    have = spark.createDataFrame([("m", "r.txt", "s1")], "matter string, filename string, sha256 string")
    got = {(r.filename, r.sha256): (r.rejected, r.stored_name) for r in ingest.upload_states(ups, have).collect()}
    assert got == {("x/r.txt", "s2"): ("bad name", None), ("r.txt", "s1"): (None, "r.txt"), ("q.exe", "s"): ("unsupported type", None), (".txt", "s"): ("bad name", None), ("r.txt", "s3"): ("empty", None)}


def test_mailbox_is_walked_past_its_cap(spark):
    items = spark.createDataFrame([(1, f"u{i}", i) for i in range(25)], "connection_id long, source_id string, uid long")
    ledger = items.limit(0).select("connection_id", "source_id")
    sizes = []
    for _ in range(4):
        done = ingest.capped_pass(items, ledger, 10).select("connection_id", "source_id").collect()
        sizes.append(len(done))
        ledger = spark.createDataFrame(ledger.collect() + done, "connection_id long, source_id string")
    assert sizes == [10, 10, 5, 0]


def test_sync_due(spark):
    rows = [(1, True, False, "2024-01-01T00:00:00"), (2, True, False, "2024-01-01T01:45:00"), (3, True, False, "soon"), (4, False, False, None), (5, True, True, None)]
    df = spark.createDataFrame(rows, "id long, sync_on boolean, running boolean, last_sync string")
    assert {r.id for r in ingest.sync_due(df, F.to_timestamp(F.lit("2024-01-01 02:00:00"))).collect()} == {1, 3}


def test_audit_chain(spark):
    df = spark.createDataFrame([(i, f"t{i}", "e", None, f"d{i}") for i in range(1, 6)], "id long, ts string, event string, matter_slug string, detail string")
    chain = catalog.audit_chain(df)
    assert catalog.audit_breaks(chain).isEmpty()
    assert [r.id for r in catalog.audit_breaks(chain.withColumn("detail", F.when(F.col("id") == 3, "x").otherwise(F.col("detail")))).collect()] == [3]
    assert [r.id for r in catalog.audit_breaks(chain.where("id <> 3")).collect()] == [4]


def test_upserts_and_holds(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert sorted(map(tuple, catalog.upsert(t, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, catalog.insert_new(t, new, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "d")]
    with pytest.raises(ValueError):
        catalog.upsert(t, new.unionByName(new), ["k"])
    holds = spark.createDataFrame([(1, "m", None, "why"), (2, "n", "2024", "x")], "id long, matter_slug string, released string, reason string")
    docs = {"documents": spark.createDataFrame([("m",), ("n",)], "matter_slug string")}
    with pytest.raises(retention.OnHold):
        retention.dispose(docs, holds, "m")
    assert retention.dispose(docs, holds, "n")["documents"].collect()[0][0] == "m"
    with pytest.raises(ValueError):
        retention.erase_all(docs, holds.limit(0), "yes")


def test_fact_gate(spark):
    raw = [(1, 0, 0, "date_event", 2, "on 1 May 2024", {"purpose": "deadline", "label": "l", "date_text": "1 May 2024", "date_kind": "explicit", "date_iso": "2024-05-01"}), (1, 0, 1, "party", 9, "Acme Ltd", {}), (1, 0, 2, "amount", 1, "not there", {"value": "1"}), (1, 0, 3, "amount", 1, "Acme", {}),
           (1, 0, 4, "date_event", 1, "30 days after", {"kind": "obligation", "label": "l", "date_text": "30 days", "date_kind": "relative", "date_iso": "2024-01-01"})]
    pages = [(1, 0, 1, "Acme Ltd pays 30 days after notice"), (1, 0, 2, "due on 1 May\n2024.")]
    got = facts.gate_facts(spark.createDataFrame(raw, "doc_id long, group_no int, pos int, fact_type string, page long, span string, raw map<string,string>"), spark.createDataFrame(pages, "doc_id long, group_no int, page_number long, page_text string")).collect()
    seen = {r.span: (r.page, r.char_start, r.char_end, {k: v for k, v in r.value.items() if v}) for r in got}
    assert seen == {
        "on 1 May 2024": (2, 4, 17, {"kind": "deadline", "label": "l", "date_text": "1 May 2024", "date_iso": "2024-05-01", "date_kind": "explicit"}),
        "Acme Ltd": (1, 0, 8, {"name": "Acme Ltd"}),
        "30 days after": (1, 14, 27, {"kind": "obligation", "label": "l", "date_text": "30 days", "date_kind": "relative"}),
    }


def test_reviews(spark):
    r = spark.createDataFrame([("m", "k1", "confirmed", "2024-01-02"), ("m", "k2", "dismissed", None)], "matter_slug string, fact_key string, status string, confirmed_date string")
    gone = facts.set_reviews(r, spark.createDataFrame([("m", "k1", None, None)], r.schema))
    assert [x.fact_key for x in gone.collect()] == ["k2"]
    f = spark.createDataFrame([("m", "k1")], "matter_slug string, fact_key string")
    assert [x.fact_key for x in facts.pruned_reviews(r, f).collect()] == ["k1"] and [x.fact_key for x in facts.orphaned_reviews(r, f).collect()] == ["k2"]


def test_absence_and_small_talk(spark):
    rows = [("m", 1, i, f"d{i}", True, i == 2) for i in range(4)] + [("m", 2, i, f"d{i}", i != 1, False) for i in range(3)] + [("m", 3, 0, "d0", True, False)]
    got = {r.question_id: (r.status, r.checked, r.total) for r in review.absence(spark.createDataFrame(rows, "matter string, question_id long, doc_order long, filename string, ran boolean, found boolean")).collect()}
    assert got == {1: ("found", 3, 4), 2: ("not_confirmed", 2, 3), 3: ("potentially_missing", 1, 1)}
    m = spark.createDataFrame([("Hello there!",), ("What’s up?",), ("hello, what is the rent",), (None,)], "m string")
    assert [r[0] for r in m.select(review.is_small_talk(F.col("m"))).collect()] == [True, True, False, False]


def test_transcripts(spark):
    page = "\n".join(f"{i:>2}  Q. word {i}" for i in range(1, 21))
    texts = spark.createDataFrame([(1, page + "\f" + "cover page\nwithout numbers"), (2, "x\nPage 4\n" + page), (3, page + "\n" + page)], "doc_id long, text string")
    lines = transcripts.numbered_lines(transcripts.text_pages(texts))
    assert [r.doc_id for r in transcripts.condensed_documents(lines).collect()] == [3]
    clean, spans = transcripts.clean_pages(lines.where("doc_id < 3"))
    got = {(r.doc_id, r.page_number): r for r in clean.collect()}
    assert got[1, 1].page_text.startswith("Q. word 1\nQ. word 2") and got[1, 1].numbered and not got[1, 2].numbered and (2, 4) in got
    for r in spans.join(clean.withColumnRenamed("page_number", "page"), ["doc_id", "page"]).collect():
        assert r.page_text[r.char_start : r.char_end] == f"Q. word {r.line}"


def test_pages(spark):
    words = spark.createDataFrame([(1, 1, 1, 1, 1, "b", 90.0), (1, 1, 1, 1, 0, "a", 70.0), (1, 1, 1, 2, 0, "c", 80.0), (1, 1, 1, 2, 1, "x", -1.0)], "page_id long, block int, par int, line int, word int, text string, conf double")
    assert tuple(P.ocr_lines(words).first()) == (1, "a b\nc", 80.0)
    m = P.merged_text(spark.createDataFrame([(1, "One\nTwo", "two\nThree\nthree"), (2, "x", "x")], "page_id long, page_text string, ocr_text string"))
    assert {r.page_id: r.page_text for r in m.collect()} == {1: "One\nTwo\nThree", 2: "x"}
    r = spark.createDataFrame([("a" * 30, 0.1), ("", 0.9), ("a" * 30, 0.9), ("", 0.1)], "t string, s double")
    assert [x[0] for x in r.select(P.route(F.col("t"), F.col("s"))).collect()] == ["pymupdf", "tesseract", "mixed", "pymupdf"]


def test_store(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    c = spark.createDataFrame([("m", "f", "1"), ("m", "g", "2"), ("n", "f", "3")], "matter string, source_filename string, text string")
    sinks.write_chunks(c, path)
    sinks.replace_documents(spark, path, spark.createDataFrame([("m", "f", "new")], c.schema), staging)
    rows = lambda: sorted((r.matter, r.source_filename, r.text) for r in spark.read.parquet(path).collect())
    assert rows() == [("m", "f", "new"), ("m", "g", "2"), ("n", "f", "3")]
    sinks.delete_document(spark, path, "n", "f", staging)
    sinks.compact(spark, path, staging)
    assert rows() == [("m", "f", "new"), ("m", "g", "2")]
    with pytest.raises(ValueError):
        sinks.append_chunks(c.withColumn("extra", F.lit(1)), path)


def test_calendar(spark):
    label = "Pay; now, " + "é" * 80
    rows = [("m", "k1", 1, 1, 0, "date_event", {"kind": "deadline", "label": label}, "s", "confirmed", "2024-05-01"), ("m", "k2", 1, 1, 1, "date_event", {"kind": "deadline", "label": "x"}, "s", None, None), ("m", "k3", 1, 1, 2, "date_event", {"kind": "event", "label": "x"}, "s", "confirmed", "2024-05-01")]
    (e,) = sinks.calendar_events(spark.createDataFrame(rows, "matter_slug string, fact_key string, doc_id long, page long, char_start long, fact_type string, value map<string,string>, span string, status string, confirmed_date string")).collect()
    assert "DTSTART;VALUE=DATE:20240501" in e.event and "Pay\\; now\\, " in e.event and all(len(x.encode()) <= 75 for x in e.event.split("\r\n"))


def test_golden_and_latency(spark):
    t = spark.createDataFrame([("a", float(i)) for i in range(1, 12)], "k string, v double")
    r = evals.latency(t, ["k"], "v").first()
    assert (r.mean, r.median, r.p95) == (6.0, 6.0, 11.0)


def test_connector_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for p in ("a.txt", ".hidden", "sub/b.txt"):
        (tmp_path / p).write_bytes(b"x")
    spark.dataSource.register(connectors.ItemSource)
    got = spark.read.format("vellum_items").option("service", "folder").option("path", str(tmp_path)).load()
    assert sorted(r.name for r in got.collect()) == ["a.txt", "b.txt"] and connectors.listed_services() == [("Files", "folder")]


def test_changed_files_come_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_bytes(b"one")
    (folder / "b.txt").write_bytes(b"one")
    q = watch.changed_contents(watch.watch(spark, str(folder), 0)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        (folder / "a.txt").write_bytes(b"two")
        later = time.time() + 5
        os.utime(folder / "a.txt", (later - 3, later - 3))
        deadline = time.time() + 60
        while time.time() < deadline and spark.table("seen").count() < 2:
            q.processAllAvailable()
            time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(bytes(r.content) for r in spark.table("seen").collect()) == [b"one", b"two"]


def test_windowed_counts(spark):
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "a", 1.0) for m in (1, 30, 59)] + [(dt.datetime(2024, 1, 1, 1, 0), "a", 2.0)], "ts timestamp, event_type string, value double")
    assert sorted((r.n, r.total) for r in watch.windowed_counts(e).collect()) == [(1, 2.0), (3, 3.0)]


def test_upload_numbers_are_free(spark):
    names = "matter string, filename string, sha256 string"
    have = spark.createDataFrame([("m", "a.txt", "s0"), ("m", "a-1.txt", "s1"), ("m", "b.txt", "s0")], names)
    ups = spark.createDataFrame([("m", "a.txt", "new", 5), ("m", "a.txt", "other", 5), ("m", "a.txt", "s1", 5), ("m", "b.txt", "x", 5), ("m", "b-1.txt", "y", 5), ("n", "a.txt", "z", 5)], names + ", size long")
    got = {(r.matter, r.filename, r.sha256): r.stored_name for r in ingest.upload_states(ups, have).collect()}
    assert got == {("m", "a.txt", "new"): "a-2.txt", ("m", "a.txt", "other"): "a-3.txt", ("m", "a.txt", "s1"): "a-1.txt", ("m", "b.txt", "x"): "b-2.txt", ("m", "b-1.txt", "y"): "b-1.txt", ("n", "a.txt", "z"): "a.txt"}


def test_white_space_of_any_kind_is_no_text(spark):
    blank = spark.createDataFrame([("m", "f", 1, "\n" * 30, 0.9)], "matter string, source_filename string, page_number long, page_text string, share double")
    assert blank.select(P.route(F.col("page_text"), F.col("share"))).first()[0] == "tesseract"
    assert chunking.scanned_documents(blank).first().scanned and chunking.transcript_chunks(blank.withColumn("numbered", F.lit(True))).count() == 0
    assert blank.select(P.ocr_verdict(F.col("page_text"), F.lit(90.0))).first()[0] == "ocr found no text"


def test_disposal_keeps_rows_of_no_matter(spark):
    t = spark.createDataFrame([("x", 1), (None, 2), ("y", 3)], "matter_slug string, n long")
    holds = spark.createDataFrame([], "id long, matter_slug string, reason string, released string")
    assert sorted(r.n for r in retention.dispose({"t": t}, holds, "x")["t"].collect()) == [2, 3]


def test_a_document_without_chunks_loses_its_old_ones(spark, tmp_path):
    path, staging = str(tmp_path / "c"), str(tmp_path / "s")
    c = spark.createDataFrame([("m", "f", "old"), ("m", "g", "stays"), ("n", "h", "old")], "matter string, source_filename string, text string")
    sinks.write_chunks(c, path)
    gone = spark.createDataFrame([("m", "f"), ("n", "h")], "matter string, source_filename string")
    sinks.replace_documents(spark, path, c.limit(0), staging, gone)
    assert [tuple(r) for r in spark.read.parquet(path).select("matter", "source_filename", "text").collect()] == [("m", "g", "stays")]


def test_facts_are_replaced_also_by_none(spark):
    f = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, fact_key string")
    docs = spark.createDataFrame([(1, "v3", "ready"), (2, "v3", "ready")], "id long, digest_version string, status string")
    ids = spark.createDataFrame([(1,), (7,)], "doc_id long")
    new = spark.createDataFrame([(7, "z")], "doc_id long, fact_key string")
    rows, stamped = facts.replace_facts(f, docs, new, ids, "v4")
    assert [tuple(r) for r in rows.collect()] == [(2, "b")] and {r.id: r.digest_version for r in stamped.collect()} == {1: "v4", 2: "v3"}


def test_single_documents_fail_loud(spark):
    answers = spark.createDataFrame([("m", 1, None, None)], "matter string, question_id long, answer_text string, citations array<string>")
    indexed = spark.createDataFrame([("m", "f")], "matter string, source_filename string")
    assert review.scoped_answers(answers, indexed).first().answer_text.startswith("I could not find")
    with pytest.raises(review.NotIndexed):
        review.scoped_answers(answers, indexed, "g")


def test_cues_and_mails():
    from vellum.sources import extract

    cues = b"WEBVTT - x\n\nNOTE a\nb\n\n7\n1:00:05.000 --> 1:00:06.000 align:start\n<v.loud Ann Lee>Hi</v> <i>you</i> <x>\n42\n"
    assert extract._subtitles(cues, "vtt") == "[01:00:05] Ann Lee: Hi you <x>"
    mail = b"From: a@b.c\nSubject: S\nMIME-Version: 1.0\nContent-Type: text/html\n\n<p>Hi&nbsp;&amp; <b>bye</b></p>"
    assert extract._eml(mail, "eml") == "From: a@b.c\nSubject: S\n\nHi & bye"


def test_arrows_in_speech_are_kept():
    cues = b"WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000 align:start\nthen A --> B\n--> and on\n\n00:03 --> 00:04\nend\n"
    assert extract._subtitles(cues, "vtt") == "[00:00:01] then A --> B\n--> and on\n[00:00:03] end"


def test_a_forwarded_mail_is_not_the_body():
    import email.message

    inner = email.message.EmailMessage()
    inner["Subject"] = "old"
    inner.set_content("the forwarded text")
    mail = email.message.EmailMessage()
    mail["From"], mail["Subject"] = "a@b.c", "Fwd"
    mail.set_content("<p>my own <b>words</b></p>", subtype="html")
    mail.add_attachment(inner)
    got = extract._eml(mail.as_bytes(), "eml")
    assert "my own words" in got and "forwarded" not in got
    odd = b"From: a@b.c\nSubject: S\nContent-Type: text/plain; charset=x-none\n\nB\xc3\xa9"
    assert extract._eml(odd, "eml").endswith("Bé")
