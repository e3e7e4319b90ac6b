"""Digests, absence in waves, audit verdicts, page geometry, two-stage extraction, job tails and the folder stream."""

import hashlib
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from vellum import plugins
from vellum.operators import catalog, digest, facts, review
from vellum.sources import pages
from vellum.streaming import watch

PAGE = "state your name\nmy name is Jane Doe and I live here\nthe lease ended in May\nthe lease ended in May"


def digest_tables(spark):
    raw = "\n".join([
        "Here are the bullets:", "<think>- [no] not said</think>",
        '- [ Names ] She is Jane [document: depo.txt, page: 3, chunk: C1, span: "my name is Jane Doe"]',
        '* [lease] It ended [document: depo.txt, page: 3, chunk: C1, span: "the lease ended in May"]',
        '- [lies] Made up [document: depo.txt, page: 3, chunk: C1, span: "she confessed to it all"]',
        '- [names] Wrong page [document: depo.txt, page: 4, chunk: C2, span: "my name is Jane Doe"]',
        "- no topic at all", "NONE",
    ])
    outputs = spark.createDataFrame([(1, 0, raw), (1, 1, None), (2, 0, "NONE")], "doc_id long, batch int, raw string")
    chunks = [(1, 0, "C1", 0, "depo.txt", 3, 0, len(PAGE), PAGE), (1, 0, "C2", 1, "depo.txt", 4, 0, 9, "page four"), (1, 1, "C1", 0, "depo.txt", 5, 0, 4, "five"), (2, 0, "C1", 0, "other.txt", 1, 0, 3, "one")]
    grounding = spark.createDataFrame(chunks, "doc_id long, batch int, chunk_id string, rank int, source_filename string, page_number long, char_start long, char_end long, text string")
    at, lines = 0, []
    for k, line in enumerate(PAGE.split("\n"), 1):
        lines.append((1, 3, k, at, at + len(line)))
        at += len(line) + 1
    return outputs, grounding, spark.createDataFrame(lines, "doc_id long, page long, line long, char_start long, char_end long")


def test_every_bullet_is_verified_by_itself(spark):
    outputs, grounding, line_map = digest_tables(spark)
    judged = digest.judged_bullets(outputs, grounding, line_map)
    got = {(r.topic, r.body): (r.verified, r.span, r.page, r.lines) for r in judged.collect()}
    assert got == {
        ("names", "She is Jane"): (True, "my name is Jane Doe", 3, "2"), ("lease", "It ended"): (True, "the lease ended in May", 3, None),
        ("lies", "Made up"): (False, None, None, None), ("names", "Wrong page"): (False, None, None, None),
    }
    made = {r.doc_id: r for r in digest.digest_map(judged, grounding.select("doc_id", "page_number"), outputs).collect()}
    assert [(t.topic, [b.page for b in t.bullets]) for t in made[1].topics] == [("lease", [3]), ("names", [3])]
    assert (made[1].pages, made[1].batches, made[1].failed, made[1].verified, made[1].rejected) == (3, 2, 1, 2, 2)
    assert made[2].topics == [] and (made[2].verified, made[2].rejected, made[2].failed) == (0, 0, 0)
    rows = digest.digest_rows(judged).sort("pos").collect()
    assert [(r.Topic, r.Testimony, r.Cite) for r in rows] == [("lease", 'It ended\n"the lease ended in May"', "depo.txt p.3"), ("names", 'She is Jane\n"my name is Jane Doe"', "depo.txt p.3:2")]


@pytest.mark.parametrize("seed", range(3))
def test_waves_are_the_sequential_search(spark, seed):
    rng = random.Random(seed)
    docs = [(m, i, f"{m}-{i}") for m in "abc" for i in range({"a": 1, "b": 9, "c": 20}[m])]
    truth = {(m, q, i): (rng.random() < 0.9, rng.random() < 0.08) for m, i, _ in docs for q in range(5)}
    table = spark.createDataFrame([(*k, *v) for k, v in truth.items()], "matter string, question_id long, doc_order long, ran boolean, found boolean")
    missing = spark.createDataFrame([(m, q, "?") for m in "abcz" for q in range(5)], "matter string, question_id long, question string")
    documents = spark.createDataFrame(docs, "matter string, doc_order long, filename string")
    got, calls = review.absence_in_waves(missing, documents, lambda wave: wave.join(table, ["matter", "question_id", "doc_order"]))
    want, sequential = set(), 0
    for m in "abc":
        mine = [d for d in docs if d[0] == m]
        for q in range(5):
            checked, hit = 0, None
            for _, i, name in mine:
                ran, found = truth[m, q, i]
                sequential += 1
                checked += ran
                if ran and found:
                    hit = name
                    break
            want.add((m, q, "found" if hit else "potentially_missing" if checked == len(mine) else "not_confirmed", checked, len(mine), hit))
    assert {tuple(r) for r in got.collect()} == want
    assert sequential <= calls < 2 * sequential + 15 and calls <= len(truth)
    none, n = review.absence_in_waves(missing, documents.limit(0), lambda wave: wave)
    assert none.collect() == [] and n == 0


def chain(spark, n, log=False):
    rows, last = [], {}
    for i in range(n):
        who = i % 3 if log else 0
        prev = last.get(who, "genesis")
        own = hashlib.sha256("|".join([prev, f"t{i}", "e", "", f"d{i}"]).encode()).hexdigest()
        rows.append([who, i, f"t{i}", "e", None, f"d{i}", prev, own])
        last[who] = own
    return rows


def verdicts(spark, rows, log):
    df = spark.createDataFrame(rows, "log long, id long, ts string, event string, matter_slug string, detail string, prev_hash string, entry_hash string").repartition(5)
    return sorted(map(tuple, catalog.audit_verdict(df if log else df.drop("log")).collect()))


@pytest.mark.parametrize("log", [False, True])
def test_audit_verdict_finds_the_first_break(spark, log):
    rows = chain(spark, 60, log)
    assert verdicts(spark, rows, log) == ([(k, 20, None) for k in range(3)] if log else [(60, None)])
    mine = [r for r in rows if r[0] == 0]
    for k in (0, 1, 7, len(mine) - 1):
        at = mine[k][1]
        edited = [[*r[:5], "x", *r[6:]] if r[1] == at else r for r in rows]
        assert verdicts(spark, edited, log)[0][-1] == at
        removed = [r for r in rows if r[1] != at]
        assert verdicts(spark, removed, log)[0][-1] == (mine[k + 1][1] if k + 1 < len(mine) else None)
    swapped = [[*r[:1], {mine[3][1]: mine[4][1], mine[4][1]: mine[3][1]}.get(r[1], r[1]), *r[2:]] for r in rows]
    assert verdicts(spark, swapped, log)[0][-1] == mine[3][1]
    assert verdicts(spark, [], log) in ([], [(None, None)])


def test_spans_become_rectangles(spark):
    lines = ["The Quick brown", "fox jumps over", "the lazy dog and", "the quick brown cat"]
    words = [(1, 1, 10 * k + i, w, 10.0 * i, 20.0 * k, 10.0 * i + 9, 20.0 * k + 10) for k, line in enumerate(lines) for i, w in enumerate(line.split())]
    words.append((1, 2, 0, "other", 0.0, 0.0, 9.0, 9.0))
    table = spark.createDataFrame(words, "doc_id long, page long, pos long, text string, x0 double, y0 double, x1 double, y1 double")
    asked = ["quick  BROWN", "brown\nfox jumps", "the quick brown fox jumps over a wall of stone", "nothing here", "", "a few words that are not there at all", "azy"]
    got = pages.span_rectangles(table, spark.createDataFrame([(1, 1, s) for s in asked], "doc_id long, page long, span string")).collect()
    found = {s: sorted((r.place, r.y0, r.x0, r.x1) for r in got if r.span == s) for s in asked}
    assert found[asked[0]] == [(0, 0.0, 10.0, 29.0), (1, 60.0, 10.0, 29.0)]
    assert found[asked[1]] == [(0, 0.0, 20.0, 29.0), (0, 20.0, 0.0, 19.0)]
    assert found[asked[2]] == [(0, 0.0, 0.0, 29.0), (0, 20.0, 0.0, 29.0)]  # its first six words
    assert found[asked[3]] == found[asked[4]] == found[asked[5]] == [] and found[asked[6]] == [(0, 40.0, 10.0, 19.0)]


def test_tables_are_cells_of_crossing_rules(spark):
    flat = lambda d, y, x0=0.0, x1=100.0: (d, 1, x0, y, x1, y + 0.5)
    up = lambda d, x, y0=0.0, y1=50.0: (d, 1, x, y0, x + 0.5, y1)
    rules = [flat(1, 0.0), flat(1, 50.0), up(1, 0.0), up(1, 99.0), *[flat(2, 10.0 * k) for k in range(9)], up(2, 50.0), flat(3, 0.0), flat(3, 50.0), up(3, 10.0, 60.0, 90.0), up(3, 20.0, 60.0, 90.0)]
    rules += [flat(5, 0.0), flat(5, 50.0), up(5, 0.0), up(5, 99.0), flat(6, 0.0), flat(6, 0.4), up(6, 0.0), up(6, 99.0)]
    docs = spark.createDataFrame([(d, 1, "broken" if d == 5 else None) for d in range(1, 7)], "doc_id long, page long, error string")
    table = spark.createDataFrame(rules, "doc_id long, page long, x0 double, y0 double, x1 double, y1 double")
    assert {r.doc_id for r in pages.table_gate(docs, table).collect() if r.has_tables} == {1}
    assert pages.table_gate(docs, table.limit(0)).count() == 6


def test_checkboxes_and_label_fonts(spark):
    rows = spark.createDataFrame([("ABC+Wingdings", "þ"), ("wingdings", " o "), ("Wingdings", "x"), ("Arial", "n"), (None, "n"), ("Wingdings", None)], "f string, c string")
    assert [r[0] for r in rows.select(pages.checkbox(F.col("f"), F.col("c"))).collect()] == ["[√]", "[ ]", None, None, None, None]
    rows = spark.createDataFrame([("WQ+LiberationSans", 8.8), ("Courier", 8.8), ("Courier", 9.1), ("ArialMT", 8.8), ("Times+X", 8.6)], "f string, s double")
    assert [r[0] for r in rows.select(pages.entered(F.col("f"), F.col("s"))).collect()] == [False, True, False, False, True]
    rules = spark.createDataFrame([(1, 1, 0.0, 50.0, 100.0, 50.5)], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 1, 5.0, 40.0, 20.0, 49.0, "Name:", 8.8, "ArialMT"), (1, 1, 30.0, 40.0, 50.0, 49.0, "Jane", 8.8, "Courier")], "doc_id long, page long, x0 double, y0 double, x1 double, y1 double, text string, size double, font string")
    assert [r.value for r in pages.form_fields(rules, spans).collect()] == ["Jane"] and [r.value for r in pages.form_fields(rules, spans.drop("font")).collect()] == ["Name: Jane"]


class Scripted:
    """Finds amounts; fails on whole groups that hold "broken", on pages that hold it, and by an exception on "raise"."""

    def extract(self, text):
        if "raise" in text:
            raise RuntimeError("model")
        if "broken" in text:
            return None
        return [{"fact_type": "amount", "span": w, "page": 99, "value": w, "x": None} for w in text.split() if w.startswith("$")]


def test_extraction_in_two_stages(spark):
    rows = [(1, 1, "pay $5 now"), (1, 2, "pay $6"), (2, 1, "broken"), (2, 2, "and $7 and $7"), (3, 1, "broken raise"), (3, 2, "raise $9"), (3, 3, "fine $1"), (4, 1, "nothing"), (5, 1, None), (6, 1, "broken $2")]
    table = spark.createDataFrame(rows, "doc_id long, page_number long, page_text string")
    gated, states = facts.extract_facts(table, lambda calls: plugins.extracted(calls, Scripted()))
    assert sorted((r.doc_id, r.page, r.span) for r in gated.collect()) == [(1, 1, "$5"), (1, 2, "$6"), (2, 2, "$7"), (2, 2, "$7"), (3, 3, "$1")]
    got = {r.doc_id: (r.groups, r.failed_groups, r.failed_pages, r["raw"], r.facts, r.done) for r in states.collect()}
    assert got == {1: (1, 0, 0, 2, 2, True), 2: (1, 1, 1, 2, 2, True), 3: (2, 1, 2, 1, 1, False), 4: (1, 0, 0, 0, 0, True), 5: (1, 0, 0, 0, 0, True), 6: (1, 1, 1, 0, 0, False)}
    docs = spark.createDataFrame([(i, "v1" if i == 3 else None) for i in range(1, 8)], "id long, digest_version string")
    assert {r.id: r.digest_version for r in facts.stamped(docs, states, "v2").collect()} == {1: "v2", 2: "v2", 3: "v1", 4: "v2", 5: "v2", 6: None, 7: None}


def test_job_tail_replays_and_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "MOST_EVENTS", 3)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = tmp_path / "in"
    src.mkdir()
    schema = "job_id string, at long, kind string, event string, data string, subscriber string"
    table = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(f"file://{src}")
    ev = lambda j, at, e, kind="event": (j, at, kind, e, f"d{at}", None)
    sub = lambda j, at, who: (j, at, "subscribe", None, None, who)

    def told(who, n, most=60):
        """What a subscriber was told once that are n rows; with timers in the plan a stream is never done with its batches."""
        rows, until = [], time.time() + most
        while len(rows) < n and time.time() < until:
            time.sleep(0.3)
            rows = spark.table("told").where(F.col("subscriber") == who).collect()
        return [(r.seq, r.event, r.last) for r in rows]

    query = None
    try:
        table([ev("a", 1, "start"), sub("a", 2, "early"), ev("a", 3, "step"), ev("b", 1, "start")])
        stream = spark.readStream.schema(schema).json(f"file://{src}")
        query = watch.job_tail(stream, keep_s=3).writeStream.outputMode("append").format("memory").queryName("told").option("checkpointLocation", f"file://{tmp_path}/cp").start()
        assert told("early", 2) == [(0, "start", False), (1, "step", False)]
        table([ev("a", 4, "more"), sub("a", 5, "late"), ev("a", 6, "beyond"), ev("a", 7, "done", "terminal"), ev("a", 8, "ignored"), sub("a", 9, "after")])
        assert told("early", 5)[2:] == [(2, "more", False), (3, "done", False), (None, None, True)]
        assert told("late", 5) == [(0, "start", False), (1, "step", False), (2, "more", False), (3, "done", False), (None, None, True)]
        assert told("after", 4) == [(0, "start", False), (1, "step", False), (2, "more", False), (None, None, True)]
        time.sleep(6)  # state of "a" goes in the batch after its time
        table([ev("b", 2, "tick"), sub("a", 20, "expired"), sub("b", 21, "other")])
        assert told("other", 2) == [(0, "start", False), (1, "tick", False)] and told("expired", 1, 1) == []
    finally:
        if query is not None:
            query.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_folder_offsets_do_not_grow(tmp_path):
    reader = watch._FolderStream({"path": str(tmp_path), "rest": "0"})
    assert reader.latestOffset() == {"changed": -1} == reader.initialOffset()
    for k in range(50):
        (tmp_path / f"{k}.txt").write_text("x")
    one = reader.latestOffset()
    assert len(str(one)) < 40 and len(reader.partitions(reader.initialOffset(), one)) == 50
    (tmp_path / "3.txt").write_text("y")
    old = tmp_path / ".hidden"
    old.write_text("moved in")
    os.utime(old, (1, 1))
    os.rename(old, tmp_path / "old.txt")
    two = reader.latestOffset()
    assert sorted(os.path.basename(p.path) for p in reader.partitions(one, two)) == ["3.txt", "old.txt"]
    assert reader.partitions(two, reader.latestOffset()) == [] and list(reader.read(watch._Changed(str(tmp_path / "gone.txt")))) == []
    slow = watch._FolderStream({"path": str(tmp_path), "rest": "60"})
    assert slow.latestOffset() == {"changed": -1}
