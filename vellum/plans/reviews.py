"""Further queries, whole texts throughout: digests, searches in waves, verdicts on chains, page geometry, extraction, ordered listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import plugins
from ..functions.keys import fact_key
from ..functions.text import normal_form
from ..operators import catalog, chunking, digest, facts, ingest, retention, review, verification
from ..sources import pages
from ..sources.store import cut, thin
from .queries import _AUDIT, _LINES, _audit, _line_map, _questions, doc_pages, query, table

PHRASE = "[A-Za-z]+(?: [A-Za-z]+){3,}"


def _digested(spark, d):
    """Turns of conversations are pages; a model's output for ten of them quotes a phrase of each, and makes every third one up."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "role", F.coalesce("text", F.lit("")).alias("text"))
    batches = chunking.page_batches(turns.withColumn("matter", F.lit("m")).withColumn("source_filename", F.concat(F.lit("conv-"), F.col("doc_id").cast("string")))).drop("matter")
    rank = F.row_number().over(Window.partitionBy("doc_id", "batch").orderBy("page_number")) - 1
    shown = batches.withColumn("rank", rank).withColumn("chunk_id", F.concat(F.lit("C"), (rank + 1).cast("string")))
    phrase = F.regexp_extract("text", PHRASE, 0)
    span = F.when(F.col("page_number") % 3 == 0, F.concat(F.lit("nobody ever said this in turn "), F.col("page_number").cast("string"))).otherwise(phrase)
    line = F.concat(F.lit("- ["), "role", F.lit("] said [document: "), "source_filename", F.lit(", page: "), F.col("page_number").cast("string"), F.lit(", chunk: "), "chunk_id", F.lit(', span: "'), span, F.lit('"]'))
    said = shown.withColumn("line", F.when(phrase != "", line))
    outputs = said.groupBy("doc_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "line"))), lambda x: F.coalesce(x["line"], F.lit("NONE"))), "\n").alias("raw"))
    grounding = shown.select("doc_id", "batch", "chunk_id", "rank", "source_filename", "page_number", F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end"), "text")
    lines = turns.select("doc_id", F.col("page_number").alias("page"), F.posexplode(F.split("text", "\n")).alias("pos", "content")).withColumn("line", (F.col("pos") + 1).cast("long"))
    return digest.judged_bullets(outputs, grounding, catalog.line_map(lines)), grounding, outputs


_SAID = f"s AS (SELECT conv_id AS doc_id, turn, role, regexp_extract(coalesce(text, ''), '{PHRASE}') AS phrase FROM conversations)"


@query(f"""WITH {_SAID} SELECT doc_id, lower(role) AS topic, turn % 3 <> 0 AS verified, CASE WHEN turn % 3 <> 0 THEN phrase END AS span, CASE WHEN turn % 3 <> 0 THEN turn END AS page
    FROM s WHERE phrase <> ''""")
def digest_bullets(spark, d):
    judged, _, _ = _digested(spark, d)
    return judged.select("doc_id", "topic", "verified", "span", "page")


@query(f"""WITH {_SAID}, b AS (SELECT conv_id, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 10) AS batch FROM conversations),
    c AS (SELECT conv_id AS doc_id, count(*) AS pages, count(DISTINCT batch) AS batches FROM b GROUP BY conv_id)
    SELECT doc_id, pages, batches, (SELECT count(*) FROM s WHERE s.doc_id = c.doc_id AND phrase <> '' AND turn % 3 <> 0) AS verified, (SELECT count(*) FROM s WHERE s.doc_id = c.doc_id AND phrase <> '' AND turn % 3 = 0) AS rejected,
           (SELECT count(DISTINCT lower(role)) FROM s WHERE s.doc_id = c.doc_id AND phrase <> '' AND turn % 3 <> 0) AS topics FROM c""")
def digest_counts(spark, d):
    made = digest.digest_map(*_digested(spark, d))
    return made.select("doc_id", "pages", "batches", "verified", "rejected", F.size("topics").cast("long").alias("topics"))


@query(f"""WITH {_SAID}, t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lower(role), turn) - 1 AS pos FROM s WHERE phrase <> '' AND turn % 3 <> 0)
    SELECT doc_id, pos, lower(role) AS "Topic", 'said' || chr(10) || '"' || phrase || '"' AS "Testimony" FROM t""")
def digest_table(spark, d):
    judged, _, _ = _digested(spark, d)
    return digest.digest_rows(judged).select("doc_id", F.col("pos").cast("long").alias("pos"), "Topic", "Testimony")


@query(r"""WITH a AS (SELECT item_id, text, 'src' || (item_id % 20) AS matter FROM benchmark),
    r AS (SELECT a.matter, item_id AS question_id, doc_id, regexp_matches(d.text, '\S') AS ran, contains(d.text, a.text) AS found FROM a JOIN documents d ON d.source = a.matter),
    h AS (SELECT matter, question_id, min(doc_id) FILTER (WHERE found AND ran) AS hit FROM r GROUP BY ALL)
    SELECT matter, question_id, CASE WHEN any_value(hit) IS NOT NULL THEN 'found' WHEN (count(*) FILTER (WHERE ran)) = count(*) THEN 'potentially_missing' ELSE 'not_confirmed' END AS status,
           (count(*) FILTER (WHERE ran AND (hit IS NULL OR doc_id <= hit))) AS checked, count(*) AS total, 'doc-' || any_value(hit) AS found_in FROM r JOIN h USING (matter, question_id) GROUP BY matter, question_id""")
def absence_in_waves(spark, d):
    """Asks for whole passages, one document after the other in growing waves; questions that have their answer aren't asked again."""
    documents = doc_pages(spark, d).select("matter", F.col("doc_id").alias("doc_order"), F.col("source_filename").alias("filename"), "page_text")

    def ask(wave: DataFrame) -> DataFrame:
        return wave.withColumn("ran", F.col("page_text").rlike(r"\S")).withColumn("found", F.expr("contains(page_text, query)"))

    return review.absence_in_waves(_questions(spark, d).select("matter", F.col("qid").alias("question_id"), "query"), documents, ask)[0]


@query("SELECT user_id AS log, count(*) AS entries, min(event_id) FILTER (WHERE event_id % 1000 = 500) AS first_bad_id FROM events GROUP BY user_id")
def audit_verdict(spark, d):
    chain = catalog.audit_chain(_audit(spark, d)).withColumn("detail", F.when(F.col("id") % 1000 == 500, F.lit("edited")).otherwise(F.col("detail")))
    return catalog.audit_verdict(chain)


@query(_AUDIT.replace("PARTITION BY user_id ORDER BY event_id) AS n FROM events", "PARTITION BY 1 ORDER BY event_id) AS n FROM (SELECT 1 AS user_id, * EXCLUDE (user_id) FROM events)") + " SELECT count(*) AS entries, NULL::BIGINT AS first_bad_id FROM c")
def audit_verdict_of_one_chain(spark, d):
    """A single chain over all entries, checked by ranges of ids."""
    return catalog.audit_verdict(catalog.audit_chain(_audit(spark, d).drop("log")))


@query("SELECT o_orderkey AS doc_id, o_orderkey % 3 <> 0 AND (SELECT count(DISTINCT l_linenumber) FROM lineitem WHERE l_orderkey = o_orderkey) > 1 AS has_tables FROM orders")
def table_gate(spark, d):
    """An order's lines as horizontal rules, with two vertical ones, or with one for every third order."""
    docs = table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).cast("long").alias("page"), F.lit(None).cast("string").alias("error"))
    y = F.col("l_linenumber") * 20.0
    flat = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).cast("long").alias("page"), F.lit(0.0).alias("x0"), y.alias("y0"), F.lit(100.0).alias("x1"), (y + 1).alias("y1"))
    sides = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(10.0))).otherwise(F.array(F.lit(10.0), F.lit(90.0)))
    up = docs.select("doc_id", "page", F.explode(sides).alias("x0")).select("doc_id", "page", "x0", F.lit(0.0).alias("y0"), (F.col("x0") + 1).alias("x1"), F.lit(200.0).alias("y1"))
    return pages.table_gate(docs, flat.unionByName(up))


@query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT item_id, text, array_to_string(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> ''), ' ') AS p FROM benchmark),
    k AS (SELECT w.doc_id, item_id, length(p) AS n, string_split(array_to_string(w, ' '), p) AS pieces FROM p JOIN documents d ON contains(d.text, p.text) JOIN w ON w.doc_id = d.doc_id),
    i AS (SELECT *, unnest(range(1, len(pieces))) AS i FROM k),
    h AS (SELECT doc_id, item_id, n, i, list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * n AS f FROM i),
    u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS pos FROM w WHERE doc_id IN (SELECT doc_id FROM k)),
    a AS (SELECT doc_id, pos, length(x) AS l, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM u),
    r AS (SELECT DISTINCT h.doc_id, item_id, i, pos // 10 AS line FROM h JOIN a ON a.doc_id = h.doc_id AND a.f + a.l > h.f AND a.f < h.f + n)
    SELECT doc_id, item_id, count(*) AS rectangles, 10.0::DOUBLE * count(*) AS height FROM r GROUP BY doc_id, item_id""")
def span_rectangles(spark, d):
    """Words of documents set in lines of ten; the rectangles of every passage that a document holds."""
    docs = table(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("page"), "text")
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("span"))
    spans = cut(docs.join(F.broadcast(items) if items.count() <= 10_000 else items, F.expr("contains(text, span)")).select("doc_id", "page", "item_id", "span"), "passages-held")
    held = docs.join(thin(spans.select("doc_id").distinct()), "doc_id", "left_semi")
    words = held.select("doc_id", "page", F.posexplode(F.filter(F.split("text", r"\s+"), lambda x: x != "")).alias("pos", "text"))
    column, line = F.col("pos") % 10, F.floor(F.col("pos") / 10)
    boxes = words.select("doc_id", "page", "pos", "text", (column * 30.0).alias("x0"), (line * 20.0).alias("y0"), (column * 30.0 + 25).alias("x1"), (line * 20.0 + 10).alias("y1"))
    found = pages.span_rectangles(boxes, spans).join(spans, ["doc_id", "page", "span"])
    return found.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("rectangles"), F.sum(F.col("y1") - F.col("y0")).alias("height"))


class _FirstWord:
    """A model that finds each page's first word of letters, and fails where it is shown a percent sign."""

    def extract(self, text: str) -> list[dict] | None:
        import re

        if "%%%" in text:
            return None
        word = re.search("[A-Za-z]+", text.split("===\n", 1)[-1])
        return [{"fact_type": "amount", "span": word[0], "page": 1, "value": word[0]}] if word else []


@query("""SELECT doc_id, 1::BIGINT AS groups, contains(text, '%%%')::BIGINT AS failed_groups, contains(text, '%%%')::BIGINT AS failed_pages, (NOT contains(text, '%%%') AND regexp_matches(text, '[A-Za-z]'))::BIGINT AS facts,
    NOT contains(text, '%%%') AS done FROM documents""")
def extraction_two_stages(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("page_number"), F.col("text").alias("page_text"))
    _, states = facts.extract_facts(rows, lambda calls: plugins.extracted(calls, _FirstWord()))
    return states.select("doc_id", "groups", "failed_groups", "failed_pages", "facts", "done")


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their place in the order that they come in."""
    return rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("place", F.row_number().over(Window.orderBy("__at")).cast("long")).drop("__at")


@query("SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders WHERE o_custkey = 8")
def documents_by_update(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("matter_slug"), F.col("o_orderdate").alias("updated"))
    return _placed(catalog.documents_of(t, 8)).select("id", "place")


@query("""SELECT user_id AS thread_id, count(*) AS messages, row_number() OVER (ORDER BY max(ts) DESC, user_id DESC) AS place FROM events GROUP BY user_id""")
def threads_by_update(spark, d):
    m = table(spark, d, "events").select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("pos"), F.lit("user").alias("role"), F.col("event_type").alias("text"), "ts")
    return _placed(catalog.threads(m)).select("thread_id", "messages", "place")


# -- whole texts --------------------------------------------------------------------------------------------------------


@query(r"SELECT doc_id, sha256(doc_id || '|amount|1|' || lower(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), '\s+', ' ', 'g')))) AS fact_key FROM documents")
def fact_keys_of_whole_texts(spark, d):
    span = normal_form(F.regexp_replace("text", "[^a-zA-Z ]", ""))
    return table(spark, d, "documents").select("doc_id", fact_key(F.col("doc_id"), F.lit("amount"), F.lit(1), span).alias("fact_key"))


@query(f"""WITH {_LINES}, h AS (SELECT c.doc_id, min(line) AS lo, max(line) AS hi FROM documents c JOIN m ON c.doc_id = m.doc_id AND char_start < length(text) AND char_start + m.n > 0 AND length(text) > 0 GROUP BY c.doc_id)
    SELECT d.doc_id, CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END AS lines FROM documents d LEFT JOIN h USING (doc_id)""")
def lines_of_whole_texts(spark, d):
    docs = table(spark, d, "documents")
    cites = docs.select("doc_id", F.lit(1).cast("long").alias("page"), F.lit(0).cast("long").alias("char_start"), F.length("text").cast("long").alias("char_end"), F.col("text").alias("span"))
    whole = docs.select("doc_id", F.lit(1).cast("long").alias("page_number"), F.col("text").alias("page_text"))
    return verification.derived_lines(cites, _line_map(spark, d), whole).select("doc_id", "lines")


def _whole_claims(spark, d):
    """Answers that quote a whole passage, said to be in chunk C1: the right one for even ids, for odd ones what stands there is turned round."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")
    answers = items.select("qid", F.concat(F.lit('It says so [document: f, page: 1, chunk: C1, span: "'), "text", F.lit('"].')).alias("answer_text"))
    text = F.when(F.col("qid") % 2 == 0, F.concat(F.lit("before "), "text", F.lit(" after"))).otherwise(F.reverse("text"))
    chunks = items.select("qid", F.lit("C1").alias("chunk_id"), F.lit(0).alias("rank"), F.lit("f").alias("source_filename"), F.lit(1).cast("long").alias("page_number"), F.lit(100).cast("long").alias("char_start"), (F.lit(100) + F.length(text)).cast("long").alias("char_end"), text.alias("text"))
    return answers, chunks


@query("""SELECT item_id AS qid, item_id % 2 = 0 AS accepted, CASE WHEN item_id % 2 = 0 THEN 107 + length(text) - length(ltrim(text)) END AS char_start, CASE WHEN item_id % 2 = 0 THEN 107 + length(rtrim(text)) END AS char_end FROM benchmark""")
def verify_whole_passages(spark, d):
    return verification.verified_claims(*_whole_claims(spark, d)).select("qid", "accepted", F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"))


@query("""WITH a AS (SELECT item_id, text, 'src' || (item_id % 20) AS matter FROM benchmark),
    hit AS (SELECT a.item_id, a.matter, d.doc_id FROM a JOIN documents d ON d.source = a.matter AND contains(d.text, a.text))
    SELECT d.source AS matter, 'doc-' || d.doc_id AS filename, a.item_id AS question_id,
           CASE WHEN h.doc_id IS NOT NULL THEN 'found' WHEN EXISTS (SELECT 1 FROM hit x WHERE x.item_id = a.item_id) THEN 'not_confirmed' ELSE 'potentially_missing' END AS status
    FROM documents d JOIN a ON a.matter = d.source LEFT JOIN hit h ON h.item_id = a.item_id AND h.doc_id = d.doc_id""")
def grid_of_whole_passages(spark, d):
    docs = doc_pages(spark, d).select("matter", F.col("source_filename").alias("filename"), "page_text")
    q = _questions(spark, d)
    hits = docs.join(q, "matter").where(F.expr("contains(page_text, query)"))
    cites = hits.groupBy("qid").agg(F.collect_set(F.struct("filename", F.lit(1).cast("long").alias("page"), F.col("query").alias("span"))).alias("citations"))
    none = F.array().cast("array<struct<filename:string,page:bigint,span:string>>")
    answers = q.join(cites, "qid", "left").select("matter", F.col("qid").alias("question_id"), F.when(F.col("citations").isNull(), F.lit(verification.REFUSAL)).otherwise("yes").alias("answer_text"), F.coalesce("citations", none).alias("citations"))
    return review.grid(answers, docs).select("matter", "filename", "question_id", "status")


@query("""SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg(lpad((turn // 60)::VARCHAR, 2, '0') || ':' || lpad((turn % 60)::VARCHAR, 2, '0') || ':00.000 --> ' || lpad((turn // 60)::VARCHAR, 2, '0') || ':' || lpad((turn % 60)::VARCHAR, 2, '0') || ':30.500' || chr(10) || '<v ' || role || '>' || text, chr(10) || chr(10) ORDER BY turn) AS text
    FROM conversations GROUP BY conv_id""")
def vtt_of_whole_turns(spark, d):
    c = table(spark, d, "conversations")
    u = c.select(F.col("conv_id").alias("item_id"), F.col("turn").alias("pos"), F.col("role").alias("who"), "text", (F.col("turn") * 60.0).alias("start_s"), (F.col("turn") * 60 + 30.5).alias("end_s"))
    return ingest.vtt_cues(u).select(F.col("item_id").alias("conv_id"), "text")


# -- what leaves, moves and is listed twice -------------------------------------------------------------------------------


def _export(spark, d):
    """Documents' texts as natives below /kb; every seventh document's stored path leads out of it; every fifth is not sealed."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("matter_slug"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.coalesce("text", F.lit("")).alias("text"))
    inside = F.concat(F.lit("/kb/"), F.coalesce("matter_slug", F.lit("none")), F.lit("/"), "filename")
    stored = F.when(F.col("id") % 7 == 0, F.concat(F.lit("/kb/../etc/"), "filename")).otherwise(inside)
    body = F.encode("text", "UTF-8")
    natives = t.select(F.concat(F.lit("file:"), stored).alias("path"), F.when(F.col("id") % 5 == 0, body).otherwise(retention.sealed(body, F.lit("0123456789abcdef"))).alias("content"))
    keys = t.select("matter_slug").distinct().withColumn("key", F.lit("0123456789abcdef"))
    said = table(spark, d, "conversations").select(F.concat(F.lit("conv-"), (F.col("conv_id") % 20).cast("string")).alias("matter_slug"), F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), "text")
    audit = table(spark, d, "events").select(F.lit(None).cast("string").alias("matter_slug"), F.col("event_id").alias("id"))
    return retention.export_entries(t.drop("text").withColumn("stored_path", stored), natives, "file:///kb", said, audit, keys)


@query("SELECT source AS matter, 'documents/doc-' || doc_id || '.txt' AS name, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE doc_id % 7 <> 0 AND source IS NOT NULL")
def matter_export(spark, d):
    """Whole natives, read back from the archives."""
    import io
    import zipfile

    def unpacked(frames):
        import pandas as pd

        for f in frames:
            for matter, body in zip(f["matter"], f["archive"], strict=True):
                with zipfile.ZipFile(io.BytesIO(body)) as z:
                    yield pd.DataFrame([(matter, n, z.read(n)) for n in z.namelist()], columns=["matter", "name", "body"])

    files = retention.archives(_export(spark, d)).select("matter", "archive").mapInPandas(unpacked, "matter string, name string, body binary")
    return files.where("name like 'documents/%'").select("matter", "name", F.sha2("body", 256).alias("sha256"))


@query("""SELECT matter, name, sum(lines)::BIGINT AS lines FROM (
      SELECT source AS matter, 'manifest/documents' AS name, count(*) AS lines FROM documents WHERE source IS NOT NULL GROUP BY 1
      UNION ALL SELECT 'conv-' || (conv_id % 20), 'chats/messages', count(*) FROM conversations GROUP BY 1) GROUP BY 1, 2""")
def matter_manifests(spark, d):
    rows = _export(spark, d).where("name not like 'documents/%'")
    return rows.groupBy("matter", F.regexp_extract("name", r"^(.*)-\d+\.jsonl$", 1).alias("name")).agg(F.sum(F.size(F.split(F.decode("body", "UTF-8"), "\n"))).alias("lines"))


@query("""WITH m AS (SELECT *, o_orderkey % 5 = 3 AND o_custkey <> 2 AS moved FROM orders), l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS id, CASE WHEN moved THEN 2 ELSE o_custkey END AS matter_slug, CASE WHEN moved THEN 'queued' ELSE 'ready' END AS status, CASE WHEN moved THEN 0 ELSE coalesce(n, 0) END AS chunks
    FROM m LEFT JOIN l ON l_orderkey = o_orderkey""")
def documents_moved(spark, d):
    """Every fifth kind of order moves to the second customer; its lines, which are chunks, go."""
    o = table(spark, d, "orders")
    name = lambda k: F.concat(F.lit("o"), F.col(k).cast("string"), F.lit(".txt"))
    docs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("matter_slug"), name("o_orderkey").alias("filename"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("checksum"), F.lit("ready").alias("status"), F.lit(None).cast("string").alias("reason"))
    chunks = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("matter"), name("l_orderkey").alias("source_filename"))
    matters = table(spark, d, "customer").select(F.col("c_custkey").alias("slug"))
    holds = spark.createDataFrame([], "id long, matter_slug long, reason string, released string")
    moves = docs.where("id % 5 = 3").select(F.col("id").alias("doc_id"), F.lit(2).cast("long").alias("matter"))
    rows, left = retention.move_documents(docs, chunks, matters, holds, moves)
    n = left.groupBy(F.col("source_filename").alias("filename")).agg(F.count(F.lit(1)).alias("chunks"))
    return rows.join(n, "filename", "left").select("id", "matter_slug", "status", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query("SELECT user_id AS connection_id, event_type AS source_id, max(date_trunc('day', ts))::DATE::VARCHAR AS since FROM events GROUP BY 1, 2")
def items_listed_once(spark, d):
    """Event types as items, days as windows."""
    e = table(spark, d, "events").select(F.col("user_id").alias("connection_id"), F.col("event_type").alias("source_id"), F.to_date("ts").alias("since"))
    return ingest.listed_once(e).withColumn("since", F.col("since").cast("string"))
