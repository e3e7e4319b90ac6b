"""Queries on catalogs, states, reviews and pages, each with DuckDB SQL; tables stand for what ``queries`` says.

Where an operator works on what no table has (page images, uploads, runs), its rows are made of columns of a whole table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, chunking, evals, facts, ingest, retention, retrieval, review, verification
from ..sources import pages as page_images, sinks
from .queries import _BM25, _CELLS, _grid, doc_pages, file_name, query, table


def _jobs(spark, d):
    t = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("done")
    return t.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("matter_slug"), status.alias("status"), F.lit(None).cast("string").alias("error"))


@query("""SELECT c_custkey AS id, c_mktsegment AS service, count(o_orderkey) AS items FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def connections_with_counts(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("service"), F.col("c_name").alias("credential"))
    return catalog.connections_with_counts(c, table(spark, d, "orders").select(F.col("o_custkey").alias("connection_id")))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'error' ELSE 'done' END AS status, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'interrupted' END AS error FROM orders")
def interrupted_jobs(spark, d):
    return catalog.interrupted(_jobs(spark, d)).select("id", "status", "error")


@query("""WITH f AS (SELECT DISTINCT user_id AS matter_slug FROM events), j AS (SELECT o_custkey AS matter_slug, max(o_orderkey) AS id FROM orders GROUP BY 1)
    SELECT f.matter_slug, c_custkey IS NOT NULL AS matter_exists, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'P' THEN 'queued' WHEN 'F' THEN 'done' END AS job_status
    FROM f LEFT JOIN customer ON c_custkey = f.matter_slug LEFT JOIN j ON j.matter_slug = f.matter_slug LEFT JOIN orders ON o_orderkey = j.id""")
def folder_status(spark, d):
    folders = table(spark, d, "events").groupBy(F.col("user_id").alias("matter_slug")).agg(F.max("ts").alias("last_scan"))
    matters = table(spark, d, "customer").select(F.col("c_custkey").alias("slug"))
    return catalog.folder_status(folders, matters, _jobs(spark, d), F.lit("2030-01-01").cast("timestamp")).select("matter_slug", "matter_exists", "job_status")


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_custkey = 8")
def documents_of_matter(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("matter_slug"), F.col("o_orderpriority").alias("filename"), F.col("o_totalprice").alias("price"))
    return catalog.documents_of(t, 8).select("id", "price")


@query("""SELECT conv_id AS thread_id, substring(min_by(text, turn) FILTER (WHERE role = 'user'), 1, 120) AS title, count(*) AS messages FROM conversations GROUP BY conv_id""")
def chat_threads(spark, d):
    return catalog.threads(table(spark, d, "conversations").select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("pos"), "role", "text"))


@query("SELECT doc_id, page_id AS line FROM (SELECT page_id % 50 AS doc_id, page_id FROM pages) WHERE doc_id <> 7 UNION ALL SELECT 7, page_id + 1 FROM pages WHERE page_id % 50 = 7 AND page_id % 4 = 3")
def line_map_replaced(spark, d):
    old = table(spark, d, "pages").select((F.col("page_id") % 50).alias("doc_id"), F.col("page_id").alias("line"))
    return catalog.replace_line_map(old, old.where("line % 4 = 3").withColumn("line", F.col("line") + 1), 7)


# -- states -----------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey AS doc, l_linenumber AS line, CASE WHEN (t AND l_quantity > 40) OR (NOT t AND l_linenumber % 3 = 0 AND NOT ocr) THEN 'failed' WHEN (t AND l_quantity < 10) OR ocr THEN 'needs_review' ELSE 'ready' END AS status
    FROM (SELECT *, l_returnflag = 'R' AS t, l_linestatus = 'O' AS ocr FROM lineitem)""")
def document_states(spark, d):
    t = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("line"), (F.col("l_linenumber") % 3).alias("chunks"), F.lit(0).alias("tables"), (F.col("l_linestatus") == "O").alias("ocr_failed"),
        (F.col("l_quantity") > 40).alias("condensed"), F.when(F.col("l_quantity") < 10, 0).otherwise(1).alias("numbered_pages"), (F.col("l_returnflag") == "R").alias("is_transcript"),
    )
    return ingest.document_states(t).select("doc", "line", "status")


@query("""WITH c AS (SELECT event_id, 200 + event_id % 400 AS code FROM events)
    SELECT event_id, CASE WHEN code = 401 THEN 'auth' WHEN code IN (402, 403) THEN 'access' WHEN code = 429 THEN 'rate' WHEN code >= 500 THEN 'unavailable' WHEN code >= 400 THEN 'error' ELSE 'ok' END AS state FROM c""")
def http_states(spark, d):
    return table(spark, d, "events").select("event_id", ingest.http_state(200 + F.col("event_id") % 400).alias("state"))


@query("""WITH k AS (SELECT conv_id, turn, unnest([role, 'k' || (turn % 3)]) AS key, generate_subscripts([role, 'k' || (turn % 3)], 1) AS i FROM conversations),
    f AS (SELECT conv_id, key, min(turn * 10 + i) AS nth FROM k WHERE key <> 'user' GROUP BY conv_id, key)
    SELECT c.conv_id AS table_id, 'user' || coalesce(',' || string_agg(key, ',' ORDER BY nth), '') AS columns FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f ON f.conv_id = c.conv_id GROUP BY c.conv_id""")
def table_columns(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("table_id"), F.array(F.lit("user")).alias("schema_keys"), F.col("turn").alias("pos"), F.array("role", F.concat(F.lit("k"), (F.col("turn") % 3).cast("string"))).alias("keys"))
    return ingest.column_union(rows).select("table_id", F.array_join("columns", ",").alias("columns"))


@query("""WITH p AS (SELECT o_orderkey, o_orderdate::DATE AS a FROM orders), w AS (SELECT o_orderkey, a, unnest(range(0, 3)) AS i FROM p)
    SELECT o_orderkey, ((a + to_months((5 * i)::INT))::DATE)::VARCHAR AS since FROM w WHERE a + to_months((5 * i)::INT) <= a + to_months(12)""")
def recording_windows(spark, d):
    day = F.col("o_orderdate").cast("date")
    return table(spark, d, "orders").select("o_orderkey", F.explode(ingest.listing_windows(day, F.add_months(day, 12))).alias("w")).select("o_orderkey", F.col("w.since").cast("string").alias("since"))


@query("""SELECT p_partkey, CASE WHEN slash THEN 'bad name' WHEN p_size % 5 = 0 THEN 'unsupported type' END AS rejected,
      CASE WHEN slash OR p_size % 5 = 0 THEN NULL WHEN n = 1 THEN base ELSE 'f' || p_size || '-' || (n - 1) || '.txt' END AS stored_name
    FROM (SELECT *, dense_rank() OVER (PARTITION BY base, slash OR p_size % 5 = 0 ORDER BY sha) AS n
          FROM (SELECT p_partkey, p_size, p_partkey % 9 = 4 AS slash, 'f' || p_size || CASE WHEN p_size % 5 = 0 THEN '.exe' ELSE '.txt' END AS base, 's' || (p_partkey % 23) AS sha FROM part))""")
def upload_names(spark, d):
    p = table(spark, d, "part")
    base = F.concat(F.lit("f"), F.col("p_size").cast("string"), F.when(F.col("p_size") % 5 == 0, ".exe").otherwise(".txt"))
    rows = p.select("p_partkey", F.lit("m").alias("matter"), F.when(F.col("p_partkey") % 9 == 4, F.concat(F.lit("up/"), base)).otherwise(base).alias("filename"), F.concat(F.lit("s"), (F.col("p_partkey") % 23).cast("string")).alias("sha256"), F.lit(5).alias("size"))
    return ingest.upload_states(rows, rows.limit(0).select("matter", "filename", "sha256")).select("p_partkey", "rejected", "stored_name")


@query("SELECT p_partkey FROM part WHERE p_size % 2 = 0 AND p_size < 26")
def attachments_taken(spark, d):
    name = F.concat(F.lit("a"), F.when(F.col("p_size") % 2 == 0, ".PDF").otherwise(".zip"))
    rows = table(spark, d, "part").select("p_partkey", name.alias("filename"), (F.col("p_size").cast("long") * 1024 * 1024).alias("size"))
    return ingest.wanted_attachments(rows).select("p_partkey")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS since FROM customer")
def listing_since(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, ingest.DATED[0]).otherwise("mail").alias("service"), F.col("c_mktsegment").alias("last_sync"))
    return ingest.listed_since(rows).select("id", "since")


@query("SELECT o_custkey AS m, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders) WHERE o_custkey IS DISTINCT FROM 8 GROUP BY 1")
def disposed_rows(spark, d):
    t = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey")).alias("matter_slug"))
    holds = spark.createDataFrame([], "id long, matter_slug string, reason string, released string")
    return retention.dispose({"documents": t}, holds, 8)["documents"].groupBy(F.col("matter_slug").alias("m")).agg(F.count(F.lit(1)).alias("n"))


# -- facts ------------------------------------------------------------------------------------------------------------


def _documents(spark, d):
    t = table(spark, d, "orders")
    return t.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("matter_slug"), F.when(F.col("o_orderkey") % 4 == 0, "v4").otherwise("v3").alias("digest_version"), F.lit("ready").alias("status"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("filename"))


@query("SELECT o_custkey AS matter_slug, count(*) AS total, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS done, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS stuck FROM orders GROUP BY 1")
def stuck_documents(spark, d):
    return facts.stuck(facts.digest_progress(_documents(spark, d), "v4"), idle=True, swept=True)


@query("SELECT o_orderkey AS id, o_custkey AS matter_slug FROM orders WHERE o_orderkey % 4 <> 0")
def digest_backfill(spark, d):
    return facts.backfill(_documents(spark, d), "v4")


@query("""SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS page FROM lineitem WHERE l_orderkey % 3 <> 0
    UNION ALL SELECT l_orderkey, (l_linenumber + 100)::BIGINT FROM lineitem WHERE l_orderkey % 3 = 0 AND l_returnflag = 'R'""")
def facts_replaced(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), "l_returnflag")
    new = f.where("doc_id % 3 = 0 and l_returnflag = 'R'").withColumn("page", F.col("page") + 100)
    again = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("doc_id"))
    return facts.replace_facts(f, _documents(spark, d), new, again, "v4")[0].select("doc_id", "page")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'v4' WHEN o_orderkey % 4 = 0 THEN 'v4' ELSE 'v3' END AS digest_version FROM orders")
def documents_stamped(spark, d):
    docs = _documents(spark, d)
    f = docs.limit(0).select(F.col("id").alias("doc_id"))
    again = docs.where("id % 3 = 0").select(F.col("id").alias("doc_id"))
    return facts.replace_facts(f, docs, f, again, "v4")[1].select("id", "digest_version")


@query("SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS page FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 8")
def facts_of_matter(spark, d):
    f = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("page"), F.lit(0).alias("char_start"))
    return facts.facts_of_matter(f, _documents(spark, d), 8).select("doc_id", "page")


@query("SELECT conv_id AS doc_id, turn AS group_no, unnest([turn * 2, turn * 2 + 1])::BIGINT AS page_number FROM conversations WHERE role <> 'user'")
def pages_to_retry(spark, d):
    g = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("group_no"), (F.col("role") == "user").alias("ok"), F.array((F.col("turn") * 2).cast("long"), (F.col("turn") * 2 + 1).cast("long")).alias("page_numbers"))
    return facts.retry_pages(g)


@query("SELECT conv_id AS doc_id, bool_or(role = 'user') AS done, count(*) FILTER (WHERE role = 'user') AS facts FROM conversations GROUP BY conv_id")
def extractions_done(spark, d):
    g = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("role") == "user").alias("ok"), F.when(F.col("role") == "user", F.array(F.lit("x"))).alias("facts"))
    return facts.extraction_states(g)


# -- retrieval and review ---------------------------------------------------------------------------------------------


@query(f"""WITH {_BM25.replace("FROM documents)", "FROM documents WHERE source = 'src3')").replace("SELECT DISTINCT item_id AS qid, 'src' || (item_id % 20) AS matter, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark", "SELECT 0 AS qid, 'src3' AS matter, unnest(['the', 'of', 'que']) AS term")}
    SELECT doc_id, round(score, 6) AS score, rank, NULL::BIGINT AS total, (SELECT count(*) FROM lex) >= 10 AS truncated FROM lex WHERE rank BETWEEN 5 AND 9""")
def lexical_search_page(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.col("source").alias("matter"), "text")
    page = retrieval.lexical_page(chunks, "src3", "the of que", offset=5, limit=5, key=("matter", "doc_id"))
    return page.select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "total", "truncated")


@query("""SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'what is said' ELSE 'the ' || item_id || ' thing' END AS query FROM benchmark WHERE item_id % 3 = 0""")
def second_pass_questions(spark, d):
    b = table(spark, d, "benchmark")
    asked = F.when(F.col("item_id") % 2 == 0, "what is said").otherwise(F.concat(F.lit('where is "the '), F.col("item_id").cast("string"), F.lit(' thing" ?')))
    return retrieval.second_pass_questions(b.select(F.col("item_id").alias("qid"), asked.alias("question"), (F.col("item_id") % 3 == 0).alias("refused"))).select("qid", "query")


@query("SELECT doc_id, substring(text, greatest(length(text) // 2 - 80, 0) + 1, 240) AS snippet FROM documents")
def snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", retrieval.snippet(F.col("text"), F.floor(F.length("text") / 2)).alias("snippet"))


@query("SELECT 'doc-' || doc_id AS source_filename, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS doc_id FROM documents")
def citation_doc_ids(spark, d):
    known = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), file_name().alias("filename"), F.col("source").alias("matter_slug"))
    return retrieval.with_doc_ids(doc_pages(spark, d).drop("doc_id"), known).select("source_filename", "doc_id")


@query("SELECT item_id AS qid, CASE item_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN true ELSE false END AS small FROM benchmark")
def small_talk(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("Hi!", "Thanks  a lot...", "What’s up?", "what is the term", "hello world")]), (F.col("item_id") % 5 + 1).cast("int"))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), review.is_small_talk(said).alias("small"))


@query("""SELECT p_partkey::VARCHAR AS id, p_name AS name, p_type AS category FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) UNION ALL SELECT 'custom-1', 'Who pays?', 'Custom'""")
def clause_plan(spark, d):
    p = table(spark, d, "part")
    least = p.agg(F.min("p_brand")).first()[0]
    clauses = p.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), F.lit("?").alias("question"), F.array("p_brand").alias("doc_types"))
    return review.clause_plan(clauses, [least], [" Who pays? ", " "]).select("id", "name", "category")


@query("SELECT p_partkey::VARCHAR AS id, CASE p_partkey WHEN 3 THEN 0 ELSE 1 END AS pos FROM part WHERE p_partkey IN (1, 3)")
def grid_columns(spark, d):
    return review.grid_columns(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id")), ["3", "1", "3", "none"]).select("id", "pos")


@query("SELECT o_orderkey AS run, o_custkey % 2 = 0 OR o_orderkey % 3 <> 0 AS stale FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")
def stale_reviews(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("matter"), F.lit("k1").alias("docs_key"), F.when(F.col("o_orderkey") % 3 == 0, "t2").otherwise("t1").alias("taxonomy_version"))
    now = table(spark, d, "customer").select(F.col("c_custkey").alias("matter"), F.when(F.col("c_custkey") % 2 == 0, "k2").otherwise("k1").alias("docs_key"), F.lit("t2").alias("taxonomy_version"))
    return review.stale_runs(runs.join(now.select("matter"), "matter", "left_semi"), now).select("run", "stale")


@query("SELECT item_id AS question_id, CASE item_id % 3 WHEN 0 THEN 'potentially_missing' ELSE 'not_confirmed' END AS status FROM benchmark")
def cell_of_refusals(spark, d):
    said = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Sorry. "), F.lit(verification.REFUSAL))).when(F.col("item_id") % 3 == 1, F.upper(F.lit(verification.REFUSAL))).otherwise("It says so.")
    none = F.array().cast("array<struct<filename:string,page:bigint,span:string>>")
    return table(spark, d, "benchmark").select(F.col("item_id").alias("question_id"), review.cell(none, said)["status"].alias("status"))


@query(f"""WITH {_CELLS} SELECT filename AS "Document", 'Q' || question_id AS "Clause", status AS "Status", CASE WHEN status = 'found' THEN filename || ' p.1' ELSE '' END AS "Citation" FROM cells""")
def grid_export(spark, d):
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("Q"), F.col("item_id").cast("string")).alias("name"))
    return sinks.grid_rows(_grid(spark, d), names).select("Document", "Clause", "Status", "Citation")


@query("SELECT item_id AS question_id, CASE WHEN item_id % 2 = 0 THEN 'yes' ELSE 'I could not find this in the documents.' END AS answer_text FROM benchmark")
def unanswered_are_refusals(spark, d):
    b = table(spark, d, "benchmark")
    answers = b.select(F.lit("m").alias("matter"), F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 2 == 0, "yes").alias("answer_text"), F.array().cast("array<string>").alias("citations"))
    return review.scoped_answers(answers, answers.limit(0).select("matter", F.col("answer_text").alias("source_filename"))).select("question_id", "answer_text")


@query("SELECT item_id AS fact_id, item_id % 3 = 0 AS absent, CASE WHEN item_id % 3 <> 0 THEN 'm' || (item_id % 7) END AS matter FROM benchmark")
def golden_questions(spark, d):
    b = table(spark, d, "benchmark")
    absent = F.when(F.col("item_id") % 3 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    manifest = b.select(F.col("item_id").alias("fact_id"), absent.alias("expected_absent_topics"), F.concat(F.lit("m"), (F.col("item_id") % 7).cast("string")).alias("matter_or_client"))
    return evals.golden(b.select(F.col("item_id").alias("fact_id"), F.col("text").alias("question")), manifest).select("fact_id", "absent", "matter")


@query(r"SELECT conv_id AS qid, min(turn) + 1 AS rank FROM conversations WHERE contains(regexp_replace(text, '\s+', '', 'g'), 'ofthe') GROUP BY conv_id")
def rank_of_correct(spark, d):
    return evals.rank_of_correct(table(spark, d, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("rank"), "text"), F.lit("of the")).select("qid", "rank")


@query("SELECT source AS source_filename, round(avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0 END), 6) AS rate FROM documents GROUP BY source")
def section_rate(spark, d):
    return evals.section_match_rate(table(spark, d, "documents").select(F.col("source").alias("source_filename"), F.coalesce(F.col("lang") == "en", F.lit(False)).alias("section_detected")))


# -- pages ------------------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey, round(least(p_size / 40.0::DOUBLE, 1), 6) AS share, CASE WHEN p_size < 20 AND p_size % 2 = 0 THEN 'pymupdf' WHEN p_size >= 20 AND p_size % 2 = 0 THEN 'mixed' WHEN p_size >= 20 THEN 'tesseract' ELSE 'pymupdf' END AS route FROM part""")
def page_routes(spark, d):
    box = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("p_size").cast("double").alias("x1"), F.lit(10.0).alias("y1")))
    share = page_images.image_share(box, F.lit(40.0), F.lit(10.0))
    text = F.when(F.col("p_size") % 2 == 0, F.repeat(F.lit("a"), F.lit(30))).otherwise(F.repeat(F.lit("\n "), F.lit(30)))
    return table(spark, d, "part").select("p_partkey", F.round(share, 6).alias("share"), page_images.route(text, share).alias("route"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'ocr found no text' WHEN p_size < 50 AND p_size % 2 = 0 THEN 'ocr confidence ' || p_size || '.0' END AS why FROM part")
def ocr_verdicts(spark, d):
    text = F.when(F.col("p_size") % 3 == 0, " \n\t").otherwise("some text")
    conf = F.when(F.col("p_size") % 2 == 0, F.col("p_size")).otherwise(90).cast("double")
    return table(spark, d, "part").select("p_partkey", page_images.ocr_verdict(text, conf).alias("why"))


@query("SELECT 'm' AS matter, p_brand AS source_filename, bool_and(p_size % 4 <> 1) AS scanned FROM part GROUP BY p_brand")
def scanned_documents(spark, d):
    text = F.when(F.col("p_size") % 4 == 1, F.repeat(F.lit("a"), F.lit(20))).otherwise(F.concat(F.repeat(F.lit("\n"), F.lit(40)), F.lit("19 characters only.")))
    return chunking.scanned_documents(table(spark, d, "part").select(F.lit("m").alias("matter"), F.col("p_brand").alias("source_filename"), text.alias("page_text")))


@query("SELECT doc_id, 1::BIGINT AS page, 'a b' AS value FROM documents WHERE doc_id % 60 >= 40")
def form_values(spark, d):
    line = table(spark, d, "documents").select("doc_id", F.lit(1).cast("long").alias("page"), (F.col("doc_id") % 60).cast("double").alias("q"))
    rules = line.select("doc_id", "page", F.lit(0.0).alias("x0"), F.lit(100.0).alias("y0"), F.col("q").alias("x1"), F.lit(101.0).alias("y1"))
    span = lambda x, text, size, y: F.struct(F.lit(float(x)).alias("x0"), F.lit(float(y - 9)).alias("y0"), F.lit(float(x + 5)).alias("x1"), F.lit(float(y)).alias("y1"), F.lit(text).alias("text"), F.lit(size).alias("size"))
    spans = line.select("doc_id", "page", F.explode(F.array(span(9, "b", 9.0, 99), span(2, "a", 8.5, 99), span(3, "label", 12.0, 99), span(4, "far", 9.0, 60))).alias("s")).select("doc_id", "page", "s.*")
    return page_images.form_fields(rules, spans).select("doc_id", "page", "value")
