"""Digests of transcripts: a model's bullets, each verified by itself against the pages it was shown, with the lines they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .verification import derived_lines, verified_claims

# fixed values: what a bullet looks like, and the citation tag that isn't part of what it says
BULLET, TAG = r"^[-*]\s*\[([^\]]{2,60})\]\s*(.+)$", r"\[document:[^\]]*\]"


def bullets(outputs: DataFrame) -> DataFrame:
    """(doc_id, batch, pos, topic, body, line) of a model's outputs (doc_id, batch, raw): a line that isn't a bullet says nothing, and a null
    output, a call that failed, has none."""
    said = F.regexp_replace("raw", r"(?is)<think>.*?</think>", "")
    lines = outputs.select("doc_id", "batch", F.posexplode(F.split(said, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("pos", "line")).withColumn("line", F.trim("line"))
    body = F.trim(F.regexp_replace(F.regexp_extract("line", BULLET, 2), TAG, ""))
    return lines.where(F.col("line").rlike(BULLET)).select("doc_id", "batch", "pos", F.lower(F.trim(F.regexp_extract("line", BULLET, 1))).alias("topic"), body.alias("body"), "line")


def judged_bullets(outputs: DataFrame, grounding: DataFrame, line_map: DataFrame) -> DataFrame:
    """One row per bullet: doc_id, batch, pos, topic, body, verified, and of its first citation span, filename, page and lines.

    ``grounding``: doc_id, batch, chunk_id, rank, source_filename, page_number, char_start, char_end, text, the chunks that each call was
    shown; ``line_map``: doc_id, page, line, char_start, char_end.  A bullet is verified if one of its own claims is; what another bullet
    or batch says doesn't count for it.  Lines are null where a page has no numbered lines or the span stands on it more than once.
    """
    found = bullets(outputs).withColumn("qid", F.concat_ws(":", F.col("doc_id").cast("string"), F.col("batch").cast("string"), F.col("pos").cast("string")))
    shown = found.select("qid", "doc_id", "batch").join(grounding, ["doc_id", "batch"]).drop("doc_id", "batch")
    claims = verified_claims(found.select("qid", F.col("line").alias("answer_text")), shown).where("accepted")
    first = claims.withColumn("nth", F.row_number().over(Window.partitionBy("qid").orderBy("pos"))).where("nth = 1").select("qid", "span", "filename", "page", "char_start", "char_end")
    rows = found.drop("line").join(first, "qid", "left")
    pages = grounding.groupBy("doc_id", "page_number").agg(F.min_by("text", "rank").alias("page_text"))
    cited = rows.where("page is not null").select("doc_id", "page", "char_start", "char_end", "span").distinct()
    lines = derived_lines(cited, line_map, pages).select("doc_id", "page", "char_start", "char_end", "span", "lines")
    joined = rows.join(lines, ["doc_id", "page", "char_start", "char_end", "span"], "left")
    return joined.select("doc_id", "batch", "pos", "topic", "body", F.col("page").isNotNull().alias("verified"), "span", "filename", "page", "lines")


def digest_map(judged: DataFrame, pages: DataFrame, outputs: DataFrame) -> DataFrame:
    """(doc_id, topics, pages, batches, failed, verified, rejected): a document's verified bullets by topic, ascending, in order of pages, and
    what was counted.  Nothing is worded anew.  ``pages``: doc_id, page_number of all indexed pages."""
    good = judged.where("verified")
    item = F.struct("page", "batch", "pos", "body", "span", "filename", "lines")
    by_topic = good.groupBy("doc_id", "topic").agg(F.array_sort(F.collect_list(item)).alias("bullets"))
    topics = by_topic.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("topic", "bullets"))).alias("topics"))
    kind = dict(topics.dtypes)["topics"]
    counted = judged.groupBy("doc_id").agg(F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("rejected"))
    calls = outputs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("batches"), F.count_if(F.col("raw").isNull()).alias("failed"))
    known = pages.groupBy("doc_id").agg(F.count_distinct("page_number").alias("pages"))
    rows = known.join(calls, "doc_id", "left").join(counted, "doc_id", "left").join(topics, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("topics", F.array().cast(kind)).alias("topics"), "pages", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("batches", "failed", "verified", "rejected")])


def digest_rows(judged: DataFrame) -> DataFrame:
    """(doc_id, pos, Topic, Testimony, Cite): the rows of a deposition digest's table in order: topic, page, place in the output."""
    said = F.concat(F.col("body"), F.lit("\n\""), F.coalesce("span", F.lit("")), F.lit("\""))
    cite = F.concat(F.col("filename"), F.lit(" p."), F.col("page").cast("string"), F.when(F.col("lines").isNotNull(), F.concat(F.lit(":"), "lines")).otherwise(""))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("topic", "page", "batch", "pos")) - 1
    return judged.where("verified").select("doc_id", place.alias("pos"), F.col("topic").alias("Topic"), said.alias("Testimony"), cite.alias("Cite"))
