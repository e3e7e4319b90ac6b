"""Review grids: documents by questions, with negative cells asked again in their own document."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.store import cut
from .verification import REFUSAL

# fixed values: whole messages that get a fixed reply and no retrieval, and their greatest length
SMALL_TALK = (
    "hi", "hello", "hey", "yo", "hiya", "howdy", "greetings", "hi there",
    "hello there", "hey there", "good morning", "good afternoon", "good evening",
    "are you there", "you there", "anyone there", "is anyone there",
    "is this working", "is this on", "are you working", "are you on",
    "are you alive", "test", "testing", "ping", "hello are you there",
    "hi are you there",
    "thanks", "thank you", "thank you very much", "thanks a lot", "ty", "thx",
    "ok", "okay", "cool", "great", "good", "nice", "perfect", "got it",
    "who are you", "what are you", "what can you do", "what do you do", "help",
    "how are you", "how are you doing", "whats up", "sup", "how does this work",
    "what is this",
)
SMALL_TALK_LENGTH = 40


def is_small_talk(message: Column) -> Column:
    flat = F.regexp_replace(F.lower(F.trim(F.coalesce(message, F.lit("")))), "[’']", "")
    flat = F.trim(F.regexp_replace(F.regexp_replace(flat, "[.,!?;:]+", " "), r"\s+", " "))
    return (F.length(flat) <= SMALL_TALK_LENGTH) & flat.isin(*SMALL_TALK)


def clause_plan(clauses: DataFrame, doc_types: list[str] | None, custom: list[str] = ()) -> DataFrame:
    """Clauses (id, name, category, question, doc_types) that the given types call for, then custom questions."""
    rows = clauses if not doc_types else clauses.where(F.arrays_overlap("doc_types", F.array(*[F.lit(t) for t in doc_types])))
    own = clauses.sparkSession.createDataFrame([(f"custom-{i}", q.strip()[:48], "Custom", q.strip(), []) for i, q in enumerate(custom, 1) if q.strip()], "id string, name string, category string, question string, doc_types array<string>")
    return rows.select("id", "name", "category", "question", "doc_types").unionByName(own)


def grid_columns(taxonomy: DataFrame, clause_ids: list[str] | None = None, custom: list[str] = ()) -> DataFrame:
    """A grid's questions in order: custom ones, else the given ids that exist, else the whole taxonomy."""
    spark = taxonomy.sparkSession
    if any(q.strip() for q in custom):
        return clause_plan(taxonomy.limit(0), None, custom).withColumn("pos", F.regexp_extract("id", r"(\d+)$", 1).cast("int"))
    if clause_ids:
        wanted = spark.createDataFrame([(c, i) for i, c in enumerate(dict.fromkeys(clause_ids))], "id string, pos int")
        return taxonomy.join(wanted, "id")
    return taxonomy


def cell(citations: Column, answer: Column, filename: Column | None = None) -> Column:
    """struct<status, citations>: found if a verified citation (of the file) is left, potentially_missing if the answer has the refusal in its own letters, else not_confirmed."""
    own = citations if filename is None else F.filter(citations, lambda c: c["filename"] == filename)
    status = F.when(F.size(own) > 0, "found").when(answer.contains(REFUSAL), "potentially_missing").otherwise("not_confirmed")
    return F.struct(status.alias("status"), F.when(F.size(own) > 0, own).otherwise(F.slice(own, 1, 0)).alias("citations"))


def grid(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """Cells of all documents of a matter by its answered questions: one answer per question serves every document.

    ``answers``: matter, question_id, answer_text, citations; ``documents``: matter, filename.  The result is what is asked for, a row
    for each document and question of one matter; questions are joined by matter.
    """
    rows = documents.select("matter", "filename").join(answers, "matter")
    return rows.withColumn("cell", cell(F.col("citations"), F.col("answer_text"), F.col("filename"))).select("matter", "filename", "question_id", F.col("cell.status").alias("status"), F.col("cell.citations").alias("citations"), F.lit("matter").alias("verified_scope"))


class NotIndexed(ValueError):
    """A document that was asked about alone has no chunks."""


def scoped_answers(answers: DataFrame, indexed: DataFrame, filename: str | None = None) -> DataFrame:
    """Answers of a review whose questions got none: a matter without chunks refuses every question, but a single document
    that isn't indexed raises, as its passages were never checked.  ``answers``: matter, question_id, answer_text, citations; ``indexed``: matter, source_filename."""
    if filename is not None and indexed.where(F.col("source_filename") == filename).isEmpty():
        raise NotIndexed(filename)
    return answers.withColumn("answer_text", F.coalesce("answer_text", F.lit(REFUSAL))).withColumn("citations", F.coalesce("citations", F.array().cast(dict(answers.dtypes)["citations"])))


def overlay_rechecks(cells: DataFrame, rechecks: DataFrame) -> DataFrame:
    """Cells that weren't found, replaced by what their document alone says; ``rechecks``: matter, filename, question_id, answer_text, citations.
    A document that could not be asked changes nothing."""
    again = rechecks.withColumn("again", cell(F.col("citations"), F.col("answer_text"), F.col("filename"))).select("matter", "filename", "question_id", "again")
    rows = cells.join(again, ["matter", "filename", "question_id"], "left")
    better = (F.col("status") != "found") & F.col("again").isNotNull()
    return rows.select("matter", "filename", "question_id", F.when(better, F.col("again.status")).otherwise(F.col("status")).alias("status"), F.when(better, F.col("again.citations")).otherwise(F.col("citations")).alias("citations"), F.when(better, "document").otherwise(F.col("verified_scope")).alias("verified_scope"))


def summary(cells: DataFrame, by: list[str]) -> DataFrame:
    """Counts of cells by status."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("found", "potentially_missing", "not_confirmed")]
    return cells.groupBy(*by).agg(*counts, F.count(F.lit(1)).alias("total"))


def absence(rechecks: DataFrame) -> DataFrame:
    """Questions that a whole matter had no answer for, after asking documents one by one until one has it.

    ``rechecks``: matter, question_id, doc_order, filename, ran, found.  Documents after the first hit count as not asked; those
    that could not run never count as checked.
    """
    hit = F.min(F.when(F.col("found") & F.col("ran"), F.col("doc_order"))).alias("hit")
    first = rechecks.groupBy("matter", "question_id").agg(hit, F.min_by("filename", F.when(F.col("found") & F.col("ran"), F.col("doc_order"))).alias("found_in"))
    rows = rechecks.join(first, ["matter", "question_id"])
    asked = F.col("hit").isNull() | (F.col("doc_order") <= F.col("hit"))
    got = rows.groupBy("matter", "question_id").agg(F.count_if(asked & F.col("ran")).alias("checked"), F.count(F.lit(1)).alias("total"), F.min("hit").alias("hit"), F.min("found_in").alias("found_in"))
    status = F.when(F.col("hit").isNotNull(), "found").when(F.col("checked") == F.col("total"), "potentially_missing").otherwise("not_confirmed")
    return got.select("matter", "question_id", status.alias("status"), "checked", "total", "found_in")


def absence_in_waves(missing: DataFrame, documents: DataFrame, ask: Callable[[DataFrame], DataFrame], first: int = 1, growth: int = 2) -> tuple[DataFrame, int]:
    """``absence`` by asking no more than is needed, and the number of calls that it took.

    ``missing``: matter, question_id and what ``ask`` needs of a question; ``documents``: matter, doc_order, filename and what it needs of a
    document.  ``ask`` adds ran and found to rows of both; a model is called there and nowhere else.  Documents are asked about in waves by
    their order, ``first`` and then ``growth`` times as many; after each, questions that have their answer are dropped, so a question
    that is answered by the n-th document is asked of fewer than ``growth`` * n + ``first``.  Each wave's answers are written, as calls are dear.
    """
    place = F.row_number().over(Window.partitionBy("matter").orderBy("doc_order")) - 1
    placed = cut(documents.withColumn("__place", place), "absence-documents")
    longest = placed.agg(F.max("__place")).first()[0]
    pending, waves, calls, lo, size = missing, [], 0, 0, first
    while longest is not None and lo <= longest:
        wave = pending.join(placed.where(F.col("__place").between(lo, lo + size - 1)), "matter")
        asked = cut(ask(wave).select("matter", "question_id", "doc_order", "filename", "ran", "found"), "absence-wave")
        waves.append(asked)
        calls += asked.count()
        answered = asked.where("ran and found").select("matter", "question_id").distinct()
        pending = cut(pending.join(answered, ["matter", "question_id"], "left_anti"), "absence-pending")
        if pending.isEmpty():
            break
        lo, size = lo + size, size * growth
    total = documents.groupBy("matter").agg(F.count(F.lit(1)).alias("total"))
    questions = missing.select("matter", "question_id").join(total, "matter")
    if not waves:
        return questions.where(F.lit(False)).select("matter", "question_id", F.lit("").alias("status"), F.lit(0).cast("long").alias("checked"), "total", F.lit("").alias("found_in")), 0
    got = absence(reduce(DataFrame.unionByName, waves)).drop("total", "status")
    rows = questions.join(got, ["matter", "question_id"])
    status = F.when(F.col("found_in").isNotNull(), "found").when(F.col("checked") == F.col("total"), "potentially_missing").otherwise("not_confirmed")
    return rows.select("matter", "question_id", status.alias("status"), "checked", "total", "found_in"), calls


def topics(bullets: DataFrame) -> DataFrame:
    """Verified bullets (doc_id, topic, page, body) grouped by topic regardless of case, topics ascending, bullets by page."""
    rows = bullets.withColumn("key", F.lower(F.trim("topic")))
    items = F.array_sort(F.collect_list(F.struct("page", "body")))
    return rows.groupBy("doc_id", "key").agg(F.min_by("topic", F.struct("page", "body")).alias("topic"), items.alias("bullets"))


def stale_runs(runs: DataFrame, current: DataFrame) -> DataFrame:
    """Review runs with whether documents or the taxonomy changed since; ``current``: matter, docs_key, taxonomy_version."""
    now = current.select("matter", F.col("docs_key").alias("k"), F.col("taxonomy_version").alias("v"))
    return runs.join(now, "matter", "left").withColumn("stale", ~(F.col("docs_key").eqNullSafe(F.col("k")) & F.col("taxonomy_version").eqNullSafe(F.col("v")))).drop("k", "v")
