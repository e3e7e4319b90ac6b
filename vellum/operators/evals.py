"""Evaluations of retrieval, answers and extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import plain_norm, squeezed
from .verification import REFUSAL

# fixed values: overlap of cited tokens that counts as the same passage, length from which a shorter span counts
OVERLAP, NEEDLE = 0.6, 12
TARGETS = {"date_event": 0.85, "amount": 0.85, "party": 0.90}


def golden(questions: DataFrame, manifest: DataFrame) -> DataFrame:
    """Questions with what is expected; those about absent topics are asked without a scope."""
    rows = questions.join(manifest, "fact_id").withColumn("absent", F.size("expected_absent_topics") > 0)
    return rows.withColumn("matter", F.when(F.col("absent"), F.lit(None)).otherwise(F.col("matter_or_client")))


def eval_tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 1))


def score_golden(runs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each answered question with whether it passes.

    Present facts need a citation of the right file on the right page, or most of whose tokens are in the expected span; no rejected claims and no
    refusal.  Absent ones need a refusal without citations.  ``runs``: fact_id, answer_text, citations, rejected_claims.
    """
    rows = runs.join(manifest, "fact_id")
    want = eval_tokens(F.col("verbatim_span"))

    def overlap(c: Column) -> Column:
        got = eval_tokens(c["span"])
        return F.when(F.size(got) > 0, F.size(F.array_intersect(got, want)) / F.size(got)).otherwise(0.0)

    hit = F.exists("citations", lambda c: (c["filename"] == F.col("filename")) & ((c["page"] == F.col("page_number")) | (overlap(c) >= OVERLAP)))
    says_no = F.ltrim(F.col("answer_text")).startswith(REFUSAL)
    absent = F.size("expected_absent_topics") > 0
    passed = F.when(absent, says_no & (F.size("citations") == 0)).otherwise(hit & (F.size("rejected_claims") == 0) & ~says_no)
    return rows.select("fact_id", absent.alias("absent"), F.coalesce(passed, F.lit(False)).alias("passed"))


def recall_at_k(ranked: DataFrame, gold: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Share of questions with a right row (file and page) in the first k; ``ranked``: qid, config, rank, source_filename, page_number; ``gold``: qid, class, gold_filename, gold_page."""
    right = ranked.where(F.col("rank") < k).join(gold.select("qid", "gold_filename", "gold_page"), "qid").where((F.col("source_filename") == F.col("gold_filename")) & (F.col("page_number") == F.col("gold_page")))
    hits = right.select("qid", "config").distinct().withColumn("hit", F.lit(1.0))
    asked = gold.select("qid", "class").crossJoin(ranked.select("config").distinct())
    return asked.join(hits, ["qid", "config"], "left").groupBy(*by).agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


def recall_table(recall: DataFrame, configs: list[str]) -> DataFrame:
    return recall.groupBy("class").pivot("config", configs).agg(F.first("recall"))


def rank_scores(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of questions right at the first rank, and the mean reciprocal rank; a row is right if file, page and normalised span are.
    ``ranked``: qid, config, rank (from 0), source_filename, page_number, text; ``gold``: qid, gold_filename, gold_page, span."""
    rows = ranked.join(gold, "qid")
    right = (F.col("source_filename") == F.col("gold_filename")) & (F.col("page_number") == F.col("gold_page")) & plain_norm(F.col("text")).contains(F.trim(plain_norm(F.col("span"))))
    best = rows.groupBy("config", "qid").agg(F.min(F.when(right, F.col("rank") + 1)).alias("best"))
    return best.groupBy("config").agg(F.round(F.avg(F.when(F.col("best") == 1, 1.0).otherwise(0.0)), 6).alias("rank1"), F.round(F.avg(F.coalesce(1 / F.col("best"), F.lit(0.0))), 6).alias("mrr"))


def rank_of_correct(ranked: DataFrame, needle: Column) -> DataFrame:
    """The first rank (from 1) of each question whose text holds the needle, white space aside."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return ranked.where(bare(F.col("text")).contains(bare(needle))).groupBy("qid").agg((F.min("rank") + 1).alias("rank"))


def fact_recall(inventory: DataFrame, facts: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """Found and all facts of an inventory (doc, fact_type, span_contains) by type, and whether the share meets its target.

    A fact is found if one of its document and type holds the text, or is long enough and lies in it; types without any are not enforced.
    """
    got = facts.groupBy("doc", "fact_type").agg(F.collect_set(squeezed(F.lower("span"))).alias("spans"))
    want = squeezed(F.lower("span_contains"))
    rows = inventory.join(got, ["doc", "fact_type"], "left").withColumn("want", want)
    hit = F.exists(F.coalesce("spans", F.array().cast("array<string>")), lambda s: s.contains(F.col("want")) | ((F.length(s) >= NEEDLE) & F.col("want").contains(s)))
    by = rows.groupBy("fact_type").agg(F.count_if(hit).alias("found"), F.count(F.lit(1)).alias("total"))
    target = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    return by.withColumn("recall", F.round(F.col("found") / F.col("total"), 6)).withColumn("met", F.coalesce(F.col("recall") >= target[F.col("fact_type")], F.lit(True)))


def latency(times: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, median and the 95th percentile by nearest index (half to even), not interpolated."""
    rows = times.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(value)) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    at = F.bround(F.lit(0.95) * (F.col("n") - 1), 0)
    return rows.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"), F.round(F.max(F.when(F.col("i") == at, F.col(value))), 6).alias("p95"))


def section_match_rate(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_filename").agg(F.round(F.avg(F.col("section_detected").cast("double")), 6).alias("rate"))
