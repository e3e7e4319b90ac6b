"""Facts of documents: the gate that keeps one only if its span is on a page, and the matter overview."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import fact_key
from ..functions.text import located, normal_form
from ..schemas import REVIEW_STATES
from ..sources.store import cut, spread
from .chunking import extraction_groups

# fixed values: what a fact of each type must have, and all it can have
REQUIRED = {"party": ("name",), "date_event": ("kind", "label", "date_text"), "amount": ("value",), "defined_term": ("term",), "key_ref": ("ref_value",)}
VALUES = {
    "party": ("name", "role", "org_form"),
    "date_event": ("kind", "label", "date_text", "date_iso", "date_kind", "anchor"),
    "amount": ("value", "currency", "purpose"),
    "defined_term": ("term",),
    "key_ref": ("ref_type", "ref_value"),
}
EVENT_KINDS = ("event", "obligation", "deadline")
DUE_KINDS = ("deadline", "obligation")
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
NO_DATE = "9999-99-99"


def _value(k: str) -> Column:
    return F.nullif(F.trim(F.coalesce(F.col("raw")[k], F.lit(""))), F.lit(""))


def gate_facts(raw_facts: DataFrame, pages: DataFrame) -> DataFrame:
    """Facts (doc_id, group_no, pos, fact_type, page, span, raw map) whose defining fields are there and whose span lies on a page of
    their group; ``pages``: doc_id, group_no, page_number, page_text.

    The reported page is tried first; page and offsets are those of where the span was found.  A date is kept as ISO only if it is explicit and looks like one.
    """
    rows = raw_facts.withColumn("span", F.trim(F.coalesce("span", F.lit(""))))
    named = F.when((F.col("fact_type") == "party") & _value("name").isNull(), F.map_concat(F.map_filter("raw", lambda k, v: k != "name"), F.create_map(F.lit("name"), F.col("span")))).otherwise(F.col("raw"))
    rows = rows.withColumn("raw", named)
    kind = (F.col("fact_type") == "date_event") & _value("kind").isNull() & _value("purpose").isin(*EVENT_KINDS)
    rows = rows.withColumn("raw", F.when(kind, F.map_concat(F.map_filter("raw", lambda k, v: k != "kind"), F.create_map(F.lit("kind"), _value("purpose")))).otherwise(F.col("raw")))
    able = reduce(lambda a, b: a | b, [(F.col("fact_type") == t) & reduce(lambda a, b: a & b, [_value(k).isNotNull() for k in need]) for t, need in REQUIRED.items()])
    rows = rows.where((F.col("span") != "") & able)
    tried = rows.join(pages.select("doc_id", "group_no", "page_number", "page_text"), ["doc_id", "group_no"])
    tried = tried.withColumn("at", located(F.col("page_text"), F.col("span"))).where("at is not null").drop("page_text")
    first = Window.partitionBy("doc_id", "group_no", "pos").orderBy((F.col("page_number") == F.col("page")).desc_nulls_last(), "page_number")
    hit = tried.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    explicit = (F.col("raw")["date_kind"] == "explicit") & F.col("raw")["date_iso"].rlike(ISO_DATE)

    def entries(t: str) -> Column:
        value = {k: _value(k) for k in VALUES[t]}
        if "date_iso" in value:
            value["date_iso"] = F.when(explicit, value["date_iso"])
        return F.create_map(*[x for k, v in value.items() for x in (F.lit(k), v)])

    values = reduce(lambda c, t: c.when(F.col("fact_type") == t, entries(t)), VALUES, F.when(F.lit(False), F.lit(None)))
    return hit.select("doc_id", "fact_type", F.col("page_number").cast("long").alias("page"), F.col("at.start").cast("long").alias("char_start"), F.col("at.end").cast("long").alias("char_end"), "span", fact_key(F.col("doc_id"), F.col("fact_type"), F.col("page_number"), normal_form("span")).alias("fact_key"), values.alias("value"))


def retry_pages(groups: DataFrame) -> DataFrame:
    """Pages of groups whose extraction failed (``ok`` false), each to be extracted alone; ``groups``: doc_id, group_no, ok, page_numbers."""
    return groups.where(~F.col("ok")).select("doc_id", "group_no", F.explode("page_numbers").alias("page_number"))


def extract_facts(pages: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Facts of documents' pages in two stages, and which documents count as done: (gated facts, states).

    ``pages``: doc_id, page_number, page_text; ``extract`` adds ``facts`` to calls with a ``text``, null for a call that failed (as
    ``plugins.extracted`` does).  Groups of pages go first; of a group that failed each page is asked alone, so that one bad page doesn't blank
    the others.  States are doc_id, groups, failed_groups, failed_pages, raw, facts and done: a document is done unless the group call and all
    pages of some group failed, also when there is nothing in it.  Answers are written, as calls are dear.
    """
    grouped = cut(extraction_groups(pages.select("doc_id", "page_number", F.coalesce("page_text", F.lit("")).alias("page_text"))), "extraction-pages")
    headed = F.concat(F.lit("=== page "), F.col("page_number").cast("string"), F.lit(" ===\n"), "page_text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", headed.alias("t")))), lambda x: x["t"]), "\n\n")
    first = cut(extract(grouped.groupBy("doc_id", "group_no").agg(text.alias("text"))).select("doc_id", "group_no", "facts"), "extraction-groups")
    failed = first.where("facts is null").select("doc_id", "group_no")
    alone = cut(extract(grouped.join(failed, ["doc_id", "group_no"], "left_semi").select("doc_id", "group_no", "page_number", headed.alias("text"))).select("doc_id", "group_no", "page_number", "facts"), "extraction-retries")
    # a group's facts are looked for on all its pages, those of a page that was asked alone on this page only
    by_group = grouped.select("doc_id", "group_no", F.lit(-1).cast("long").alias("alone"), "page_number", "page_text")
    by_page = grouped.select("doc_id", "group_no", F.col("page_number").cast("long").alias("alone"), "page_number", "page_text")
    answers = first.select("doc_id", "group_no", F.lit(-1).cast("long").alias("alone"), "facts").unionByName(alone.select("doc_id", "group_no", F.col("page_number").cast("long").alias("alone"), "facts"))
    call = lambda df: df.withColumn("group_no", F.struct("group_no", "alone")).drop("alone")
    raw = call(answers).select("doc_id", "group_no", F.posexplode("facts").alias("pos", "f")).select("doc_id", "group_no", "pos", "f.fact_type", F.col("f.page").alias("page"), "f.span", "f.raw")
    gated = gate_facts(raw, call(by_group.unionByName(by_page)))
    kept = gated.groupBy("doc_id").agg(F.count(F.lit(1)).alias("facts"))
    groups = first.join(alone.groupBy("doc_id", "group_no").agg(F.count_if(F.col("facts").isNull()).alias("bad_pages"), F.count_if(F.col("facts").isNotNull()).alias("good_pages"), F.sum(F.coalesce(F.size("facts"), F.lit(0))).alias("raw_pages")), ["doc_id", "group_no"], "left")
    ok = F.col("facts").isNotNull() | (F.coalesce("good_pages", F.lit(0)) > 0)
    raw_count = F.sum(F.when(F.col("facts").isNotNull(), F.size("facts")).otherwise(F.coalesce("raw_pages", F.lit(0))))
    states = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("facts").isNull()).alias("failed_groups"), F.sum(F.coalesce("bad_pages", F.lit(0))).alias("failed_pages"), raw_count.alias("raw"), F.every(ok).alias("done"))
    return gated, states.join(kept, "doc_id", "left").withColumn("facts", F.coalesce("facts", F.lit(0)))


def stamped(documents: DataFrame, states: DataFrame, version: str) -> DataFrame:
    """Documents (id, digest_version) stamped with a version where their extraction is done; others keep what they had and are asked again."""
    done = states.where("done").select(F.col("doc_id").alias("id"), F.lit(version).alias("__new"))
    return documents.join(done, "id", "left").withColumn("digest_version", F.coalesce("__new", "digest_version")).drop("__new")


def extraction_states(results: DataFrame) -> DataFrame:
    """Whether each document's extraction counts as done: some group or page of it succeeded, also if it had no facts."""
    return results.groupBy("doc_id").agg(F.bool_or("ok").alias("done"), F.sum(F.coalesce(F.size("facts"), F.lit(0))).alias("facts"))


def stale_documents(documents: DataFrame, version: str) -> DataFrame:
    return documents.where(F.col("status").isin("ready", "needs_review") & ~F.col("digest_version").eqNullSafe(F.lit(version))).orderBy("id")


def digest_progress(documents: DataFrame, version: str) -> DataFrame:
    able = documents.where(F.col("status").isin("ready", "needs_review"))
    done = F.count_if(F.col("digest_version").eqNullSafe(F.lit(version)))
    return able.groupBy("matter_slug").agg(F.count(F.lit(1)).alias("total"), done.alias("done"))


def replace_facts(facts: DataFrame, documents: DataFrame, new: DataFrame, doc_ids: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Facts and documents after an extraction of ``doc_ids`` (doc_id): their facts are replaced, also by none, and they are
    stamped with the version.  A document that is gone meanwhile gets no facts back."""
    there = cut(spread(documents.select(F.col("id").alias("doc_id")), "doc_id").join(doc_ids, "doc_id").distinct(), "facts-replaced")
    # outer and inner joins, as semi- and anti-joins are moved below the spreading
    kept = spread(facts, "doc_id").join(there.withColumn("_read", F.lit(True)), "doc_id", "left").where("_read is null")
    rows = kept.select(*facts.columns).unionByName(spread(new, "doc_id").join(there, "doc_id").select(*facts.columns))
    stamped = documents.join(there.select(F.col("doc_id").alias("id"), F.lit(True).alias("_read")), "id", "left")
    return rows, stamped.withColumn("digest_version", F.when(F.col("_read"), F.lit(version)).otherwise(F.col("digest_version"))).select(*documents.columns)


def stuck(progress: DataFrame, idle: bool, swept: bool) -> DataFrame:
    """Progress with the documents of each matter that nobody works on any more: all that are left once the queue is idle
    and the sweep at the start is through."""
    left = F.col("total") - F.col("done")
    return progress.withColumn("stuck", F.when((left > 0) & F.lit(idle and swept), left).otherwise(0).cast("long"))


def backfill(documents: DataFrame, version: str) -> DataFrame:
    """Documents to extract again, in order."""
    return stale_documents(documents, version).select("id", "matter_slug")


def facts_of_matter(facts: DataFrame, documents: DataFrame, matter: str) -> DataFrame:
    docs = documents.where(F.col("matter_slug") == matter).select(F.col("id").alias("doc_id"), "filename", "matter_slug")
    return facts.join(docs, "doc_id").orderBy("doc_id", "page", "char_start")


def reviewed(facts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Facts with their review: status and a confirmed date, null without one; ``reviews``: matter_slug, fact_key, status, confirmed_date."""
    return facts.join(reviews, ["matter_slug", "fact_key"], "left")


def set_reviews(reviews: DataFrame, changes: DataFrame) -> DataFrame:
    """Reviews after changes of the same columns; a null status takes a review away, one that isn't of REVIEW_STATES raises, as does a change of no matter."""
    if not changes.where("matter_slug is null").unionByName(changes.where(~F.col("status").isin(*REVIEW_STATES))).isEmpty():
        raise ValueError(f"a review needs a matter and a status of {REVIEW_STATES}, or none")
    kept = reviews.join(changes, ["matter_slug", "fact_key"], "left_anti")
    return kept.unionByName(changes.where("status is not null").select(*reviews.columns))


def orphaned_reviews(reviews: DataFrame, facts: DataFrame) -> DataFrame:
    return reviews.join(facts.select("matter_slug", "fact_key"), ["matter_slug", "fact_key"], "left_anti")


def pruned_reviews(reviews: DataFrame, facts: DataFrame) -> DataFrame:
    return reviews.join(facts.select("matter_slug", "fact_key"), ["matter_slug", "fact_key"], "left_semi")


def shown(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("status").eqNullSafe(F.lit("dismissed")))


def overview_counts(rows: DataFrame) -> DataFrame:
    """Counts by type of a matter's reviewed facts, and how many are dismissed."""
    live = ~F.col("status").eqNullSafe(F.lit("dismissed"))
    return rows.groupBy("matter_slug").agg(*[F.count_if(live & (F.col("fact_type") == t)).alias(t) for t in REQUIRED], F.count_if(~live).alias("dismissed"))


def timeline(rows: DataFrame) -> DataFrame:
    """Date events by date, those without one last."""
    date = F.coalesce(F.nullif(F.col("value")["date_iso"], F.lit("")), F.lit(NO_DATE))
    return shown(rows).where("fact_type = 'date_event'").withColumn("sort_date", date).orderBy("sort_date", "doc_id", "page", "char_start")


def deadlines(rows: DataFrame) -> DataFrame:
    """Deadlines and obligations, unconfirmed first, then by the confirmed or stated date."""
    date = F.coalesce(F.nullif("confirmed_date", F.lit("")), F.nullif(F.col("value")["date_iso"], F.lit("")), F.lit(NO_DATE))
    due = shown(rows).where((F.col("fact_type") == "date_event") & F.col("value")["kind"].isin(*DUE_KINDS))
    return due.withColumn("confirmed", F.col("status").eqNullSafe(F.lit("confirmed"))).withColumn("sort_date", date).orderBy("confirmed", "sort_date", "doc_id", "page", "char_start")


def parties(rows: DataFrame) -> DataFrame:
    """Parties, one per name regardless of case and punctuation; the first mention is shown."""
    key = F.trim(F.regexp_replace(F.lower(F.col("value")["name"]), "[^a-z0-9]+", " "))
    first = Window.partitionBy("matter_slug", "party_key").orderBy("doc_id", "page", "char_start")
    return shown(rows).where("fact_type = 'party'").withColumn("party_key", key).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def calendar_rows(rows: DataFrame) -> DataFrame:
    """Deadlines that can be exported: confirmed, with a date given by whoever confirmed them."""
    return deadlines(rows).where(F.col("confirmed") & (F.coalesce("confirmed_date", F.lit("")) != ""))
