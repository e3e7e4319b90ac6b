"""Catalog tables: listings, upserts, line maps, holds and the audit chain.  Tables are DataFrames; a change gives the new table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.keys import audit_hash
from ..functions.udf import small_batches
from ..sources.store import shared_path

GENESIS = "genesis"
#: About so many entries of one long chain are sorted and walked by a task; the next task goes on with the last hash.
CHAIN_ROWS = 250_000
# fixed value: the greatest length of a thread's title
TITLE = 120


def matters_with_counts(matters: DataFrame, documents: DataFrame) -> DataFrame:
    """Matters with the number of their documents and of those still to be read, by name."""
    n = documents.groupBy(F.col("matter_slug").alias("slug")).agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status").isin("queued", "parsing")).alias("pending"))
    return matters.join(n, "slug", "left").fillna(0, ["documents", "pending"]).orderBy("display_name")


def connections_with_counts(connections: DataFrame, items: DataFrame) -> DataFrame:
    """Connections without their credential, with the number of items seen, the newest first."""
    n = items.groupBy(F.col("connection_id").alias("id")).agg(F.count(F.lit(1)).alias("items"))
    return connections.drop("credential").join(n, "id", "left").fillna(0, ["items"]).orderBy(F.col("id").desc())


def latest(table: DataFrame, by: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return table.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(order.desc()))).where("_nth = 1").drop("_nth")


def jobs(table: DataFrame, limit: int | None = None, **equal) -> DataFrame:
    """Jobs whose columns equal the given values (a list: any of them), the newest first."""
    for name, value in equal.items():
        if value is not None:
            table = table.where(F.col(name).isin(*value) if isinstance(value, (list, tuple)) else F.col(name) == value)
    rows = table.orderBy(F.col("id").desc())
    return rows if limit is None else rows.limit(limit)


def active_job(table: DataFrame) -> DataFrame:
    """The newest queued or running job of each dedupe key."""
    return latest(table.where(F.col("status").isin("queued", "running")), ["dedupe_key"], F.col("id"))


def interrupted(table: DataFrame, reason: str = "interrupted") -> DataFrame:
    live = F.col("status").isin("queued", "running")
    return table.withColumn("error", F.when(live, F.lit(reason)).otherwise(F.col("error"))).withColumn("status", F.when(live, "error").otherwise(F.col("status")))


def upsert(table: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with ``changes`` in the place of rows of the same key; a key must not come twice in ``changes``."""
    unique(changes, key, "changes")
    return table.join(changes, key, "left_anti").unionByName(changes.select(*table.columns))


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """``table`` with those ``rows`` whose key it doesn't have yet; of equal keys one."""
    return table.unionByName(rows.dropDuplicates(key).join(table, key, "left_anti").select(*table.columns))


def unique(table: DataFrame, key: list[str], what: str) -> DataFrame:
    twice = table.groupBy(*key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: more than one row of {[twice[0][k] for k in key]}")
    return table


def delete_where(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``table`` without the rows of ``keys``: with the tables below it this makes a cascade."""
    return table.join(keys, on, "left_anti")


def move_document(documents: DataFrame, doc_id: int, matter: str) -> DataFrame:
    me = F.col("id") == doc_id
    return documents.withColumn("matter_slug", F.when(me, F.lit(matter)).otherwise(F.col("matter_slug"))).withColumn("status", F.when(me, "queued").otherwise(F.col("status"))).withColumn("reason", F.when(me, F.lit(None)).otherwise(F.col("reason")))


def active_holds(holds: DataFrame) -> DataFrame:
    """The oldest hold of each matter that isn't released."""
    return holds.where("released is null").groupBy("matter_slug").agg(F.min("id").alias("hold_id"), F.min_by("reason", "id").alias("reason"))


def line_map(pages: DataFrame) -> DataFrame:
    """(doc_id, page, line, char_start, char_end) of numbered lines (doc_id, page, line, pos, content) joined by line ends."""
    length = F.length("content").cast("long")
    before = F.sum(length + 1).over(Window.partitionBy("doc_id", "page").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    start = F.coalesce(before, F.lit(0))
    return pages.select("doc_id", "page", "line", start.alias("char_start"), (start + length).alias("char_end"))


def audit_chain(entries: DataFrame) -> DataFrame:
    """Entries (id, ts, event, matter_slug, detail) with the hash chain over them in order of id.

    Each hash needs the one before, so a chain is walked in order: rows are sorted where their chain is, stream through in Arrow
    batches, and only the last hash is kept.  Chains are per ``log`` if there is such a column, which spreads them over tasks.  A
    single chain is cut into ranges of about CHAIN_ROWS entries, which are dealt out at once and walked one after the other; each is
    written, and only its last hash goes on to the next.
    """
    log = [c for c in ("log",) if c in entries.columns]
    small_batches(entries.sparkSession)
    if not log:
        parts = -(-entries.count() // CHAIN_ROWS)
        if parts > 1:
            return _long_chain(entries, parts)
    dealt = entries.repartition(*log) if log else entries.repartition(1)
    return _walked(dealt.sortWithinPartitions(*log, "id"), log, GENESIS)


def _walked(dealt: DataFrame, log: list[str], start: str) -> DataFrame:
    """Sorted entries with their hashes; ``start`` is the hash before a chain's first entry."""
    schema = T.StructType([*dealt.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("entry_hash", T.StringType())])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, last = None, start
        for b in batches:
            prev, own = [], []
            said = [b[c].astype(object).where(b[c].notna(), "").astype(str) for c in ("ts", "event", "matter_slug", "detail")]
            for mine, *rest in zip(b[log[0]] if log else [None] * len(b), *said, strict=True):
                if mine != chain:
                    chain, last = mine, start
                prev.append(last)
                last = hashlib.sha256("|".join([last, *rest]).encode()).hexdigest()
                own.append(last)
            yield b.assign(prev_hash=prev, entry_hash=own)

    return dealt.mapInPandas(task, schema)


def _long_chain(entries: DataFrame, parts: int) -> DataFrame:
    spark, dealt, done = entries.sparkSession, shared_path(entries.sparkSession, "chain-ranges"), shared_path(entries.sparkSession, "chain")
    entries.repartitionByRange(parts, "id").withColumn("__part", F.spark_partition_id()).write.partitionBy("__part").parquet(dealt)
    last, schema = GENESIS, entries.schema
    for k in sorted(r[0] for r in spark.read.parquet(dealt).select("__part").distinct().collect()):
        one = spark.read.schema(schema).parquet(f"{dealt}/__part={k}").coalesce(1).sortWithinPartitions("id")
        walked = _walked(one, [], last)
        walked.write.parquet(f"{done}/{k}")
        last = spark.read.schema(walked.schema).parquet(f"{done}/{k}").agg(F.max_by("entry_hash", "id")).first()[0]
    return spark.read.schema(walked.schema).parquet(f"{done}/*")


def audit_breaks(chain: DataFrame) -> DataFrame:
    """Entries whose own hash or link to the entry before is wrong, each checked against its neighbour, chain by chain; for one long
    chain see ``audit_verdict``."""
    log = [c for c in ("log",) if c in chain.columns]
    before = F.lag("entry_hash", 1, GENESIS).over(Window.partitionBy(*log).orderBy("id"))
    own = audit_hash(F.col("prev_hash"), F.col("ts"), F.col("event"), F.col("matter_slug"), F.col("detail"))
    rows = chain.withColumn("bad_link", ~F.col("prev_hash").eqNullSafe(before)).withColumn("bad_hash", ~F.col("entry_hash").eqNullSafe(own))
    return rows.where("bad_link or bad_hash")


def audit_verdict(chain: DataFrame) -> DataFrame:
    """(log, entries, first_bad_id) for each chain, or without ``log`` one row: null if the whole chain holds.

    Chains are cut into ranges of ids, so that no chain lies in one task.  Each task checks its rows' own hashes and the links between
    them and hands on one row per chain: its first and last id, the link it starts with, the hash it ends with, its first bad id.  Only
    those are put in order, to compare the links across borders: as many rows as there are ranges and chains.
    """
    log = [c for c in ("log",) if c in chain.columns]
    own = audit_hash(F.col("prev_hash"), F.col("ts"), F.col("event"), F.col("matter_slug"), F.col("detail"))
    rows = chain.select(*log, "id", "prev_hash", "entry_hash", F.col("entry_hash").eqNullSafe(own).alias("good"))
    dealt = rows.repartitionByRange(*log, "id").sortWithinPartitions(*log, "id")
    kind = [chain.schema[c] for c in log]
    schema = T.StructType([*kind, *(T.StructField(c, T.LongType()) for c in ("first", "n", "bad")), T.StructField("starts", T.StringType()), T.StructField("ends", T.StringType())])

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None  # what has been seen of the chain that goes on
        for b in batches:
            out = []
            for name, part in b.groupby(log[0], sort=False, dropna=False) if log else [(None, b)]:
                before = part["entry_hash"].shift(1)
                goes_on = last is not None and (not log or name == last["log"])
                if goes_on:
                    before.iloc[0] = last["ends"]
                bad = (~part["good"].astype(bool)) | (part["prev_hash"] != before)
                if not goes_on:
                    bad.iloc[0] = not bool(part["good"].iloc[0])
                wrong = part["id"][bad.to_numpy()]
                if goes_on:
                    last["n"] += len(part)
                    last["bad"] = last["bad"] if last["bad"] is not None or not len(wrong) else int(wrong.iloc[0])
                else:
                    if last is not None:
                        out.append(last)
                    last = {"log": name, "first": int(part["id"].iloc[0]), "n": len(part), "bad": int(wrong.iloc[0]) if len(wrong) else None, "starts": part["prev_hash"].iloc[0]}
                last["ends"] = part["entry_hash"].iloc[-1]
            if out:
                yield pd.DataFrame(out, columns=["log", "first", "n", "bad", "starts", "ends"]).astype({"bad": "Int64"}).drop(columns=[] if log else "log")
        if last is not None:
            yield pd.DataFrame([last], columns=["log", "first", "n", "bad", "starts", "ends"]).astype({"bad": "Int64"}).drop(columns=[] if log else "log")

    ranges = dealt.mapInPandas(task, schema)
    before = F.lag("ends", 1, GENESIS).over(Window.partitionBy(*log).orderBy("first"))
    broken = F.least(F.when(~F.col("starts").eqNullSafe(before), F.col("first")), F.col("bad"))
    return ranges.withColumn("broken", broken).groupBy(*log).agg(F.sum("n").alias("entries"), F.min("broken").alias("first_bad_id"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def folder_status(folders: DataFrame, matters: DataFrame, jobs_table: DataFrame, now: Column) -> DataFrame:
    """Watched folders with whether their matter exists, seconds since the last scan, and the state of their newest job."""
    known = matters.select(F.col("slug").alias("matter_slug"), F.lit(True).alias("known"))
    newest = jobs_table.groupBy("matter_slug").agg(F.max_by("status", "id").alias("job_status"))
    rows = folders.join(known, "matter_slug", "left").join(newest, "matter_slug", "left")
    return rows.withColumn("matter_exists", F.coalesce("known", F.lit(False))).withColumn("seconds_since_scan", F.unix_timestamp(now) - F.unix_timestamp("last_scan")).drop("known")


def documents_of(documents: DataFrame, matter: str | None = None) -> DataFrame:
    """A matter's documents, or all, the last updated first (of equal ones the newest id); without a column ``updated`` by name, then id."""
    mine = documents if matter is None else documents.where(F.col("matter_slug") == matter)
    return mine.orderBy(*([F.col("updated").desc_nulls_last(), F.col("id").desc()] if "updated" in documents.columns else ["filename", "id"]))


def replace_line_map(line_map: DataFrame, new: DataFrame, doc_id: int) -> DataFrame:
    """``line_map`` with a document's lines replaced, also by none."""
    return line_map.where(~F.col("doc_id").eqNullSafe(F.lit(doc_id))).unionByName(new.where(F.col("doc_id") == doc_id).select(*line_map.columns))


def threads(messages: DataFrame) -> DataFrame:
    """Threads of messages (thread_id, pos, role, text and, if known, ts): the title is the first of the user's, at most TITLE characters; the one with
    the last message first, without times the newest."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("pos")))
    timed = "ts" in messages.columns
    got = messages.groupBy("thread_id").agg(F.substring(first, 1, TITLE).alias("title"), F.count(F.lit(1)).alias("messages"), *([F.max("ts").alias("updated")] if timed else []))
    return got.orderBy(*([F.col("updated").desc_nulls_last()] if timed else []), F.col("thread_id").desc())
