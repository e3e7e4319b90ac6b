"""What happens to files that arrive: duplicates, quarantine, states, connectors' imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.keys import content_id

# fixed values: what is taken in, and up to what size
SUFFIXES = ("pdf", "docx", "txt", "md", "eml", "html", "htm", "vtt", "srt", "csv", "json")
MOST_BYTES = 25 * 1024 * 1024
# fixed values: seconds between syncs, seconds that a file must rest, items of one pass, connectors that list by date
SYNC_EVERY, RESTING, PASS_CAP, DATED = 1800, 2, 500, ("fireflies",)
# fixed value: where imported items land
UNFILED = "unfiled"


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))


def with_checksum(files: DataFrame) -> DataFrame:
    return files.withColumn("sha256", content_id(F.col("content")))


def ingest_states(files: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Files (filename, sha256, error, ocr_failed) with their state, as if read in order of name.

    A copy of an extractable file that came before (or whose sha256 is in ``seen``) is a duplicate; a file that can't be
    extracted is quarantined, and so is its twin; one with failed OCR needs review; the rest is ingested.
    """
    good = F.col("error").isNull()
    nth = F.row_number().over(Window.partitionBy("sha256", good).orderBy("filename"))
    rows = files.withColumn("nth", nth)
    known = F.lit(False)
    if seen is not None:
        rows = rows.join(seen.select("sha256", F.lit(True).alias("known")).distinct(), "sha256", "left")
        known = F.coalesce("known", F.lit(False))
    status = F.when(known | (good & (F.col("nth") > 1)), "duplicate").when(~good, "quarantined").when(F.col("ocr_failed"), "needs_review").otherwise("ingested")
    reason = F.when(status == "quarantined", F.col("error")).when(status == "needs_review", "ocr failed")
    return rows.withColumn("status", status).withColumn("reason", reason).drop("nth", "known")


def document_states(documents: DataFrame) -> DataFrame:
    """Documents (id, chunks, tables, ocr_failed, condensed, numbered_pages, is_transcript) with state and reason."""
    lines = F.col("is_transcript")
    failed = (lines & F.col("condensed")) | (~lines & (F.col("chunks") + F.col("tables") == 0) & ~F.col("ocr_failed"))
    review = (lines & (F.col("numbered_pages") == 0)) | F.col("ocr_failed")
    return documents.withColumn("status", F.when(failed, "failed").when(review, "needs_review").otherwise("ready"))


def _numbered(name: str) -> tuple[Column, Column, Column]:
    """A file name's stem, the number after its last hyphen (null if it has none), and its suffix."""
    stem, end = F.regexp_replace(name, r"\.[^.]+$", ""), F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return F.regexp_replace(stem, r"-\d+$", ""), F.nullif(F.regexp_extract(stem, r"-(\d+)$", 1), F.lit("")).cast("long"), end


def upload_states(uploads: DataFrame, existing: DataFrame) -> DataFrame:
    """Uploads (matter, filename, sha256, size) with why they are refused, and the name they get: one that is
    taken by other bytes gets the first of -1, -2, ... before its suffix that is free.  ``existing``: matter, filename, sha256.

    A name with a separator is refused.  Bytes that are there under the name or one of its numbers keep that one.  New
    uploads of one name get free numbers in order of sha256; names that uploads bring themselves aren't free.
    """
    name = F.col("filename")
    bad = (name == "") | name.startswith(".") | name.rlike(r"[/\\]") | name.contains("..")
    why = F.when(bad, "bad name").when(~suffix(name).isin(*SUFFIXES), "unsupported type").when(F.col("size") <= 0, "empty").when(F.col("size") > MOST_BYTES, "too large")
    rows = uploads.withColumn("rejected", why)
    good = rows.where("rejected is null").select("matter", "filename", "sha256").distinct()
    stem, end = F.regexp_replace("filename", r"\.[^.]+$", ""), F.regexp_extract("filename", r"(\.[^.]+)$", 1)
    good = good.withColumn("stem", stem).withColumn("end", end)
    # numbers that are taken of each name: 0 is the name itself
    there = existing.select("matter", "filename", "sha256").withColumn("old", F.lit(True)).unionByName(good.select("matter", "filename", "sha256").withColumn("old", F.lit(False)))
    root, number, tail = _numbered("filename")
    as_number = there.where(number.isNotNull()).select("matter", root.alias("stem"), tail.alias("end"), number.alias("k"), "sha256", "old")
    as_name = there.where("old").select("matter", stem.alias("stem"), end.alias("end"), F.lit(0).cast("long").alias("k"), "sha256", "old")
    names = as_number.unionByName(as_name)
    key = ["matter", "stem", "end"]
    same = good.join(names.where("old").select(*key, "sha256", "k"), [*key, "sha256"]).groupBy("matter", "filename", "sha256").agg(F.min("k").alias("own"))
    taken = names.groupBy(*key).agg(F.collect_set("k").alias("taken"))
    fresh = good.join(same, ["matter", "filename", "sha256"], "left_anti").withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("sha256")))
    fresh = fresh.join(taken, key, "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<bigint>")))
    free = F.filter(F.sequence(F.lit(0).cast("long"), (F.size("taken") + F.col("nth")).cast("long")), lambda k: ~F.array_contains("taken", k))
    chosen = same.unionByName(fresh.select("matter", "filename", "sha256", F.element_at(free, F.col("nth").cast("int")).alias("own")))
    joined = rows.join(chosen, ["matter", "filename", "sha256"], "left")
    stored = F.when(F.col("own") == 0, F.col("filename")).when(F.col("own") > 0, F.concat(stem, F.lit("-"), F.col("own").cast("string"), end))
    return joined.withColumn("stored_name", F.when(F.col("rejected").isNull(), stored)).drop("own")


def wanted_attachments(attachments: DataFrame) -> DataFrame:
    """Attachments (filename, size) that are taken in: of a type that can be read, neither empty nor too large."""
    return attachments.where(suffix(F.col("filename")).isin(*SUFFIXES) & F.col("size").between(1, MOST_BYTES))


def listed_since(connections: DataFrame) -> DataFrame:
    """From when each connection's items are listed: since its last sync only where the service lists by date, else all of them."""
    return connections.withColumn("since", F.when(F.col("service").isin(*DATED), F.col("last_sync")))


def new_items(listed: DataFrame, ledger: DataFrame) -> DataFrame:
    """What a connection lists and hasn't handed over yet; ``ledger``: connection_id, source_id."""
    return listed.join(ledger, ["connection_id", "source_id"], "left_anti")


def import_states(listed: DataFrame, ledger: DataFrame, stored: DataFrame) -> DataFrame:
    """Listed items (connection_id, source_id, filename, sha256, size, suggested_matter) with what an import does with each.

    All land in ``unfiled``; the configured matter is only suggested.  ``stored``: checksums that
    are there already; with a matter_slug only those of ``unfiled`` count, as that is where items land.
    """
    seen = ledger.select("connection_id", "source_id", F.lit(True).alias("seen")).distinct()
    if "matter_slug" in stored.columns:
        stored = stored.where(F.col("matter_slug") == UNFILED)
    there = stored.select(F.col("checksum").alias("sha256"), F.lit(True).alias("there")).distinct()
    rows = listed.join(seen, ["connection_id", "source_id"], "left").join(there, "sha256", "left")
    able = suffix(F.col("filename")).isin(*SUFFIXES) & F.col("size").between(1, MOST_BYTES)
    state = F.when(F.col("seen"), "already").when(~able, "skipped").when(F.col("there"), "duplicate").otherwise("imported")
    return rows.withColumn("state", state).withColumn("matter", F.when(state == "imported", UNFILED)).drop("seen", "there")


def import_summary(states: DataFrame) -> DataFrame:
    return states.groupBy("connection_id").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("imported", "skipped", "duplicate", "already")])


def capped_pass(listed: DataFrame, ledger: DataFrame, cap: int = PASS_CAP) -> DataFrame:
    """One pass over a mailbox: the oldest items that weren't seen, ``cap`` at most, so repeated passes walk through it all."""
    rows = new_items(listed, ledger)
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("connection_id").orderBy("uid"))).where(F.col("nth") <= cap).drop("nth")


def sync_due(connections: DataFrame, now: Column) -> DataFrame:
    """Connections to sync: on, not running, and last synced long enough ago or at a time that can't be read."""
    age = F.unix_timestamp(now) - F.unix_timestamp(F.try_to_timestamp("last_sync"))
    return connections.where(F.col("sync_on") & ~F.col("running") & (F.coalesce(age, F.lit(SYNC_EVERY)) >= SYNC_EVERY))


def changed_files(found: DataFrame, known: DataFrame, now: Column) -> DataFrame:
    """Files of a watched folder to read: allowed, not hidden, at rest, and newer than when last read; ``known``: path, mtime."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    rows = found.join(known.select("path", F.col("mtime").alias("read")), "path", "left")
    rest = F.unix_timestamp(now) - F.unix_timestamp("mtime") >= RESTING
    return rows.where(suffix(name).isin(*SUFFIXES) & ~name.startswith(".") & rest & (F.col("read").isNull() | (F.col("mtime") > F.col("read")))).drop("read")


def http_state(code: Column) -> Column:
    """What a service's answer means."""
    return F.when(code == 401, "auth").when(code.isin(402, 403), "access").when(code == 429, "rate").when(code >= 500, "unavailable").when(code >= 400, "error").otherwise("ok")


def vtt_cues(utterances: DataFrame) -> DataFrame:
    """Utterances (item_id, pos, who, text, start_s, end_s) as a WebVTT text; with any unusable time as plain lines."""
    clock = lambda s: F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), s % 60)
    right = F.col("start_s").isNotNull() & (F.col("start_s") >= 0) & F.coalesce(F.col("end_s") >= F.col("start_s"), F.lit(False))
    cue = F.concat(clock(F.col("start_s")), F.lit(" --> "), clock(F.col("end_s")), F.lit("\n<v "), "who", F.lit(">"), "text")
    rows = F.array_sort(F.collect_list(F.struct("pos", cue.alias("cue"), F.concat("who", F.lit(": "), "text").alias("line"))))
    got = utterances.groupBy("item_id").agg(F.every(right).alias("timed"), rows.alias("rows"))
    text = F.when(F.col("timed"), F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("rows", lambda r: r["cue"]), "\n\n"))).otherwise(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"))
    return got.select("item_id", F.when(F.col("timed"), "vtt").otherwise("txt").alias("kind"), text.alias("text"))


def column_union(records: DataFrame) -> DataFrame:
    """Columns of a table's records (table_id, pos, keys) : those of its schema (``schema_keys``) in order, then others as first seen."""
    seen = records.select("table_id", "schema_keys", "pos", F.posexplode("keys").alias("k", "key"))
    first = seen.groupBy("table_id", "schema_keys", "key").agg(F.min(F.struct("pos", "k")).alias("at"))
    extra = first.where(~F.array_contains("schema_keys", F.col("key")))
    names = extra.groupBy("table_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "key"))), lambda x: x["key"]).alias("extra"))
    tables = records.select("table_id", "schema_keys").distinct().join(names, "table_id", "left")
    return tables.select("table_id", F.concat("schema_keys", F.coalesce("extra", F.array().cast("array<string>"))).alias("columns"))


def listing_windows(start: Column, end: Column, months: int = 6) -> Column:
    """array<struct<since, until>> of a date range in windows shorter than ``months``, the newest first."""
    steps = F.sequence(start, end, F.expr(f"interval {months - 1} months"))
    return F.reverse(F.transform(steps, lambda d: F.struct(d.alias("since"), F.least(F.add_months(d, months - 1), end).alias("until"))))


def listed_once(listed: DataFrame) -> DataFrame:
    """Items (connection_id, source_id, since) that windows with a common day list twice, each once: as its newest window has it."""
    nth = F.row_number().over(Window.partitionBy("connection_id", "source_id").orderBy(F.col("since").desc_nulls_last(), *[c for c in sorted(listed.columns) if c not in ("connection_id", "source_id", "since")]))
    return listed.withColumn("__nth", nth).where("__nth = 1").drop("__nth")
