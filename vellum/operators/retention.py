"""Disposal, export and moves: holds stop them, a certificate says what each artifact's method was, an export is what a matter's owner gets."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .catalog import active_holds, unique
from .ingest import upload_states

# fixed value: what must be typed to erase everything
ERASE_PHRASE = "ERASE ALL DATA"
# rows of one manifest file, and bytes that an archive is meant to hold at most
MANIFEST_ROWS, ARCHIVE_BYTES = 10_000, 32 * 1024 * 1024


class OnHold(ValueError):
    """A hold forbids this."""


def assert_free(holds: DataFrame, matter: str | None = None) -> None:
    """Raise if the matter, or without one any, is held."""
    held = active_holds(holds)
    if not (held if matter is None else held.where(F.col("matter_slug") == matter)).isEmpty():
        raise OnHold(matter or "some matter")


def certificates(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """What disposing of each matter amounts to: ``Purge`` only if it has natives, all were encrypted, and its key is destroyed; else ``Clear``.
    ``documents``: matter_slug, encrypted; ``keys``: matter_slug, destroyed."""
    n = documents.groupBy("matter_slug").agg(F.count(F.lit(1)).alias("natives"), F.bool_and("encrypted").alias("all_encrypted"))
    rows = n.join(keys, "matter_slug", "full")
    purge = (F.coalesce("natives", F.lit(0)) > 0) & F.coalesce("all_encrypted", F.lit(False)) & F.coalesce("destroyed", F.lit(False))
    return rows.select("matter_slug", F.coalesce("natives", F.lit(0)).alias("natives"), F.when(purge, "Purge").otherwise("Clear").alias("method"))


def dispose(tables: dict[str, DataFrame], holds: DataFrame, matter: str, column: str = "matter_slug") -> dict[str, DataFrame]:
    """All tables without a matter's rows; rows of no matter stay."""
    assert_free(holds, matter)
    return {name: t.where(~F.col(column).eqNullSafe(F.lit(matter))) for name, t in tables.items()}


def erase_all(tables: dict[str, DataFrame], holds: DataFrame, phrase: str) -> dict[str, DataFrame]:
    if phrase != ERASE_PHRASE:
        raise ValueError("the phrase doesn't match")
    assert_free(holds)
    return {name: t.limit(0) for name, t in tables.items()}


def sealed(body, key):
    """A native's bytes under its matter's key (AES-GCM); without the key they can't be read again."""
    return F.aes_encrypt(body, key, F.lit("GCM"))


def opened(body, key):
    return F.try_aes_decrypt(body, key, F.lit("GCM"))


def plain_path(path: Column) -> Column:
    """A path without scheme and host."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")


def _lines(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Rows of each matter as files of JSON lines, MANIFEST_ROWS in each; ``order`` names a row."""
    nth = F.row_number().over(Window.partitionBy("matter_slug").orderBy(*order)) - 1
    made = rows.select(F.col("matter_slug").alias("matter"), nth.alias("nth"), F.to_json(F.struct("*")).alias("line")).withColumn("block", F.floor(F.col("nth") / MANIFEST_ROWS))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n")
    return made.groupBy("matter", "block").agg(F.encode(body, "UTF-8").alias("body")).select("matter", F.concat(F.lit(f"{name}-"), F.col("block").cast("string"), F.lit(".jsonl")).alias("name"), "body")


def export_entries(documents: DataFrame, natives: DataFrame, root: str, messages: DataFrame, audit: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(matter, name, body): all that belongs to each matter, as files.

    ``documents``: id, matter_slug, filename, stored_path; ``natives``: path and content of files, as ``binaryFile`` lists them; ``messages``: matter_slug, thread_id, pos;
    ``audit``: matter_slug, id; further columns go into the manifests.  With ``keys`` (matter_slug, key) a sealed native leaves unsealed, a plain one as it is.
    A native is taken only if it is a listed file below ``root``: a stored path that leads elsewhere, also by ``..``, gives no file, and its document stays in the
    manifest.  Names lose what looks like a folder; of one matter's documents with equal names the later ones carry their id.  Rows of no matter are left out.
    """
    inside = plain_path(F.lit(root.rstrip("/") + "/"))
    path = plain_path(F.col("path"))
    files = natives.select(path.alias("stored_path"), "content").where(F.startswith("stored_path", inside) & ~F.concat("stored_path", F.lit("/")).contains("/../"))
    mine = documents.where("matter_slug is not null")
    base = F.regexp_replace(F.coalesce("filename", F.lit("")), r"^.*[/\\]", "")
    again = F.row_number().over(Window.partitionBy("matter_slug", "base").orderBy("id")) > 1
    named = mine.select("id", "matter_slug", plain_path(F.col("stored_path")).alias("stored_path"), base.alias("base")).withColumn("name", F.when(again | F.col("base").isin("", ".", ".."), F.concat(F.col("id").cast("string"), F.lit("-"), "base")).otherwise(F.col("base")))
    bodies = named.join(files, "stored_path")
    if keys is not None:
        bodies = bodies.join(keys.select("matter_slug", "key"), "matter_slug", "left").withColumn("content", F.coalesce(opened(F.col("content"), F.col("key")), F.col("content")))
    entries = bodies.select(F.col("matter_slug").alias("matter"), F.concat(F.lit("documents/"), "name").alias("name"), F.col("content").alias("body"))
    for rows, name, order in ((mine, "manifest/documents", ["id"]), (messages, "chats/messages", ["thread_id", "pos"]), (audit, "manifest/audit", ["id"])):
        entries = entries.unionByName(_lines(rows.where("matter_slug is not null"), name, order))
    return entries


def archives(entries: DataFrame, size: int = ARCHIVE_BYTES) -> DataFrame:
    """(matter, part, files, archive): zips of each matter's entries, which are dealt by name so that a zip has about half of ``size``, whatever a matter has in all; one file is never cut."""
    total = entries.groupBy("matter").agg(F.ceil(F.sum(F.length("body")) / (size / 2)).alias("parts"))
    part = F.pmod(F.xxhash64("name"), F.greatest("parts", F.lit(1).cast("long")))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, body in sorted(zip(pdf["name"], pdf["body"], strict=True)):
                z.writestr(zipfile.ZipInfo(name), body, zipfile.ZIP_DEFLATED)  # without the time, so that equal entries give equal bytes
        return pd.DataFrame({"matter": [pdf["matter"].iloc[0]], "part": [pdf["part"].iloc[0]], "files": [len(pdf)], "archive": [out.getvalue()]})

    kind = entries.schema["matter"].dataType.simpleString()
    return entries.join(total, "matter").withColumn("part", part).select("matter", "part", "name", "body").groupBy("matter", "part").applyInPandas(packed, f"matter {kind}, part long, files long, archive binary")


def move_documents(documents: DataFrame, chunks: DataFrame, matters: DataFrame, holds: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks after ``moves`` (doc_id, matter): moved documents are queued again under a name that is free there, and lose the chunks of their old scope.

    ``documents``: id, matter_slug, filename, checksum, status, reason; ``chunks``: matter, source_filename; ``matters``: slug.  A move to where a document is
    changes nothing.  An unknown document or matter raises, a hold on a matter that a document would leave stops all moves.  Without a checksum the name is kept.
    """
    asked = unique(moves, ["doc_id"], "moves").select(F.col("doc_id").alias("id"), F.col("matter").alias("_to"))
    if not asked.join(documents, "id", "left_anti").isEmpty():
        raise ValueError("a document that isn't there")
    if not asked.join(matters.select(F.col("slug").alias("_to")), "_to", "left_anti").isEmpty():
        raise ValueError("a matter that isn't there")
    going = asked.join(documents.select("id", "matter_slug", "filename", "checksum"), "id").where(~F.col("matter_slug").eqNullSafe(F.col("_to")))
    if not going.join(active_holds(holds), "matter_slug", "left_semi").isEmpty():
        raise OnHold("a matter that a document would leave")
    names = upload_states(going.select("id", F.col("_to").alias("matter"), "filename", F.col("checksum").alias("sha256"), F.lit(1).alias("size")), documents.select(F.col("matter_slug").alias("matter"), "filename", F.col("checksum").alias("sha256")))
    done = names.select("id", F.col("matter").alias("_to"), F.coalesce("stored_name", "filename").alias("_name"))
    me = F.col("_to").isNotNull()
    new = {"matter_slug": F.col("_to"), "filename": F.col("_name"), "status": F.lit("queued"), "reason": F.lit(None)}
    rows = documents.join(done, "id", "left").select(*[F.when(me, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in documents.columns])
    gone = going.select(F.col("matter_slug").alias("matter"), F.col("filename").alias("source_filename"))
    return rows, chunks.join(gone, ["matter", "source_filename"], "left_anti")
