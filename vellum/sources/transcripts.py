"""Numbered transcripts: pages, gutter lines, clean text and line maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import nonblank

from ..operators.catalog import line_map

# fixed values: a numbered line, a page header, the share of numbered lines of a transcript page, lines of a page at most
GUTTER, PAGE_HEADER, SHARE, MOST_LINES = r"^\s{0,6}(\d{1,2})(?:\s+(.*))?$", r"^\s*(?:Page|PAGE)\s+(\d+)\s*$", 0.6, 28


def text_pages(texts: DataFrame) -> DataFrame:
    """Raw lines (doc_id, page, pos, raw) of transcripts (doc_id, text): pages end at form feeds, else start at ``Page N`` lines, else there is one."""
    feeds = F.col("text").contains("\f")
    fed = texts.where(feeds).select("doc_id", F.posexplode(F.split("text", "\f")).alias("p", "t")).select("doc_id", (F.col("p") + 1).cast("long").alias("page"), F.posexplode(F.split("t", "\n")).alias("pos", "raw"))
    rows = texts.where(~feeds).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    number = F.nullif(F.regexp_extract("raw", PAGE_HEADER, 1), F.lit("")).cast("long")
    headed = rows.withColumn("number", number).withColumn("page", F.last("number", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    headed = headed.withColumn("any", F.max("number").over(Window.partitionBy("doc_id")))
    plain = headed.where("number is null and (any is null or page is not null)").select("doc_id", F.coalesce("page", F.lit(1).cast("long")).alias("page"), "pos", "raw")
    return fed.unionByName(plain)


def numbered_lines(raw: DataFrame) -> DataFrame:
    """Lines with their number and content, those of pages that aren't numbered with null numbers."""
    line = F.nullif(F.regexp_extract("raw", GUTTER, 1), F.lit("")).cast("long")
    rows = raw.where(nonblank(F.col("raw"))).withColumn("line", line).withColumn("content", F.when(line.isNotNull(), F.rtrim(F.regexp_extract("raw", GUTTER, 2))).otherwise(F.col("raw")))
    page = Window.partitionBy("doc_id", "page")
    rows = rows.withColumn("numbered", F.avg(F.col("line").isNotNull().cast("double")).over(page) >= SHARE)
    return rows.where(~F.col("numbered") | F.col("line").isNotNull()).withColumn("line", F.when(F.col("numbered"), F.col("line"))).drop("raw")


def condensed_documents(lines: DataFrame) -> DataFrame:
    """Documents with several transcript pages on a sheet: too many numbered lines, or numbers that start again.  Their lines must not be cited."""
    back = F.lag("line").over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    rows = lines.where("numbered").withColumn("restart", F.col("line") <= back)
    pages = rows.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("restart", F.lit(False))).alias("restart"))
    return pages.where((F.col("n") > MOST_LINES) | F.col("restart")).select("doc_id").distinct()


def clean_pages(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages with their clean text, line maps of the numbered ones)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n")
    pages = lines.groupBy("doc_id", F.col("page").alias("page_number")).agg(text.alias("page_text"), F.bool_and("numbered").alias("numbered"))
    return pages, line_map(lines.where("numbered"))
