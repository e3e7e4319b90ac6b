"""Exact duplicates by a content sort, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import cut, id_text, thin

WHITE = r"[\x20\x09-\x0D]+"
#: A text with more than one in so many of all rows is sorted in several runs.
HOT_SHARE = 256


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty.
    Sampled splitters range-partition the rows by a short head of the normalised bytes and a hash of all of them
    (so splitters stay small however long texts are); each partition is sorted by those and by the whole
    text, which spills where it must, and neighbours are compared in full.  Of each group the row with the smallest
    doc_id stays.  Null ids come last; of rows with the same id and text one stays.  An empty table gives no rows.

    A text that more than 1/HOT_SHARE of all rows have (there are fewer than HOT_SHARE such texts, found by one
    count with map-side sums) is sorted in runs of about that size by a salt from the id; the heads of the runs, at most
    about twice HOT_SHARE rows in all, are then merged by the SHA-256 of the text.
    """
    spark = docs.sparkSession
    keyed = id_text(docs, id_col, text_col).select("id", normalised(F.col("text")).alias("norm")).withColumn("h", F.xxhash64("norm"))
    n = docs.count()
    limit = max(1, n // HOT_SHARE)
    hot = keyed.groupBy("h").count().where(F.col("count") > limit).collect()  # fewer than HOT_SHARE rows, whatever the input
    if hot:
        salts = spark.createDataFrame([(r["h"], -(-r["count"] // limit)) for r in hot], "h long, runs long")
        keyed = keyed.join(F.broadcast(salts), "h", "left").withColumn("salt", F.when(F.col("runs").isNotNull(), F.pmod(F.xxhash64("id"), "runs")).otherwise(0))
    else:
        keyed = keyed.withColumn("runs", F.lit(None).cast("long"))
    # the window's keys include the splitters', so that it needs no exchange of its own; a constant salt would be folded away
    key = ["head", "h", *["salt"] * bool(hot)]
    dealt = keyed.withColumn("head", F.substring("norm", 1, 16)).select("id", "norm", "runs", *key).repartitionByRange(*key)
    run = Window.partitionBy(*key, "norm")
    order = run.orderBy(F.col("id").asc_nulls_last())
    runs = dealt.select(
        "id", "h", (F.col("runs").isNotNull()).alias("hot"), F.sha2("norm", 256).alias("sha"),
        F.row_number().over(order).alias("place"),
        F.min("id").over(run).alias("first"),
        F.count(F.lit(1)).over(run).alias("size"),
    )
    if hot:
        runs = cut(runs, "content-sort")
        heads = runs.where("hot and place = 1").groupBy("sha").agg(F.min("first").alias("all_first"), F.sum("size").alias("all_size"))
        runs = runs.join(F.broadcast(heads), "sha", "left")
        first, size = F.when(F.col("hot"), F.col("all_first")).otherwise(F.col("first")), F.when(F.col("hot"), F.col("all_size")).otherwise(F.col("size"))
    else:
        first, size = F.col("first"), F.col("size")
    return runs.select(
        F.col("id").alias("doc_id"), first.alias("keep_id"), size.alias("group_size"),
        ((F.col("place") == 1) & (F.col("id").eqNullSafe(first))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with one id and equal texts the least one stays, by text and then by the other columns.

    A null text counts as empty, null ids come last, an empty table gives no rows.  Rows that stay aren't shuffled for it: those that go are few
    and are taken out by id and hash.  Where an id and text come more than once, the least row of each task is found before any exchange.
    """
    pairs = exact_groups(docs, id_col, text_col).groupBy(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    pairs = cut(pairs.agg(F.max("kept").alias("__kept"), F.count(F.lit(1)).alias("__rows")).where("not __kept or __rows > 1"), "exact-pairs")
    own = F.col(f"`{text_col}`").cast("string")
    named = docs.withColumn("__own", F.col(f"`{id_col}`").cast("long")).withColumn("__hash", F.sha2(normalised(own), 256))
    same = F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__sha"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = named.join(thin(pairs.select("__id", "__sha")), same, "left_anti").select(*columns)
    twice = pairs.where("__kept").select("__id", "__sha")
    if twice.isEmpty():
        return left
    rest = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]))
    ties = named.join(thin(twice), same, "left_semi").groupBy("__own", "__hash").agg(F.min_by(F.struct(*columns), F.struct(own, rest)).alias("__row"))
    return left.unionByName(ties.select("__row.*"))
