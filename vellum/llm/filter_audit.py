"""How filters interact: counts of documents for each order of five filters, from one relational word pipeline."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, spread_join

# fixed values of the contract: the filters' letters, fewest words, least distinct share, most capitals, signs
LETTERS = "ABCDE"
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, "[#$%&*|]"
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a mask: a document's mask has bit k set if it fails filter LETTERS[k].
MASKS = 1 << len(LETTERS)


def _read(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(key, id, part, text): rows with one id, part and text share a key of 128 bits of SHA-256, and all that follows is equal for them."""
    rows = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    said = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("-")), F.octet_length("part"), "part", "text")
    return rows.select(F.unhex(F.substring(F.sha2(said, 256), 1, 32)).alias("key"), "id", "part", "text")


def word_totals(rows: DataFrame) -> DataFrame:
    """(key, n_words, n_distinct) of (key, text) that have words: exploded, counted per (row, word), then per row, then per key; equal rows add up.

    Texts are dealt by row, so that both counts need no exchange of words: a text takes less room than its (row, word) pairs, and
    rows that are equal go to different tasks.
    """
    dealt = rows.select("key", F.monotonically_increasing_id().alias("row"), "text").repartition("key", "row")
    words = dealt.select("key", "row", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("word"))
    counted = words.groupBy("key", "row", "word").agg(F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("key", "row").agg(F.sum("n").alias("n_words"), F.count(F.lit(1)).alias("n_distinct"))
    return totals.groupBy("key").agg(F.sum("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(key, id, part, copies, mask): a row per distinct (id, part, text), the number of its rows, and the filters it fails as bits.

    A null text is empty, a null part is the empty string.  E compares ids: a row with a null id fails nothing there and
    makes nothing fail; rows with one id don't make each other fail.  A text that very many documents share is split over tasks.
    """
    rows = _read(docs, id_col, text_col, part_col)
    flags = rows.select(
        "key", "id", "part", F.unhex(F.sha2("text", 256)).alias("sha"),
        (100 * F.regexp_count("text", F.lit("[A-Z]")).cast("long") > CAPITAL_PERCENT * F.length("text")).alias("c"),
        F.col("text").rlike(SIGNS).alias("d"),
    )
    flags = cut(flags.groupBy("key", "id", "part", "sha", "c", "d").agg(F.count(F.lit(1)).alias("copies")), "audit-flags")
    texts = flags.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("matches")).where("matches > 1")
    flags = spread_join(flags, cut(texts, "audit-texts"), ["sha"], "matches", "left", by=("key",))
    both = flags.join(word_totals(rows), "key", "full_outer")
    n_words = F.coalesce(F.col("n_words") / F.col("copies"), F.lit(0)).cast("long")
    failed = [
        n_words < LEAST_WORDS, 100 * F.coalesce("n_distinct", F.lit(0)) < DISTINCT_PERCENT * n_words, F.col("c"), F.col("d"),
        F.coalesce(F.col("id") > F.col("first"), F.lit(False)),
    ]
    mask = sum((f.cast("int") * (1 << k) for k, f in enumerate(failed)), F.lit(0))
    return both.select("key", "id", "part", "copies", mask.alias("mask"))


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, n, good, toxic): for each part three arrays that say how many documents, good and toxic ones have each mask.

    These are conditional counts, MASKS columns of each kind, so one sum per task and part is shuffled.  An id with several labels is
    good (toxic) if one of them says so; labels with null ids count for nothing.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") == 1).alias("q"), (F.col("toxic") == 1).alias("t"))
    marks = marks.where("id is not null").groupBy("id").agg(F.max("q").alias("good"), F.max("t").alias("toxic"))
    rows = failures(docs, id_col, text_col, part_col).join(marks, "id", "left")
    kinds = {"n": F.lit(True), "good": F.coalesce("good", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    sums = [F.sum(F.when((F.col("mask") == m) & kind, F.col("copies")).otherwise(0)).alias(f"{name}_{m}") for name, kind in kinds.items() for m in range(MASKS)]
    counted = rows.groupBy("part").agg(*sums)
    return counted.select("part", *[F.array(*[F.col(f"{name}_{m}") for m in range(MASKS)]).alias(name) for name in kinds])


def _steps() -> Column:
    """All orders and steps, each with the bit of its filter and the bits of those before it."""
    rows = []
    for order in permutations(range(len(LETTERS))):
        for step, k in enumerate(order, 1):
            name = "".join(LETTERS[i] for i in order)
            rows.append(f"struct('{name}' as filter_order, {step} as step, {1 << k} as own, {sum(1 << i for i in order[: step - 1])} as before)")
    return F.expr(f"array({', '.join(rows)})")


def order_report(counted: DataFrame) -> DataFrame:
    """For each part, order and step the documents kept, removed, ..., from the counts of :func:`interactions`.

    shapley is what the step's filter removes, summed over all orders: it comes first among the k filters that a document fails in
    (number of orders) / k of them.
    """
    n_orders = len(list(permutations(LETTERS)))
    rows = counted.withColumn("s", F.explode(_steps())).select("*", "s.*").drop("s")

    def total(of: str, fits) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(fits(m), F.get(F.col(of), m)).otherwise(0))

    own, before = F.col("own"), F.col("before")
    has = lambda m, bits: m.bitwiseAND(bits) != 0
    removed = lambda m: has(m, own) & ~has(m, before)
    shares = F.array(*[F.lit(n_orders // max(1, m.bit_count())) for m in range(MASKS)])
    share = F.aggregate(F.sequence(F.lit(0), F.lit(MASKS - 1)), F.lit(0).cast("long"), lambda sum_, m: sum_ + F.when(has(m, own), F.get("n", m) * F.get(shares, m)).otherwise(0))
    return rows.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("n", lambda m: ~has(m, own.bitwiseOR(before))).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: has(m, own) & has(m, before)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step; nulls, ties and repeated rows as :func:`failures` says.

    Every row counts, repeated ones too; long texts are read whole.  An empty table has no parts and gives no rows.
    """
    return order_report(interactions(docs, labels, id_col, text_col, part_col))
