"""A stored inverted index for BM25: postings in blocks with score bounds, delta segments, deletions, versions.

Below the index's path lie

* ``segments/<n>/docs``: a row per chunk with its number, length and terms, as they stand in its text, joined by spaces,
* ``segments/<n>/postings``: a row per (scope, term, block of BLOCK consecutive chunk numbers) with its size, greatest frequency and least
  length, which bound what any chunk of the block gains, and its chunks; partitioned by a hash of (scope, term), sorted by
  term.  A block that a task had in two portions has two rows of a term,
* ``segments/<n>/stats`` and, for each deletion, ``deletions/<n>/dead``, ``gone`` and ``stats``: what totals lose,
* ``versions/<n>``: which segments and deletions a version is made of.  A version is written last and never changed, so a reader sees a
  whole one or the one before, and of two writers of one version the second fails.

Appending writes a segment of the new chunks alone; merging writes one of all that live.  Statistics are those of the scope, as the
brute-force ranking has them, so ranks are the same.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.udf import small_batches
from ..sources.store import cut, thin
from .retrieval import B, K1, _best, terms

#: Chunks of a block as a power of two, partitions of postings, parts that a partition can be dealt in, and chunk numbers of a segment as a power of two.
BLOCK_BITS, BUCKETS, PARTS, SEGMENT_BITS = 10, 64, 1024, 50
#: At most so many terms of texts are written as postings by one task.
TASK_TERMS = 2_000_000
BLOCKS = "scope string, term string, block long, n long, most int, least int, chunks array<struct<doc:long,tf:int,len:int>>"
#: What ``retrieval.TERM`` has stays, all other bytes are spaces.
KEPT = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))
VERSION = "version long, scope string, key array<string>, segments array<long>, deletions array<long>, used long"
#: Scores that differ by less are taken for equal where blocks are left out.
SLACK = 1e-9


class NoIndex(ValueError):
    """A path without an index, or without the version that was asked for."""


def current(spark: SparkSession, path: str, version: int | None = None):
    """The newest version's row, or that of a given version."""
    try:
        rows = spark.read.schema(VERSION).parquet(f"{path}/versions/*")
        rows = rows if version is None else rows.where(F.col("version") == version)
        row = rows.orderBy(F.col("version").desc()).first()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise NoIndex(path) from e
        raise
    if row is None:
        raise NoIndex(f"{path}, version {version}")
    return row


def _commit(spark: SparkSession, path: str, version: int, scope: str, key: list[str], segments: list[int], deletions: list[int], used: int) -> int:
    row = spark.createDataFrame([(version, scope, key, segments, deletions, used)], VERSION)
    row.coalesce(1).write.mode("error").parquet(f"{path}/versions/{version}")
    return version


def _bucket() -> Column:
    return F.pmod(F.xxhash64("scope", "term"), F.lit(BUCKETS)).cast("int").alias("bucket")


def _names(key: list[str]) -> list[str]:
    """The key's columns as they are stored, so that no name of a caller's clashes with one of the index."""
    return [f"key_{i}" for i in range(len(key))]


def _joined(texts: pa.Array) -> pa.Array:
    found = [(text.as_py() or "").lower().encode().translate(KEPT).split() for text in texts]
    return pa.StructArray.from_arrays([pa.array(map(len, found), pa.int32()), pa.array(map(b" ".join, found), pa.binary()).cast(pa.string())], ["len", "t"])


def joined_terms(text: Column) -> Column:
    """struct<len, t>: how many ``terms`` a text has, and these joined by spaces."""
    small_batches(SparkSession.getActiveSession())
    return F.arrow_udf(_joined, "struct<len:int,t:string>")(text)


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))


def _blocks(batches):
    """Chunks (scope, block, doc, len, t) as rows of BLOCKS.  A number for each occurrence of a term, made of its scope and block, the term and the chunk, is sorted and counted."""
    for b in batches:
        b = b.filter(pc.greater(b["len"], 0))
        if not b.num_rows:
            continue
        block, doc, length = (b[c].to_numpy() for c in ("block", "doc", "len"))
        word = pc.list_flatten(pc.split_pattern(b["t"], " ")).dictionary_encode()
        n_words, n_rows = len(word.dictionary), b.num_rows
        scope = b["scope"].dictionary_encode().indices.fill_null(-1).to_numpy().astype(np.int64) + 1
        group = np.unique(block, return_inverse=True)[1] * (scope.max() + 1) + scope
        key = np.repeat(group * n_words * n_rows + np.arange(n_rows), length) + word.indices.to_numpy() * np.int64(n_rows)
        key.sort()
        first = _starts(key)
        tf, row, of = np.diff(first, append=len(key)).astype(np.int32), key[first] % n_rows, key[first] // n_rows
        at = _starts(of)
        ends, head = np.append(at, len(of)), row[at]
        chunks = pa.StructArray.from_arrays([pa.array(doc[row]), pa.array(tf), pa.array(length[row])], ["doc", "tf", "len"])
        yield pa.RecordBatch.from_pydict({
            "scope": b["scope"].take(pa.array(head)), "term": word.dictionary.take(pa.array(of[at] % n_words)), "block": block[head], "n": np.diff(ends),
            "most": np.maximum.reduceat(tf, at), "least": np.minimum.reduceat(length[row], at), "chunks": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), chunks),
        })


def _write_segment(rows: DataFrame, path: str, number: int, key: list[str]) -> None:
    """``rows`` have scope, the key as it is stored, ``len`` and ``t``; chunks are numbered as they come.

    Blocks are made where their chunks are read and shuffled once, to tasks that write a run of partitions or a part of one; so
    a very frequent term is dealt to many, too.
    """
    spark, base = rows.sparkSession, f"{path}/segments/{number}"
    doc = F.monotonically_increasing_id() + F.lit(number << SEGMENT_BITS)
    rows.select("scope", *_names(key), doc.alias("doc"), "len", "t").write.mode("error").parquet(f"{base}/docs")
    docs = spark.read.parquet(f"{base}/docs")
    docs.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("len").cast("long")).alias("total")).write.mode("error").parquet(f"{base}/stats")
    total = spark.read.parquet(f"{base}/stats").agg(F.sum("total")).first()[0] or 0
    tasks = min(BUCKETS * PARTS, max(1, -(-total // TASK_TERMS)))
    small_batches(spark)
    posted = docs.select("scope", F.shiftright("doc", BLOCK_BITS).alias("block"), "doc", "len", "t").mapInArrow(_blocks, BLOCKS).withColumn("bucket", _bucket())
    part = F.pmod(F.xxhash64("scope", "term", "block"), F.lit(PARTS))
    task = F.floor((F.col("bucket") * PARTS + part) * tasks / (BUCKETS * PARTS)).cast("int")
    posted.repartitionById(tasks, task).sortWithinPartitions("bucket", "term", "scope", "block").write.mode("error").partitionBy("bucket").parquet(f"{base}/postings")


def _tokens(chunks: DataFrame, key: list[str], scope: str) -> DataFrame:
    """Chunks as they are indexed.  Those that a task reads are put in order by scope, so that blocks of a scope are full ones."""
    rows = chunks.select(F.col(scope).alias("scope"), *[F.col(c).alias(n) for c, n in zip(key, _names(key), strict=True)], F.col("text").alias("t"))
    return rows.sortWithinPartitions("scope").withColumn("t", joined_terms(F.col("t"))).select("scope", *_names(key), "t.len", "t.t")


def build(chunks: DataFrame, path: str, key: list[str], scope: str = "matter") -> int:
    """Index chunks (scope, key, text) at a path that has no index yet; gives version 1.  A null text has no terms but counts as a chunk."""
    _write_segment(_tokens(chunks, key, scope), path, 0, key)
    return _commit(chunks.sparkSession, path, 1, scope, list(key), [0], [], 1)


def append(chunks: DataFrame, path: str) -> int:
    """Add chunks whose keys the index doesn't have, as a segment of their own; gives the new version."""
    spark = chunks.sparkSession
    now = current(spark, path)
    _write_segment(_tokens(chunks, list(now["key"]), now["scope"]), path, now["used"], list(now["key"]))
    return _commit(spark, path, now["version"] + 1, now["scope"], list(now["key"]), [*now["segments"], now["used"]], list(now["deletions"]), now["used"] + 1)


def _read(spark: SparkSession, path: str, numbers: list[int], kind: str, what: str, schema: str) -> DataFrame:
    if not numbers:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema) if schema else spark.read  # a partitioned table without rows has no file that tells
    return reduce(DataFrame.unionByName, [reader.parquet(f"{path}/{kind}/{n}/{what}") for n in numbers])


def _docs(spark: SparkSession, path: str, now) -> DataFrame:
    return _read(spark, path, list(now["segments"]), "segments", "docs", "")


def _dead(spark: SparkSession, path: str, now) -> DataFrame:
    return _read(spark, path, list(now["deletions"]), "deletions", "dead", "doc long")


def delete(keys: DataFrame, path: str) -> int:
    """Take out the chunks with these keys (scope and key columns); those that aren't there change nothing.  Gives the new version.

    What terms and totals lose is counted from the terms of the deleted chunks, so postings aren't read.
    """
    spark = keys.sparkSession
    now = current(spark, path)
    names, base = _names(now["key"]), f"{path}/deletions/{now['used']}"
    on = ["scope", *names]
    wanted = keys.select(F.col(now["scope"]).alias("scope"), *[F.col(c).alias(n) for c, n in zip(now["key"], names, strict=True)]).distinct()
    hit = _docs(spark, path, now).join(wanted, on, "left_semi").join(_dead(spark, path, now), "doc", "left_anti")
    hit.select("doc", "scope", "len", "t").write.mode("error").parquet(f"{base}/dead")
    dead = spark.read.parquet(f"{base}/dead")
    dead.where("len > 0").select("scope", F.explode(F.array_distinct(F.split("t", " "))).alias("term")).groupBy("scope", "term").agg(F.count(F.lit(1)).alias("n")).write.mode("error").parquet(f"{base}/gone")
    dead.groupBy("scope").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("len").cast("long")).alias("total")).write.mode("error").parquet(f"{base}/stats")
    return _commit(spark, path, now["version"] + 1, now["scope"], list(now["key"]), list(now["segments"]), [*now["deletions"], now["used"]], now["used"] + 1)


def merge(spark: SparkSession, path: str) -> int:
    """Write all that lives as one segment; gives the new version.  Files of older versions stay for their readers."""
    now = current(spark, path)
    live = _docs(spark, path, now).join(_dead(spark, path, now).select("doc"), "doc", "left_anti")
    _write_segment(live.select("scope", *_names(now["key"]), "len", "t").sortWithinPartitions("scope"), path, now["used"], list(now["key"]))
    return _commit(spark, path, now["version"] + 1, now["scope"], list(now["key"]), [now["used"]], [], now["used"] + 1)


class Search:
    """A stated set of questions (qid, scope, query) against one version of an index."""

    def __init__(self, questions: DataFrame, path: str, k: int, question_key: str = "qid", version: int | None = None, digits: int = 9):
        spark = questions.sparkSession
        self.spark, self.path, self.k, self.qid, self.digits = spark, path, k, "asked_by", digits
        self.question_key = question_key
        self.now = current(spark, path, version)
        self.key, self.scope = list(self.now["key"]), self.now["scope"]
        asked = questions.select(F.col(question_key).alias(self.qid), F.col(self.scope).alias("scope"), F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
        self.asked = cut(asked.distinct().withColumn("bucket", _bucket()), "asked")
        self.words = cut(self.asked.select("scope", "term").distinct(), "asked-terms")
        #: BUCKETS at most, whatever is asked
        self.buckets = sorted(r["bucket"] for r in self.asked.select("bucket").distinct().collect())

    def postings(self) -> DataFrame:
        """The blocks of asked terms: partitions of other terms aren't opened."""
        every = _read(self.spark, self.path, list(self.now["segments"]), "segments", "postings", f"{BLOCKS}, bucket int")
        return every.where(F.col("bucket").isin(self.buckets)).drop("bucket").join(thin(self.words), ["scope", "term"], "left_semi")

    def _totals(self, what: str, by: list[str], columns: list[str]) -> DataFrame:
        """What deletions take from totals, as negative numbers."""
        schema = ", ".join(f"{c} string" for c in by) + ", " + ", ".join(f"{c} long" for c in columns)
        gone = _read(self.spark, self.path, list(self.now["deletions"]), "deletions", what, schema)
        return gone.select(*by, *[(-F.col(c)).alias(c) for c in columns])

    def weights(self, heads: DataFrame) -> DataFrame:
        """(scope, term, idf, avg_len) of asked terms, by statistics of their scope without what is deleted."""
        stats = _read(self.spark, self.path, list(self.now["segments"]), "segments", "stats", "scope string, n long, total long").unionByName(self._totals("stats", ["scope"], ["n", "total"]))
        stats = stats.groupBy("scope").agg(F.sum("n").alias("chunks"), (F.sum("total") / F.sum("n")).alias("avg_len"))
        lost = self._totals("gone", ["scope", "term"], ["n"]).join(thin(self.words), ["scope", "term"], "left_semi")
        df = heads.select("scope", "term", "n").unionByName(lost).groupBy("scope", "term").agg(F.sum("n").alias("df")).where("df > 0")
        idf = F.log(1 + (F.col("chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return df.join(stats, "scope").select("scope", "term", idf.alias("idf"), "avg_len")

    @staticmethod
    def _gain(tf: Column, length: Column) -> Column:
        """It grows with the frequency and falls with the length, so a block's extremes bound it."""
        return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.col("avg_len")))

    def scored(self, posted: DataFrame, blocks: DataFrame, weights: DataFrame) -> DataFrame:
        """(qid, scope, doc, score) of all living chunks of ``blocks`` (qid, block) among the asked postings."""
        wanted = self.asked.drop("bucket").join(blocks, self.qid)
        rows = posted.select("scope", "term", "block", "chunks").join(thin(cut(wanted, "wanted-blocks")), ["scope", "term", "block"])
        rows = rows.join(thin(weights), ["scope", "term"]).select(self.qid, "scope", "idf", "avg_len", F.explode("chunks").alias("c"))
        rows = rows.select(self.qid, "scope", F.col("c.doc").alias("doc"), self._gain(F.col("c.tf"), F.col("c.len")).alias("gain"))
        scores = rows.groupBy(self.qid, "scope", "doc").agg(F.sum("gain").alias("score"))
        if not self.now["deletions"]:
            return scores
        return scores.join(_dead(self.spark, self.path, self.now).select("doc"), "doc", "left_anti")

    def topk(self) -> DataFrame:
        """The k best chunks of each question by BM25: qid, scope, key, score, rank; ties by key.

        Blocks of the greatest bounds that hold k chunks are scored first; the k-th score so far leaves out every block whose
        terms' bounds together don't reach it.  What is read last can't be missed, as no chunk of a left-out block comes so far.
        """
        posted = cut(self.postings(), "asked-postings")  # the index is read once, whatever else is asked of these
        heads = posted.select("scope", "term", "block", "n", "most", "least")
        weights = cut(self.weights(heads), "weights")
        bounds = heads.join(thin(weights), ["scope", "term"]).withColumn("bound", self._gain(F.col("most"), F.col("least")))
        bounds = bounds.join(thin(self.asked.drop("bucket")), ["scope", "term"]).groupBy(self.qid, "block").agg(F.sum("bound").alias("bound"), F.max("n").alias("n"))
        by = Window.partitionBy(self.qid).orderBy(F.col("bound").desc(), "block").rowsBetween(Window.unboundedPreceding, -1)
        self.ranges = cut(bounds.withColumn("first", F.coalesce(F.sum("n").over(by), F.lit(0)) < self.k), "bounds")
        one = cut(self.scored(posted, self.ranges.where("first").select(self.qid, "block"), weights), "first-scores")
        least = _best(one, self.k, [self.qid], F.col("score").desc(), F.col("doc")).where(F.col("rank") == self.k - 1).select(self.qid, F.col("score").alias("least"))
        least = cut(least, "least")
        self.rest = cut(self.ranges.where("not first").join(least, self.qid, "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK).select(self.qid, "block"), "rest")
        found = one.unionByName(self.scored(posted, self.rest, weights)).join(least, self.qid, "left").where(F.col("score") >= F.coalesce("least", F.lit(0.0)) - SLACK).drop("least")
        found = cut(found, "found")
        named = _docs(self.spark, self.path, self.now).select("doc", *_names(self.key)).join(thin(found), "doc").withColumn("score", F.round("score", self.digits))
        ranked = _best(named, self.k, [self.qid], F.col("score").desc(), *[F.col(c) for c in _names(self.key)])
        named = [F.col(n).alias(c) for c, n in zip(self.key, _names(self.key), strict=True)]
        return ranked.select(F.col(self.qid).alias(self.question_key), F.col("scope").alias(self.scope), *named, "score", "rank")


def topk(questions: DataFrame, path: str, k: int, question_key: str = "qid", version: int | None = None) -> DataFrame:
    """The k best chunks of each question (qid, scope, query) in a stored index; a question without a hit has no rows."""
    return Search(questions, path, k, question_key, version).topk()
