"""Token ids in Simple-8b words: encoding, files of blocks, and vectorised decoding.

A 64-bit word has a selector in its highest four bits and up to 60 ids of equal width below it.  An id of 60 bits or more is
an escape: a word with selector ESCAPE, then the id itself.  A file is Parquet with one row for each block of documents:
shard, block    where it stands; shards and blocks ascend with doc_id
doc_ids         its documents
n_tokens        ids of each document
words           all its ids as little-endian words
offsets         the word at which every RESTART-th id starts: readers decode from there, so a document's ids take no more than its own parts
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import arrow_schema, id_text, work_path
from .vocab import byte_bpe, encoder

#: Ids in a word and bits of each, by selector; the last selector is the escape.
SELECTORS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
#: Ids of a block (a document is never cut, so a very long one makes a larger block) and between its restart points.
BLOCK, RESTART = 1 << 17, 1 << 14

BLOCKS = "shard long, block long, doc_ids array<long>, n_tokens array<long>, words binary, offsets array<long>"
TOKENS = "shard long, block long, place long, doc_id long, n_tokens long, ids_crc32 long"


def encode(ids: np.ndarray) -> np.ndarray:
    """64-bit words of unsigned ids.  Each word takes as many ids as fit, from left to right."""
    v = np.asarray(ids, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.full(n + SELECTORS[0][0], 255, np.uint8)  # ids that aren't there fit nowhere
    bits[:n] = np.frexp(v.astype(np.float64))[1] if v.max() < 1 << 53 else np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), v, side="right")
    # the widest of the next k ids, for each selector's k, from those of two smaller counts
    choice = np.full(n, ESCAPE, np.uint8)
    widest, done = bits, 1
    for s in range(len(SELECTORS) - 1, -1, -1):
        k, most = SELECTORS[s]
        while done < k:
            step = min(done, k - done)
            widest, done = np.maximum(widest[:-step], widest[step:]), done + step
        choice[widest[:n] <= most] = s
    count = np.array([k for k, _ in SELECTORS] + [1, 1])[choice]
    step, starts, p = count.tolist(), [], 0
    while p < n:
        starts.append(p)
        p += step[p]
    first = np.array(starts)
    kinds = choice[first]
    width = np.where(kinds == ESCAPE, 2, 1)
    place = np.concatenate(([0], np.cumsum(width)))
    words = np.zeros(place[-1], np.uint64)
    words[place[:-1]] = kinds.astype(np.uint64) << np.uint64(60)
    for s, (k, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(kinds == s)
        if len(rows):
            part = v[first[rows][:, None] + np.arange(k)]
            words[place[rows]] |= np.bitwise_or.reduce(part << (np.arange(k) * bits).astype(np.uint64), axis=1)
    rows = np.flatnonzero(kinds == ESCAPE)
    words[place[rows] + 1] = v[first[rows]]
    return words


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of words; all words of one selector are unpacked at once."""
    w = np.asarray(words, np.uint64)
    kinds = (w >> np.uint64(60)).astype(np.int64)
    if (kinds == ESCAPE).any():  # the word after an escape isn't a word; an escaped id can look like another escape
        raw, skip = np.zeros(len(w), bool), -1
        for p in np.flatnonzero(kinds == ESCAPE).tolist():
            if p != skip:
                raw[p + 1], skip = True, p + 1
        kinds[raw] = -1
    counts = np.zeros(len(w), np.int64)
    for s, (k, _) in enumerate(SELECTORS):
        counts[kinds == s] = k
    counts[kinds == ESCAPE] = 1
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    start = ends - counts
    for s, (k, bits) in enumerate(SELECTORS):
        rows = np.flatnonzero(kinds == s)
        if len(rows):
            mask = np.uint64((1 << bits) - 1)
            out[start[rows][:, None] + np.arange(k)] = (w[rows][:, None] >> (np.arange(k) * bits).astype(np.uint64)) & mask
    rows = np.flatnonzero(kinds == ESCAPE)
    out[start[rows]] = w[rows + 1]
    return out


def block_words(ids: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """A block's words, and the word at which every RESTART-th id starts."""
    parts = [encode(ids[a : a + RESTART]) for a in range(0, len(ids), RESTART)]
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in parts])))[:-1]
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), offsets.tolist() if parts else []


def decode_range(words: np.ndarray, offsets: list[int], start: int, n: int) -> np.ndarray:
    """``n`` ids of a block from the ``start``-th on: only the parts between restart points that hold them are decoded, each in one go."""
    if not n:
        return np.zeros(0, np.uint64)
    first, last = start // RESTART, (start + n - 1) // RESTART
    ends = [*offsets, len(words)]
    parts = [decode(words[ends[k] : ends[k + 1]]) for k in range(first, last + 1)]
    at = start - first * RESTART
    return (parts[0] if len(parts) == 1 else np.concatenate(parts))[at : at + n]


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts (null: empty), each with ``end_id`` after it, into blocks in ascending order of doc_id.

    Rows that repeat are written as often, side by side; null ids come first; an empty table gives no blocks; other
    columns are ignored.  Sampled ids split the rows over tasks, so a shard holds a range of ids.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, schema = encoder(vocabulary), end_id.to_bytes(4, "little"), arrow_schema(BLOCKS)
        shard, block, ids, ns, parts, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def made() -> pa.RecordBatch:
            words, offsets = block_words(np.frombuffer(b"".join(parts), "<u4"))
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((shard, block, ids, ns, words.astype("<u8").tobytes(), offsets), schema, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                for doc, b in zip(some.column(0).to_pylist(), enc.ids(some.column(1)), strict=True):
                    ids.append(doc)
                    ns.append(len(b) // 4 + 1)
                    parts.append(b + end)
                    size += ns[-1]
                    if size >= BLOCK:
                        yield made()
                        block, ids, ns, parts, size = block + 1, [], [], [], 0
        if ids:
            yield made()

    rows = id_text(docs, id_col, text_col).repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(task, BLOCKS).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, with the count of all ids before it.

    Counts are summed within shards and over shards; only the latter, one number for each shard, meet in one task.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(TOKENS)
        for batch in batches:
            for shard, block, docs, ns, words, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = decode_range(np.frombuffer(words, "<u8"), offsets, 0, sum(ns)).astype("<u4").tobytes()
                ends = np.cumsum(ns).tolist()
                crc = [zlib.crc32(memoryview(ids)[(e - n) * 4 : e * 4]) for e, n in zip(ends, ns, strict=True)]
                k = len(docs)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([shard] * k, [block] * k, [e - n for e, n in zip(ends, ns, strict=True)], docs, ns, crc), schema, strict=True)], schema=schema)

    files = spark.read.schema(BLOCKS).parquet(path)
    sizes = files.select("shard", "block", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("size"))
    in_shard = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("size").alias("all")).select("shard", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("before"))
    blocks = sizes.join(shards, "shard").select("shard", "block", (F.col("before") + F.coalesce(F.sum("size").over(in_shard), F.lit(0))).alias("base"))
    ids = files.select("shard", "block", "doc_ids", "n_tokens", "words", "offsets").mapInArrow(task, TOKENS)
    return ids.join(blocks, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str, lo: int | None = None, hi: int | None = None) -> DataFrame:
    """doc_id and its ids, from the files; only of documents from ``lo`` to ``hi`` if given, of whose blocks only their parts are decoded."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema("doc_id long, ids array<long>")
        for batch in batches:
            for docs, ns, words, offsets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                inside = [k for k, d in enumerate(docs) if (lo is None or d is not None and d >= lo) and (hi is None or d is not None and d <= hi)]
                if inside:  # documents ascend, so these are neighbours
                    first, ns = sum(ns[: inside[0]]), ns[inside[0] : inside[-1] + 1]
                    ids = decode_range(np.frombuffer(words, "<u8"), offsets, first, sum(ns)).astype(np.int64)
                    parts = np.split(ids, np.cumsum(ns)[:-1])
                    yield pa.RecordBatch.from_arrays([pa.array(docs[inside[0] : inside[-1] + 1], pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))], schema=schema)

    files = spark.read.schema(BLOCKS).parquet(path)
    if lo is not None:
        files = files.where(F.element_at("doc_ids", -1) >= lo)
    if hi is not None:
        files = files.where(F.coalesce(F.get("doc_ids", F.lit(0)), F.lit(hi)) <= hi)
    return files.select("doc_ids", "n_tokens", "words", "offsets").mapInArrow(task, "doc_id long, ids array<long>")


def encoded_tokens(docs: DataFrame) -> DataFrame:
    path = work_path(docs.sparkSession, "tokens")
    write(docs, path, byte_bpe(), end_id=2)
    return read(docs.sparkSession, path)
