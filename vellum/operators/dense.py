"""Exact nearest vectors of many questions: a matrix product per Arrow batch, the best of each task, one small merge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Bytes of question vectors that are sent to tasks at once; more questions take another pass over the items.
BLOCK_BYTES = 32 << 20
#: Rows of a batch that are multiplied at once, so the products of a block stay small.
PRODUCT = 1 << 22


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors that are there as one float64 matrix, and their rows; a null vector or element has no distance."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(np.nan_to_num(np.asarray(size, np.float64), nan=-1) >= 0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(rows):
        return np.zeros((0, 0)), rows
    width = int(size[rows[0]])
    if any(size[rows] != width):
        raise ValueError("vectors of different widths")
    return flat.reshape(len(rows), width), rows


def _nearest(items: pa.RecordBatch, vector: str, scope: str | None, q: np.ndarray, codes: dict, q_codes: np.ndarray, limit: np.ndarray, k: int, equal: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, question, distance) of a batch's items that can be among the k best; ``limit`` is the k-th distance of each question so far,
    and distances that differ by less than ``equal`` can round alike.

    Products in 32 bits choose generously, by the error that so many terms can have; distances are those of differences in 64 bits.
    """
    x, rows = _matrix(items.column(vector))
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if x.shape[1] != q.shape[1]:
        raise ValueError("vectors of different widths")
    xx, qq = (x * x).sum(1), (q * q).sum(1)
    near = xx[:, None] + qq[None, :] - 2.0 * (x.astype(np.float32) @ q.astype(np.float32).T)
    if scope is not None:
        own = np.array([codes.get(v, -1) for v in items.column(scope).take(pa.array(rows)).to_pylist()])
        near[own[:, None] != q_codes[None, :]] = np.inf
    error = 2.0**-23 * (x.shape[1] + 8) * (xx.max() + qq)
    if len(rows) > k:
        limit = np.minimum(limit, np.partition(near, k - 1, axis=0)[k - 1] + error + equal)
    row, which = np.nonzero(near <= np.minimum(limit + error, np.finfo(np.float64).max))
    out = np.empty(len(row))
    for at in range(0, len(row), 1 << 14):
        part = slice(at, at + (1 << 14))
        out[part] = ((x[row[part]] - q[which[part]]) ** 2).sum(1)
    return rows[row], which, out


def _kept(rows: pa.Table, k: int, order: list[str]) -> pa.Table:
    """The k best rows of each question."""
    rows = rows.sort_by([("__q", "ascending"), ("distance", "ascending"), *((c, "ascending") for c in order)])
    which = rows["__q"].to_numpy()
    place = np.arange(len(which)) - np.searchsorted(which, which)
    return rows.filter(pa.array(place < k))


def _block(questions: list, items: DataFrame, k: int, order: list[str], scope: str | None, question_key: str, digits: int, vector: str) -> DataFrame:
    """The k best items of each of some questions in each task."""
    spark = items.sparkSession
    names = [c for c in items.columns if c != vector]
    codes = {v: i for i, v in enumerate(dict.fromkeys(r["scope"] for r in questions if r["scope"] is not None))}
    sent = spark.sparkContext.broadcast((np.array([r["vector"] for r in questions], np.float64), codes, np.array([codes.get(r["scope"], -2) for r in questions])))
    schema = T.StructType([*(items.schema[c] for c in names), T.StructField("__q", T.LongType()), T.StructField("distance", T.DoubleType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, codes, q_codes = sent.value
        limit, best, pending, n = np.full(len(q), np.inf), None, [], 0

        def reduced() -> None:
            nonlocal best, pending, n
            best = _kept(pa.concat_tables([*([best] if best is not None else []), *pending]), k, order)
            which, distance = best["__q"].to_numpy(), best["distance"].to_numpy()
            last = np.flatnonzero(np.bincount(which, minlength=len(q)) == k)
            limit[last] = distance[np.searchsorted(which, last, "right") - 1] + 10.0**-digits
            pending, n = [], 0

        for whole in batches:
            step = max(256, PRODUCT // len(q))
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                row, which, distance = _nearest(b, vector, scope, q, codes, q_codes, limit, k, 10.0**-digits)
                if len(row):
                    got = pa.Table.from_batches([b.select(names).take(pa.array(row))])
                    pending.append(got.append_column("__q", pa.array(which, pa.int64())).append_column("distance", pa.array(np.round(distance, digits))))
                    n += len(row)
                    if best is None or n > 4 * k * len(q):
                        reduced()
        if pending:
            reduced()
        if best is not None:
            yield from best.to_batches()

    got = items.select(*names, vector).mapInArrow(task, schema)
    ids = spark.createDataFrame([(i, r[question_key]) for i, r in enumerate(questions)], T.StructType([T.StructField("__q", T.LongType()), T.StructField(question_key, T.StringType() if isinstance(questions[0][question_key], str) else T.LongType())]))
    return got.join(F.broadcast(ids), "__q").drop("__q")  # as many rows as the block has questions


def dense_topk(questions: DataFrame, items: DataFrame, k: int, key: list[str], scope: str | None = None, question_key: str = "qid", digits: int = 9, vector: str = "vector") -> DataFrame:
    """The k nearest items of each question by squared L2 distance, exact; ``rank`` starts at 0, ties go by ``key``.

    ``questions`` has question_key (a number or a string), ``vector`` and, with a scope, its column, which an item's must equal.  They
    come in blocks of at most BLOCK_BYTES; each task multiplies a block with its Arrow batches and keeps the k best rows of each question, so
    items are neither joined, shuffled nor sorted, and what is merged are k rows of a question and task.  An item without a vector, or a
    question without one, has no rows; other columns of items come along.
    """
    columns = [question_key, vector, *([scope] if scope else [])]
    width = questions.where(F.col(vector).isNotNull()).select(F.max(F.size(vector))).first()[0]
    kind = questions.schema[question_key].dataType
    if not isinstance(kind, (T.StringType, T.LongType, T.IntegerType, T.ShortType)):
        raise TypeError(f"{question_key}: a number or a string")
    asked = questions.where(F.col(vector).isNotNull()).select(F.col(question_key), F.col(vector).alias("vector"), (F.col(scope) if scope else F.lit(None).cast("string")).alias("scope"))
    at_once = max(1, BLOCK_BYTES // (8 * (width or 1)))
    parts, some = [], []
    for r in asked.toLocalIterator():
        some.append(r)
        if len(some) == at_once:
            parts.append(_block(some, items, k, key, scope, question_key, digits, vector))
            some = []
    if some:
        parts.append(_block(some, items, k, key, scope, question_key, digits, vector))
    names = [c for c in items.columns if c != vector]
    if not parts:
        return items.select(*names).withColumn("distance", F.lit(0.0)).withColumn(question_key, F.lit(None).cast(kind)).withColumn("rank", F.lit(0)).where(F.lit(False))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    order: list[Column] = [F.col("distance"), *[F.col(c) for c in key]]
    ranked = rows.withColumn(question_key, F.col(question_key).cast(kind)).withColumn("rank", F.row_number().over(Window.partitionBy(question_key).orderBy(*order)) - 1)
    return ranked.where(F.col("rank") < k).select(*names, question_key, "distance", "rank")
