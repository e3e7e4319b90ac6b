"""Helpers shared by the operators of this package: inputs, shared folders, cut lineage, sizes."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Broadcast sides of up to so many thin rows; beyond it the same join shuffles.
BROADCAST_ROWS = 500_000
#: A join key with more than one in so many of the rows it meets, and more than so many, is split over tasks.
HOT_KEYS, HOT_LEAST = 1024, 512
#: Rows and bytes of an Arrow batch of whole texts; a batch with longer texts ends sooner.
BATCH_ROWS, BATCH_BYTES = 2048, 4 << 20

_made: "weakref.WeakKeyDictionary" = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "vellum-work")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended; the folder is left for the cluster's own clean-up
        pass


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it goes when the interpreter ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if spark not in _made:
        _made[spark] = []
        atexit.register(lambda s=spark, paths=_made[spark]: [delete(s, p) for p in paths])
    _made[spark].append(path)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages survive lost executors without recomputing it."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python BATCH_ROWS or about BATCH_BYTES at a time, so that buffers on both sides stay small; a session's lower numbers stay."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, most)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, as ``id`` and ``text``; other columns can't clash with its own names."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def thin(side: DataFrame, rows: int | None = None) -> DataFrame:
    """``side`` as a broadcast if its count is within BROADCAST_ROWS, else as it is (the join then shuffles)."""
    n = side.count() if rows is None else rows
    return F.broadcast(side) if n <= BROADCAST_ROWS else side


def spread_join(rows: DataFrame, side: DataFrame, keys: list[str], matches: str, how: str = "inner", by: tuple[str, ...] = ("id",)) -> DataFrame:
    """``rows`` joined with ``side``, whose rows have distinct keys and say in ``matches`` how many of ``rows`` they meet; that column goes.

    A key that meets more than 1/HOT_KEYS of all is split over tasks by a hash of the columns ``by``, which tell apart rows that are
    else equal, as copies are (their ids; hashes of their texts or places in them are the same): there are fewer than
    HOT_KEYS such keys, so they are broadcast whatever the input.  ``side`` is read twice and should be a written table.
    """
    total, longest = side.agg(F.sum(matches), F.max(matches)).first()
    most = max(HOT_LEAST, (total or 0) // HOT_KEYS)
    if (longest or 0) <= most:
        return rows.join(side.drop(matches), keys, how)
    parts = F.ceil(F.col(matches) / most).cast("int")
    hot = side.where(F.col(matches) > most).select(*keys, parts.alias("__parts"))
    salt = F.pmod(F.xxhash64(*by), F.coalesce("__parts", F.lit(1))).cast("int")
    salted = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__parts")
    other = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))).drop(matches)
    return salted.join(other, [*keys, "__salt"], how).drop("__salt")


def freeing(task):
    """``task``, which gives memory back to the system at its end: a Python worker stays, idle, while other stages need the room."""

    def run(batches):
        import ctypes

        import pyarrow as pa

        yield from task(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run


def slices(batches, rows: int = 64):
    """Arrow batches in small pieces, so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def arrow_schema(ddl: str):
    """The Arrow schema of flat DDL such as "a long, b array<long>"; needs no session, so tasks can call it."""
    import pyarrow as pa

    plain = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    plain |= {f"array<{k}>": pa.list_(v) for k, v in plain.items()}
    return pa.schema([(name, plain[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])
