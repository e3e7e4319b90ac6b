"""Watched folders and job events as streams."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..operators.ingest import RESTING, SUFFIXES

FILES = "path string, mtime timestamp, size long, content binary, seen timestamp"
# fixed value: events of a job that are kept
MOST_EVENTS = 500


@dataclass
class _Changed(InputPartition):
    path: str


class _FolderStream(DataSourceStreamReader):
    """An offset is one moment, whatever the number of files: a file belongs to the batch in which its last change lies, so one that changes under
    its name comes again, which Spark's own file stream doesn't do.  The change is the inode's (writing, renaming, moving in), as a file that
    is moved in keeps its old modification time.  A folder and its direct subfolders are watched; hidden, linked and restless files wait.
    """

    def __init__(self, options: dict):
        self.root, self.rest = options["path"].removeprefix("file://"), float(options.get("rest", RESTING))

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def _found(self):
        def inside(folder, deeper):
            for e in os.scandir(folder):
                if e.name.startswith(".") or e.is_symlink():
                    continue
                if e.is_dir() and deeper:
                    yield from inside(e.path, False)
                elif e.is_file() and e.name.rsplit(".", 1)[-1].lower() in SUFFIXES:
                    yield e.path, max(e.stat().st_ctime_ns, e.stat().st_mtime_ns)

        return inside(self.root, True)

    def latestOffset(self) -> dict:
        """The last change that has rested; nothing that rests later can have changed before it."""
        rested = time.time_ns() - int(self.rest * 1e9)
        return {"changed": max((t for _, t in self._found() if t <= rested), default=-1)}

    def partitions(self, start: dict, end: dict):
        return [_Changed(p) for p, t in sorted(self._found()) if start["changed"] < t <= end["changed"]]

    def read(self, partition):
        from datetime import UTC, datetime

        try:
            with open(partition.path, "rb") as f:
                body = f.read()
            changed = os.stat(partition.path).st_mtime
        except FileNotFoundError:  # it went since the batch was planned
            return
        yield partition.path, datetime.fromtimestamp(changed, UTC), len(body), body, datetime.now(UTC)


class WatchedFolder(DataSource):
    @classmethod
    def name(cls):
        return "vellum_folder"

    def schema(self):
        return FILES

    def streamReader(self, schema):
        return _FolderStream(dict(self.options))


def watch(spark: SparkSession, path: str, rest: float = RESTING) -> DataFrame:
    """A stream of new and changed files."""
    spark.dataSource.register(WatchedFolder)
    return spark.readStream.format("vellum_folder").option("path", path).option("rest", str(rest)).load()


def changed_contents(stream: DataFrame, remembered: str = "30 days") -> DataFrame:
    """Files whose bytes the stream hasn't had under that matter (their folder) before.

    State is one hash per content and goes after the time that contents are ``remembered``, counted from when they were last seen new; the
    same bytes after that come again, and the ingest knows them by their checksum.
    """
    keyed = stream.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("sha256", F.sha2("content", 256))
    return keyed.withWatermark("seen", remembered).dropDuplicatesWithinWatermark(["folder", "sha256"])


TAIL = "job_id string, subscriber string, seq long, event string, data string, last boolean"


def job_tail(stream: DataFrame, keep_s: float = 3600.0) -> DataFrame:
    """What each subscriber of a job is told (TAIL): all events so far, then each new one, then a row with ``last`` that ends it.

    ``stream``: job_id, at, kind, event, data, subscriber; rows of a job count in order of ``at`` within a batch.  kind is "event", "terminal" (the
    job's last event) or "subscribe".  The first MOST_EVENTS events are kept and told; a terminal one beyond them is told but not kept.  What
    comes after the terminal event is ignored, and who subscribes then gets the kept events and the end at once.  A job's state goes ``keep_s``
    seconds after its terminal event; jobs lie in a state store by their id, so no task holds more than its own.
    """
    from pyspark.sql.streaming import StatefulProcessor

    import pandas as pd

    names = [c.split(" ")[0] for c in TAIL.split(", ")]

    class Tail(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.kept = handle.getListState("kept", "seq long, event string, data string")
            self.count = handle.getValueState("count", "n long")
            self.subscribers = handle.getListState("subscribers", "name string")
            self.ended = handle.getValueState("ended", "at long")

        def handleInputRows(self, key, rows, timerValues):
            job, out = key[0], []
            n = self.count.get()[0] if self.count.exists() else 0
            ended = self.ended.exists()
            told = [x[0] for x in self.subscribers.get()] if self.subscribers.exists() else []
            for r in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples():
                if r.kind == "subscribe":
                    if n:
                        out += [(job, r.subscriber, *x, False) for x in self.kept.get()]
                    if ended:
                        out.append((job, r.subscriber, None, None, None, True))
                    else:
                        told.append(r.subscriber)
                        self.subscribers.appendValue((r.subscriber,))
                    continue
                if ended or (r.kind != "terminal" and n >= MOST_EVENTS):
                    continue
                seq = n
                if n < MOST_EVENTS:
                    self.kept.appendValue((seq, r.event, r.data))
                    n += 1
                out += [(job, s, seq, r.event, r.data, False) for s in told]
                if r.kind == "terminal":
                    out += [(job, s, None, None, None, True) for s in told]
                    told, ended, now = [], True, timerValues.getCurrentProcessingTimeInMs()
                    self.subscribers.clear()
                    self.ended.update((now,))
                    self.handle.registerTimer(now + int(keep_s * 1000))
            self.count.update((n,))
            yield pd.DataFrame(out, columns=names).astype({"seq": "Int64"})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            for state in (self.kept, self.count, self.subscribers, self.ended):
                state.clear()
            yield pd.DataFrame([], columns=names).astype({"seq": "Int64", "last": bool})

        def close(self) -> None:
            pass

    return stream.groupBy("job_id").transformWithStateInPandas(Tail(), TAIL, "Append", "ProcessingTime")


def job_history(events: DataFrame) -> DataFrame:
    """The first MOST_EVENTS events of each job in order (job_id, seq, event, data) as one array, for replay."""
    from pyspark.sql import Window

    rows = events.withColumn("nth", F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))).where(F.col("nth") <= MOST_EVENTS)
    return rows.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("seq", "event", "data"))).alias("events"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events per type in tumbling windows; rows later than the watermark are dropped.  Works on streams and tables."""
    marked = events.withWatermark("ts", late)
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
