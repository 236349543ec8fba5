"""Streaming operators, and batch twins that give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType


def event_stream(spark: SparkSession, folder: str, pattern: str, schema: StructType, watermark: str = "1 day", files: int | None = None) -> DataFrame:
    """Event files as a stream with event time `ts`, at most `files` per trigger."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    raw = (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, keep progress in `checkpoint`, write Parquet to `path`."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


#: Names of versions sort as their numbers do.
VERSION = "version={:015d}"


def _storage(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that were written to the end, in order; one that a failure cut short has no mark of success."""
    where, fs = _storage(spark, root)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    done = [n for n in names if n.startswith("version=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/_SUCCESS"))]
    return sorted(int(n.split("=")[1]) for n in done)


def upsert_versions(stream: DataFrame, root: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame], base: DataFrame, keep: int = 2) -> DataFrame:
    """The table at `root` after all batches of the stream, each merged into the version before it.

    Batch k makes version k + 1 from the last version up to k that storage holds, so nothing is kept by the driver: after a restart
    on the same checkpoint the next batch goes on from what is there, and a batch that is run again replaces its own version. Version 0
    is `base`, written if there is none. The last `keep` versions stay.
    """
    spark = stream.sparkSession
    at = lambda n: f"{root}/{VERSION.format(n)}"
    if not versions(spark, root):
        base.write.mode("overwrite").parquet(at(0))

    def each(df: DataFrame, batch: int) -> None:
        before = max(n for n in versions(spark, root) if n <= batch)
        merge(spark.read.parquet(at(before)), df).write.mode("overwrite").parquet(at(batch + 1))
        for old in versions(spark, root)[:-keep]:
            where, fs = _storage(spark, at(old))
            fs.delete(where, True)

    run_batches(stream, each, checkpoint, "append")
    return spark.read.parquet(at(versions(spark, root)[-1]))


def ingest_counted(stream: DataFrame, path: str, progress: str, checkpoint: str, counters: dict[str, Column]) -> None:
    """Append what is new to `path` and store each batch's counters under `progress`, exactly once across restarts.

    Counters are observed while the batch is written, without a second pass. Rows and counters of a batch lie under its number, so a batch
    that is run again replaces both.
    """

    def each(df: DataFrame, batch: int) -> None:
        seen = Observation(f"progress-{batch}")
        observed = df.observe(seen, *[c.alias(name) for name, c in counters.items()])
        observed.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        row = seen.get
        types = ", ".join(f"{name} {'double' if isinstance(row[name], float) else 'long'}" for name in counters)
        df.sparkSession.createDataFrame([tuple(row[name] for name in counters)], types).write.mode("overwrite").parquet(f"{progress}/batch={batch}")

    run_batches(stream, each, checkpoint, "append")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """The RocksDB state store inside; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class RateLimiter(StatefulProcessor):
    """Admits an event if fewer than `limit` admitted ones lie within `seconds` before it. Refused ones leave no trace.

    A key's events of one trigger are put in time order over all Arrow batches, as two numbers each. An event that comes in a later
    trigger than newer ones is judged when it comes, and newer admitted ones count as well. A timer clears a key's state when the
    watermark has passed the end of its window: no event that still comes can be so old, so idle users cost nothing.
    """

    def __init__(self, limit: int, seconds: float):
        self.limit, self.seconds = limit, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", StructType([StructField("ts", DoubleType())]))

    def handleInputRows(self, key, rows, timerValues):
        times = [t[0] for t in self.admitted.get()]
        parts = [(pdf["ts"].astype("datetime64[us]").astype("int64").to_numpy(), pdf["event_id"].to_numpy()) for pdf in rows]
        micros, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.lexsort((ids, micros))
        keep = []
        for now in (micros[order] / 1e6).tolist():
            times = [t for t in times if t > now - self.seconds]
            keep.append(len(times) < self.limit)
            if keep[-1]:
                times.append(now)
        yield pd.DataFrame({"user_id": key[0], "event_id": ids[order], "admitted": keep})
        self.admitted.put([(t,) for t in times])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if times:
            self.handle.registerTimer(int((max(times) + self.seconds) * 1000) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.admitted.clear()
        yield pd.DataFrame({"user_id": [], "event_id": [], "admitted": []}).astype({"user_id": "int64", "event_id": "int64", "admitted": "bool"})

    def close(self) -> None:
        pass


def rate_limit_stream(stream: DataFrame, limit: int, seconds: float) -> DataFrame:
    """(user_id, event_id, admitted); run it inside `state_store`. State: `limit` times and a timer per user whose window is still open.
    The stream needs a watermark on ts; events behind it are dropped."""
    return stream.select("user_id", "event_id", "ts").groupBy("user_id").transformWithStateInPandas(RateLimiter(limit, seconds), "user_id long, event_id long, admitted boolean", "Append", "EventTime")


def rate_limit_batch(events: DataFrame, limit: int, seconds: float) -> DataFrame:
    """The same over a table. One user's events are sorted in a task in Arrow batches, never held together: state is
    `limit` times, so a user with very many events streams through."""

    def run(batches):
        user, times = None, []
        for pdf in batches:
            keep = []
            for u, ts in zip(pdf["user_id"], pdf["t"], strict=True):
                if u != user:
                    user, times = u, []
                times = [t for t in times if t > ts - seconds]
                keep.append(len(times) < limit)
                if keep[-1]:
                    times.append(ts)
            yield pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "admitted": keep})

    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("t", F.col("us") / 1e6)
    return rows.repartition("user_id").sortWithinPartitions("user_id", "us", "event_id").select("user_id", "event_id", "t").mapInPandas(run, "user_id long, event_id long, admitted boolean")


def status_counts(jobs: DataFrame, status: Column) -> DataFrame:
    return jobs.groupBy(status.alias("status")).count()


def dedup_shown(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first of each key within the watermark."""
    return stream.dropDuplicatesWithinWatermark(keys)
