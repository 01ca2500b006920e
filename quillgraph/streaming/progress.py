"""Streams of progress events: latest values, monotone progress, expiry, sessions, incremental intake."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ensure_checkpoint_dir


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    """A file, or the files under a folder, as a stream; event times without a zone are read as UTC, for watermarks need a zone."""
    # Written as a pattern, a path may also be that of a single file.
    pattern = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in stream.schema if f.dataType.typeName() == "timestamp_ntz"})


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """The result of a stream once all that is there now has been read.

    In complete mode each batch replaces the result, in append and update mode
    batches add up. State and results lie in the shared checkpoint folder.
    """
    spark = stream.sparkSession
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    how = "overwrite" if mode == "complete" else "append"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode(how).parquet(f"{base}/out")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def latest(events: DataFrame, client: str, at: str, value: str) -> DataFrame:
    """(client, at, value): the latest value of each client, the greater on ties. For streams (complete or update) and tables."""
    best = F.max(F.struct(F.col(at).alias("t"), F.col(value).alias("v")))
    return events.groupBy(F.col(client).alias("client")).agg(best.alias("b")).select("client", F.col("b.t").alias("at"), F.col("b.v").alias("value"))


def windowed(events: DataFrame, at: str, by: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, by, n): events in windows of event time; rows later than ``late`` may be left out of a stream."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")


def sessions(events: DataFrame, client: str, at: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(client, start, end, n): spells of activity; a silence of ``gap`` ends one."""
    s = events.withWatermark(at, late).groupBy(F.col(client).alias("client"), F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
    return s.select("client", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def monotone(events: DataFrame, client: str, at: str, value: str, order: str) -> DataFrame:
    """Events with ``shown``, progress that never goes back. For tables: a running maximum by client."""
    so_far = W.partitionBy(client).orderBy(at, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return events.withColumn("shown", F.max(value).over(so_far))


def monotone_stream(events: DataFrame, client: str, at: str, value: str, order: str, done: str | None = None, forget: int | None = None) -> DataFrame:
    """(client, seq, shown) of a stream: the running maximum is one number of state for a client, rows of a batch in order of time.

    ``done`` is a column that marks a client's final events: they are shown as
    they are and end the client's state, so a later run begins anew. With
    ``forget``, the state of a client that isn't heard of for so many seconds of
    event time is dropped, and events later than that are too; without it, a
    client's state stays.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values([at, order], kind="stable")
        final = rows[done].fillna(False).astype(bool).to_numpy() if done else np.zeros(len(rows), bool)
        best = state.get[0] if state.exists else float("-inf")
        # Runs end with a final event, which neither raises nor is raised.
        run = np.concatenate([[0], np.cumsum(final)[:-1]])
        shown = rows[value].astype(float).where(~final).groupby(run).cummax()
        shown = shown.where(run > 0, shown.clip(lower=best)).where(~final, rows[value].astype(float))
        if final[-1]:
            if state.exists:
                state.remove()
        else:
            state.update((float(shown.iloc[-1]),))
            if forget:
                heard = int(rows[at].max().timestamp() * 1000)
                state.setTimeoutTimestamp(max(heard + forget * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "seq": rows[order].to_numpy(), "shown": shown.to_numpy()})

    out = f"client {kinds[client]}, seq {kinds[order]}, shown double"
    timed = events.withWatermark(at, f"{forget} seconds") if forget else events
    how = GroupStateTimeout.EventTimeTimeout if forget else GroupStateTimeout.NoTimeout
    return timed.groupBy(client).applyInPandasWithState(step, out, "best double", "append", how)


def alive(events: DataFrame, client: str, at: str, seconds: int = 3600, most: int = 1000) -> DataFrame:
    """(client, at): clients heard of within ``seconds`` of the newest event, the ``most`` latest of them."""
    seen = events.groupBy(F.col(client).alias("client")).agg(F.max(at).alias("at"))
    newest = events.agg(F.max(at).alias("now"))
    fresh = seen.crossJoin(newest).where(F.unix_timestamp("now") - F.unix_timestamp("at") <= seconds)  # one row
    return fresh.orderBy(F.desc("at"), "client").limit(most).select("client", "at")


def remaining(events: DataFrame, client: str, at: str, percent: str) -> DataFrame:
    """Events with ``eta``, the seconds that remain at the pace since the client's first event; at least 0, null at 0 %."""
    first = F.min(at).over(W.partitionBy(client))
    passed = F.unix_timestamp(at) - F.unix_timestamp(first)
    return events.withColumn("eta", F.greatest(F.round(F.try_divide(passed, F.col(percent) / 100) - passed), F.lit(0.0)))


def foreach_event(stream: DataFrame, tell: Callable[[list], None], checkpoint: str, most: int = 1000):
    """A running query that hands every row to a listener such as a progress bar, ``most`` at a time.

    Rows come to the driver partition by partition, so it holds one partition's
    rows at most, and none is left out.
    """

    def send(batch: DataFrame, _: int) -> None:
        held: list[dict] = []
        for row in batch.toLocalIterator():
            held.append(row.asDict())
            if len(held) == most:
                tell(held)
                held = []
        if held:
            tell(held)

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint).start()
