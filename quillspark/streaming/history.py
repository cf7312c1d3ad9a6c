"""Streaming extension: reading history and saved positions kept as state, snapshots of the last write, and windowed counts of late events.

The batch twin of ``history`` is ``operators.userstate.reading_history``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.userstate import HISTORY

OUTPUT = "user_id bigint, book string, chapter int, ts timestamp, r bigint"
STATE = "books array<string>, chapters array<int>, times array<timestamp>, ids array<bigint>"


def history(events: DataFrame, keep: int = HISTORY) -> DataFrame:
    """Each user's latest distinct chapters after every batch that touches the user (update mode).

    ``events``: (event_id, user_id, ts, book, chapter).  The state of a user is ``keep`` entries.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        latest: dict[tuple[str, int], tuple[pd.Timestamp, int]] = {}
        if state.exists:
            latest = {(b, int(c)): (pd.Timestamp(t), int(i)) for b, c, t, i in zip(*state.get, strict=True)}
        for batch in batches:
            for b, c, t, i in zip(batch["book"], batch["chapter"], batch["ts"], batch["event_id"], strict=True):
                latest[(b, int(c))] = max(latest.get((b, int(c)), (pd.Timestamp.min, -1)), (t, int(i)))
            latest = dict(sorted(latest.items(), key=lambda x: x[1], reverse=True)[:keep])
        rows = [(b, c, t.to_pydatetime(), i) for (b, c), (t, i) in latest.items()]
        state.update(tuple(list(x) for x in zip(*rows, strict=True)))
        yield pd.DataFrame({"user_id": key[0], "book": [x[0] for x in rows], "chapter": [x[1] for x in rows], "ts": [x[2] for x in rows], "r": range(1, len(rows) + 1)})

    picked = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "book", "chapter")
    return picked.groupBy("user_id").applyInPandasWithState(step, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


POSITION = "user_id bigint, book string, chapter int, ts timestamp, live boolean"


def saved_positions(events: DataFrame, hours: int = 24, lateness: str = "10 minutes") -> DataFrame:
    """Each user's last position whenever it changes, and once more, no longer ``live``, when it is ``hours`` old by event time.

    ``events``: (event_id, user_id, ts, book, chapter).  The state of a user goes when its time is up.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def row(live: bool, last: tuple) -> pd.DataFrame:
            return pd.DataFrame({"user_id": [key[0]], "book": [last[0]], "chapter": [last[1]], "ts": [pd.Timestamp(last[2])], "live": [live]})

        if state.hasTimedOut:
            yield row(False, state.get)
            state.remove()
            return
        last = state.get if state.exists else None
        for batch in batches:
            for b, c, t, i in zip(batch["book"], batch["chapter"], batch["ts"], batch["event_id"], strict=True):
                if last is None or (t, int(i)) > (pd.Timestamp(last[2]), int(last[3])):
                    last = (b, int(c), t.to_pydatetime(), int(i))
        until = int(pd.Timestamp(last[2]).tz_localize("UTC").timestamp() * 1000) + hours * 3_600_000
        if until <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield row(False, last)
            return
        changed = not state.exists or tuple(state.get) != last
        state.update(last)
        state.setTimeoutTimestamp(until)
        if changed:
            yield row(True, last)

    picked = events.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "book", "chapter").withWatermark("ts", lateness)
    return picked.groupBy("user_id").applyInPandasWithState(step, POSITION, "book string, chapter int, ts timestamp, id bigint", "update", GroupStateTimeout.EventTimeTimeout)


def keep_last(events: DataFrame, path: str, key: list[str], order: list[str]) -> DataStreamWriter:
    """A writer that keeps the last write of each key as a snapshot a batch (``path/version=<batch>``).

    A batch that is run again writes the same snapshot again.  ``latest`` reads the newest one.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch if number == 0 else batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={number - 1}"))
        best = rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("row"))
        best.select("row.*").write.mode("overwrite").parquet(f"{path}/version={number}")

    return events.writeStream.outputMode("append").foreachBatch(merge)


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot that is complete."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
    return spark.read.parquet(f"{path}/version={max(int(f.getPath().getParent().getName().split('=')[1]) for f in files)}")


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "24 hours") -> DataFrame:
    """Counts by window and type; events later than ``lateness`` are dropped by the watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
