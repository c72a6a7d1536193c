"""Structured Streaming: audio sessions, keyed state, windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomgraph.operators.audio import wav_bytes
from loomgraph.operators.state import get_or_create
from loomgraph.runtime import drop_materialized, materialize


def audio_sessions(pieces: DataFrame, idle: str = "10 minutes", most_bytes: int = 64 << 20) -> DataFrame:
    """One WAV file per audio session, emitted at its end message.

    pieces: session string, seq long, kind ('start', 'chunk', 'end'), pcm binary, ts timestamp, with a watermark on ts.
    start clears the session's buffer, chunk adds to it, end gives the file and clears it. A session idle for ``idle``
    is dropped; one that outgrows ``most_bytes`` gives its file at once, so state stays bounded.
    """
    seconds = pd.Timedelta(idle)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get[0] if state.exists else b""
        open_ = state.exists
        rows = pd.concat(list(batches)).sort_values("seq")
        for kind, pcm in zip(rows["kind"], rows["pcm"]):
            if kind == "start":
                held, open_ = b"", True
            elif kind == "chunk" and pcm is not None:
                held, open_ = held + bytes(pcm), True
            if (kind == "end" and open_) or len(held) > most_bytes:
                yield pd.DataFrame({"session": [key[0]], "n_bytes": [len(held)], "wav": [wav_bytes(held)]})
                held, open_ = b"", False
        if open_:
            state.update((held,))
            state.setTimeoutTimestamp(max(int(state.getCurrentWatermarkMs()), int(rows["ts"].max().timestamp() * 1000)) + int(seconds.total_seconds() * 1000))
        elif state.exists:
            state.remove()

    return pieces.groupBy("session").applyInPandasWithState(step, "session string, n_bytes long, wav binary", "held binary", "append", GroupStateTimeout.EventTimeTimeout)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Number and sum per event type and window; rows later than the watermark are left out by the stream."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def keyed_upsert(path: str, on: str, defaults: dict, schema: str):
    """A foreachBatch function that creates the state rows a batch's keys lack, in the table at ``path``.

    Each batch appends the rows of its new keys and reads the key column of the table only; a batch that is run again finds
    its keys there.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            state = spark.read.schema(schema).parquet(path)
            state.isEmpty()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            state = spark.createDataFrame([], schema)
        fresh = batch.select(on).join(state.select(on), on, "left_anti")
        new = materialize(get_or_create(spark.createDataFrame([], schema), fresh, on, defaults))
        if not new.isEmpty():
            new.write.mode("append").parquet(path)
        drop_materialized(new)

    return run
