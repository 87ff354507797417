"""A tile cache as keyed state with timers: requests are answered, and entries expire, as event time goes on.

One stream carries entries and requests. A key's state is what has come but is not due yet, and its live entries, in blocks of
rows. A key has one timer, for the first time at which something is due; once the watermark has passed it, all that is due is
taken at once, in the order of its times. So the state of a key is read once a batch, and neither the order of arrival nor how
rows fall into batches shows, but for rows that come later than the watermark allows, which are dropped. Times are whole
microseconds; no time zone enters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from landcube.sources.shared import shared_path

ENTRY, REQUEST, TICK = "entry", "request", "tick"
HIT, MISS, EXPIRED = "hit", "miss", "expired"
EVENTS = "key long, id long, ts timestamp, kind string"
ANSWERS = "kind string, key long, id long, us long, entry long"
DAY = 86_400_000_000
STORE = "spark.sql.streaming.stateStore.providerClass"
#: Rows of the state: kind 0 for an entry, 1 for a request, 2 for a tick. So many are a block.
ROW, BLOCK = np.dtype([("us", "<i8"), ("kind", "<i8"), ("id", "<i8")]), 40_000
KINDS = {ENTRY: 0, REQUEST: 1}


class Cache(StatefulProcessor):
    """``kind`` hit or miss for a request (``entry``: the newest that is live at its time), expired for an entry at its end."""

    def __init__(self, life: int):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.entries = handle.getListState("entries", "rows binary")
        self.timer = handle.getValueState("timer", "ms long")

    def _blocks(self, rows: np.ndarray) -> list[tuple]:
        return [(rows[k : k + BLOCK].tobytes(),) for k in range(0, len(rows), BLOCK)]

    def _read(self, state) -> np.ndarray:
        return np.concatenate([np.empty(0, ROW), *[np.frombuffer(block[0], ROW) for block in state.get()]])

    def _write(self, state, rows: np.ndarray) -> None:
        if len(rows):
            state.put(self._blocks(rows))
        else:
            state.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows))
        own = np.empty(len(came), ROW)
        own["us"], own["kind"], own["id"] = came["us"], came["kind"].map(KINDS).fillna(2), came["id"]
        self.waiting.appendList(self._blocks(own))
        first, held = -(-int(own["us"].min()) // 1000), self.timer.get()
        if held is None or first < held[0]:
            if held is not None:
                self.handle.deleteTimer(held[0])
            self.handle.registerTimer(first)
            self.timer.update((first,))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, waiting = timerValues.getCurrentWatermarkInMs() * 1000, self._read(self.waiting)
        due, later = waiting[waiting["us"] <= now], waiting[waiting["us"] > now]
        entries = np.sort(np.concatenate([self._read(self.entries), due[due["kind"] == 0]]), order=["us", "id"])
        asked = due[due["kind"] == 1]
        # the newest entry up to a request's time, those of that time too; if it is no longer live, none is
        at = np.searchsorted(entries["us"], asked["us"], "right") - 1
        live = at >= 0
        live[live] = entries["us"][at[live]] + self.life > asked["us"][live]
        over = entries["us"] + self.life <= now
        gone, left = entries[over], entries[~over]
        self._write(self.waiting, later)
        self._write(self.entries, left)
        ends = [x.min() for x in (later["us"], left["us"] + self.life) if len(x)]
        if ends:
            first = -(-int(min(ends)) // 1000)
            self.handle.registerTimer(first)
            self.timer.update((first,))
        else:
            self.timer.clear()
        answered = np.full(len(asked), -1)
        answered[live] = entries["id"][at[live]]
        entry = pd.arrays.IntegerArray(np.concatenate([answered, gone["id"]]), np.concatenate([~live, np.zeros(len(gone), bool)]))
        kinds = np.concatenate([np.where(live, HIT, MISS), np.full(len(gone), EXPIRED)]).astype(object)
        made = {"kind": kinds, "key": key[0], "id": np.concatenate([asked["id"], gone["id"]]), "us": np.concatenate([asked["us"], gone["us"] + self.life]), "entry": entry}
        yield pd.DataFrame(made).astype({"key": "int64"})

    def close(self) -> None:
        pass


def answers(events: DataFrame, days: int, late: str = "1 hour") -> DataFrame:
    """Hits, misses and evictions of a stream of events (key, id, ts, kind); rows of kind ``tick`` only move the time on."""
    timed = events.withWatermark("ts", late).select("key", "id", "kind", F.unix_micros("ts").alias("us"), "ts")
    return timed.groupBy("key").transformWithStateInPandas(Cache(days * DAY), ANSWERS, "append", "eventTime")


def stream_cache(spark: SparkSession, folder: str, days: int, state: str | None = None, out: str | None = None, late: str = "1 hour", most: int = 64_000_000) -> DataFrame:
    """Read all files of ``folder`` that are not read yet, oldest first, some ``most`` bytes a batch, and return all answers so far.

    A set of files written together can fall into several batches, so ``late`` has to be no less than the time that it spans.

    State and answers are in the shared folder, or where ``state`` and ``out`` say, by which a stopped run goes on. Answers are
    written by batch, each over what an earlier try of it wrote.
    """
    state, out = state or shared_path(spark, "state"), out or shared_path(spark, "answers")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        arriving = spark.readStream.schema(EVENTS).option("maxBytesPerTrigger", most).parquet(folder)
        query = answers(arriving, days, late).writeStream.foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    return spark.read.schema(ANSWERS).parquet(f"{out}/batch=*")
