"""Rate limits and running statistics on streams, with state that Spark keeps by key.

State lies in RocksDB, so it may be larger than memory, and only keys that a batch touches are read or
written.  A key leaves the state by an event-time timer as soon as its state could no longer change a
decision: after a window without calls the sliding window is empty and the bucket is full.  So forgetting
idle keys changes nothing, and a restart from the checkpoint goes on as if there had been none.

Streams need ``spark.sql.streaming.stateStore.providerClass`` to be RocksDB's; ``prepared`` sets it where the session
has the default.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .limits import Limit, bucket_step, sliding_step

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def prepared(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get(_STORE):
        spark.conf.set(_STORE, _ROCKS)


class Limiter(StatefulProcessor):
    """Decides a key's calls in order of time and id.  What was accepted is a list of times for a sliding window,
    and a pair of tokens and time for a bucket."""

    def __init__(self, rule: Limit):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.rule.rule == "token_bucket":
            self.bucket = handle.getValueState("bucket", "tokens double, then double")
        else:
            self.accepted = handle.getListState("accepted", "at double")

    def _read(self) -> Any:
        if self.rule.rule == "token_bucket":
            return self.bucket.get() if self.bucket.exists() else None
        return [x[0] for x in self.accepted.get()] if self.accepted.exists() else []

    def _write(self, state: Any) -> None:
        if self.rule.rule == "token_bucket":
            self.bucket.update(state)
        elif state:
            self.accepted.put([(x,) for x in state])
        else:
            self.accepted.clear()

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        parts = [(pdf["us"].to_numpy(), pdf["call_id"].to_numpy()) for pdf in rows]
        us, call = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.lexsort((call, us))
        us, call = us[order], call[order]
        state, allowed = self._read(), np.zeros(len(us), bool)
        step = bucket_step if self.rule.rule == "token_bucket" else sliding_step
        for i, at in enumerate(us):
            allowed[i], state = step(state, at / 1e6, self.rule)
        self._write(state)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(us[-1] // 1000) + self.rule.seconds * 1000 + 1)
        yield pd.DataFrame({"call_id": call, "allowed": allowed})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        (self.bucket if self.rule.rule == "token_bucket" else self.accepted).clear()
        return iter(())

    def close(self) -> None:
        pass


def decide(calls: DataFrame, key: str, at: str, order: str, rule: Limit, late: str = "1 hour") -> DataFrame:
    """(call_id, allowed) of a stream of calls; calls more than ``late`` behind are dropped.

    The calls of one key and one micro-batch are put in order as two arrays; the micro-batch bounds them."""
    prepared(calls.sparkSession)
    timed = calls.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.unix_micros(F.col(at).cast("timestamp")).alias("us"), F.col(order).alias("call_id"))
    kind = dict(timed.dtypes)["call_id"]
    return timed.withWatermark("at", late).groupBy("key").transformWithStateInPandas(Limiter(rule), f"call_id {kind}, allowed boolean", "Append", "EventTime")


class Running(StatefulProcessor):
    """Count, sum, least and largest value of each key; a key may be forgotten after some time without rows."""

    def __init__(self, forget_ms: int | None):
        self.forget_ms = forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.statistics = handle.getValueState("statistics", "n long, total double, least double, largest double", self.forget_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        n, total, least, largest = self.statistics.get() if self.statistics.exists() else (0, 0.0, float("inf"), float("-inf"))
        for pdf in rows:
            v = pdf["value"].dropna()
            n, total = n + len(v), total + float(v.sum())
            if len(v):
                least, largest = min(least, float(v.min())), max(largest, float(v.max()))
        self.statistics.update((n, total, least, largest))
        yield pd.DataFrame({"key": [key[0]], "n": [n], "total": [total], "mean": [total / n if n else None], "least": [least if n else None], "largest": [largest if n else None]})

    def close(self) -> None:
        pass


_STATISTICS = "key string, n long, total double, mean double, least double, largest double"


def running_statistics(stream: DataFrame, key: str, value: str, forget_ms: int | None = None) -> DataFrame:
    """(key, n, total, mean, least, largest) of each key that a micro-batch touches, over all its rows so far; write it
    in update mode.  Nulls don't count.  ``forget_ms``: time to live of a key's state."""
    prepared(stream.sparkSession)
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))
    mode = "ProcessingTime" if forget_ms else "None"
    return rows.groupBy("key").transformWithStateInPandas(Running(forget_ms), _STATISTICS, "Update", mode)


def state_of(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """The state a checkpoint holds under one name, a row per key: what all keys stand at, without rewriting any table."""
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name).load()
