"""Items that fail are tried again later in the stream, and become dead letters after the last attempt.

The first attempt is made where the item is read. What fails is kept in state until the stream's time, its watermark, has
come `wait` further; a timer then tries it again. Time is that of the events, so a run's rows don't depend on how its
input was cut into batches, and state and timers are Spark's, so a query that is stopped goes on from its checkpoint and
every item ends once. What ends up neither done nor dead is still waiting when the input ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: attempt(items, number of the attempt) -> whether each is handled now; items: a pandas frame with the item's columns.
Attempt = Callable[[pd.DataFrame, int], np.ndarray]

MOST, PARTS, WAIT_MS = 3, 16, 3_600_000


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session of its own on the same cluster whose streams keep state in RocksDB, which timers need."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return own


class Retrying(StatefulProcessor):
    """State of one part: what is due at a time, by that time; a timer for every such time."""

    def __init__(self, attempt: Attempt, key: str, key_type: str, most: int, wait_ms: int):
        self.attempt, self.key, self.key_type, self.most, self.wait = attempt, key, key_type, most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "due bigint", f"items array<{self.key_type}>, attempts array<int>")

    def _later(self, now_ms: np.ndarray) -> np.ndarray:
        """Times of the next attempt, rounded up to whole waits, so that few timers serve many items."""
        return (now_ms // self.wait + 2) * self.wait

    def _keep(self, items: list, attempts: list[int], due: np.ndarray) -> None:
        for at in np.unique(due).tolist():
            chosen = [k for k, d in enumerate(due.tolist()) if d == at]
            held = self.waiting.getValue((at,)) if self.waiting.containsKey((at,)) else ([], [])
            self.waiting.updateValue((at,), (list(held[0]) + [items[k] for k in chosen], list(held[1]) + [attempts[k] for k in chosen]))
            self.handle.registerTimer(at)

    def _ended(self, items: list, attempts: Any, state: str) -> pd.DataFrame:
        return pd.DataFrame({self.key: items, "state": state, "attempts": attempts})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for batch in rows:
            ok = np.asarray(self.attempt(batch, 1), bool)
            failed = batch[~ok]
            if self.most > 1 and len(failed):
                now = failed["ts"].astype("datetime64[ms]").astype("int64").to_numpy()
                self._keep(failed[self.key].tolist(), [1] * len(failed), self._later(now))
            yield self._ended(batch[ok][self.key].tolist(), 1, "done")
            if self.most <= 1:
                yield self._ended(failed[self.key].tolist(), 1, "dead")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        items, attempts = (list(x) for x in self.waiting.getValue((at,)))
        self.waiting.removeKey((at,))
        while items:  # attempts that are due by now as well are made at once
            attempts = [n + 1 for n in attempts]
            ok = np.zeros(len(items), bool)
            for n in set(attempts):
                these = [k for k, a in enumerate(attempts) if a == n]
                ok[these] = self.attempt(pd.DataFrame({self.key: [items[k] for k in these]}), n)
            out = [(items[k], attempts[k], "done" if ok[k] else "dead") for k in range(len(items)) if ok[k] or attempts[k] >= self.most]
            if out:
                yield pd.DataFrame(out, columns=[self.key, "attempts", "state"])[[self.key, "state", "attempts"]]
            rest = [k for k in range(len(items)) if not ok[k] and attempts[k] < self.most]
            items, attempts = [items[k] for k in rest], [attempts[k] for k in rest]
            at += self.wait
            if items and at > timerValues.getCurrentWatermarkInMs():
                self._keep(items, attempts, np.full(len(items), at))
                return

    def close(self) -> None:
        pass


def with_retries(stream: DataFrame, key: str, attempt: Attempt, most: int = MOST, wait_ms: int = WAIT_MS, late: str = "0 seconds", parts: int = PARTS) -> DataFrame:
    """key, state (done or dead) and attempts of every item of a stream with a timestamp ts, once it has ended.

    `attempt` sees the item's columns at first and its key alone later. Items are dealt to `parts` groups of state by their
    hash, so it is bounded by what waits, whatever an item's group; rows later than `late` after the newest are dropped.
    """
    kind = dict(stream.dtypes)[key]
    dealt = stream.withWatermark("ts", late).withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int"))
    return dealt.groupBy("part").transformWithStateInPandas(
        Retrying(attempt, key, kind, most, wait_ms), f"{key} {kind}, state string, attempts int", outputMode="Append", timeMode="EventTime"
    )
