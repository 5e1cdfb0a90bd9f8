"""Versions of each entity's facts over a stream, in the order of their time, by a stateful operator with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERSIONS = "entity string, id string, effective_at timestamp, version long, replaces string"


class Versions(StatefulProcessor):
    """Keeps an entity's facts until the watermark has passed their time, and then numbers them.

    Facts that come late, but within the watermark, so still get their place; a fact that comes twice
    is kept once. What is emitted is forgotten but for the last fact and its number.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, id string", "at long")
        self.last = handle.getValueState("last", "id string, version long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for fact_id, at in zip(batch["id"], batch["effective_at"]):
                micros = pd.Timestamp(at).value // 1000
                self.waiting.updateValue((micros, fact_id), (micros,))
                self.handle.registerTimer(micros // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = sorted(tuple(k) for k in self.waiting.keys() if k[0] // 1000 + 1 <= expiredTimerInfo.getExpiryTimeInMs())
        before, n = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for at, fact_id in due:
            n += 1
            out.append((key[0], fact_id, pd.Timestamp(at, unit="us"), n, before))
            before = fact_id
            self.waiting.removeKey((at, fact_id))
        if due:
            self.last.update((before, n))
            yield pd.DataFrame(out, columns=["entity", "id", "effective_at", "version", "replaces"])

    def close(self) -> None:
        """Nothing is held open."""


def entity_versions(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """entity, id, effective_at, version, replaces of a stream of facts (entity, id, effective_at), emitted once no fact that is `lateness` late at most can come before.

    The session needs ROCKSDB as spark.sql.streaming.stateStore.providerClass. Facts of one time are
    ordered by id. Rows without an entity or a time are left out.
    """
    known = stream.where("entity is not null and effective_at is not null").select("entity", "id", "effective_at").withWatermark("effective_at", lateness)
    return known.groupBy("entity").transformWithStateInPandas(Versions(), VERSIONS, "Append", "EventTime")
