"""Messages of groups handled as they come: turn counters, every n-th turn a trigger, nothing handled twice."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Turns(StatefulProcessor):
    """A group's state: its last handled message, how many there were, and those that wait for the next trigger."""

    def __init__(self, order: str, every: int):
        self.order, self.every = order, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "last long, turns long")
        self.waiting = handle.getListState("waiting", "message long")

    def _rows(self, key: tuple[Any, ...], found: list[tuple[int, int, int, int]]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *f) for f in found], columns=["key", "first", "last", "messages", "turn_no"])

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last, turns = self.seen.get() if self.seen.exists() else (None, 0)
        held, found = [r[0] for r in self.waiting.get()], []
        for message in sorted({int(m) for df in rows for m in df[self.order].dropna()}):
            if last is not None and message <= last:
                continue  # handled before: a replay, or sent twice
            last, turns = message, turns + 1
            held.append(message)
            if len(held) == self.every:
                found.append((held[0], message, len(held), turns))
                held = []
        if last is not None:
            self.seen.update((last, turns))
        if held:
            self.waiting.put([(m,) for m in held])
        else:
            self.waiting.clear()
        yield self._rows(key, found)

    def close(self) -> None:
        pass


def turn_stream(messages: DataFrame, by: str, order: str, every: int) -> DataFrame:
    """``(by, first, last, messages, turn_no)``: each time a group has ``every`` new messages, which they are and the group's turn counter.

    ``order`` numbers a group's messages.  One that is not behind the last handled
    is left out, so a message counts once, however often it is sent and however
    the stream is cut into batches; messages without a number are never handled.

    State is a group's counter and fewer than ``every`` numbers, in RocksDB under
    the stream's checkpoint, so a restart goes on behind what was handled.
    """
    spark: SparkSession = messages.sparkSession
    spark.conf.set(PROVIDER, ROCKS)
    kind = messages.schema[by].dataType.simpleString()
    rows = messages.where(messages[by].isNotNull()).select(by, messages[order].cast("long").alias(order)).groupBy(by)
    out = rows.transformWithStateInPandas(_Turns(order, every), f"key {kind}, first long, last long, messages long, turn_no long", "append", "None")
    return out.withColumnRenamed("key", by)
