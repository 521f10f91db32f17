"""Claims of objects as stream state: each object is handed out once, and again only if its worker fell silent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Where state and timers are kept: transformWithState needs a store on disk.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
STATE = "status string, claimed_ms long, attempts int"
OUT = "object_key string, action string, at_ms long, attempts int"
#: Of messages of one moment: what a worker reports counts before what arrives.
ORDER = {"done": 0, "failed": 1, "arrived": 2}


def step(state: tuple[str, int, int], kind: str, at: int, stale: int, most: int) -> tuple[tuple[str, int, int], str | None]:
    """The state of an object after a message ("arrived", "done", "failed", or "timer") and the action that it calls for.

    state: status (pending, processing, processed, quarantined), time of the
    claim and attempts. An object that arrives is processed if nobody has it,
    reclaimed if who has it is stale, quarantined after ``most`` attempts, else
    skipped; processed and quarantined are ends.
    """
    status, claimed, attempts = state
    if status in ("processed", "quarantined"):
        return state, "skip" if kind == "arrived" else None
    if kind == "done":
        return ("processed", claimed, attempts), None
    if kind == "failed":
        return (("quarantined", claimed, attempts), "quarantine") if attempts >= most else (("pending", 0, attempts), None)
    if status == "processing" and at < claimed + stale:
        return state, "skip" if kind == "arrived" else None
    if kind == "timer" and status != "processing":
        return state, None
    if attempts >= most:
        return ("quarantined", claimed, attempts), "quarantine"
    return ("processing", at, attempts + 1), "reclaim" if status == "processing" else "process"


class Claims(StatefulProcessor):
    """One object's claim, with a timer for the moment from which its worker is stale."""

    def __init__(self, stale_ms: int, most: int):
        self.stale, self.most = stale_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows))
        messages = sorted((int(at), ORDER.get(kind, 9), kind) for at, kind in zip(batch["at_ms"], batch["kind"], strict=True))
        yield from self.run(key, [(kind, at) for at, _, kind in messages if kind in ORDER])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.run(key, [("timer", expiredTimerInfo.getExpiryTimeInMs())])

    def run(self, key: tuple, messages: list[tuple[str, int]]) -> Iterator[pd.DataFrame]:
        state = tuple(self.claim.get()) if self.claim.exists() else ("pending", 0, 0)
        out = []
        for kind, at in messages:
            before = state
            state, action = step(state, kind, at, self.stale, self.most)
            if before[0] == "processing" and state[:2] != before[:2]:
                self.handle.deleteTimer(before[1] + self.stale)
            if state[0] == "processing" and state[:2] != before[:2]:
                self.handle.registerTimer(state[1] + self.stale)
            if action:
                out.append((key[0], action, at, state[2]))
        self.claim.update(state)
        if out:
            yield pd.DataFrame(out, columns=["object_key", "action", "at_ms", "attempts"])

    def close(self) -> None:
        pass


def claimed(messages: DataFrame, stale_seconds: int = 900, most: int = 5, delay: str = "1 minute") -> DataFrame:
    """(object_key, action, at_ms, attempts) of a stream of messages(object_key, kind, at): process, reclaim, skip, quarantine.

    The state lives in the checkpoint: a query that starts again goes on where
    the last one was, so that an object that is repeated is handed out once.
    Messages of a batch are taken by time; time passes with the watermark, and
    a claim of ``stale_seconds`` without a report is reclaimed when it does.
    Null keys, times or kinds and unknown kinds call for nothing.
    """
    rows = messages.where("object_key IS NOT NULL AND at IS NOT NULL AND kind IS NOT NULL").withWatermark("at", delay).selectExpr("object_key", "kind", "at", "unix_millis(at) AS at_ms")
    return rows.groupBy("object_key").transformWithStateInPandas(statefulProcessor=Claims(stale_seconds * 1000, most), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
