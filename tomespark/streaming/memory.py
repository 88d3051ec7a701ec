"""State of streams that no aggregation holds: history with tombstones, what was shown lately, and the memo of a day.

These need the state store provider that keeps state on disk; STATE_STORE is the
setting and its value. Rows may come in any order, and again after a failure: the
state changes with a batch's commit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

DAY = 86_400_000_000  # in microseconds
#: How long, and how many, shown things are remembered.
RING, AGE = 300, 30 * DAY

_HISTORY = "target string, first long, last long, opens long, title string, kind string"


class _History(StatefulProcessor):
    """Of one target: visits by their place in the log, what was folded of old ones, and the last tombstone."""

    def __init__(self, horizon: int) -> None:
        self.horizon = horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.visits = handle.getMapState("visits", "pos long", "at long, title string, kind string")
        self.folded = handle.getValueState("folded", "first long, last long, opens long, title string, kind string, latest long, pos long")
        self.gone = handle.getValueState("gone", "pos long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        gone = self.gone.get()[0] if self.gone.exists() else -1
        before = gone
        for batch in rows:
            for pos, at, title, kind, forget in batch[["pos", "at", "title", "kind", "forget"]].itertuples(index=False):
                if forget:
                    gone = max(gone, int(pos))
                elif pos > gone and not (self.folded.exists() and pos <= self.folded.get()[6]):
                    self.visits.updateValue((int(pos),), (int(at), None if pd.isna(title) else title, None if pd.isna(kind) else kind))
        if gone > before:
            self.gone.update((gone,))
            for (pos,) in [k for k in self.visits.keys() if k[0] <= gone]:
                self.visits.removeKey((pos,))
            if self.folded.exists() and self.folded.get()[6] <= gone:
                self.folded.clear()
        held = sorted((at, pos, title, kind) for (pos,), (at, title, kind) in self.visits.iterator())
        folded = self.folded.get() if self.folded.exists() else None
        old = [v for v in held if v[0] < held[-1][0] - self.horizon]
        if old:
            folded = self._with(folded, old)
            self.folded.update(folded)
            for _, pos, _, _ in old:
                self.visits.removeKey((pos,))
        whole = self._with(folded, held[len(old) :])
        # A target without a visit left is said once more, with no opens.
        row = (key[0], *whole[:5]) if whole else (key[0], None, None, 0, None, None)
        yield pd.DataFrame([row], columns=["target", "first", "last", "opens", "title", "kind"])

    @staticmethod
    def _with(folded: tuple | None, visits: list[tuple]) -> tuple | None:
        if not visits:
            return folded
        at, pos, title, kind = visits[-1]
        first, opens, top = visits[0][0], len(visits), max(v[1] for v in visits)
        if folded is None:
            return first, at, opens, title, kind, pos, top
        if (folded[1], folded[5]) > (at, pos):
            at, pos, title, kind = folded[1], folded[5], folded[3], folded[4]
        return min(first, folded[0]), at, opens + folded[2], title, kind, pos, max(top, folded[6])


def running_history(visits: DataFrame, horizon_days: int = 30) -> DataFrame:
    """(target, first, last, opens, title, kind) of each target that changed, in update mode.

    ``visits`` (target, pos, seen_at, title, kind, forget) may be shuffled. A
    tombstone wipes the visits of its target with smaller pos, come before or
    after it. Visits more than the horizon before a target's latest one are
    folded into one row, so state is bounded by the visits of a horizon; later
    tombstones wipe the folded ones all together or, if they are newer than the
    tombstone in part, not at all, and late visits with a pos below theirs are
    not counted again.
    """
    held = visits.where("target IS NOT NULL").select("target", "pos", F.unix_micros("seen_at").alias("at"), "title", "kind", F.coalesce("forget", F.lit(False)).alias("forget"))
    out = held.groupBy("target").transformWithStateInPandas(statefulProcessor=_History(horizon_days * DAY), outputStructType=_HISTORY, outputMode="Update", timeMode="None")
    return out.withColumns({"first": F.timestamp_micros("first"), "last": F.timestamp_micros("last")})


_DRAWS = "user string, target string, at long, fresh boolean"


class _Shown(StatefulProcessor):
    """Of one user: the last things shown, newest last; forgotten when the newest is past its age."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "target string, at long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        ring = [tuple(x) for x in self.ring.get()] if self.ring.exists() else []
        asked = sorted((int(at), target) for batch in rows for target, at in batch[["target", "at"]].itertuples(index=False))
        out = []
        for at, target in asked:
            ring = [x for x in ring if x[1] > at - AGE]
            fresh = all(t != target for t, _ in ring)
            if fresh:
                ring = [*ring, (target, at)][-RING:]
            out.append((key[0], target, at, fresh))
        self.ring.put(ring)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ring:
            self.handle.registerTimer((max(at for _, at in ring) + AGE) // 1000)
        yield pd.DataFrame(out, columns=["user", "target", "at", "fresh"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.ring.clear()
        yield pd.DataFrame([], columns=["user", "target", "at", "fresh"])


def shown_lately(draws: DataFrame, late: str = "1 hour") -> DataFrame:
    """(user, target, seen_at, fresh): whether each draw (user, target, seen_at) is new to its user, and remembered from then on.

    A thing is new when it is not among the last RING that were new, and was not
    new within AGE. Of each batch, draws are taken in the order of their times.
    """
    held = draws.withWatermark("seen_at", late).select("user", "target", "seen_at", F.unix_micros("seen_at").alias("at"))
    out = held.groupBy("user").transformWithStateInPandas(statefulProcessor=_Shown(), outputStructType=_DRAWS, outputMode="Append", timeMode="EventTime")
    return out.withColumn("seen_at", F.timestamp_micros("at")).drop("at")


class _Memo(StatefulProcessor):
    """Of one key and day: the value that was asked for first."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("value", "at long, value string")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        asked = sorted((int(at), value) for batch in rows for at, value in batch[["at", "value"]].itertuples(index=False))
        if not self.value.exists():
            self.value.update(asked[0])
            self.handle.registerTimer((asked[0][0] // DAY + 2) * DAY // 1000)
        memo = self.value.get()[1]
        yield pd.DataFrame([(key[0], at, memo) for at, _ in asked], columns=["key", "at", "value"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        self.value.clear()
        yield pd.DataFrame([], columns=["key", "at", "value"])


def once_a_day(asks: DataFrame, late: str = "1 hour") -> DataFrame:
    """(key, seen_at, value): every ask (key, seen_at, value) of a day is answered with the first value of that day, which is kept until the next is over."""
    held = asks.withWatermark("seen_at", late).select("key", F.to_date("seen_at").alias("day"), "seen_at", F.unix_micros("seen_at").alias("at"), "value")
    out = held.groupBy("key", "day").transformWithStateInPandas(statefulProcessor=_Memo(), outputStructType="key string, at long, value string", outputMode="Append", timeMode="EventTime")
    return out.select("key", F.timestamp_micros("at").alias("seen_at"), "value")
