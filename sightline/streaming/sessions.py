"""Merging of adjacent scenes on a stream: sessions that end by a gap or at their last allowed member.

Rows of a key wait in the state until the watermark has passed them, so they are taken in order of time whatever order they came
in; an event-time timer wakes the key for its next waiting row and for the end of its open session. What comes out is what
``intervals.merge_consecutive`` gives for the same rows as a table, but for rows that came behind the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STATE = "start_us long, end_us long, scene long, score double"


class CappedSessions(StatefulProcessor):
    """State of a key: rows that wait for the watermark, and the members of its open session (fewer than ``most``)."""

    def __init__(self, gap_us: int, least: int, most: int):
        self.gap_us, self.least, self.most = gap_us, least, most

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", STATE)
        self.open = handle.getListState("open", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new = [(r.start_us, r.end_us, r.scene, r.score) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # no row before it can still come
        waiting = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        members = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        ready, rest = [x for x in waiting if x[0] < passed], [x for x in waiting if x[0] >= passed]
        out = []
        for row in sorted(ready, key=lambda x: (x[0], x[2])):
            if members and not 0 <= row[0] - members[-1][1] <= self.gap_us:
                out += self._closed(key, members)
                members = []
            members.append(row)
            if len(members) == self.most:
                out += self._closed(key, members)
                members = []
        if members and members[-1][1] + self.gap_us < passed:
            out += self._closed(key, members)
            members = []
        if ready:
            self.waiting.put(rest) if rest else self.waiting.clear()
        self.open.put(members) if members else self.open.clear()
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        if members:
            self.handle.registerTimer((members[-1][1] + self.gap_us) // 1000 + 1)
        return iter(out)

    def _closed(self, key, members: list[tuple]) -> list[Row]:
        groups = [members] if len(members) >= self.least else [[m] for m in members]
        return [Row(key=key[0], start_us=g[0][0], end_us=g[-1][1], scenes="_".join(str(m[2]) for m in g), n=len(g), score=max(m[3] for m in g)) for g in groups]

    def close(self) -> None:
        pass


def capped_sessions(scenes: DataFrame, key: str, gap: float = 1.0, least: int = 2, most: int = 5, late: str = "10 minutes") -> DataFrame:
    """``key, start_us, end_us, scenes, n, score`` of a stream of scenes (key, scene, start and end as timestamps, score).

    Scenes of a key whose gap is 0 to ``gap`` seconds make one session of at most ``most``; groups of fewer than ``least``
    stay single. Rows more than ``late`` behind are dropped by the watermark; null keys are a key of their own, rows without
    a start or end are left out. Needs the RocksDB state store (``rocksdb``).
    """
    kind = scenes.schema[key].dataType.simpleString()
    rows = scenes.where("start IS NOT NULL AND end IS NOT NULL").withWatermark("start", late)
    rows = rows.select(F.col(key).alias("key"), "start", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), F.col("scene").cast("long").alias("scene"), F.col("score").cast("double").alias("score"))
    schema = f"key {kind}, start_us long, end_us long, scenes string, n long, score double"
    made = rows.groupBy("key").transformWithState(CappedSessions(round(gap * 1e6), least, most), schema, "Append", "EventTime")
    return made.withColumnRenamed("key", key)


def rocksdb(spark) -> None:
    """Sets the state store that ``transformWithState`` needs, for queries that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
