"""Searches as a stream: one running search a query, results that get better as tiers finish, and an end by timer.

What comes in are questions and the results of tiers. A search begins with its first question; further ones while it lives are
counted, not started again. Each tier that comes in gives a new version of the fused results, until all have come; a search
past its time is put out and begins anew with the next question.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a search lives, the tiers that make it whole, and the constant of reciprocal ranks.
TTL, TIERS, K = 1800, (1, 2, 3, 4), 60
#: What comes in: a question has no tier; a tier's results come as whole lists of documents in order.
INPUT = "hash string, at timestamp, tier int, docs array<long>"
OUTPUT = "hash string, event string, version int, status string, uses int, docs array<long>, ms long"


def status(tiers: set[int]) -> str:
    """What a search has reached."""
    return "AllDone" if tiers >= set(TIERS) else "AllMedium" if tiers >= {1, 2, 3} else "AllFast" if tiers >= {1, 2} else "Pending"


def fused(lists: dict[int, list[int]]) -> list[int]:
    """Documents by the sum of reciprocal ranks over the tiers, the best rank of each; equal ones by id."""
    score: dict[int, float] = {}
    for _, docs in sorted(lists.items()):
        for rank, d in enumerate(dict.fromkeys(docs), 1):
            score[d] = score.get(d, 0.0) + 1 / (K + rank + 1)
    return sorted(score, key=lambda d: (-round(score[d], 12), d))


class Searches(StatefulProcessor):
    """State of a query: when it began, how often it was asked for, its version; and the results of its tiers."""

    def __init__(self, ttl: int = TTL):
        self.ttl_ms = ttl * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.search = handle.getValueState("search", "began long, uses int, version int")
        self.lists = handle.getMapState("lists", "tier int", "docs array<long>")

    def _held(self) -> dict[int, list[int]]:
        return {k[0]: list(v[0]) for k, v in self.lists.iterator()}

    def _clear(self) -> None:
        self.search.clear()
        self.lists.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def _told(self, key: str, event: str, ms: int, now: tuple[int, int, int], docs: list[int]) -> Row:
        return Row(hash=key, event=event, version=now[2], status=status(set(self._held())), uses=now[1], docs=docs, ms=ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        for r in sorted(rows, key=lambda r: (r.ms, r.tier is not None, r.tier or 0)):
            ms = r.ms
            now = tuple(self.search.get()) if self.search.exists() else None
            if now and ms >= now[0] + self.ttl_ms:
                yield self._told(key[0], "expired", now[0] + self.ttl_ms, now, [])
                self._clear()
                now = None
            if r.tier is None:
                if now is None:
                    now = (ms, 1, 0)
                    self.handle.registerTimer(ms + self.ttl_ms)
                    yield self._told(key[0], "started", ms, now, [])
                else:
                    now = (now[0], now[1] + 1, now[2])
                self.search.update(now)
            elif now is not None and not self.lists.containsKey((r.tier,)):
                self.lists.updateValue((r.tier,), (list(r.docs or []),))
                now = (now[0], now[1], now[2] + 1)
                self.search.update(now)
                yield self._told(key[0], "refined", ms, now, fused(self._held()))
            # results of a search that nobody asks for any more, or of a tier that has come before, change nothing

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        if self.search.exists():
            now = tuple(self.search.get())
            if expiredTimerInfo.getExpiryTimeInMs() >= now[0] + self.ttl_ms:
                yield self._told(key[0], "expired", now[0] + self.ttl_ms, now, [])
                self._clear()

    def close(self) -> None:
        pass


#: The state store that timers and maps of state need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def tracked(stream: DataFrame, ttl: int = TTL, late: str = "1 minute") -> DataFrame:
    """A stream of INPUT rows to one of OUTPUT rows: started, refined and expired searches. Timers follow the time in the rows.

    A query's questions and results meet in one task, which holds its tiers' lists, whose lengths the tiers cap; the same results after
    a restart from the checkpoint.
    """
    stream.sparkSession.conf.set(*STORE)
    rows = stream.withWatermark("at", late).select("hash", "at", F.unix_millis("at").alias("ms"), "tier", "docs")
    told = rows.groupBy("hash").transformWithState(Searches(ttl), OUTPUT, "Append", "EventTime")
    return told.withColumn("at", F.timestamp_millis("ms")).drop("ms")
