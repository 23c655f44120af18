"""Answers that arrive in any order, with state: the latest of each (sample, condition) wins.

State is keyed by condition and bucket of samples, so a condition holding most of the rows is
spread over its buckets.  Per key a map holds the newest arrival of each sample; a newer one
replaces it and is passed on, an older one (late, out of order, or a repeat) is not.  Two more kinds
of rows tell of the key itself: ``complete`` once every expected sample of the bucket has an
answer, and, with ``idle_s``, ``stalled`` if nothing came for so many seconds before that (a
timer).  A query with timers runs until it is stopped, also under ``availableNow``.

Needs a state store with several columns: set ``spark.sql.streaming.stateStore.providerClass`` to
Spark's RocksDB provider (:data:`ROCKSDB`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scorebook._ship import ship
from scorebook.operators.inference import bucket_of

ship(__name__)

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = "model_name string, prompt_id string, bucket int, event string, sample_id string, " \
         "predicted_label string, arrived timestamp, n_samples long, n_expected long"


class LatestAnswers(StatefulProcessor):
    """``expected``: number of samples by bucket."""

    def __init__(self, expected: dict[int, int], idle_s: float | None) -> None:
        self.expected, self.idle_ms = expected, None if idle_s is None else int(idle_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getMapState("newest", "sample_id string", "arrived long, digest string")
        self.count = handle.getValueState("count", "n long, done boolean")
        self.timer = handle.getValueState("timer", "at long")

    def _event(self, key, event: str, rows: list, n: int) -> pd.DataFrame:
        model, prompt, bucket = key
        return pd.DataFrame([(model, prompt, int(bucket), event, s, p, a, n, self.expected.get(int(bucket), 0))
                             for s, p, a in rows], columns=[f.split()[0] for f in EVENTS.split(", ")])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, done = self.count.get() if self.count.exists() else (0, False)
        best: dict[str, tuple] = {}
        for pdf in rows:        # of one batch the newest per sample; equal times by the answer itself
            for s, p, a in zip(pdf["sample_id"], pdf["predicted_label"], pdf["arrived"]):
                rank = (a.value, "" if p is None else p)
                if s is not None and (s not in best or rank > best[s][0]):
                    best[s] = (rank, p, a)
        fresh = []
        for s, (rank, p, a) in best.items():
            if self.newest.containsKey((s,)):
                if rank <= tuple(self.newest.getValue((s,))):
                    continue
            else:
                n += 1
            self.newest.updateValue((s,), rank)
            fresh.append((s, p, a))
        if fresh:
            yield self._event(key, "answer", fresh, n)
        if not done and n >= self.expected.get(int(key[2]), 0):
            done = True
            yield self._event(key, "complete", [(None, None, None)], n)
        self.count.update((n, done))
        if self.idle_ms is None:
            return
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if not done:
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.timer.clear()
        n, done = self.count.get() if self.count.exists() else (0, False)
        if not done:
            yield self._event(key, "stalled", [(None, None, None)], n)

    def close(self) -> None:
        pass


def expected_by_bucket(samples: DataFrame, buckets: int, id_col: str = "sample_id") -> dict[int, int]:
    """Samples per bucket: one row per bucket is collected."""
    per = samples.select(bucket_of(id_col, buckets).alias("b")).groupBy("b").count().collect()
    return {r["b"]: r["count"] for r in per}


def latest_answers(stream: DataFrame, expected: dict[int, int], buckets: int, idle_s: float | None = None,
                   arrived: str = "arrived") -> DataFrame:
    """Events of a stream of results: ``answer`` rows (each newer than those before it for the same
    sample and condition), ``complete`` and ``stalled`` rows per condition and bucket."""
    keyed = stream.filter("model_name IS NOT NULL AND prompt_id IS NOT NULL AND sample_id IS NOT NULL").select(
        "model_name", "prompt_id", bucket_of("sample_id", buckets).alias("bucket"), "sample_id", "predicted_label",
        F.col(arrived).alias("arrived"))
    return keyed.groupBy("model_name", "prompt_id", "bucket").transformWithStateInPandas(
        statefulProcessor=LatestAnswers(expected, idle_s), outputStructType=EVENTS, outputMode="Update",
        timeMode="None" if idle_s is None else "ProcessingTime")


def current_answers(events: DataFrame, key: Sequence[str] = ("model_name", "prompt_id", "sample_id")) -> DataFrame:
    """The table that the events amount to: the newest ``answer`` per key."""
    from scorebook.sources.results import dedupe_results
    rows = events.filter("event = 'answer'").select(*key, "predicted_label", "arrived")
    return dedupe_results(rows, key, order_by=["arrived"])
