"""Interval metrics of connections as keyed state (D1 without a batch job).

Per connection the state holds the times that the watermark hasn't passed yet, and of all earlier ones: the last time,
count, mean and M2 of the intervals (each new interval is merged into them) and the count per rounded second. Times are
taken over in order once the watermark has passed them, so events that come late but in time count as in a batch. A
connection that stays silent for ``silence`` seconds after its last event is given out with its final metrics, and its
state goes. The state of a connection grows with the watermark's delay and its different seconds, not with its events.

Spark's state is kept per bucket of connections, as a call and a state row for each of millions of connections cost far
more than their few events. A bucket's timer is that of its first connection to fall silent.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import detect

STATE = "connections binary"  # pickled: connection -> (state of its Intervals, its timer in ms)
METRICS = "intervals long, interval_avg double, interval_stddev double, entropy double, events long, cv double"


class Intervals:
    """Running metrics of the intervals between times that come in order."""

    def __init__(self, last: float | None = None, n: int = 0, mean: float = 0.0, m2: float = 0.0,
                 seconds: Sequence[float] = (), counts: Sequence[int] = (), waiting: Sequence[float] = ()) -> None:
        self.last, self.n, self.mean, self.m2 = last, n, mean, m2
        self.seconds, self.waiting = Counter(dict(zip(seconds, counts, strict=True))), list(waiting)

    def state(self) -> tuple:
        return (self.last, self.n, self.mean, self.m2, list(self.seconds), list(self.seconds.values()), self.waiting)

    def merge(self, n: int, mean: float, m2: float) -> None:
        """Add the moments of further intervals, pairwise."""
        total = self.n + n
        step = mean - self.mean
        self.m2 += m2 + step * step * self.n * n / total
        self.mean += step * n / total
        self.n = total

    def take(self, until: float) -> None:
        """Take over the waiting times up to ``until``, in order."""
        ready = sorted(t for t in self.waiting if t <= until)
        if not ready:
            return
        self.waiting = [t for t in self.waiting if t > until]
        times = ready if self.last is None else [self.last, *ready]
        self.last = float(ready[-1])
        if len(times) > 1:
            gaps = np.diff(times)
            self.merge(len(gaps), float(gaps.mean()), float(((gaps - gaps.mean()) ** 2).sum()))
            self.seconds.update(Counter(np.rint(gaps).tolist()))

    def metrics(self) -> tuple:
        deviation = math.sqrt(max(0.0, self.m2 / self.n)) if self.n else 0.0
        entropy = math.log2(self.n) - sum(k * math.log2(k) for k in self.seconds.values()) / self.n if self.n else 0.0
        return (self.n, self.mean, deviation, entropy, self.n + 1, deviation / self.mean if self.mean > 0 else 1.0)


def interval_stream(events: DataFrame, keys: Sequence[str] = detect.CONNECTION, min_events: int = 5, delay: str = "10 minutes", silence: float = 3600,
                    buckets: int = 4096) -> DataFrame:
    """The metrics of :func:`detect.interval_metrics` for each connection, when it has been silent for long enough.

    ``events`` is a stream with the epoch seconds ``t`` and the timestamp ``ts``. ``buckets`` should make some hundred to
    some ten thousand open connections a bucket.
    """
    kinds = dict(events.dtypes)
    columns = [*keys, *(x.split()[0] for x in METRICS.split(", "))]

    def follow(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = pickle.loads(state.get[0]) if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        passed = watermark / 1000
        heard: dict[tuple, list[float]] = {}
        if not state.hasTimedOut:
            for frame in frames:
                for *who, t in zip(*(frame[k].tolist() for k in (*keys, "t")), strict=True):
                    heard.setdefault(tuple(who), []).append(t)
        due = [who for who, (_values, timer) in known.items() if timer < watermark and who not in heard]
        finished = []
        for who in (*heard, *due):
            own = Intervals(*known[who][0]) if who in known else Intervals()
            own.waiting.extend(heard.get(who, ()))
            own.take(passed)
            newest = max(own.waiting, default=own.last)
            if who not in heard and newest + silence <= passed:
                del known[who]
                if own.n + 1 >= min_events:
                    finished.append((*who, *own.metrics()))
            else:
                known[who] = (own.state(), int(max(newest + silence, passed) * 1000) + 1)
        if finished:
            yield pd.DataFrame(finished, columns=columns)
        if known:
            state.update((pickle.dumps(known),))
            state.setTimeoutTimestamp(min(timer for _values, timer in known.values()))
        else:
            state.remove()

    # Keys travel as text, so that a missing number stays missing and a long one exact.
    known = events.filter(F.col("si").isNotNull() & F.col("di").isNotNull()).withWatermark("ts", delay)
    bucketed = known.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), *[F.col(k).cast("string").alias(k) for k in keys], "t", "ts")
    shape = ", ".join(f"{k} string" for k in keys) + f", {METRICS}"
    found = bucketed.groupBy("_bucket").applyInPandasWithState(follow, shape, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({k: F.col(k).cast(kinds[k]) for k in keys})


def beacon_stream(events: DataFrame, keys: Sequence[str] = detect.CONNECTION, min_events: int = 5, delay: str = "10 minutes", silence: float = 3600, **thresholds: float) -> DataFrame:
    """Periodic connections as they fall silent."""
    return detect.beaconing(events, keys, min_events, metrics=interval_stream(events, keys, min_events, delay, silence), **thresholds)
