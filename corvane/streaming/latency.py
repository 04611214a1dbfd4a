"""Streaming forms of the latency summary and the gap check, as extensions of the batch operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_latency(stream: DataFrame, *, window: str = "10 minutes", delay: str = "30 minutes") -> DataFrame:
    """Attempts, successes and mean seconds for each window of event time and branch; rows later than the delay are left out."""
    ok = F.when(F.col("status") == "ok", F.col("seconds"))
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", window), "branch").agg(F.count("*").alias("attempts"), F.count(ok).alias("successes"), F.avg(ok).alias("mean"))


def stream_gaps(stream: DataFrame, tolerance_seconds: float) -> DataFrame:
    """(series, gaps, samples) after each batch: steps between a series' samples longer than the tolerance.

    The state of a series is its latest time and two counts, whatever it has seen.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, gaps, samples = state.get if state.exists else (None, 0, 0)
        times = pd.concat([f["epoch"] for f in frames]).sort_values().tolist()
        for now in times:
            gaps += last is not None and now - last > tolerance_seconds
            last, samples = now if last is None else max(last, now), samples + 1
        state.update((last, gaps, samples))
        yield pd.DataFrame({"series": [key[0]], "gaps": [gaps], "samples": [samples]})

    return stream.groupBy("series").applyInPandasWithState(update, "series bigint, gaps bigint, samples bigint", "last double, gaps bigint, samples bigint", "update", GroupStateTimeout.NoTimeout)
