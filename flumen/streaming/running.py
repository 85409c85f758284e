"""An extension: means and phase averages of samples that arrive as a stream.

Sums and counts are algebraic, so the state is one row for each group; late samples count as long as the query runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import StructType

from ..functions.validity import bin_of, finite, phase_of, valid_flags
from ..operators.stats import COMPONENTS
from ..sources.fields import VOXEL


def running_mean(stream: DataFrame, mode: str = "nan", mask: str = "component") -> DataFrame:
    """Mean and count of each component at each voxel so far (update or complete mode)."""
    ok = valid_flags(mode, mask)
    return stream.groupBy(*VOXEL).agg(*(F.avg(F.when(ok[c], F.col(c))).alias(f"{c}_mean") for c in COMPONENTS), *(F.count_if(ok[c]).alias(f"{c}_count") for c in COMPONENTS))


def running_phase_mean(stream: DataFrame, bins: int, frequency: float, offset: float = 0.0) -> DataFrame:
    phased = stream.withColumn("phase_bin", bin_of(phase_of(F.col("t"), frequency, offset), bins))
    ok = valid_flags()
    return phased.groupBy(*VOXEL, "phase_bin").agg(*(F.avg(F.when(ok[c], F.col(c))).alias(f"{c}_mean") for c in COMPONENTS))


def windowed(stream: DataFrame, time: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, deviation and count in tumbling windows of event time; a window closes when nothing later than `late` is
    awaited (append mode)."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Contiguous runs: rows of a key no further apart than the gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))


MOMENTS = "n long, mean double, m2 double"


def running_moments(stream: DataFrame, time: str, keys: list[str], value: str, late: str = "1 hour", hold: bool = False) -> DataFrame:
    """keys, n, mean, variance of all finite values so far, updated with every batch: the moments of a batch are merged
    with those kept for their key, so a group's state is three numbers however many rows it has seen. Rows older than the
    watermark (`late` behind the newest of earlier batches) are dropped by Spark. hold: a key's
    moments are told once, when the watermark passes all it has seen, and its state goes."""
    source = stream.withWatermark(time, late)
    ok = F.when(finite(F.col(value)), F.col(value).cast("double"))
    rows = source.select(*keys, F.col(time).alias("_time"), ok.alias("_value"))
    out = StructType([*(stream.schema[k] for k in keys), *StructType.fromDDL("n long, mean double, variance double").fields])

    class Merged(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.moments = handle.getValueState("moments", MOMENTS)
            self.seen = handle.getValueState("seen", "newest long")

        def _told(self, key: tuple) -> pd.DataFrame:
            n, mean, m2 = self.moments.get() if self.moments.exists() else (0, None, None)
            return pd.DataFrame([(*key, n, mean, m2 / n if n else None)], columns=out.names)

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            n, mean, m2 = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0)
            newest = self.seen.get()[0] if self.seen.exists() else -1
            for f in rows:
                at = f.iloc[:, -2].astype("datetime64[ms]").astype("int64").to_numpy()
                newest = max(newest, int(at.max()))
                x = f.iloc[:, -1].to_numpy(float)
                x = x[np.isfinite(x)]
                if len(x):
                    k, m = len(x), float(x.mean())
                    d = m - mean
                    mean, m2, n = mean + d * k / (n + k), m2 + float(((x - m) ** 2).sum()) + d * d * n * k / (n + k), n + k
            if n:
                self.moments.update((n, mean, m2))
            self.seen.update((newest,))
            if hold:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(newest + 1)
                return
            yield self._told(key)

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
            yield self._told(key)
            self.moments.clear()
            self.seen.clear()

        def close(self) -> None:
            pass

    return rows.groupBy(*keys).transformWithStateInPandas(Merged(), out, "Append" if hold else "Update", "EventTime")
