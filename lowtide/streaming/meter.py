"""Live level meter."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that timers and typed state need.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def instant(ts: Column) -> Column:
    """The instant at which a clock at UTC shows a time without a zone, in a session of any zone."""
    minutes = F.unix_date(F.to_date(ts)).cast("long") * 1440 + F.hour(ts) * 60 + F.minute(ts)
    return F.timestamp_micros(minutes * 60_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long"))


def clock(ts: Column) -> Column:
    """The time without a zone that a clock at UTC shows at an instant."""
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.unix_micros(ts).cast("decimal(18,0)") / 1_000_000)


def window_levels(events: DataFrame, width: str = "1 second", keys: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """Peak and RMS per signal and tumbling window of (keys..., ts, v); the level of
    silence is minus infinity. The same aggregation serves batch and stream; keys and window are pre-aggregated before
    the shuffle, so a busy signal costs one row per task and window. Windows have the type of ``ts``: times without a zone
    are cut as their clock shows them, in any session. Rows without a time share a window without times; a stream
    drops them."""
    w = F.window("ts", width)
    if not events.isStreaming:  # Spark leaves out what has no time to be cut by
        any_time = F.lit("1970-01-01").cast(events.schema["ts"].dataType)
        w = F.when(F.col("ts").isNotNull(), F.window(F.coalesce("ts", any_time), width))
    grouped = events.groupBy(w.alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("_top"), F.avg(F.col("v") * F.col("v")).alias("_power")
    )
    db = lambda c, times: F.when(F.col(c) == 0.0, float("-inf")).otherwise(times * F.log10(c))
    return grouped.select(
        *keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n",
        db("_top", 20.0).alias("peak_db"), db("_power", 10.0).alias("rms_db"),
    )


def live_levels(stream: DataFrame, width: str = "1 second", late: str = "10 seconds", keys: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """Streaming form: a window is sent once the watermark passes its end; samples
    later than the watermark are dropped."""
    return window_levels(stream.withWatermark("ts", late), width, keys)


def run_to_table(levels: DataFrame, table: str, checkpoint: str) -> None:
    """Append all available windows to a parquet table and stop."""
    query = (
        levels.writeStream.outputMode("append").format("parquet").option("path", table)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()


LOUDEST = "start timestamp, end timestamp, n long, peak_db double, rms_db double, loudest_db double"


def with_loudest(levels: DataFrame, keys: tuple[str, ...] = ("signal_id",)) -> DataFrame:
    """Window levels with ``loudest_db``, the greatest rms of the windows up to each: the batch form of ``loudest_windows``."""
    w = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, 0)  # windows, not samples
    return levels.withColumn("loudest_db", F.max("rms_db").over(w))


class _Meter(StatefulProcessor):
    """Of each signal: the windows still open (start, count, count of values, peak, energy), the loudest closed one and the
    end of the last. A window of rows without values has no level.

    All of it is one value, read and written once for each batch that has rows of the signal or closes windows of it. One
    timer, at the end of the first open window, sends all that the watermark has passed; one ``idle`` after the last
    window forgets the signal. So the state is a few numbers for each window that may still change, and nothing for
    silent signals.
    """

    def __init__(self, width_ms: int, idle_ms: int):
        self.width, self.idle = width_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "best double, last long, start array<long>, n array<long>, known array<long>, top array<double>, e array<double>")

    def _read(self):
        kept = self.kept.get()
        return (None, 0, {}) if kept is None else (kept[0], kept[1], {s: rest for s, *rest in zip(*kept[2:])})

    def _write(self, best, last, windows) -> None:
        starts = sorted(windows)
        self.kept.update((best, last, starts, *([windows[s][k] for s in starts] for k in range(4))))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs()
        best, last, windows = self._read()
        first = min(windows, default=None)
        for frame in rows:
            ms, v, known = frame["ms"].to_numpy(), frame["v"].to_numpy(float), frame["known"].to_numpy(bool)
            fresh = ms - ms % self.width + self.width > late  # the others were sent already
            start, at = np.unique((ms - ms % self.width)[fresh], return_inverse=True)
            v, known = np.where(known, v, 0.0)[fresh], known[fresh]
            count, energy, peak = np.bincount(at, minlength=len(start)), np.bincount(at, v * v, len(start)), np.zeros(len(start))
            np.maximum.at(peak, at, np.abs(v))
            for s, n, m, top, e in zip(start.tolist(), count.tolist(), np.bincount(at, known, len(start)).tolist(), peak.tolist(), energy.tolist()):
                before = windows.get(s, (0, 0, 0.0, 0.0))
                windows[s] = (n + before[0], int(m) + before[1], float(np.maximum(top, before[2])), e + before[3])
        if windows:
            if min(windows) != first:
                self.handle.registerTimer(min(windows) + self.width)
            self._write(best, last, windows)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        best, last, windows = self._read()
        closed = sorted(s for s in windows if s + self.width <= now)
        db = lambda x: -math.inf if x == 0 else 10.0 * math.log10(x)
        out = []
        for s in closed:
            n, known, top, e = windows.pop(s)
            peak, rms = (2 * db(top), db(e / known)) if known else (None, None)
            best, last = rms if best is None else best if rms is None else float(np.maximum(best, rms)), s + self.width
            out.append((*key, s, n, peak, rms, best, known > 0, best is not None))
        if windows:
            if closed:
                self.handle.registerTimer(min(windows) + self.width)
                self._write(best, last, windows)
        elif last + self.idle <= now:
            self.kept.clear()
        elif closed:
            self.handle.registerTimer(last + self.idle)
            self._write(best, last, windows)
        if out:
            yield pd.DataFrame(out, columns=["signal_id", "start", "n", "peak_db", "rms_db", "loudest_db", "known", "heard"], dtype=object)

    def close(self) -> None:
        pass


def loudest_windows(stream: DataFrame, width: str = "1 second", late: str = "10 seconds", idle: str = "1 day") -> DataFrame:
    """Level windows of a stream (signal_id, ts, v) with the loudest rms that the signal has had so far.

    Windows are sent as in ``live_levels``; ``loudest_db`` is kept in state from window to window, and begins anew for a
    signal of which nothing has come for ``idle``. The session needs the RocksDB state store.
    """
    spark = stream.sparkSession
    ms = [spark.sql(f"SELECT unix_millis(timestamp'1970-01-01 00:00:00Z' + interval '{d}') AS ms").first().ms for d in (width, idle)]
    marked = stream.where("ts IS NOT NULL").select("signal_id", "ts", F.unix_millis("ts").alias("ms"), "v", F.col("v").isNotNull().alias("known")).withWatermark("ts", late)
    sent = marked.groupBy("signal_id").transformWithStateInPandas(
        _Meter(*ms), outputStructType="signal_id string, start long, n long, peak_db double, rms_db double, loudest_db double, known boolean, heard boolean",
        outputMode="Append", timeMode="EventTime",
    )
    at = lambda more: F.timestamp_millis(F.col("start") + more)
    db = lambda c, there: F.when(F.col(there), F.coalesce(c, F.lit(math.nan))).alias(c)  # pandas has no NaN beside null
    return sent.select(
        "signal_id", at(0).alias("start"), at(ms[0]).alias("end"), "n", db("peak_db", "known"), db("rms_db", "known"), db("loudest_db", "heard")
    )
