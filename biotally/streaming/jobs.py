"""Streaming forms of the counting, plate and exposure jobs."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from biotally.session import checkpoint_folder


def event_stream(spark: SparkSession, path: str, schema: str = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string") -> DataFrame:
    """Arriving event files as a stream with a session-time timestamp."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def outbreak_stream(isolates: DataFrame, window: str = "7 days", delay: str = "1 day") -> DataFrame:
    """Isolates and resistance hits per cluster and tumbling window; rows later than the delay are dropped.

    ``isolates`` holds (cluster, ts, hits).
    """
    return (
        isolates.withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "cluster")
        .agg(F.count("*").alias("isolates"), F.count_if(F.col("hits") > 0).alias("with_hits"), F.sum("hits").alias("hits"))
        .select("cluster", F.col("window.start").alias("start"), "isolates", "with_hits", "hits")
    )


def plate_stream(wells: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Running mean and SD of the negative controls per plate and day."""
    return (
        wells.filter("control = 'neg'")
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", window), "plate")
        .agg(F.count("*").alias("wells"), F.avg("od").alias("mean_neg"), F.coalesce(F.stddev_samp("od"), F.lit(0.0)).alias("sd_neg"))
        .select("plate", F.col("window.start").alias("start"), "wells", "mean_neg", "sd_neg")
    )


class _Exposure(StatefulProcessor):
    """Rows of a subject wait until the watermark has passed them, then count in order of time.

    Waiting rows lie in the state store in pieces of at most ``PIECE`` rows, each sorted by time, under their first
    millisecond and a running number. A subject has a timer for its first waiting millisecond; when it fires, all that the
    watermark has passed is taken from the pieces that have begun, and the rest of these waits on. So state is called a few
    times a subject and trigger, not for every row. What has been counted is (time, amount) only.
    """

    PIECE = 512

    def __init__(self, rate: float, idle_ms: int) -> None:
        self.rate, self.idle_ms = rate, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.body = handle.getValueState("body", "last double, amount double, seen_ms long, idle_ms long")
        self.pieces = handle.getValueState("pieces", "next long, passed_ms long")
        self.waiting = handle.getMapState("waiting", "ms long, no long", "ms array<long>, t array<double>, dose array<double>, is_sample array<boolean>, event_id array<long>")

    def _wait(self, rows: list[tuple], number: int) -> int:
        """Store (ms, t, dose, is_sample, event_id) rows in pieces; returns the next free number."""
        for k in range(0, len(rows), self.PIECE):
            piece = rows[k : k + self.PIECE]
            self.waiting.updateValue((piece[0][0], number), tuple(list(c) for c in zip(*piece, strict=True)))
            number += 1
        return number

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        number, passed = self.pieces.get() if self.pieces.exists() else (0, None)
        first = None
        for batch in rows:
            ms = (batch["ts"].astype("datetime64[us]").astype("int64") // 1000).tolist()
            new = sorted(zip(ms, *(batch[c].tolist() for c in ("t", "dose", "is_sample", "event_id")), strict=True), key=lambda x: x[0])
            if new:
                number = self._wait(new, number)
                first = new[0][0] if first is None else min(first, new[0][0])
        if first is not None:
            # A row may come at a millisecond that was passed only in part: what was passed is looked at again.
            self.pieces.update((number, None))
            self.handle.registerTimer(first)
        return iter(())

    def _passed(self, watermark: int) -> list[tuple]:
        """The waiting rows up to the watermark, taken out of their pieces; a timer is set for the first of the others."""
        number, passed = self.pieces.get() if self.pieces.exists() else (0, None)
        if passed is not None and passed >= watermark:
            return []
        ready, rest, later = [], [], []
        for at, no in list(self.waiting.keys()):
            if at > watermark:
                later.append(at)
                continue
            for row in zip(*self.waiting.getValue((at, no)), strict=True):
                (ready if row[0] <= watermark else rest).append(row)
            self.waiting.removeKey((at, no))
        rest.sort(key=lambda x: x[0])
        later += [row[0] for row in rest[:1]]
        self.pieces.update((self._wait(rest, number), watermark))
        if later:
            self.handle.registerTimer(min(later))
        return ready

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        known = created = self.body.exists()
        last, amount, seen, idle = self.body.get() if known else (0.0, 0.0, 0, 0)
        out = []
        ready = self._passed(watermark)
        for at, now, sampled, event, given in sorted((ms, t, sampled, event, dose) for ms, t, dose, sampled, event in ready):
            amount = (amount * math.exp(-self.rate * (now - last)) if known else 0.0) + given
            last, known, seen = now, True, at
            if sampled:
                out.append((key[0], event, now, amount))
        due = known and created and expiredTimerInfo.getExpiryTimeInMs() >= idle
        if due and watermark >= seen + self.idle_ms:
            self.body.clear()
            if next(iter(self.waiting.keys()), None) is None:
                self.pieces.clear()
        elif known and (ready or due):
            if due or not created:
                idle = seen + self.idle_ms
                self.handle.registerTimer(idle)
            self.body.update((last, amount, seen, idle))
        if not out:
            return iter(())
        return iter([pd.DataFrame(out, columns=["subject", "sample_id", "t", "amount"]).astype({"subject": "int64", "sample_id": "int64", "t": "float64", "amount": "float64"})])

    def close(self) -> None:
        pass


def exposure_stream(log: DataFrame, rate: float, delay: str = "1 day", idle_hours: float = 24.0 * 30) -> DataFrame:
    """Body amount of each subject at its sampling times, in order of time whatever the order of arrival.

    ``log`` holds (subject, ts, t, event_id, dose, is_sample), t in hours along with ts. A row waits in keyed state until
    the watermark, ``delay`` behind the latest row, has passed it; a row later than that is dropped, and counted in the
    query's ``numRowsDroppedByWatermark``. Samples of the last ``delay`` are still waiting when a stream stops. The state of
    a subject without rows for ``idle_hours`` of event time is dropped. Sets the session's state store to RocksDB, which
    keeps waiting rows on disk.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return (
        log.withWatermark("ts", delay)
        .groupBy("subject")
        .transformWithStateInPandas(_Exposure(rate, int(idle_hours * 3600 * 1000)), "subject bigint, sample_id bigint, t double, amount double", "append", "EventTime")
    )


def run_available(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Run a stream over the files present and return what it wrote.

    Each trigger writes its own folder (rewritten if the trigger is repeated), in the shared checkpoint folder; in
    update mode the latest row of each key counts.
    """
    spark = stream.sparkSession
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{base}/out/trigger={batch_id}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    out = spark.read.schema(f"{names}, batch int").parquet(f"{base}/out/*")
    if mode == "update":
        newest = Window.partitionBy(*keys).orderBy(F.desc("batch"))
        out = out.withColumn("r", F.row_number().over(newest)).filter("r = 1").drop("r")
    return out.drop("batch")
