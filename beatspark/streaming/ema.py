"""The running-average estimator as a stream: one small state for each patient, which goes when the patient has gone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "patient_id int, event_id bigint, ts timestamp, sbp_pred double, dbp_pred double"
STATE = "sbp double, dbp double, last bigint"
#: A patient who sends nothing for so long is calibrated anew.
IDLE = "30 days"


class RunningAverage(StatefulProcessor):
    """Value state of both averages and the time of the last reading; an event-time timer lets go of idle patients.

    Whether a reading calibrates anew hangs on its own time and the last one's alone, so the answer does not hang on when
    a timer fires or where a micro-batch ends; a timer only removes state that the next reading would not use.
    """

    def __init__(self, alpha: float, idle_ms: int):
        self.alpha, self.idle_ms = alpha, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("average", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch's readings of one patient: in the order of their time, whatever frames they came in
        columns = ["ts", "event_id", "event_kind", "sbp", "dbp"]
        readings = sorted((r for pdf in rows for r in pdf[columns].itertuples(index=False, name=None)), key=lambda r: r[:2])
        sbp, dbp, last = self.state.get() if self.state.exists() else (None, None, None)
        averages, made = [sbp, dbp], []
        for ts, event_id, kind, *values in readings:
            now = ts.value // 1_000_000
            if last is not None and now - last >= self.idle_ms:
                averages = [None, None]
            last, shown = now, []
            for k, v in enumerate(None if pd.isna(v) else float(v) for v in values):
                if v is not None and (averages[k] is None or kind == "calibrate"):
                    averages[k] = v
                    shown.append(v)
                else:
                    shown.append(averages[k])
                    if v is not None:
                        averages[k] = self.alpha * v + (1 - self.alpha) * averages[k]
            made.append((key[0], event_id, ts, *shown))
        self.state.update((*averages, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(last + self.idle_ms)
        yield pd.DataFrame(made, columns=["patient_id", "event_id", "ts", "sbp_pred", "dbp_pred"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def ema_stream(readings: DataFrame, alpha: float = 0.1, delay: str = "10 minutes", idle: str = IDLE) -> DataFrame:
    """Predictions for a stream of readings (patient_id, ts, event_id, event_kind, sbp, dbp), each before its own value counts.

    The first value calibrates, a 'calibrate' event sets the average anew, and a missing value holds it; both pressures
    are apart. Rows are taken by event time inside a micro-batch; later ones than the watermark are dropped, and counted
    in the progress of the query.
    """
    spark = readings.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    timed = readings.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("patient_id").transformWithStateInPandas(RunningAverage(alpha, int(pd.Timedelta(idle).total_seconds() * 1000)), OUTPUT, "Append", "EventTime")


def late_rows(query) -> int:
    """Rows that came behind the watermark of a query (started, or ended) and were dropped."""
    return sum(int(s["numRowsDroppedByWatermark"]) for p in query.recentProgress for s in (p["stateOperators"] if isinstance(p, dict) else [{"numRowsDroppedByWatermark": o.numRowsDroppedByWatermark} for o in p.stateOperators]))
