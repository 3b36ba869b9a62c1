"""Errors of pressure predictions, compliance, and the running-average baseline."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import SPAN, slot

ORDER = ["timestamp", "cycle_index"]


def bp_range_weight(sbp: str, dbp: str) -> Column:
    """3 for far, 2 for somewhat unusual pressures, else 1."""
    s, d = F.col(sbp), F.col(dbp)
    return F.when((d < 60) | (d > 90), 2.0).when((s < 70) | (s > 160), 3.0).when((s < 90) | (s > 140), 2.0).otherwise(1.0)


def regression_metrics(df: DataFrame, by: list[str] = []) -> DataFrame:
    """ME, population spread, MAE, RMSE and R2 of both targets over predictions, and the RMSE, MAE and R2 of both together."""
    aggs = []
    for t in ("sbp", "dbp"):
        e, y = F.col(f"{t}_pred") - F.col(f"{t}_true"), F.col(f"{t}_true")
        aggs += [F.avg(e).alias(f"{t}_me"), F.stddev_pop(e).alias(f"{t}_std"), F.avg(F.abs(e)).alias(f"{t}_mae"), F.sqrt(F.avg(e * e)).alias(f"{t}_rmse"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias(f"{t}_r2")]
    both = {"rmse": F.sqrt((F.pow("sbp_rmse", F.lit(2)) + F.pow("dbp_rmse", F.lit(2))) / 2), "mae": (F.col("sbp_mae") + F.col("dbp_mae")) / 2, "r2": (F.col("sbp_r2") + F.col("dbp_r2")) / 2}
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs).withColumns(both)


def aami_compliance(metrics: DataFrame) -> DataFrame:
    ok = F.lit(True)
    for t in ("sbp", "dbp"):
        ok = ok & (F.abs(f"{t}_me") <= 5) & (F.col(f"{t}_std") <= 8)
    return metrics.withColumn("aami_pass", F.coalesce(ok, F.lit(False)))


#: Pressures that a prediction should not leave, and the bounds of the pulse pressure.
RANGES, PULSE = {"sbp": (40.0, 250.0), "dbp": (20.0, 150.0)}, (10.0, 150.0)


def huber(e: Column, delta: float = 1.0) -> Column:
    """Half the square of small errors, and a line beyond."""
    return F.when(F.abs(e) <= delta, e * e / 2).otherwise(delta * (F.abs(e) - delta / 2))


def weighted_error(df: DataFrame, delta: float = 1.0) -> DataFrame:
    """Weighted squared error, Huber error, ME^2 + std^2, and the mean penalties for impossible predictions."""
    es, ed = F.col("sbp_pred") - F.col("sbp_true"), F.col("dbp_pred") - F.col("dbp_true")
    pulse, zero = F.col("sbp_pred") - F.col("dbp_pred"), F.lit(0.0)
    outside = sum((F.greatest(zero, F.lit(lo) - F.col(f"{t}_pred")) + F.greatest(zero, F.col(f"{t}_pred") - F.lit(hi)) for t, (lo, hi) in RANGES.items()), zero)
    return df.agg(
        F.avg(bp_range_weight("sbp_true", "dbp_true") * (es * es + ed * ed) / 2).alias("weighted_mse"), F.avg((huber(es, delta) + huber(ed, delta)) / 2).alias("huber"),
        (F.pow(F.avg(es), F.lit(2)) + F.var_samp(es) + F.pow(F.avg(ed), F.lit(2)) + F.var_samp(ed)).alias("aami_loss"),
        F.avg(F.greatest(zero, -pulse)).alias("order_penalty"), F.avg(F.greatest(zero, PULSE[0] - pulse) + F.greatest(zero, pulse - PULSE[1])).alias("pulse_penalty"), F.avg(outside).alias("range_penalty"))


_TARGETS = ("sbp", "dbp")
_PART = "patient_id int, slot bigint, alpha double, n bigint, " + ", ".join(f"{t}_head array<double>, {t}_first double, {t}_factor double, {t}_offset double" for t in _TARGETS)
_START = "patient_id int, slot bigint, alpha double, before bigint, sbp double, dbp double"
_EMA = "patient_id int, cycle_index int, alpha double, " + ", ".join(f"{t}_true double, {t}_pred double" for t in _TARGETS)


_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}


def _schema(text: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (c.split() for c in text.split(", "))])


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [(c, "ascending") for c in ORDER], null_placement="at_start"))


def _after(state: float | None, readings: list[float | None], alpha: float) -> float | None:
    """The average after some readings; without one so far, the first reading is the average."""
    for y in readings:
        if y is not None:
            state = y if state is None else alpha * y + (1 - alpha) * state
    return state


def _ema(rows: DataFrame, alphas: tuple[float, ...], warmup: int | None) -> DataFrame:
    """Predictions for rows (patient_id, slot, timestamp, cycle_index, sbp, dbp).

    The average is an affine recurrence. Each range of a patient gives its rows as a factor and an offset (and its first
    readings as they are, where a warm-up may end among them); these few numbers are carried along the patient; then each
    range runs over its rows from where the one before ended. Both passes read the same exchange of rows.
    """
    head = warmup or 0

    def parts(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        made = []
        for a in alphas:
            part = {"patient_id": table["patient_id"][0], "slot": table["slot"][0], "alpha": a, "n": table.num_rows}
            for t in _TARGETS:
                y = table[t].to_pylist()
                rest = [v for v in y[head:] if v is not None]
                part |= {f"{t}_head": y[:head], f"{t}_first": rest[0] if rest else None, f"{t}_factor": (1 - a) ** len(rest), f"{t}_offset": _after(0.0, rest, a)}
            made.append(part)
        return pa.Table.from_pylist(made, _schema(_PART))

    def carry(table: pa.Table) -> pa.Table:
        """Of one patient, for each alpha and range: the rows before it, and the average that its first prediction comes from."""
        ranges = table.sort_by("slot").to_pylist()
        return pa.Table.from_pylist([start for a in alphas for start in along([r for r in ranges if r["alpha"] == a])], _schema(_START))

    def along(ranges: list[dict]) -> list[dict]:
        before, state = 0, dict.fromkeys(_TARGETS)
        warm: dict[str, list[float]] = {t: [] for t in _TARGETS}
        made = []
        for r in ranges:
            m = min(max(head - before, 0), r["n"])  # rows of the warm-up
            for t in _TARGETS:
                warm[t] += [y for y in r[f"{t}_head"][:m] if y is not None]
                if before < head <= before + m:
                    state[t] = sum(warm[t]) / len(warm[t]) if warm[t] else None
            made.append({"patient_id": r["patient_id"], "slot": r["slot"], "alpha": r["alpha"], "before": before, **state})
            before += r["n"]
            for t in _TARGETS:
                if warmup is None or (before >= head and state[t] is not None):
                    state[t] = _after(state[t], r[f"{t}_head"][m:], r["alpha"])
                    if (first := r[f"{t}_first"]) is not None:
                        state[t] = r[f"{t}_factor"] * (first if state[t] is None else state[t]) + r[f"{t}_offset"]
        return made

    def run(table: pa.Table, starts: pa.Table) -> pa.Table:
        table = _in_order(table)
        made = []
        for start in starts.to_pylist():
            here = table.slice(min(max(head - start["before"], 0), table.num_rows))
            out = [here["patient_id"], here["cycle_index"], pa.array([start["alpha"]] * here.num_rows, pa.float64())]
            for t in _TARGETS:
                state, shown, a = start[t], [], start["alpha"]
                for v in here[t].to_pylist():
                    if state is None and warmup is None:
                        state = v  # the first reading predicts itself
                    shown.append(state)
                    if v is not None and state is not None:
                        state = a * v + (1 - a) * state
                out += [here[t], pa.array(shown, pa.float64())]
            made.append(pa.table(out, schema=_schema(_EMA)))
        return pa.concat_tables(made)

    starts = rows.groupBy("patient_id", "slot").applyInArrow(parts, _PART).groupBy("patient_id").applyInArrow(carry, _START)
    return rows.groupBy("patient_id", "slot").cogroup(starts.groupBy("patient_id", "slot")).applyInArrow(run, _EMA)


def _readings(df: DataFrame, span: float) -> DataFrame:
    return df.select(F.col("patient_id").cast("int").alias("patient_id"), slot(ORDER[0], span).alias("slot"), ORDER[0], F.col(ORDER[1]).cast("int").alias(ORDER[1]), *[F.col(f"{t}_reference").cast("double").alias(t) for t in _TARGETS])


def ema_baseline(df: DataFrame, alphas: tuple[float, ...] = (0.1,), span: float = SPAN) -> DataFrame:
    """Predictions by the running average of earlier beats, for each alpha. The first beat calibrates and predicts
    itself; a missing reading holds the average.

    patient_id, cycle_index, alpha, `<t>_true`, `<t>_pred`. No task holds more of a patient than a range of `span` seconds.
    """
    return _ema(_readings(df, span), alphas, None)


def ema_warmup(df: DataFrame, alpha: float = 0.1, warmup: int = 50, span: float = SPAN) -> DataFrame:
    """The variant that starts from the mean of the first `warmup` rows and predicts from the row after these on."""
    return _ema(_readings(df, span), (alpha,), warmup).drop("alpha")


def alpha_sweep(df: DataFrame, alphas: tuple[float, ...] = (0.05, 0.1, 0.2, 0.3)) -> DataFrame:
    """Share of patients within the standard, and mean error and spread, for each alpha."""
    each = aami_compliance(regression_metrics(ema_baseline(df, alphas).where("sbp_true IS NOT NULL AND dbp_true IS NOT NULL"), ["alpha", "patient_id"]))
    return each.groupBy("alpha").agg(F.count(F.lit(1)).alias("n_patients"), F.avg(F.col("aami_pass").cast("double")).alias("share_pass"), F.avg("sbp_me").alias("sbp_me"), F.avg("sbp_std").alias("sbp_std"), F.avg("dbp_std").alias("dbp_std"))
