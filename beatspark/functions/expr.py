"""Column helpers that every operator uses. Missing values are NULL throughout; NaN is turned into NULL on reading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over the rows where both are there; NULL where either is constant (`corr` would raise)."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def masked_corr(x: str | Column, y: str | Column, mask: Column, at_least: int = 0) -> Column:
    """`safe_corr` over the rows of a mask; NULL up to `at_least` rows."""
    r = safe_corr(F.when(mask, col(x)), F.when(mask, col(y)))
    return F.when(F.count_if(mask & col(x).isNotNull() & col(y).isNotNull()) > at_least, r)


def percent(condition: Column) -> Column:
    """Share of rows, in percent, where a condition holds; a NULL condition does not."""
    return F.try_divide(100.0 * F.count_if(condition), F.count(F.lit(1)))


def clip(x: str | Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), col(x)))


def nan_to_null(x: str | Column) -> Column:
    return F.nanvl(col(x), F.lit(None).cast("double"))


def half_even(x: str | Column, digits: int = 0) -> Column:
    """Rounds half to even, as the beat clock does."""
    return F.bround(col(x), digits)


def first_failed(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that is not kept; NULL where all are. A NULL condition is not kept."""
    return reduce(lambda later, rule: F.when(~F.coalesce(rule[1], F.lit(False)), F.lit(rule[0])).otherwise(later), reversed(rules), F.lit(None).cast("string"))


def reasons(rules: list[tuple[str, Column]]) -> Column:
    """All names whose condition holds, joined by a bar; empty where none does."""
    return F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in rules])


def ptt_column(df: DataFrame) -> str:
    """The pulse transit time to use: peak to foot, or what stands for it."""
    return "ptt_peak_to_foot" if "ptt_peak_to_foot" in df.columns else "pat_ecg_ppg"
