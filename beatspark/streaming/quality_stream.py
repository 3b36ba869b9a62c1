"""Beat rules on arriving beats: what each row is worth can be told from the row alone, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.cleaning import Thresholds, first_failed_rule
from ..operators.physiology import valid_beat


def judged(beats: DataFrame, strict: bool = True, limits: Thresholds = Thresholds()) -> DataFrame:
    """Beats, batch or stream, with `valid` (physiological bounds) and `first_failed_rule` (cleaning; NULL where all are kept)."""
    return first_failed_rule(beats, strict, limits).withColumn("valid", valid_beat())


def valid_beats(beats: DataFrame, strict: bool = True) -> DataFrame:
    """The beats of a stream that pass both."""
    return judged(beats, strict).where("valid AND first_failed_rule IS NULL").drop("valid", "first_failed_rule")
