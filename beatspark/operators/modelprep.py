"""Model input: fills, category codes, patient splits, scaling and sliding sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import BLOCK, SPAN, blocks, in_block, ranked
from .quantiles import numbered

def fill_static(df: DataFrame, numbers: list[str], texts: list[str]) -> DataFrame:
    """Numbers by their mean, texts by 'Unknown'."""
    means = df.agg(*[F.avg(c).alias(f"__{c}") for c in numbers])
    wide = df.join(F.broadcast(means), F.lit(True))
    return wide.withColumns({c: F.coalesce(F.col(c), F.col(f"__{c}")) for c in numbers} | {c: F.coalesce(F.col(c), F.lit("Unknown")) for c in texts}).drop(*[f"__{c}" for c in numbers])


def top_k_categories(df: DataFrame, column: str, k: int = 50) -> DataFrame:
    """Values beyond the k most frequent become 'Other'."""
    top = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).where(F.col(column).isNotNull()).orderBy(F.desc("__n"), column).limit(k).select(column, F.lit(True).alias("__kept"))
    return df.join(F.broadcast(top), column, "left").withColumn(column, F.when(F.col("__kept"), F.col(column)).otherwise("Other")).drop("__kept")


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """`<column>_code`: the place of a value among all values in order, from 0; NULL where the value is missing."""
    codes = numbered(df.select(column).where(F.col(column).isNotNull()).distinct(), F.col(column)).select(F.col(column).alias("__value"), (F.col("k") - 1).alias(f"{column}_code"))
    return df.join(codes, F.col(column) == F.col("__value"), "left").drop("__value")


def category_codes(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """A dictionary (value, code) of a column, missing values as 'Unknown' and those beyond the k most frequent as 'Other'."""
    value = F.coalesce(F.col(column), F.lit("Unknown")).alias("value")
    counts = df.select(value).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    if k is None:
        kept = counts.select("value", F.col("value").alias("name"))
    else:
        top = counts.orderBy(F.desc("n"), "value").limit(k).select("value", F.col("value").alias("name"))
        kept = counts.select("value").join(F.broadcast(top), "value", "left").select("value", F.coalesce("name", F.lit("Other")).alias("name"))
    codes = numbered(kept.select("name").distinct(), F.col("name"))
    return kept.join(codes, "name").select("value", (F.col("k") - 1).alias("code"))


def _shuffled(df: DataFrame, seed: int) -> DataFrame:
    """patient_id and k, each patient's number in the order of a hash. The hash is spread evenly, and so is the work."""
    ids = df.select("patient_id").where("patient_id IS NOT NULL").distinct()
    return numbered(ids, F.concat(F.md5(F.concat_ws("|", F.lit(seed), "patient_id")), F.lit("|"), F.col("patient_id")))


def patient_split(df: DataFrame, seed: int = 42) -> DataFrame:
    """patient_id and part: 80 % development (of that 90 % train, 10 % val) and 20 % test, by hash order."""
    ranked = _shuffled(df, seed)
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    dev = F.floor(F.col("n") * 0.8)
    return ranked.join(F.broadcast(total), F.lit(True)).select("patient_id", F.when(F.col("k") <= F.floor(dev * 0.9), "train").when(F.col("k") <= dev, "val").otherwise("test").alias("part"))


def split_members(df: DataFrame, split: DataFrame, part: str) -> DataFrame:
    """Rows of the patients of one part."""
    return df.join(split.where(F.col("part") == part).select("patient_id"), "patient_id", "left_semi")


def group_kfold(df: DataFrame, folds: int = 5, seed: int = 42) -> DataFrame:
    return _shuffled(df, seed).select("patient_id", F.pmod("k", F.lit(folds)).cast("int").alias("fold"))


def fit_scaler(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean (__m) and population spread (__s) of each column of the rows to fit on."""
    return rows.agg(*[F.avg(c).alias(f"__m{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s{c}") for c in columns])


def scale(rows: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    made = {c: (F.col(c) - F.col(f"__m{c}")) / (F.col(f"__s{c}") + 1e-7) for c in columns}
    return rows.join(F.broadcast(fit), F.lit(True)).withColumns(made).drop(*fit.columns)


def unscale(rows: DataFrame, fit: DataFrame, columns: list[str]) -> DataFrame:
    """The values that `scale` was given."""
    made = {c: F.col(c) * (F.col(f"__s{c}") + 1e-7) + F.col(f"__m{c}") for c in columns}
    return rows.join(F.broadcast(fit), F.lit(True)).withColumns(made).drop(*fit.columns)


def fit_transform_scaler(df: DataFrame, split: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled by the mean and population spread of the training patients' rows."""
    rows = df.join(split, "patient_id")
    return scale(rows, fit_scaler(rows.where("part = 'train'"), columns), columns)


def sliding_sequences(df: DataFrame, dynamic: list[str], targets: list[str], size: int = 30, numbers: list[str] = [], codes: list[str] = [], span: float = SPAN, block: int = BLOCK) -> DataFrame:
    """All windows of `size` rows of patients with more rows than that; static numbers and codes, and targets, come from
    the last row. Windows are made in blocks that also hold the rows before them."""
    listed = lambda columns, kind: F.array(*[F.col(c).cast(kind) for c in columns]).cast(f"array<{kind}>")
    made = df.select(
        "patient_id", "timestamp", "cycle_index", listed(dynamic, "float").alias("__row"), listed(numbers, "float").alias("static_cont"), listed(codes, "int").alias("static_cat"), listed(targets, "float").alias("target"))
    rows = blocks(ranked(made, "patient_id", ("timestamp", "cycle_index"), span).where(F.col("n") > size), size - 1, max(block, size))
    wide = rows.withColumn("seq", F.collect_list("__row").over(in_block("patient_id").rowsBetween(1 - size, 0)))
    return wide.where(F.col("own") & (F.col("k") >= size - 1)).select("patient_id", F.col("cycle_index").alias("end_idx"), "seq", "static_cont", "static_cat", "target")


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """The same n rows at every run, by a hash of their keys."""
    return df.orderBy(F.md5(F.concat_ws("|", F.lit(seed), *keys)), *keys).limit(n)
