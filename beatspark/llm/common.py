"""What several operators share: the shared folder, materialised tables, text normalisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`, as a Java regular expression.
SPACES = r"[\x20\x09-\x0D]+"
_local: str | None = None
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in `spark.checkpoint.dir`; where none is set, a temporary one in local mode and an error on a cluster."""
    global _local
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local = _local or "file://" + tempfile.mkdtemp(prefix="spark-")
    return root.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes `df` once to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/beatspark/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(df: DataFrame) -> None:
    """Deletes a table of `materialise` that nothing reads any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Keys that `spread_join` treats as hot at most, and rows of a key below which none is.
HOT_KEYS, HOT_ROWS = 1000, 20_000


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], n: str = "n", hot_rows: int | None = None) -> DataFrame:
    """`rows` joined to `keys` (a written table, each key once, `n` its number of rows), hot keys dealt out over many tasks.

    A key is hot from a thousandth of all rows on, so there are at most `HOT_KEYS` of them whatever the table, and only
    these are broadcast. Their rows get one of several salts; their one row of `keys` is repeated for each salt.
    """
    total = keys.agg(F.sum(n)).first()[0] or 0
    cut = max(hot_rows or HOT_ROWS, -(-total // HOT_KEYS))
    parts = F.ceil(F.col(n) / cut)
    hot = keys.where(F.col(n) > cut).select(*on, parts.alias("__parts"))
    left = rows.join(F.broadcast(hot), on, "left")
    salt = F.when(F.col("__parts").isNull(), F.lit(0).cast("bigint")).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("__parts")))
    right = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return left.withColumn("__salt", salt).drop("__parts").join(right, [*on, "__salt"]).drop("__salt")


def words(text: Column) -> Column:
    """Array of the words `[^\x20\x09-\x0D]+` of a text; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, _UPPER, _LOWER)


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
