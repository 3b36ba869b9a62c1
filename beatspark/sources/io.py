"""Reading and writing the catalogue, recordings, beats and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives

CASES = "caseid int, casestart int, caseend int, age double, sex string, height double, weight double, bmi double, preop_htn int, preop_dm int, asa int, optype string, ane_type string, department string, position string, approach string, aline1 string, dx string, opname string, preop_ecg string"
METADATA = "caseid int, age double, sex string, bmi double, position string, approach string, aline1 string, dx string, opname string, preop_ecg string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CASES).csv(path, header=True)


def read_beats(spark: SparkSession, path: str, schema: str | None = None, rows: int | None = None) -> DataFrame:
    """Beats from Parquet, or from CSV with a schema; the first `rows` only where asked for."""
    df = spark.read.schema(schema).csv(path, header=True, nanValue="NaN") if schema else spark.read.parquet(path)
    return df.limit(rows) if rows else df


def read_recordings(spark: SparkSession, path: str, samples: int = archives.CHUNK * archives.CHUNKS) -> DataFrame:
    """Chunks (caseid, chunk_id, start_sample, ecg, ppg, metadata) of all archives below a path, a task for each range of `samples`
    (a multiple of a chunk).

    A file that cannot be read, or lacks a signal, gives one row with `error` and no samples.
    """
    spark.dataSource.register(archives.WaveSource)
    if samples % archives.CHUNK:
        raise ValueError(f"samples: a multiple of {archives.CHUNK}")
    return spark.read.format("beat_waves").option("samples", samples).load(path)


def read_numerics(spark: SparkSession, path: str) -> DataFrame:
    """The pressures (caseid, bp_idx, sbp, dbp; one every two seconds) of the same archives; `error` as with recordings."""
    spark.dataSource.register(archives.NumericSource)
    return spark.read.format("beat_numerics").load(path)


def parse_metadata(df: DataFrame, column: str = "metadata") -> DataFrame:
    return df.withColumn("clinical", F.from_json(column, METADATA))


#: Rows of a file of beats.
FILE_ROWS = 1_000_000


def write_beats(df: DataFrame, path: str, ranges: int | None = None, rows: int = FILE_ROWS) -> None:
    """Parquet in ranges of (patient, time), sorted, with at most `rows` rows a file, and a manifest of what patients each file has.

    A patient with many rows spans several ranges; readers of one patient or time leave out files by the manifest, and row
    groups by their statistics. `ranges`: how many; by the number of rows, if None.
    """
    count = ranges or max(1, -(-df.count() // rows))
    dealt = df.repartitionByRange(count, "patient_id", "timestamp", "cycle_index").sortWithinPartitions("patient_id", "timestamp", "cycle_index")
    dealt.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)
    held = df.sparkSession.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("patient_id").alias("first"), F.max("patient_id").alias("last"), F.count(F.lit(1)).alias("rows"))
    held.coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")  # a name that readers of the beats pass over


def read_patients(spark: SparkSession, path: str, patients: list[int]) -> DataFrame:
    """The beats of a few patients, from the files that the manifest names for them."""
    wanted = F.array(*[F.lit(p) for p in patients]).cast("array<bigint>")
    files = [r.file for r in spark.read.parquet(f"{path}/_manifest").where(F.exists(wanted, lambda p: p.between(F.col("first"), F.col("last")))).select("file").collect()]
    whole = spark.read.parquet(path)
    found = spark.read.schema(whole.schema).parquet(*[f"{path}/{f}" for f in files]) if files else whole.limit(0)
    return found.where(F.col("patient_id").isin(*patients))


def concat_beats(tables: list[DataFrame]) -> DataFrame:
    """Separately stored batches under each other; columns that a batch lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_patient_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").parquet(path)


def write_report_json(report: DataFrame, path: str) -> None:
    """A report of one row as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def run_summary(cases: DataFrame, status: str = "status") -> DataFrame:
    return cases.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(status) == "ok").alias("ok"), F.count_if(F.col(status) == "failed").alias("failed"))
