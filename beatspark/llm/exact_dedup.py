"""Exact dedup by a persistent index of digests.

`DigestIndex` is a table of one entry for each text ever seen: its SHA-256, the row that stays, the number of equal rows
in the batch that brought it, and that batch. The table is split into buckets by digest, each sorted by digest, and
partitioned by batch. A new batch is reduced to one row for each digest (summed up before the shuffle, so a text that a
third of all rows share costs one row a task); a sort-merge anti-join with the index, which the bucketing spares the
index's shuffle, leaves the digests that are new; these are appended. Texts that came in an earlier batch are copies of
the row that stayed then; inside a batch the row with the largest id stays (or the smallest).

Only digests, ids and row numbers are shuffled, never texts. Rows of a text that many share get their answer by a
broadcast of such digests (a thousand at most, see `spread_join`). Built-in expressions only.

A batch of a name is added once: adding it again takes the place of what is there of it, so a job that was killed is
started again as it was. `compact` puts the files of all batches together.

Defined results: a null text counts as empty; texts are compared as they are; of repeated rows (equal id and text) one is
kept; a null id is smaller than any other; an empty table appends nothing; other columns, whatever their names, are kept by
`new_documents` and ignored elsewhere.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import check_columns, discard, materialise, shared_dir, spread_join

#: Buckets of an index that is made without a number of its own.
BUCKETS = 64


class DigestIndex:
    """The index in a folder that all executors share; it is opened again by its path, in this session or another."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.path = (path or f"{shared_dir(spark)}/beatspark/digests-{uuid.uuid4().hex}").rstrip("/")
        written = self._written_buckets()
        self.buckets = written or buckets
        self.name = f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, n BIGINT, batch STRING) USING parquet OPTIONS (compression 'zstd') "
            f"PARTITIONED BY (batch) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/buckets={self.buckets}'"
        )
        if written:  # batches that are there
            spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def _folder(self) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _written_buckets(self) -> int:
        """The number of buckets is part of the folder's name; 0 where there is no index yet."""
        fs, path = self._folder()
        found = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return next((int(f.removeprefix("buckets=")) for f in found if f.startswith("buckets=")), 0)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def before(self, batch: str) -> DataFrame:
        """Entries that other batches brought."""
        return self.entries().where(F.col("batch") != batch)

    def new(self, digests: DataFrame, batch: str) -> DataFrame:
        """Rows of `digests` (column digest) without an entry from before: a merge anti-join with the index's buckets."""
        return digests.join(self.before(batch).select("digest").hint("merge"), "digest", "left_anti")

    def forget(self, batch: str) -> None:
        """Removes what a stopped run left of a batch."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch's name has letters, digits, underscores, points and dashes only")
        self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (batch = '{batch}')")
        fs, path = self._folder()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"buckets={self.buckets}/batch={batch}"), True)

    def append(self, digests: DataFrame, batch: str) -> None:
        """Adds digest, keep_id and n as entries of `batch`."""
        # dealt by the function that the buckets go by: one file for each
        dealt = digests.select("digest", "keep_id", "n").repartition(self.buckets, "digest")
        self.spark.sql(f"INSERT INTO {self.name} PARTITION (batch = '{batch}') SELECT * FROM {{dealt}}", dealt=dealt)

    def compact(self) -> None:
        """Writes all entries anew, one file a bucket; entries lose the names of their batches."""
        everything = materialise(self.entries().select("digest", "keep_id", "n"), "digests")
        path = self.path
        self.drop()
        self.__init__(self.spark, path, self.buckets)
        self.append(everything, "compacted")
        discard(everything)

    def drop(self) -> None:
        """Forgets the table and deletes its folder."""
        self.spark.sql(f"DROP TABLE {self.name}")
        fs, path = self._folder()
        fs.delete(path, True)


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8; null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def add(index: DigestIndex, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """Dedups a batch against the index and itself and appends what is new.

    id, digest, keep_id (of the row that stays), group_size (equal rows in this batch), seen_before (the text came in
    an earlier batch), kept: one row for each row of `docs`.
    """
    check_columns(docs, id_col, text_col)
    if keep not in ("largest", "smallest"):
        raise ValueError("keep: largest or smallest")
    index.forget(batch)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), digest(F.col(text_col)).alias("digest"), F.monotonically_increasing_id().alias("at"))
    rows = materialise(rows, "row_digests")  # the row numbers stay as they are from here on
    # a null id loses either way: it comes first, and is turned away by its sign
    order = F.struct(F.col("id").isNotNull().alias("named"), (F.col("id") if keep == "largest" else -F.col("id")).alias("rank"), "id", "at")
    groups = materialise(rows.groupBy("digest").agg(F.max(order).alias("top"), F.count("*").alias("n")).select("digest", "top.id", "top.at", "n"), "batch_digests")
    index.append(index.new(groups, batch).select("digest", F.col("id").alias("keep_id"), "n"), batch)
    earlier = index.before(batch).select("digest", "keep_id", F.lit(True).alias("seen_before"))
    known = groups.join(earlier.hint("merge"), "digest", "left")
    seen = F.coalesce("seen_before", F.lit(False))
    answers = materialise(known.select("digest", "n", F.when(seen, F.col("keep_id")).otherwise(F.col("id")).alias("keep_id"), seen.alias("seen_before"), F.when(~seen, F.col("at")).alias("kept_at")), "digest_answers")
    discard(groups)
    return spread_join(rows, answers, ["digest"]).select(
        "id", "digest", "keep_id", F.col("n").alias("group_size"), "seen_before", F.coalesce(F.col("at") == F.col("kept_at"), F.lit(False)).alias("kept")
    )


def new_documents(index: DigestIndex, docs: DataFrame, batch: str, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of `docs`, all their columns, that stay: one for each text that no earlier batch had."""
    stay = add(index, docs, batch, id_col, text_col, keep).where("kept").select("id", "digest")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col(id_col).cast("bigint").alias("id"), digest(F.col(text_col)).alias("digest"))
    once = rows.groupBy("id", "digest").agg(F.first("doc").alias("doc"))  # of repeated rows one
    same = once["id"].eqNullSafe(stay["id"]) & (once["digest"] == stay["digest"])
    return once.join(stay, same, "left_semi").select("doc.*")
