"""Peaks of long recordings from chunks: each task holds one chunk and its halo, never a recording."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import FS, bridged, r_peaks

#: Samples of context on either side: the threshold looks back 2 s, and chains of close peaks settle within a few more.
HALO = 4 * FS


def with_halo(chunks: DataFrame, column: str, halo: int = HALO) -> DataFrame:
    """chunks (caseid, chunk_id, start_sample, column) with the end of the chunk before and the start of the one after.

    A source that reads beyond its chunks gives these itself, as `<column>_left` and `<column>_right` of HALO samples (fewer at
    the ends of a recording); then no samples are moved.
    """
    if halo <= HALO and {f"{column}_left", f"{column}_right"} <= set(chunks.columns):
        left, right = F.col(f"{column}_left"), F.col(f"{column}_right")
        return chunks.withColumn("left_halo", F.slice(left, F.greatest(F.lit(1), F.size(left) - halo + 1), halo)).withColumn("right_halo", F.slice(right, 1, halo))
    order = Window.partitionBy("caseid").orderBy("chunk_id")
    before, after = F.lag(column).over(order), F.lead(column).over(order)
    empty = F.array().cast("array<double>")
    return chunks.withColumn("left_halo", F.coalesce(F.slice(before, F.greatest(F.lit(1), F.size(before) - halo + 1), halo), empty)).withColumn("right_halo", F.coalesce(F.slice(after, 1, halo), empty))


def views(arrays: pa.Array) -> Iterator[np.ndarray | None]:
    """Each array of a column as doubles, NaN where a value is missing; None where the array is."""
    flat, ends = np.asarray(arrays.values.to_numpy(zero_copy_only=False), dtype=float), arrays.offsets.to_numpy()
    return (flat[a:b] if there else None for a, b, there in zip(ends[:-1], ends[1:], arrays.is_valid().to_pylist()))


def arrow_column(made: list, kind: str) -> pa.Array:
    """A column of arrays or numbers, without boxing each value; NaN becomes NULL."""
    if not kind.startswith("array"):
        return pa.array(made, {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}[kind], from_pandas=True)
    held = [np.zeros(0) if x is None else x for x in made]
    flat = np.concatenate([np.zeros(0), *held]) if kind == "array<double>" else np.concatenate([np.zeros(0, dtype=np.int64), *held])
    ends = pa.array(np.cumsum([0, *map(len, held)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(flat, from_pandas=True), mask=pa.array([x is None for x in made], pa.bool_()))


@dataclass(frozen=True)
class Source:
    """Chunks whose samples are read where they are needed: `rows` (caseid, chunk_id, start_sample, and what the source wants)
    are small and can be joined with anything; `deal` deals such rows, or others with a caseid and chunk_id (or another number,
    whose column it is given), over the tasks, and `samples` adds the arrays of the signals and of their neighbours
    (`<signal>_left`, `<signal>_right`) to dealt ones. So no exchange ever moves samples. `size`: samples of a chunk, where it
    is known.
    """

    rows: DataFrame
    samples: Callable[[DataFrame], DataFrame]
    deal: Callable[..., DataFrame] | None = None
    size: int | None = None

    def made(self, rows: DataFrame) -> DataFrame:
        """`rows`, dealt, with their samples."""
        return self.samples(self.deal(rows) if self.deal else rows)


def sourced(chunks: DataFrame | Source, column: str, halo: int) -> Source:
    """A table of chunks as a source whose rows hold their samples already; then a join moves them."""
    if isinstance(chunks, Source):
        return chunks
    if not {f"{column}_left", f"{column}_right"} <= set(chunks.columns):
        chunks = with_halo(chunks, column, halo).withColumnsRenamed({"left_halo": f"{column}_left", "right_halo": f"{column}_right"})
    return Source(chunks, lambda rows: rows)


def sampled(chunks: DataFrame | Source) -> DataFrame:
    """All chunks with their samples."""
    return chunks.made(chunks.rows) if isinstance(chunks, Source) else chunks


def detect_r_peaks(chunks: DataFrame | Source, column: str = "ecg", halo: int = HALO, fs: int = FS) -> DataFrame:
    """caseid, peak_no and sample_idx of all peaks; each chunk gives those inside itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = []
            for start, own, left, right in zip(batch.column(1).to_pylist(), *(views(batch.column(k)) for k in (2, 3, 4))):
                found = r_peaks(bridged(np.concatenate((left, own, right))), fs) - len(left)
                each.append(found[(found >= 0) & (found < len(own))] + start)
            cases = np.repeat(batch.column(0).to_numpy(), [len(found) for found in each])
            yield pa.RecordBatch.from_arrays([pa.array(cases, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *each]))], ["caseid", "sample_idx"])

    rows = with_halo(sampled(chunks), column, halo).select(F.col("caseid").cast("int").alias("caseid"), "start_sample", F.col(column).alias("x"), "left_halo", "right_halo")
    peaks = rows.mapInArrow(run, "caseid int, sample_idx bigint")
    return peaks.withColumn("peak_no", F.row_number().over(Window.partitionBy("caseid").orderBy("sample_idx")) - 1)
