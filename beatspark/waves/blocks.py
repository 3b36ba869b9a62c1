"""Blocks of a source's chunks that follow each other: samples are made, filtered and cut into beats in one task, and given
up there. Spans, votes and templates move; samples are neither moved nor written, and are made anew for each pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import select
from . import kernels
from .chunks import Source, arrow_column, views
from .kernels import FS

#: Chunks of a block, the most samples that a task holds (with three more, of the blocks beside it).
BLOCK = 64
#: Samples of context of the polarity's high-pass.
DRIFT_HALO = 4 * FS


def without_gaps(x: np.ndarray, mean: float | None) -> np.ndarray:
    return np.where(np.isnan(x), np.nan if mean is None else mean, x)


def band_filtered(x: np.ndarray | None, mean: float | None, hr: float, kind: str, fs: int = FS) -> np.ndarray | None:
    """A chunk, its gaps filled with the recording's mean, reduced to multiples of the heart rate."""
    if x is None or len(x) < 2:
        return x if x is None else np.zeros(len(x))
    return kernels.morlet_band(without_gaps(x, mean), *kernels.filter_band(hr, kind, fs), fs)


def drift_free(left: np.ndarray, own: np.ndarray, right: np.ndarray, fs: int = FS) -> np.ndarray:
    """A chunk high-passed at half a Hertz, with the context of its neighbours."""
    return kernels.zero_phase(np.concatenate((left, own, right)), 0.5, None, 2, fs)[len(left) : len(left) + len(own)]


def median_shape(shapes: np.ndarray) -> np.ndarray:
    """The median of each column of a table, without its missing values (`select.median_template`)."""
    held = ~np.isnan(shapes)
    if held.all():
        return np.median(shapes, axis=0)
    return np.array([np.median(x[there]) if there.any() else np.nan for x, there in zip(shapes.T, held.T)])


def likeness(shapes: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Mean product of the z-scores of each row and the template (`arrays.template_corr`)."""
    z = lambda x: (x - x.mean(axis=-1, keepdims=True)) / (x.std(axis=-1, keepdims=True) + 1e-6)
    return (z(shapes) * z(template)).mean(axis=1)


class Block:
    """Chunks of a recording in their order (numbers, first samples, samples). What is asked for of a chunk is made once."""

    def __init__(self, chunks: list[tuple[int, int, np.ndarray | None]], size: int, mean: float | None, hr: float, kind: str, fs: int):
        self.at, self.starts, self.samples = {c[0]: k for k, c in enumerate(chunks)}, [c[1] for c in chunks], [c[2] for c in chunks]
        self.size, self.fs, self.band = size, fs, (mean, hr, kind, fs)
        self._filtered, self._steady = [None] * len(chunks), [None] * len(chunks)

    def filtered(self, k: int) -> np.ndarray:
        """The k-th chunk in its band; empty where there is none, or it has no samples."""
        if not 0 <= k < len(self.samples):
            return np.zeros(0)
        if self._filtered[k] is None:
            made = band_filtered(self.samples[k], *self.band)
            self._filtered[k] = np.zeros(0) if made is None else made
        return self._filtered[k]

    def steady(self, k: int) -> np.ndarray:
        if self._steady[k] is None:
            self._steady[k] = drift_free(self.filtered(k - 1)[-DRIFT_HALO:], self.filtered(k), self.filtered(k + 1)[:DRIFT_HALO], self.fs)
        return self._steady[k]

    def beat(self, start: int, end: int, reach: int) -> np.ndarray | None:
        """The filtered samples of a span, from the chunk that it begins in and `reach` of the next one; None beyond these."""
        k = self.at.get(start // self.size)
        if k is None:
            return None
        own, first, last = self.filtered(k), start - self.starts[k], end - self.starts[k]
        held = own if last <= len(own) else np.concatenate((own, self.filtered(k + 1)[:reach]))
        return held[first:last] if last <= len(held) else None

    def steady_span(self, start: int, end: int) -> np.ndarray | None:
        """The filtered samples of a span without their drift; None where it reaches beyond what is there."""
        over = [self.at[c] for c in range(start // self.size, (end - 1) // self.size + 1) if c in self.at]
        parts = [self.steady(k)[max(start - self.starts[k], 0) : max(end - self.starts[k], 0)] for k in over]
        return np.concatenate(parts) if sum(map(len, parts)) == end - start else None


def _of_chunk(chunk: Column, block: int) -> Column:
    return F.floor(chunk / block).cast("int")


def chunks_in_blocks(source: Source, cases: DataFrame, spans: DataFrame, column: str, block: int) -> DataFrame:
    """The chunks of all blocks that spans (caseid, sample_idx, and more) begin in, each block's in their order: caseid,
    block, chunk_id, start_sample and `__signal`; at its first one, `__spans` (those that begin in it), the columns of
    `cases` and `__blocks`, how many of its recording there are. A block has one chunk before it and two behind it besides.

    All sides are small and dealt alike, so that nothing moves behind that.
    """
    key, names, more = ["caseid", "block"], [c for c in spans.columns if c != "caseid"], [c for c in cases.columns if c != "caseid"]
    own = spans.select("caseid", _of_chunk(F.floor(F.col("sample_idx") / source.size), block).alias("block"), F.struct(*names).alias("__span"))
    of_case = own.select(*key).distinct().join(cases, "caseid").withColumn("__blocks", F.count(F.lit(1)).over(Window.partitionBy("caseid")))
    near = F.array_distinct(F.array(*[_of_chunk(F.col("chunk_id") + k, block) for k in (-2, -1, 0, 1)]))
    rows = source.rows.select("caseid", F.struct("chunk_id", *[c for c in source.rows.columns if c not in ("caseid", "chunk_id")]).alias("__row"), F.explode(near).alias("block"))
    listed = lambda df, name: source.deal(df, "block").groupBy(*key).agg(F.collect_list(name).alias(f"{name}s"))
    joined = listed(rows, "__row").join(listed(own, "__span"), key).join(source.deal(of_case, "block"), key)
    each = joined.select(*key, F.posexplode(F.array_sort("__rows")).alias("__k", "__row"), "__spans", "__blocks", *more)
    first = [F.when(F.col("__k") == 0, F.col(c)).alias(c) for c in ("__spans", "__blocks", *more)]
    return source.samples(each.select(*key, *first, "__row.*")).select(*key, "chunk_id", "start_sample", F.col(column).alias("__signal"), "__spans", "__blocks", *more)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, kind: str, fs: int) -> Iterator[tuple[dict, pa.StructArray, Block]]:
    """What comes with the first chunk of each block, its spans, and its samples. `cases` have to give __mean and __hr."""
    head, chunks = {}, []
    block = lambda: (head, head["__spans"].values, Block(chunks, size, head["__mean"].as_py(), head["__hr"].as_py(), kind, fs))
    for batch in batches:
        begins, names = batch.column("__spans").is_valid().to_pylist(), batch.schema.names
        for k, chunk in enumerate(zip(batch.column("chunk_id").to_pylist(), batch.column("start_sample").to_pylist(), views(batch.column("__signal")))):
            if begins[k]:
                if head:
                    yield block()
                head, chunks = {name: batch.column(name)[k] for name in names if name not in ("chunk_id", "start_sample", "__signal")}, []
            chunks.append(chunk)
    if head:
        yield block()


def first_look(source: Source, cases: DataFrame, spans: DataFrame, column: str, kind: str, vote: Callable[[np.ndarray], int], points: int, reach: int, fs: int = FS, block: int = BLOCK) -> DataFrame:
    """What beats have to be compared with, of `spans` (caseid, peak_no, sample_idx, end_idx, is_beat, vote_end), by block:
    caseid, block; beats, the numbers of those that can be cut; their median at `points` points, where all of the recording
    are here, else the `shapes` of all; votes (of samples up to `vote_end`, where there is one), and how many of them are 1.
    """
    size = source.size
    schema = f"caseid {dict(spans.dtypes)['caseid']}, block int, beats array<int>, template array<double>, shapes array<array<double>>, votes bigint, ones bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, held, b in _blocks(batches, size, kind, fs):
            rows = list(zip(*[held.field(name).to_pylist() for name in ("peak_no", "sample_idx", "end_idx", "is_beat", "vote_end")]))
            cut = [(no, x) for no, start, end, beat, _ in rows if beat and (x := b.beat(start, end, reach)) is not None]
            shapes = [kernels.resample(x, points) for _, x in cut]
            whole = shapes and head["__blocks"].as_py() == 1
            votes = [vote(x) for _, start, _, _, end in rows if end is not None and (x := b.steady_span(start, end)) is not None]
            template, rest = [median_shape(np.stack(shapes)) if whole else None], [] if whole else shapes
            nested = pa.ListArray.from_arrays(pa.array([0, len(rest)], pa.int32()), arrow_column(rest, "array<double>"))
            numbers = [pa.array([x]) for x in (sum(v >= 0 for v in votes), sum(v == 1 for v in votes))]
            made = [pa.array([head["caseid"]]), pa.array([head["block"]]), pa.array([[no for no, _ in cut]], pa.list_(pa.int32())), arrow_column(template, "array<double>"), nested, *numbers]
            yield pa.RecordBatch.from_arrays(made, ["caseid", "block", "beats", "template", "shapes", "votes", "ones"])

    return chunks_in_blocks(source, cases, spans, column, block).mapInArrow(run, schema)


def templates(look: DataFrame) -> DataFrame:
    """caseid and template: at each place, the exact median of all beats of a case. Shapes move of recordings of more than
    one block only."""
    rest = look.where("template IS NULL").select("caseid", F.explode("shapes").alias("shape"))
    return look.where("template IS NOT NULL").select("caseid", "template").unionByName(select.median_template(rest, "shape"))


def alike_beats(source: Source, cases: DataFrame, spans: DataFrame, column: str, kind: str, least: float, points: int, reach: int, fs: int = FS, block: int = BLOCK) -> DataFrame:
    """`spans` (caseid, sample_idx, end_idx, and more) with their signal, `inverted` and the likeness to the `template` of
    their case (all three by `cases`), of at least `least`."""
    size, names = source.size, [c for c in spans.columns if c != "caseid"]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in spans.select("caseid", *names).dtypes), f"`{column}` array<double>", "cycle_correlation double", "inverted boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, held, b in _blocks(batches, size, kind, fs):
            cut = [b.beat(start, end, reach) for start, end in zip(held.field("sample_idx").to_pylist(), held.field("end_idx").to_pylist())]
            there = [k for k, x in enumerate(cut) if x is not None]
            if not there:
                continue
            template = np.array([np.nan if v is None else v for v in head["template"].as_py()])
            like = likeness(np.stack([kernels.resample(cut[k], points) for k in there]), template)
            kept = [k for k, x in zip(there, like) if x >= least]
            found = held.take(pa.array(kept, pa.int64()))
            ends = [arrow_column([cut[k] for k in kept], "array<double>"), pa.array(like[like >= least]), pa.array([head["inverted"].as_py()] * len(kept), pa.bool_())]
            yield pa.RecordBatch.from_arrays([pa.array([head["caseid"].as_py()] * len(kept), head["caseid"].type), *[found.field(name) for name in names], *ends], ["caseid", *names, column, "cycle_correlation", "inverted"])

    return chunks_in_blocks(source, cases, spans, column, block).mapInArrow(run, schema)
