"""Recordings as a splittable source: archives (.npz) are read by ranges of samples, never whole.

A partition is a range of one archive; its bounds come from the archive's directory and its arrays' headers. A task opens
the archive, goes to its range and reads that. Arrays that are stored plain are read where they lie; compressed ones are
unpacked up to the range, in small pieces. A file that cannot be read, or lacks an array, is one row with `error`.
"""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Names of the arrays in an archive.
WAVES = {"ecg": "wave_SNUADC_ECG_II", "ppg": "wave_SNUADC_PLETH"}
NUMERICS = {"sbp": "num_Solar8000_ART_SBP", "dbp": "num_Solar8000_ART_DBP"}
#: Samples of a stored chunk, and chunks of a partition.
CHUNK, CHUNKS = 10_000, 50
WAVE_SCHEMA = "caseid int, chunk_id int, start_sample bigint, ecg array<double>, ppg array<double>, metadata string, error string"
NUMERIC_SCHEMA = "caseid int, bp_idx int, sbp double, dbp double, error string"


def case_of(path: str) -> int:
    digits = "".join(c for c in path.rsplit("/", 1)[-1] if c.isdigit())
    return int(digits) if digits else -1


def _open(path: str) -> zipfile.ZipFile:
    system, inside = arrow_fs.FileSystem.from_uri(path) if ":/" in path else (arrow_fs.LocalFileSystem(), path)
    return zipfile.ZipFile(system.open_input_file(inside))


def archives(path: str) -> list[str]:
    """The archives below a path, with the scheme that the path has."""
    system, inside = arrow_fs.FileSystem.from_uri(path) if ":/" in path else (arrow_fs.LocalFileSystem(), path)
    scheme = path[: path.index(":") + 1] + "//" if ":/" in path else ""
    found = system.get_file_info(arrow_fs.FileSelector(inside, recursive=True)) if system.get_file_info(inside).type == arrow_fs.FileType.Directory else [system.get_file_info(inside)]
    return sorted(scheme + f.path for f in found if f.is_file and f.path.endswith(".npz"))


def _header(member) -> tuple[int, np.dtype]:
    """Length and type of an array whose header is read next."""
    version = np.lib.format.read_magic(member)
    shape, _, kind = np.lib.format.read_array_header_1_0(member) if version == (1, 0) else np.lib.format.read_array_header_2_0(member)
    if len(shape) != 1 or kind.hasobject:
        raise ValueError("not a signal")
    return shape[0], kind


def read_range(archive: zipfile.ZipFile, name: str, start: int, count: int) -> np.ndarray:
    """Values `start` to `start + count` of an array."""
    with archive.open(f"{name}.npy") as member:
        held, kind = _header(member)
        count = max(0, min(count, held - start))
        member.seek(member.tell() + start * kind.itemsize)
        data = member.read(count * kind.itemsize)
    if len(data) < count * kind.itemsize:
        raise ValueError("the array is cut short")
    return np.frombuffer(data, kind).astype(np.float64)


class Part(InputPartition):
    def __init__(self, path: str, start: int, count: int, error: str | None = None):
        self.path, self.start, self.count, self.error = path, start, count, error


class _Reader(DataSourceReader):
    arrays: dict[str, str]
    size: int

    def __init__(self, path: str, schema: pa.Schema, size: int | None = None):
        self.path, self.schema, self.size = path, schema, size or self.size

    def partitions(self) -> list[Part]:
        parts = []
        for path in archives(self.path):
            try:
                with _open(path) as archive:
                    held = []
                    for name in self.arrays.values():
                        with archive.open(f"{name}.npy") as member:
                            held.append(_header(member)[0])
                parts += [Part(path, at, min(self.size, min(held) - at)) for at in range(0, max(min(held), 1), self.size)]
            except Exception as e:  # a broken archive is data here, and reported as such
                parts.append(Part(path, 0, 0, type(e).__name__))
        return parts

    def rows(self, part: Part) -> Iterator[dict]:
        raise NotImplementedError

    def failed(self, part: Part, error: str) -> dict:
        raise NotImplementedError

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        error = part.error
        if error is None:
            try:
                for row in self.rows(part):
                    yield pa.RecordBatch.from_pydict(row, self.schema)
            except Exception as e:
                error = type(e).__name__
        if error is not None:
            yield pa.RecordBatch.from_pylist([self.failed(part, error)], self.schema)


class WaveReader(_Reader):
    arrays, size = WAVES, CHUNK * CHUNKS

    def rows(self, part: Part) -> Iterator[dict]:
        with _open(part.path) as archive:
            meta = str(np.load(archive.open("metadata.npy"), allow_pickle=False)) if "metadata.npy" in archive.namelist() else None
            signals = [read_range(archive, name, part.start, part.count) for name in WAVES.values()]
        for at in range(0, part.count, CHUNK):
            chunk = [s[at : at + CHUNK] for s in signals]
            start = part.start + at
            yield dict(zip(self.schema.names, ([case_of(part.path)], [start // CHUNK], [start], *([c] for c in chunk), [meta], [None])))

    def failed(self, part: Part, error: str) -> dict:
        return {"caseid": case_of(part.path), "chunk_id": -1, "start_sample": -1, "ecg": [], "ppg": [], "error": error}


class NumericReader(_Reader):
    arrays, size = NUMERICS, 1_000_000

    def rows(self, part: Part) -> Iterator[dict]:
        with _open(part.path) as archive:
            sbp, dbp = (read_range(archive, name, part.start, part.count) for name in NUMERICS.values())
        n = len(sbp)
        missing = lambda x: pa.array(x, from_pandas=True)  # noqa: E731  NaN is a missing reading
        yield {"caseid": [case_of(part.path)] * n, "bp_idx": list(range(part.start, part.start + n)), "sbp": missing(sbp), "dbp": missing(dbp), "error": [None] * n}

    def failed(self, part: Part, error: str) -> dict:
        return {"caseid": case_of(part.path), "bp_idx": -1, "error": error}


class WaveSource(DataSource):
    """spark.read.format("beat_waves").load(path); option samples: values in a partition, a multiple of a chunk"""

    reader_class = WaveReader

    @classmethod
    def name(cls) -> str:
        return "beat_waves"

    def schema(self) -> str:
        return WAVE_SCHEMA

    def reader(self, schema) -> _Reader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return self.reader_class(self.options["path"], to_arrow_schema(schema), int(self.options.get("samples", 0)))


class NumericSource(WaveSource):
    """spark.read.format("beat_numerics").load(path)"""

    reader_class = NumericReader

    @classmethod
    def name(cls) -> str:
        return "beat_numerics"

    def schema(self) -> str:
        return NUMERIC_SCHEMA
