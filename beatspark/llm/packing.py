"""Best-fit packing of tokenised documents by large-item matching.

`tokenise` turns each whole document into token ids and cuts only those longer than the capacity into pieces.
`pack` gives each piece a sequence and an offset. Pieces of full length are sequences of their own and need no
packing, so at most one piece of a document is packed, however long it is. Packing goes on inside groups of about `GROUP`
such pieces: lengths alone are shuffled, dealt by a hash, and the best fit inside a group of that size leaves at most a few
part-filled sequences, whatever the size of the corpus.

Inside a group, pieces above one third of the capacity are matched first: two of them at most fit a sequence
(three of exactly a third and less are left to the second step), and the longest open one always takes the longest
that still fits. Smaller pieces then fall into the tightest remaining gap, longest first.

Defined results: a null text is an empty document, of one end token; repeated rows (same id and text, or no id) are
packed one by one; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns, materialise

CAPACITY = 2048
END_ID = 0
#: Pieces that are packed together.
GROUP = 50_000
#: Words whose ids a worker remembers; beyond it the memory is emptied and filled anew.
REMEMBERED = 1_600_000
#: Texts that a worker tokenises together.
_TEXTS = 256

_memory: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """Token ids of whole texts for a tokenizer that never joins text across a blank or a line feed.

    Words between these are tokenised once and remembered, as natural text repeats its words. New words go through
    the tokenizer together, parted by one of its own special tokens.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED, parting: str = "<|startoftext|>"):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._ids: dict[str, bytes] = {"": b""}
        self._remembered = remembered
        self._parting, self._parting_id = parting, self._tokenizer.token_to_id(parting)

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if "<|" not in w]
        if plain:
            ids = self._encode(self._parting.join(plain))
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == self._parting_id)).tolist()
            at = 0
            for word, cut in zip(plain, [*cuts, len(raw)]):
                self._ids[word] = raw[at:cut]
                at = cut + 4
        for word in new:
            if "<|" in word:
                self._ids[word] = self._encode(word).tobytes()

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        parts = [t.replace("\n", " ").split(" ") for t in texts]
        used: set[str] = set().union(*parts)
        new = used.difference(self._ids)
        if new and len(self._ids) + len(new) > self._remembered:
            self._ids = {"": b""}
            new = used - {""}
        if new:
            self._learn(sorted(new))
        return [b"".join(map(self._ids.__getitem__, p)) for p in parts]

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_batch([text])[0], dtype="<u4")


def _tokenizer(path: str, remembered: int) -> WordTokenizer:
    if path not in _memory:
        _memory.clear()
        _memory[path] = WordTokenizer(path, remembered)
    return _memory[path]


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the token ids."""
    check_columns(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer_path, remembered).encode_batch
        end = end_id.to_bytes(4, "little")
        for batch in (whole.slice(at, _TEXTS) for whole in batches for at in range(0, whole.num_rows, _TEXTS)):
            rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            tokens = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for k, v in zip(rows, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        rows[k].append(v)
                    if with_ids:
                        tokens.append(np.frombuffer(part, "<u4").astype(np.int32))
            arrays = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
            names = list(rows)
            if with_ids:
                arrays.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def fit(lengths: Iterable[int], capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each item. Deterministic: equal lengths keep their order."""
    sizes = np.asarray(lengths, dtype=np.int64)
    bins, offsets = np.full(len(sizes), -1, dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    large = [int(i) for i in order if 3 * sizes[i] > capacity]
    small = [int(i) for i in order if 3 * sizes[i] <= capacity]
    gaps: dict[int, list[int]] = {}
    open_gaps = 0  # bit g: there are bins with a gap of g
    n_bins = 0

    def leave(bin_: int, gap: int) -> None:
        nonlocal open_gaps
        if gap:
            gaps.setdefault(gap, []).append(bin_)
            open_gaps |= 1 << gap

    # match large items: by length, the unmatched ones in stacks; bit s: unmatched items of length s
    waiting: dict[int, list[int]] = {}
    there = 0
    for i in reversed(large):
        waiting.setdefault(int(sizes[i]), []).append(i)
        there |= 1 << int(sizes[i])

    def take(size: int) -> int:
        nonlocal there
        item = waiting[size].pop()
        if not waiting[size]:
            there &= ~(1 << size)
        return item

    while there:
        first = take(there.bit_length() - 1)
        bins[first] = n_bins
        rest = capacity - int(sizes[first])
        fits = there & ((1 << (rest + 1)) - 1)
        if fits:
            second = take(fits.bit_length() - 1)
            bins[second], offsets[second] = n_bins, sizes[first]
            rest -= int(sizes[second])
        leave(n_bins, rest)
        n_bins += 1
    for i in small:
        size = int(sizes[i])
        above = open_gaps >> size
        if above:
            gap = size + (above & -above).bit_length() - 1
            bin_ = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps &= ~(1 << gap)
        else:
            bin_, gap, n_bins = n_bins, capacity, n_bins + 1
        bins[i], offsets[i] = bin_, capacity - gap
        leave(bin_, gap - size)
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """`pieces` with sequence_id and offset.

    Pieces of full length are sequences of their own at once. The others are packed in groups of `group` about; rows that
    are equal in all are dealt out among the groups by a random number beside their hash. A run of a task gives a row the
    same group again, as the number hangs on its place in the task's input, which is a written table.
    """
    check_columns(pieces, "length")
    if "__group" in pieces.columns:
        raise ValueError("a column has the name __group")
    rows = materialise(pieces, "pieces")
    full = F.col("length") == capacity
    n_groups = max(1, -(-rows.where(~full).count() // group))
    # even numbers are groups' sequences, odd ones those of full pieces
    whole = rows.where(full).withColumns({"sequence_id": F.monotonically_increasing_id() * 2 + 1, "offset": F.lit(0).cast("bigint")})
    deal = F.pmod(F.xxhash64(*[F.col(c) for c in pieces.columns if c != "ids"], F.rand(1)), F.lit(n_groups)).cast("int")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([c for c in ("length", "doc_id", "piece", "ids_crc32") if c in pdf], kind="stable", ignore_index=True)
        bins, offsets = fit(pdf["length"], capacity)
        pdf = pdf.drop(columns="__group")
        pdf["sequence_id"] = (bins * n_groups + int(key[0])) * 2
        pdf["offset"] = offsets
        return pdf

    return rows.where(~full).withColumn("__group", deal).groupBy("__group").applyInPandas(run, schema).unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of all documents with their places: `tokenise`, then `pack`."""
    return pack(tokenise(docs, tokenizer_path, capacity, end_id, remembered=remembered), capacity, group)
