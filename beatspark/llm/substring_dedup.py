"""Exact substring dedup by prefix-free parsing, to a fixed depth.

A byte is removed where it lies in a string of `length` bytes that also starts anywhere else, which is to say where the
corpus order (its suffix array) has a neighbour with `length` bytes in common.

Parsing: a rolling hash of 8 bytes is taken at every byte, and the first `window` places of each string of `length`
bytes elect the smallest hash (leftmost of equal ones) as its trigger. All starts with one trigger form a run; its
phrase reaches from the first of them up to the trigger, and the parse is what follows the trigger. The choice depends
on the string alone, so equal strings have their trigger at the same place: a string is a suffix of one phrase, then
the parse behind it.

1. Runs are grouped by the parse, as deep as all strings of any run reach (`length - window + 1` bytes). A run alone in
   its group repeats nowhere.
2. In groups of several, runs whose whole extent is equal (phrase and parse) repeat as a whole.
3. What is left are runs at the edge of a repeat. Of these and of one run of each class of equal ones, two orders are
   made: the suffix order of the dictionary (distinct phrases, compared from their ends, with the lengths that
   neighbours have in common) and the suffix order of the parses (with the same for their beginnings). The suffixes of
   one length a of all phrases are intervals of the first order, the parses equal to depth `length - a` intervals of
   the second; two strings are neighbours in corpus order to the full depth where they share both intervals.

Groups are ordered inside tasks, many to a task. A group of more than `CROWD` classes is parted before: the strings with
the shorter and with the longer part of their phrase go apart, each with the bytes that equal strings of that part have
in common (more of the parse, or more of the phrase) as its new name; and these again, down to strings of one length of
phrase, which are equal where their names are. So no task orders more, whatever a passage's number of contexts. Equal texts are parsed once; a text that is there twice is covered as a whole. Counts
of groups are pre-aggregated, and rows meet them in joins that deal hot parses and classes out over many tasks
(`spread_join`). Texts are told apart by 128 bits of hash, runs by two 64-bit hashes, of the parse and of the extent.

Defined results: a null text is empty; texts shorter than `length` keep everything; of equal texts and passages no
copy is kept; an empty table gives an empty result; other columns are passed through by `dedup`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_columns, materialise, spread_join

LENGTH = 400
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0x00000000FFFFFFFF)
#: Bytes of texts that are parsed together.
_TOGETHER = 1 << 20
#: Classes of runs in a group that are ordered together at most, and about how many a task takes.
CROWD, _BUCKET = 10_000, 4000


def window_of(length: int) -> int:
    return max(1, length // 2)


def runs(texts: list[bytes], length: int = LENGTH) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined, and of all runs: number of the text, first start, last start and trigger (places in the joined bytes)."""
    window = window_of(length)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    bases = np.cumsum(sizes) - sizes
    joined = b"".join(texts)
    n = len(joined)
    inside = np.zeros(n + 1, dtype=np.int8)
    fit = sizes >= length
    np.add.at(inside, bases[fit], 1)
    np.add.at(inside, bases[fit] + sizes[fit] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:n], dtype=np.int8))
    if not starts.size:
        none = np.zeros(0, dtype=np.int64)
        return joined, none, none, none, none
    eight = np.ndarray((n,), "<u8", joined + b"\0" * 8, 0, (1,))
    low = ((eight * _MULTIPLIER) & _HIGH) | np.arange(n, dtype=np.uint64)
    step = 1
    while 2 * step <= window:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if step < window:
        low = np.minimum(low[: -(window - step)], low[window - step :])
    trigger = (low[starts] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
    last = np.concatenate((first[1:], [len(starts)])) - 1
    begin = starts[first]
    return joined, np.searchsorted(bases, begin, side="right") - 1, begin, starts[last], trigger[first]


def _batches(batch: pa.RecordBatch, packed: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch with about `_TOGETHER` bytes of text, and the texts."""
    at, size, texts = 0, 0, []
    open_ = zstandard.ZstdDecompressor()
    for k in range(batch.num_rows):
        data = open_.decompress(batch.column(packed)[k].as_py())
        texts.append(data)
        size += len(data)
        if size >= _TOGETHER or k == batch.num_rows - 1:
            yield batch.slice(at, len(texts)), texts
            at, size, texts = k + 1, 0, []


def _parse(texts: DataFrame, length: int) -> DataFrame:
    """ka, kb (of the text), first and last (start of a run), trigger, parse and extent (hashes)."""
    deep = length - window_of(length) + 1
    hash_ = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data in _batches(whole, 2):
                joined, text, begin, end, trigger = runs(data, length)
                sizes = np.array([len(t) for t in data], dtype=np.int64)
                base = (np.cumsum(sizes) - sizes)[text]
                parse = np.fromiter((hash_(joined[t : t + deep]) for t in trigger.tolist()), "<u8", len(trigger))
                extent = np.fromiter((hash_(joined[b : e + length]) for b, e in zip(begin.tolist(), end.tolist())), "<u8", len(begin))
                rows = pa.array(text)
                places = [pa.array((x - base).astype(np.int32)) for x in (begin, end, trigger)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), *places, pa.array(parse.view("<i8")), pa.array(extent.view("<i8"))],
                    ["ka", "kb", "first", "last", "trigger", "parse", "extent"],
                )

    return texts.select("ka", "kb", "packed").mapInArrow(run, "ka bigint, kb bigint, first int, last int, trigger int, parse bigint, extent bigint")


def _extents(asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the `asked` runs (parse, first, last, trigger, open) of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data = open_.decompress(row["packed"])
                out += [(row["ka"], row["kb"], r["parse"], r["first"], r["trigger"], r["open"], data[r["first"] : r["last"] + length]) for r in row["asked"]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], ["ka", "kb", "parse", "first", "trigger", "open", "bytes"])

    return asked.select("ka", "kb", "packed", "asked").mapInArrow(run, "ka bigint, kb bigint, parse bigint, first int, trigger int, open boolean, bytes binary")


def _in_order(data: list[bytes], among: list) -> tuple[np.ndarray, np.ndarray]:
    """The sorted order of byte strings within their groups `among`, and how many bytes each has in common with the one before it (-1: another group)."""
    order = sorted(range(len(data)), key=lambda k: (among[k], data[k]))
    size = np.array([len(data[k]) for k in order])
    width = int(size.max(initial=0))
    table = np.frombuffer(b"".join(data[k].ljust(width, b"\0") for k in order), np.uint8).reshape(len(order), width)
    common = np.full(len(order), -1, dtype=np.int64)
    if len(order) > 1:
        differ = np.concatenate((table[1:] != table[:-1], np.ones((len(order) - 1, 1), dtype=bool)), axis=1).argmax(axis=1)
        same = np.array([among[x] == among[y] for x, y in zip(order, order[1:])])
        common[1:] = np.where(same, np.minimum(differ, np.minimum(size[1:], size[:-1])), -1)
    return np.array(order), common


def neighbours(data: list[bytes], cut: np.ndarray, among: list, length: int, low: np.ndarray | None = None, high: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """By the suffix orders of phrases (`data` up to `cut`) and parses (behind it) of runs of the groups `among`: for each
    length a of phrase suffixes (from `low` to before `high`, if given for each run), the runs whose string with that much
    of its phrase has an equal one in another run.
    """
    cuts = cut.tolist()
    parses, deep = _in_order([d[c:] for d, c in zip(data, cuts)], among)
    # a dictionary: equal phrases are one entry; suffixes of phrases are compared from their ends
    backwards = [d[:c][::-1] for d, c in zip(data, cuts)]
    words = sorted(set(backwards))
    number = {w: k for k, w in enumerate(words)}
    phrase = np.array([number[b] for b in backwards])
    _, long = _in_order(words, [0] * len(words))
    least = np.maximum(cut - (np.array([len(d) for d in data]) - length), 0 if low is None else low)
    most = cut if high is None else np.minimum(cut, high - 1)
    rest = np.zeros(len(data), dtype=np.int64)
    for a in range(int(least.min()), int(most.max()) + 1):
        here = np.flatnonzero((least <= a) & (a <= most))
        if len(here) < 2:
            continue
        suffix = np.cumsum(long < a)
        rest[parses] = np.cumsum(deep < length - a)
        _, which, times = np.unique(suffix[phrase[here]] * (len(data) + 1) + rest[here], return_inverse=True, return_counts=True)
        found = here[times[which] > 1]
        if len(found):
            yield a, found


_PART = "part bigint, low int, high int, ka bigint, kb bigint, first int, trigger int, open boolean, bytes binary"


def _parted(parts: DataFrame, length: int) -> DataFrame:
    """Runs (columns of `_PART`) for each half of their strings, by the length of the phrase in these; a half's name (`part`)
    holds the bytes that equal strings of it have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                cut, data = r["trigger"] - r["first"], r["bytes"]
                least, middle = cut - (len(data) - length), (r["low"] + r["high"]) // 2
                for low, high in ((r["low"], middle), (middle, r["high"])):
                    if max(low, least) <= min(high - 1, cut):
                        common = data[cut - low : cut + length - high + 1]
                        name = xxhash.xxh3_64_intdigest(common, low & 0xFFFF) ^ (r["part"] & 0xFFFFFFFFFFFFFFFF)
                        out.append({**r, "part": name - (1 << 64) if name >= 1 << 63 else name, "low": low, "high": high})
            yield pa.RecordBatch.from_pylist(out, batch.schema)

    return parts.mapInArrow(run, _PART)


def _compare_groups(parts: DataFrame, n: int, length: int) -> DataFrame:
    """Repeated strings (ka, kb, first, last) of open runs, whole parts of runs ordered inside a task."""
    buckets = max(1, -(-n // _BUCKET))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first, cut, low, high = (pdf[c].to_numpy().astype(np.int64) for c in ("first", "trigger", "low", "high"))
        cut -= first
        among = list(zip(pdf["part"].tolist(), low.tolist()))
        hits = [(rows, first[rows] + cut[rows] - a) for a, rows in neighbours(pdf["bytes"].tolist(), cut, among, length, low, high)]
        row, at = (np.concatenate([h[k] for h in hits]) if hits else np.zeros(0, dtype=np.int64) for k in (0, 1))
        mine = pdf["open"].to_numpy()[row]
        row, at = row[mine], at[mine]
        order = np.lexsort((at, row))
        row, at = row[order], at[order]
        begins = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)))) if len(row) else np.zeros(0, dtype=int)
        ends = np.concatenate((begins[1:], [len(row)])) - 1 if len(row) else begins
        found = pdf.iloc[row[begins]]
        return pd.DataFrame({"ka": found["ka"].to_numpy(), "kb": found["kb"].to_numpy(), "first": at[begins], "last": at[ends]})

    return parts.withColumn("bucket", F.pmod(F.xxhash64("part", "low"), F.lit(buckets))).groupBy("bucket").applyInPandas(run, "ka bigint, kb bigint, first int, last int")


def _edges(extents: DataFrame, length: int) -> DataFrame:
    """Repeated strings (ka, kb, first, last) of the open ones of edge runs: parts small enough are ordered, others parted again."""
    parts = extents.select(F.col("parse").alias("part"), F.lit(0).alias("low"), F.lit(window_of(length)).alias("high"), "ka", "kb", "first", "trigger", "open", "bytes")
    found = None
    while True:
        sizes = materialise(parts.groupBy("part", "low").agg(F.count("*").alias("n")).where("n > 1"), "part_sizes")
        ordered, crowded = sizes.where(F.col("n") <= CROWD), sizes.where(F.col("n") > CROWD)
        here = _compare_groups(parts.join(ordered.drop("n"), ["part", "low"]), ordered.agg(F.sum("n")).first()[0] or 0, length)
        if crowded.isEmpty():
            return found.union(here) if found else here
        # strings of one length of phrase that have one name are equal
        many = spread_join(parts, crowded, ["part", "low"])
        start = F.col("trigger") - F.col("low")
        equal = many.where((F.col("high") - F.col("low") == 1) & F.col("open")).select("ka", "kb", start.alias("first"), start.alias("last"))
        found = reduce(DataFrame.union, [x for x in (found, here, equal) if x is not None])
        parts = materialise(_parted(many.where(F.col("high") - F.col("low") > 1).select(*[c.split()[0] for c in _PART.split(", ")]), length), "parts")


def _pack(data: pd.Series) -> pd.Series:
    return data.map(zstandard.ZstdCompressor(level=3).compress)


def spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """ka, kb and `covered`, the (first, end) of repeated stretches, for those of `texts` that have any.

    `texts`: ka, kb, packed, size and n (how often the text is there), each text of `length` bytes and more once.
    """
    parsed = _parse(texts, length)
    counted = parsed.groupBy("parse").agg(F.count("*").alias("n"), F.min("extent").alias("lo"), F.max("extent").alias("hi"))
    groups = materialise(counted.where("n > 1").select("parse", "n", (F.col("lo") != F.col("hi")).alias("mixed")), "parses")
    shared = materialise(spread_join(parsed, groups, ["parse"]).drop("n"), "shared_runs")
    alike = shared.where("NOT mixed").select("ka", "kb", "first", "last")

    mixed = shared.where("mixed").drop("mixed")
    place = F.xxhash64("ka", "kb", "first")
    classes = mixed.groupBy("parse", "extent").agg(F.count("*").alias("n"), F.min(place).alias("one"))
    classes = materialise(classes, "classes")
    named = spread_join(mixed, classes, ["parse", "extent"])
    repeated = named.where("n > 1").select("ka", "kb", "first", "last")
    # one run of each class is put in order
    one = F.struct("parse", "first", "last", "trigger", (F.col("n") == 1).alias("open"))
    asked = named.where(place == F.col("one")).groupBy("ka", "kb").agg(F.collect_set(one).alias("asked"))
    extents = materialise(_extents(texts.select("ka", "kb", "packed").join(asked, ["ka", "kb"]), length), "edge_runs")
    edges = _edges(extents, length)

    stretches = alike.union(repeated).union(edges).select("ka", "kb", "first", (F.col("last") + length).alias("end"))
    whole = texts.where("n > 1").select("ka", "kb", F.lit(0).alias("first"), F.col("size").alias("end"))
    covered = stretches.union(whole).distinct().groupBy("ka", "kb").agg(F.collect_list(F.struct("first", "end")).alias("covered"))
    return materialise(covered, "covered")


def union(covered: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of (first, end) stretches; touching ones are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((c["first"], c["end"]) for c in covered or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def marked(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Each row of `docs` as struct `doc`, its text's bytes zstd-compressed as `packed`, and `covered` (null where nothing repeats)."""
    check_columns(docs, text)
    data = F.coalesce(F.col(text).cast("string"), F.lit(""))
    doc = F.struct(*([F.col(c) for c in docs.columns if c != text] or [F.lit(0).alias("none")]))
    rows = docs.select(doc.alias("doc"), data.cast("binary").alias("data"), F.xxhash64(data).alias("ka"), F.xxhash64(F.lit(1), data).alias("kb"))
    rows = rows.withColumn("packed", F.pandas_udf(_pack, "binary")("data")).withColumn("size", F.octet_length("data")).drop("data")
    texts = rows.where(F.col("size") >= length).groupBy("ka", "kb").agg(F.first("packed").alias("packed"), F.first("size").alias("size"), F.count("*").alias("n"))
    texts = materialise(texts, "texts")
    keys = materialise(texts.select("ka", "kb", "n").join(spans(texts, length), ["ka", "kb"], "left"), "covered_texts")
    # a text of many rows meets its stretches in many tasks
    long = spread_join(rows.where(F.col("size") >= length), keys, ["ka", "kb"]).select("doc", "packed", "covered")
    return long.union(rows.where(F.col("size") < length).select("doc", "packed", F.lit(None).cast(keys.schema["covered"].dataType).alias("covered")))


def cut(found: DataFrame) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256 and kept of `marked` rows.

    kept_sha256 is that of the remaining bytes; in the text `kept`, a character that a cut splits goes as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data, covered in zip(batch.column(1), batch.column(2)):
                data, removed, at, parts = zstandard.decompress(data.as_py()), union(covered.as_py()), 0, []
                for a, b in [*removed, (len(data), len(data))]:
                    parts.append(data[at:a])
                    at = b
                out.append((len(data), sum(b - a for a, b in removed), len(removed), hashlib.sha256(b"".join(parts)).hexdigest(), "".join(p.decode("utf-8", "ignore") for p in parts)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    doc = found.schema["doc"].dataType.simpleString()
    return found.select("doc", "packed", "covered").mapInArrow(run, f"doc {doc}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept string")


def dedup(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """`docs` with the repeated stretches cut from `text`."""
    kept = cut(marked(docs, text, length))
    return kept.select(*[F.col("kept").alias(c) if c == text else F.col("doc")[c].alias(c) for c in docs.columns])
