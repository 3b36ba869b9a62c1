"""SimHash near-duplicate groups by covering locality-sensitive hashing.

`fingerprints` gives each whole text a 64-bit SimHash of its word shingles. `links` finds all pairs of distinct
fingerprints within a radius of r bits by 2^(r+1)-1 structured masks: bit i gets a vector phi(i) in {1..2^(r+1)-1},
and table v keeps the bits with an odd number of common ones in v and phi(i). The vectors of r differing bits span
at most r of r+1 dimensions, so some v is orthogonal to all of them, and the pair agrees on all bits of its table.

Work stays linear in a bucket: up to `PAIRWISE` members are compared directly; members of larger ones go to hubs. A
pair within 2 bits has a common fingerprint within 1 bit of both: each crowded fingerprint goes once to all 65 of
these, and each such group (of at most 65 members) is a star of true links. `components` joins links to connected
components.

Defined results: null and empty texts have no shingle and fingerprint 0, linked like any other; fewer words than a
shingle make one shingle of the whole sequence; repeated rows fall into one group; an empty table gives an empty
result; other columns are ignored by `fingerprints`. A null id keeps its row, and no group is named by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import check_columns, discard, materialise

BITS = 64
SEED = 42
#: Members of a bucket that are compared pair by pair.
PAIRWISE = 24
_CHUNK = 1 << 15


def shingle_ends(text: str | None, size: int) -> tuple[bytes, list[int], list[int]]:
    """The lower-cased words joined by blanks, and where each shingle starts and ends in it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return b"", [], []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) <= size:
        return joined, [0], [len(joined)]
    return joined, starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()


def simhash(text: str | None, size: int = 3) -> int:
    """Bit k is set if it is set in over half the shingles' hashes."""
    joined, starts, ends = shingle_ends(text, size)
    if not starts:
        return 0
    hash_ = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        h = np.fromiter((hash_(joined[s:e], SEED) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK])), dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """id, fp (the fingerprint as a signed bigint)."""
    check_columns(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), size) for t in batch.column(1)), dtype="<u8", count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"), pa.int64())], ["id", "fp"])

    kept = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, "id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def masks(radius: int) -> list[int]:
    """The covering masks: any two 64-bit strings within `radius` bits agree on one of them at least."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(BITS) if ((1 + i % n) & v).bit_count() % 2) for v in range(1, n + 1)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Links (a, b) between distinct fingerprints of `fps` (column fp, each once) that join all pairs within `radius`.

    With columns `by`, only rows equal in them meet, and each fingerprint is there once for each of their values.

    Small buckets give each of their pairs; large ones give stars whose every edge is a true link and that
    connect whatever a pairwise comparison would have connected.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius: 0, 1 or 2")
    tables = masks(radius)
    spread = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(tables)]))
    at = [*by, "v", "key"]
    keyed = fps.select(*by, "fp", spread.alias("t")).select(*by, "t.v", "t.key", "fp")
    sized = keyed.groupBy(*at).agg(F.count("*").alias("n")).where("n > 1")
    members = keyed.join(sized, at)

    small = members.where(F.col("n") <= PAIRWISE).groupBy(*at).agg(F.collect_list("fp").alias("all"))
    near = F.filter("all", lambda x: (x > F.col("a")) & (_distance(x, F.col("a")) <= radius))
    pairs = small.select(*by, "all", F.explode("all").alias("a")).select(*by, "a", F.explode(near).alias("b"))

    flips = F.explode(F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(BITS)])).alias("flip")
    crowded = members.where(F.col("n") > PAIRWISE).select(*by, "fp").distinct()
    hubs = crowded.select(*by, "fp", flips)
    groups = hubs.groupBy(*by, F.col("fp").bitwiseXOR(F.col("flip")).alias("hub")).agg(F.min("fp").alias("least"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
    # at radius 1 the members of a hub are linked to the hub itself, where that is a fingerprint; at 2 to each other
    centre = F.col("hub") if radius == 1 else F.col("least")
    stars = groups.where(F.array_contains("all", F.col("hub")) if radius == 1 else F.lit(True)).select(*by, centre.alias("a"), F.explode("all").alias("b")).where("a <> b")
    return pairs.union(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of each node of `edges` (a, b), root being the smallest node of its connected component.

    Alternates large and small stars: each round moves links to smaller nodes until only stars are left. A round is
    two joins on narrow rows; its result is written to the shared folder, so lineage stays short.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
    last = sign(now)
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lower.select("u", F.col("m").alias("v"))).distinct()
        before, now = now, materialise(small, "links")
        discard(before)
        here = sign(now)
        if here == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        last = here
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """id, fp and component_id (the smallest id that links reach, its own included) of each row."""
    found = materialise(fingerprints(docs, id_col, text_col, size), "fingerprints")
    first = materialise(found.groupBy("fp").agg(F.min("id").alias("first")), "distinct_fingerprints")
    roots = components(links(first.select("fp"), radius))
    named = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return found.join(named.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def drop_fingerprint_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """`docs` with one row of each of `groups`: that with the smallest id (null last). Of repeated rows one stays; columns are
    kept as they are. `docs` is read more than once and has to give its rows in the same order, as a plain scan does.
    """
    check_columns(docs, id_col, text_col)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("at"), F.col(text_col).alias("text"))
    named = groups(rows.select("at", "text"), "at", "text", size, radius).select(F.col("id").alias("at"), "component_id")
    which = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "at")).alias("which")
    kept = rows.select("id", "at").join(named, "at").groupBy("component_id").agg(which).select(F.col("which.at").alias("at"))
    return rows.select("row", "at").join(kept, "at", "left_semi").select("row.*")


# Near duplicates of a stated similarity: bands of a sketch of five-word shingles propose groups, which may be too wide
# but lose no pair; inside them texts are compared by their sets of shingles, and only what that confirms is linked.
# Shingle fingerprints do not do here: texts of shingle similarity 0.8 differ in about ten of 64 bits, where covering
# masks leave no bits to tell texts apart.

#: Values of a sketch, a byte each, and values in a band: of pairs at 0.8, two in 10^9 agree on none of the 51 bands.
SKETCH, SHINGLE, BAND = 256, 5, 5
#: Texts are copies of each other from this share of common shingles. Pairs of estimates under `CANDIDATE` are not
#: compared; the estimate's standard error at 0.8 is 0.025, `CANDIDATE` lies six below.
SIMILARITY, CANDIDATE = (4, 5), 0.65
#: Bits of the hash that names a text, and texts of equal hashes up to which their list is broadcast.
NODE_BITS, CLASHES = 64, 10_000
#: Words of the texts of a group that one task compares; larger groups are dealt out by pairs of blocks.
BLOCK = 1_000_000
_random = np.random.default_rng(20240229)
_FACTORS = _random.integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.uint64(32)


def sketch(text: str | None, size: int = SHINGLE) -> bytes:
    """A byte of each least value of `SKETCH` permutations of the shingles' hashes; no shingles: empty."""
    joined, starts, ends = shingle_ends(text, size)
    if not starts:
        return b""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(starts), 512):
        h = np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts[at : at + 512], ends[at : at + 512])), np.uint64)
        h = h ^ (h >> _SHIFT)
        np.minimum(least, (h[:, None] * _FACTORS).min(axis=0), out=least)
    return ((least ^ (least >> _SHIFT)) & np.uint64(255)).astype(np.uint8).tobytes()


def _signatures(docs: DataFrame) -> DataFrame:
    """node (hash of the text), n (number of words) and sketch of distinct texts with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_py() for t in batch.column(1)]
            n = [len(t.encode("utf-8", "surrogatepass").split()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array([sketch(t) for t in texts], pa.binary())], ["node", "n", "sketch"])

    texts = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("node", F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "node bigint, n bigint, sketch binary").dropDuplicates(["node"])


def _bands(found: DataFrame) -> DataFrame:
    """node, key: a row for each band of each sketch; the key holds the band's number and its values."""
    count = SKETCH // BAND

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, SKETCH)[:, : count * BAND]
            keys = values.reshape(-1, count, BAND).astype(np.int64) @ (np.int64(1) << (8 * np.arange(BAND))) + (np.arange(count) << (8 * BAND))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(zero_copy_only=False), count)), pa.array(keys.ravel())], ["node", "key"])

    return found.select("node", "sketch").mapInArrow(run, "node bigint, key bigint")


def _alike(pairs: DataFrame, found: DataFrame, least: float = CANDIDATE) -> DataFrame:
    """The pairs (a, b) with the estimate of their similarity from the sketches, from `least` on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(n, SKETCH) for k in (2, 3))
            estimate = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            keep = pa.array(estimate >= least)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (batch.column(0), batch.column(1), pa.array(estimate))], ["a", "b", "estimate"])

    sketches = lambda c: found.select(F.col("node").alias(c), F.col("sketch").alias(f"{c}_sketch"))
    both = pairs.distinct().join(sketches("a"), "a").join(sketches("b"), "b").select("a", "b", "a_sketch", "b_sketch")
    return both.mapInArrow(run, "a bigint, b bigint, estimate double")


def _pairs(members: DataFrame) -> DataFrame:
    """All pairs (a, b) of the members (key, node) of small groups."""
    small = members.groupBy("key").agg(F.collect_list("node").alias("all"))
    return small.select("all", F.explode("all").alias("a")).select("a", F.explode(F.filter("all", lambda x: x > F.col("a"))).alias("b"))


def _led(rows: DataFrame, leaders: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Compares the members of crowded groups (key, node, waiting) with their leaders (key, leader): the links found, and
    the members that are not done with.

    Texts like one leader are joined by it. One that is like none is waiting, and may lead. Of those that are joined, a
    text still has to meet the leaders to come if it can be like one that is waiting: sketches that differ in so many
    places from each other differ from a leader's in numbers of places that are no farther apart. A group without waiting
    members is done.
    """
    met = rows.join(leaders, "key").where("node <> leader")
    compared = materialise(_alike(met.select(F.col("leader").alias("a"), F.col("node").alias("b")), found, -1.0), "led")
    seen = met.join(compared, (met.leader == compared.a) & (met.node == compared.b)).select("key", "node", "leader", "waiting", "estimate")
    best = seen.groupBy("key", "node").agg(F.max("estimate").alias("best"), F.first("waiting").alias("waiting"))
    apart = best.where(F.col("waiting") & (F.col("best") < CANDIDATE)).select("key", "node")
    # the likest of the waiting texts, for each leader
    reach = seen.join(apart, ["key", "node"], "left_semi").groupBy("key", "leader").agg(F.max("estimate").alias("reach"))
    near = seen.join(reach, ["key", "leader"]).groupBy("key", "node").agg(F.max("estimate").alias("best"), F.max(F.col("estimate") - F.col("reach")).alias("most"), F.first("waiting").alias("waiting"))
    left = near.where((F.col("waiting") & (F.col("best") < CANDIDATE)) | (F.col("most") <= 1 - CANDIDATE + 0.01)).join(leaders.select("key", F.col("leader").alias("node")), ["key", "node"], "left_anti")
    return compared.where(F.col("estimate") >= CANDIDATE), materialise(left.select("key", "node", (F.col("waiting") & (F.col("best") < CANDIDATE)).alias("waiting")), "waiting")


def _candidates(found: DataFrame, bands: DataFrame, sized: DataFrame) -> DataFrame:
    """Links (a, b) between alike sketches whose components hold every pair of near duplicates; `sized`: bands of several
    texts, and their number.

    Bands with few texts give their pairs. In a crowded band all texts are compared with one leader, which is enough where
    they are copies. Where it is not, because texts meet in the band by chance, the texts that are left are split by each
    second band besides: near duplicates that agree in one band agree in others. Groups that stay crowded are compared
    with more and more leaders. Every link is between texts of alike sketches, so chance meetings join nothing.
    """
    members = bands.join(sized, "key")
    crowded = members.where(F.col("n") > PAIRWISE)
    links = [_alike(_pairs(members.where(F.col("n") <= PAIRWISE)), found)]
    leaders = sized.where(F.col("n") > PAIRWISE).select("key", F.col("least").alias("leader"))
    led, left = _led(crowded.select("key", "node", F.lit(True).alias("waiting")), leaders, found)
    links.append(led)
    if not left.isEmpty():
        other = bands.select("node", F.col("key").alias("other"))
        twice = left.select("key", "node").join(other, "node").where("key <> other").select("node", F.struct(F.least("key", "other").alias("one"), F.greatest("key", "other").alias("two")).alias("key")).distinct()
        many = materialise(twice.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "double_bands")
        both = twice.join(many, "key")
        links.append(_alike(_pairs(both.where(F.col("n") <= PAIRWISE)), found))
        left, several = materialise(both.where(F.col("n") > PAIRWISE).select("key", "node", F.lit(True).alias("waiting")), "waiting"), 1
        while not left.isEmpty():
            place = F.row_number().over(Window.partitionBy("key").orderBy("node"))
            first = materialise(left.where("waiting").withColumn("place", place).where(F.col("place") <= several).select("key", F.col("node").alias("leader")), "leaders")
            led, left = _led(left, first, found)
            links.append(led)
            several *= 4
    return reduce(DataFrame.union, [x.select("a", "b") for x in links]).distinct()


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the text's shingles."""
    joined, starts, ends = shingle_ends(text, size)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, len(starts)))


def linked(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of positions that connect what all pairs of `sets` (distinct values, none empty) of Jaccard similarity
    `SIMILARITY` would connect. A set is compared with all that no link has reached yet.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    each = np.split(flat, np.cumsum(sizes)[:-1])
    p, q = SIMILARITY
    waiting, reached, out = np.arange(len(sets)), [], []
    marked = np.zeros(len(values), dtype=bool)
    while len(waiting):
        if reached:
            x = reached.pop()
        else:
            x = int(waiting[0])
            flat, waiting = flat[sizes[x] :], waiting[1:]
            if not len(waiting):
                break
        marked[each[x]] = True
        ends = np.cumsum(sizes[waiting])
        common = np.add.reduceat(marked[flat], ends - sizes[waiting], dtype=np.int64)
        marked[each[x]] = False
        near = (p + q) * common >= p * (sizes[x] + sizes[waiting])
        if near.any():
            found = waiting[near].tolist()
            out += [(x, y) for y in found]
            reached += found
            flat, waiting = flat[np.repeat(~near, sizes[waiting])], waiting[~near]
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(node, root) of the texts of `docs` (node, text) that are near duplicates of others: shingle similarity 0.8."""
    found = materialise(_signatures(docs), "signatures")
    bands = _bands(found)
    sized = materialise(bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "bands")
    wide = materialise(components(_candidates(found, bands, sized)).join(found.select("node", "n"), "node"), "candidates")
    discard(sized)
    blocks = wide.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    own = wide.join(blocks, "root").select("node", "root", "blocks", F.pmod(F.xxhash64("node", "root"), "blocks").alias("own"))
    # All pairs of blocks hold all pairs of texts.
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_remove(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), F.col("own"))))
    tiles = own.select("node", "root", "own", other.alias("other")).select("node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    texts = docs.join(wide.select("node"), "node", "left_semi").dropDuplicates(["node"])

    def run(group: pa.Table) -> pa.Table:
        nodes = group.column("node").to_numpy()
        pairs = np.array(linked([shingles(t.as_py()) for t in group.column("text")]), dtype=np.int64).reshape(-1, 2)
        return pa.table({"a": nodes[pairs[:, 0]], "b": nodes[pairs[:, 1]]})

    linked_texts = components(tiles.join(texts, "node").select("root", "i", "j", "node", "text").groupBy("root", "i", "j").applyInArrow(run, "a bigint, b bigint"))
    discard(wide)
    discard(found)
    return linked_texts


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row (struct), id, at (the row's number), text and node of each row: a hash that no two texts share.

    A second hash shows which texts share the first one; these get another. `docs` is read more than once and has to
    give its rows in the same order, as a plain scan does.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("at"), text.alias("text"))
    rows = rows.withColumn("node", F.shiftright(F.xxhash64("text"), 64 - NODE_BITS))
    second = F.xxhash64(F.lit(1), "text")
    shared = materialise(rows.groupBy("node").agg(F.min(second).alias("lo"), F.max(second).alias("hi")).where("lo <> hi").select("node", F.lit(True).alias("again")), "clashes")
    if n := shared.count():
        rows = rows.join(F.broadcast(shared) if n <= CLASHES else shared, "node", "left")
        rows = rows.withColumn("node", F.when(F.col("again"), F.xxhash64(F.lit(2), "text")).otherwise(F.col("node"))).drop("again")
    return rows


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of exact and near copies: that with the smallest id (null last).

    Texts without words are copies of each other only if they are equal; null texts are empty; of repeated rows one
    stays; an empty table gives an empty result; other columns, whatever their names, are kept as they are.
    """
    check_columns(docs, id_col, text_col)
    rows = _named(docs, id_col, text_col)
    roots = materialise(near_duplicates(rows.select("node", "text")), "near_duplicates")
    thin = rows.select("node", "id", "at").join(roots, "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct(F.col("id").isNull().alias("none"), "id", "at").alias("which"))
    kept = thin.groupBy("root").agg(F.min("which").alias("which")).select(F.col("which.at").alias("at"))
    return rows.select("row", "at").join(kept, "at", "left_semi").select("row.*")
