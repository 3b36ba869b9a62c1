"""Hard-negative mining with an STR-packed R-tree over integer vectors.

Rows are packed by sort-tile-recursive: cut into slabs of equal counts along one coordinate after the other (the label
first, so that most boxes hold one label, then the widest coordinates). The upper level (`Tiles`) has its cuts from a
bounded sample (`SAMPLE`, a documented parameter) and at most `TILES` tiles; every row is dealt to its tile and each
tile's box is the exact range of all its rows, so bounds hold whatever the sample was. Tiles of many rows are dealt into
blocks. Inside a task, the rows of a block are packed further, exactly, down to leaves of `LEAF` rows.

For a query q, a box with ranges [lo, hi] bounds the inner product by the sum over coordinates of min and max of q*lo and
q*hi. A best-first queue takes boxes by their upper bound (cut off at the window's upper end), leaves out boxes whose
interval lies outside the score window or whose labels don't fit, and stops at the first box strictly below the k-th
score so far; ties are looked at, as they go to the smaller id. A query first visits its best tile; what it finds there
is the k-th score that other tiles are measured by before anything is sent to them.

`top` answers windows: the first k rows of the same label, or of other labels, with scores in [low, high]. `mine` finds
positives with one such search, and with their scores the windows of the negatives in a second one. All rows are searched
exactly; a box is only left out where its bound proves that it can't matter.

Of rows with equal label and vector only the smallest ids can be returned, as ties go to the smaller id: more than
`k` + 1 of them are not looked at. Equal anchors (label and vector) are searched once, and the answers dealt back to
them. Scores are exact: products of doubles where 2^53 holds all sums, of 64-bit integers elsewhere.

Defined results: vectors that are null, of another length than most (ties: the shorter), hold null or non-finite entries
or entries of 2^24 and more after scaling (their products need not fit a long) take no part, nor do rows with a null label or id; a zero vector does; repeated
rows (equal id, label and vector) count once; anchors without positives, and positives without negatives, give no
rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import check_columns, discard, materialise, spread_join

SAMPLE = 20_000
#: Tiles at most; rows of a tile that few rows give, and rows of a block.
TILES, SMALL, BLOCK = 1024, 512, 8192
LEAF, FAN = 128, 8
#: Coordinates, the label besides, that the upper level is cut along.
CUT = 3
POSITIVES, NEGATIVES = 5, 10
SCALE = 256
#: Entries below this, in vectors of up to 16,384, have inner products that a long holds.
LARGEST = 1 << 24
_ASK = "key bigint, label bigint, q array<bigint>, low array<bigint>, high array<bigint>, kth array<bigint>"
#: Below all scores, and above them.
_LEAST, _MOST = -(1 << 62), 1 << 62


def integers(v: Column, scale: int = SCALE) -> Column:
    return F.transform(v.cast("array<double>"), lambda c: F.floor(c * F.lit(float(scale))).cast("bigint"))


def usable(v: Column, scale: int = SCALE) -> Column:
    bad = F.exists(v.cast("array<double>"), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= LARGEST / scale))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def pack(keys: list[np.ndarray], rows: np.ndarray, tiles: int) -> list[np.ndarray]:
    """Sort-tile-recursive: `rows` in about `tiles` parts of equal counts, cut by one key after the other."""
    if tiles <= 1 or len(rows) < 2:
        return [rows]
    slabs = tiles if len(keys) == 1 else max(2, round(tiles ** (1 / len(keys))))
    parts = np.array_split(rows[np.argsort(keys[0][rows], kind="stable")], min(slabs, len(rows)))
    if len(keys) == 1:
        return parts
    return [p for part in parts for p in pack(keys[1:], part, max(1, round(tiles / slabs)))]


def widest(x: np.ndarray, count: int) -> list[int]:
    return np.argsort(-x.var(axis=0), kind="stable")[:count].tolist() if len(x) else []


def bounds(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of q with points of each box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return low @ up + high @ down, high @ up + low @ down


@dataclass
class Tiles:
    """The upper level: cut points by a tree of slabs, then boxes of all rows."""

    axes: list[int]  # coordinate of each level; -1: the label
    cuts: dict[tuple[int, ...], np.ndarray]  # by the slabs taken so far
    number: dict[tuple[int, ...], int]
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    first_label: np.ndarray | None = None
    last_label: np.ndarray | None = None
    rows: np.ndarray | None = None

    @classmethod
    def of(cls, x: np.ndarray, labels: np.ndarray, tiles: int) -> Tiles:
        axes = [-1, *widest(x, CUT)]
        cuts: dict[tuple[int, ...], np.ndarray] = {}
        number: dict[tuple[int, ...], int] = {}

        def split(path: tuple[int, ...], rows: np.ndarray, left: int) -> None:
            if len(path) == len(axes):
                number[path] = len(number)
                return
            axis, levels = axes[len(path)], len(axes) - len(path)
            slabs = max(1, round(left ** (1 / levels))) if levels > 1 else left
            values = labels[rows] if axis < 0 else x[rows, axis]
            at = np.sort(values)[[len(rows) * s // slabs for s in range(1, slabs)]] if len(rows) else np.zeros(0)
            cuts[path] = np.unique(at)
            own = np.searchsorted(cuts[path], values, side="right")
            for s in range(len(cuts[path]) + 1):
                split((*path, s), rows[own == s], max(1, round(left / slabs)))

        split((), np.arange(len(x)), tiles)
        return cls(axes, cuts, number)

    def tile(self, x: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The tile of each row."""
        out = np.zeros(len(x), dtype=np.int64)
        waiting: list[tuple[tuple[int, ...], np.ndarray]] = [((), np.arange(len(x)))]
        while waiting:
            path, rows = waiting.pop()
            if not len(rows):
                continue
            if len(path) == len(self.axes):
                out[rows] = self.number[path]
                continue
            axis = self.axes[len(path)]
            own = np.searchsorted(self.cuts[path], labels[rows] if axis < 0 else x[rows, axis], side="right")
            waiting += [((*path, s), rows[own == s]) for s in range(len(self.cuts[path]) + 1)]
        return out

    def wanted(self, q: np.ndarray, label: int, same: bool, windows: list[tuple[int, int, float]]) -> list[tuple[float, int]]:
        """(upper bound, tile) of the tiles that a query with these windows (low, high, k-th score so far) has to visit."""
        least, most = bounds(self.low, self.high, q)
        fits = (self.first_label <= label) & (label <= self.last_label) if same else (self.first_label != label) | (self.last_label != label)
        ok = np.zeros(len(most), dtype=bool)
        for low, high, kth in windows:
            ok |= (most >= low) & (least <= high) & (np.minimum(most, high) >= kth)
        return [(float(most[t]), int(t)) for t in np.flatnonzero(ok & fits & (self.rows > 0))]


class Tree:
    """The R-tree of a block: leaves of `LEAF` rows, `FAN` nodes below a node, root last."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, labels: np.ndarray):
        keys = [labels, *(x[:, a] for a in widest(x, CUT))]
        self.leaves = pack(keys, np.arange(len(x)), -(-len(x) // LEAF))
        self.x, self.ids, self.labels = x, ids, labels
        boxes = [(x[r].min(axis=0), x[r].max(axis=0), labels[r].min(), labels[r].max()) for r in self.leaves]
        self.children: list[list[int]] = [[] for _ in boxes]
        level = list(range(len(boxes)))
        while len(level) > 1:  # leaves come in packing order, so neighbours share a parent
            above = []
            for at in range(0, len(level), FAN):
                kids = level[at : at + FAN]
                boxes.append((np.min([boxes[k][0] for k in kids], axis=0), np.max([boxes[k][1] for k in kids], axis=0), min(boxes[k][2] for k in kids), max(boxes[k][3] for k in kids)))
                self.children.append(kids)
                above.append(len(boxes) - 1)
            level = above
        self.low, self.high = np.stack([b[0] for b in boxes]), np.stack([b[1] for b in boxes])
        self.first, self.last = np.array([b[2] for b in boxes]), np.array([b[3] for b in boxes])

    def search(self, q: np.ndarray, label: int, same: bool, windows: list[tuple[int, int, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high, k-th score so far) the ids and scores of the first k rows, best first."""
        least, most = bounds(self.low, self.high, q)
        fits = (self.first <= label) & (label <= self.last) if same else (self.first != label) | (self.last != label)
        scored: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out = []
        for low, high, kth in windows:
            upper = np.minimum(most, high)
            open_ = fits & (most >= low) & (least <= high)
            ids, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
            root = len(self.children) - 1
            queue = [(-upper[root], root)] if open_[root] else []
            while queue:
                bound, node = heapq.heappop(queue)
                if -bound < kth:
                    break
                if self.children[node]:
                    for kid in self.children[node]:
                        if open_[kid] and upper[kid] >= kth:
                            heapq.heappush(queue, (-upper[kid], kid))
                    continue
                if node not in scored:
                    rows = self.leaves[node]
                    rows = rows[(self.labels[rows] == label) == same]
                    scored[node] = self.ids[rows], self.x[rows] @ q
                here, s = scored[node]
                good = np.flatnonzero((s >= max(low, kth)) & (s <= high))
                if len(good):
                    ids, scores = np.concatenate([ids, here[good]]), np.concatenate([scores, s[good]])
                    first = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[first], scores[first]
                    if len(ids) == k:
                        kth = max(kth, scores[-1])
            out.append((ids, scores))
        return out


def _matrix(column: pd.Series, exact: bool) -> np.ndarray:
    """Doubles where they hold all sums exactly, else 64-bit integers."""
    return np.stack(column.to_numpy()).astype(np.float64 if exact else np.int64)


@dataclass
class Index:
    tiles: Tiles
    rows: DataFrame  # tile, id, label, v
    blocks: list[int]  # of each tile
    exact: bool


def prepare(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, v (integers) of the rows that take part, each once."""
    v = F.col(vector_col)
    rows = vectors.where(usable(v, scale) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), integers(v, scale).alias("v")).distinct()


def index(rows: DataFrame, k: int, small: int = SMALL, tiles: int = TILES, block: int = BLOCK) -> Index | None:
    """Packs every row of `rows` (id, label, v of one length); None for an empty table."""
    order = Window.partitionBy("label", "v").orderBy("id")
    kept = materialise(rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1).drop("place"), "negatives_rows")
    total = kept.agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.max(F.size("v")).alias("size")).first()
    if not total.n:
        return None
    exact = (int(total.most) + 1) ** 2 * total.size < 1 << 53
    some = kept.orderBy(F.xxhash64("id", "label"), "id").limit(SAMPLE).toPandas()
    wanted = max(1, min(tiles, max(min(128, total.n // small), total.n // block)))
    made = Tiles.of(np.stack(some["v"].to_numpy()), some["label"].to_numpy(), wanted)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(tile=made.tile(np.stack(pdf["v"].to_numpy()), pdf["label"].to_numpy()))

    placed = materialise(kept.mapInPandas(assign, "id bigint, label bigint, v array<bigint>, tile bigint"), "negatives_index")
    discard(kept)

    def box(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for tile, part in pdf.groupby("tile"):
                x = np.stack(part["v"].to_numpy())
                yield pd.DataFrame({"tile": tile, "place": range(-1, x.shape[1]), "low": [part["label"].min(), *x.min(axis=0)], "high": [part["label"].max(), *x.max(axis=0)], "n": len(x)})

    sides = placed.mapInPandas(box, "tile bigint, place int, low bigint, high bigint, n bigint").groupBy("tile", "place").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    count = len(made.number)  # about `tiles` at most, so what follows is bounded
    made.low, made.high = (np.zeros((count, total.size), dtype=np.float64 if exact else np.int64) for _ in range(2))
    made.first_label, made.last_label, made.rows = (np.zeros(count, dtype=np.int64) for _ in range(3))
    for r in sides.collect():
        if r.place < 0:
            made.first_label[r.tile], made.last_label[r.tile], made.rows[r.tile] = r.low, r.high, r.n
        else:
            made.low[r.tile, r.place], made.high[r.tile, r.place] = r.low, r.high
    return Index(made, placed, [max(1, -(-int(n) // block)) for n in made.rows], exact)


def _visit(made: Index, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """key, window, id, score: what the asked tiles (columns of `_ASK`, tile and block) hold for each window."""
    exact = made.exact
    blocks = F.get(F.array(*[F.lit(n) for n in made.blocks]), F.col("tile").cast("int"))
    dealt = made.rows.withColumn("block", F.pmod(F.xxhash64("id", "label"), blocks).cast("int"))

    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = {"key": [], "window": [], "id": [], "score": []}
        if len(left) and len(right):
            tree = Tree(_matrix(left["v"], exact), left["id"].to_numpy(), left["label"].to_numpy())
            for key, label, q, low, high, kth in zip(right["key"], right["label"], _matrix(right["q"], exact), right["low"], right["high"], right["kth"]):
                for w, (ids, scores) in enumerate(tree.search(q, label, same, list(zip(low.tolist(), high.tolist(), kth.tolist())), k)):
                    parts["key"] += [key] * len(ids)
                    parts["window"] += [w] * len(ids)
                    parts["id"] += ids.tolist()
                    parts["score"] += [int(s) for s in scores]
        return pd.DataFrame(parts)

    return dealt.groupBy("tile", "block").cogroup(asks.groupBy("tile", "block")).applyInPandas(look, "key bigint, window int, id bigint, score bigint")


def top(made: Index, asks: DataFrame, same: bool, k: int) -> DataFrame:
    """key, window, id, score, rank: for each window of each ask the first k rows of the same (or of another) label.

    `asks`: key, label, q and arrays low and high, a window for each place; each key once.
    """
    tiles, blocks, exact = made.tiles, made.blocks, made.exact

    def route(first: bool):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in frames:
                out = []
                for row, q in zip(pdf.itertuples(index=False), _matrix(pdf["q"], exact) if len(pdf) else ()):
                    windows = list(zip(row.low.tolist(), row.high.tolist(), row.kth.tolist()))
                    meet = tiles.wanted(q, row.label, same, [(low, high, _LEAST) for low, high, _ in windows])
                    best = max(meet, key=lambda m: (m[0], -m[1]), default=None)
                    chosen = [m for m in ([best] if first else tiles.wanted(q, row.label, same, windows)) if m is not None and first == (m == best)]
                    out += [(*row, t, b) for _, t in chosen for b in range(blocks[t])]
                yield pd.DataFrame(out, columns=[*pdf.columns, "tile", "block"])

        return run

    schema = f"{_ASK}, tile bigint, block int"
    start = asks.select("key", "label", "q", "low", "high", F.transform("low", lambda _: F.lit(_LEAST)).alias("kth"))
    order = Window.partitionBy("key", "window").orderBy(F.desc("score"), "id")
    near = materialise(_visit(made, start.mapInPandas(route(True), schema), same, k), "negatives_near")
    known = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("known"))
    so_far = F.transform("low", lambda _, w: F.coalesce(F.try_element_at("known", w), F.lit(_LEAST)))
    again = start.join(known, "key", "left").withColumn("kth", so_far).drop("known")
    far = _visit(made, again.mapInPandas(route(False), schema), same, k)
    return near.union(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES,
    window: tuple[int, int] = (30, 90), scale: int = SCALE, small: int = SMALL, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `anchors`: a condition on `vectors`. Negatives have scores from window[0] to window[1] hundredths of the positive's.
    """
    check_columns(vectors, id_col, vector_col, label_col)
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    v = F.col(vector_col)
    size = vectors.where(usable(v, scale)).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").first()
    alike = vectors.where(F.size(v) == size.d) if size else vectors.limit(0)
    made = index(prepare(alike, id_col, vector_col, label_col, scale), max(positives, negatives), small, block=block)
    if made is None:
        return vectors.sparkSession.createDataFrame([], schema)
    asked = materialise(prepare(alike.where(anchors), id_col, vector_col, label_col, scale), "negatives_anchors")
    keys = materialise(asked.groupBy("label", "v").agg(F.min(F.xxhash64("id", "label", "v")).alias("key"), F.count("*").alias("n")), "negatives_keys")

    every = keys.select("key", "label", F.col("v").alias("q"), F.array(F.lit(_LEAST)).alias("low"), F.array(F.lit(_MOST)).alias("high"))
    near = top(made, every, True, positives + 1).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))
    scores = F.filter(F.array_distinct(F.transform("near", lambda p: p["score"])), lambda s: s >= 0)  # a negative one has no window
    near = materialise(near.withColumn("scores", scores), "negatives_positives")
    part = lambda s, share: s.cast("decimal(20,0)") * F.lit(share) / F.lit(100).cast("decimal(3,0)")
    windows = keys.join(near.where(F.size("scores") > 0), "key").select(
        "key", "label", F.col("v").alias("q"),
        F.transform("scores", lambda s: F.ceil(part(s, window[0])).cast("bigint")).alias("low"), F.transform("scores", lambda s: F.floor(part(s, window[1])).cast("bigint")).alias("high"),
    )
    hard = top(made, windows, False, negatives).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("window", "rank", "id", "score"))).alias("hard"))
    answers = materialise(keys.join(near, "key").join(hard, "key").select("label", "v", "n", "near", "scores", "hard"), "negatives_answers")

    # an anchor is not its own positive; what is left of the list is `positives` long at most
    own = F.slice(F.filter("near", lambda p: p["id"] != F.col("id")), 1, positives)
    pairs = spread_join(asked, answers, ["label", "v"]).select("id", F.explode(own).alias("p"), "scores", "hard")
    fits = F.filter("hard", lambda h: h["window"] == F.array_position("scores", F.col("p.score")) - 1)
    return pairs.select("id", "p", F.explode(fits).alias("h")).select(
        F.col("id").alias("anchor_id"), F.col("p.id").alias("positive_id"), F.col("h.rank").alias("rank"), F.col("h.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("h.score").alias("negative_score"),
    )
