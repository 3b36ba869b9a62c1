"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

`build_tree` splits a bounded sample of the vectors (`SAMPLE`, a documented parameter) by k-means, level by level, the
deeper the more rows there are, so that a leaf holds about `LEAF` rows at every size (up to the sample's finest split,
`SAMPLE` / 2 leaves; larger tables want a larger sample). Every vector is then indexed under the leaf it descends to. A
query walks the tree through a priority queue of the branches not taken, nearest centre first, and visits leaves in
that order, until it has made the calibrated number of visits and these leaves hold enough rows for its k neighbours.
`calibrate` compares a fixed number of calibration vectors with all rows by brute force and widens the visits until the
wanted share of true neighbours lies in visited leaves. Queries and rows then meet by cell: the largest subtrees of at most `BLOCK` rows. A query goes once
to each cell that it visits a leaf of, with the list of these leaves, and gets k rows back; a leaf with more rows than
that is a cell of its own, dealt into blocks over many tasks. The distance is computed on the original vectors in double precision.

Equal vectors tie, and ties go to the smaller id, so of each distinct vector only the k + 1 smallest ids can ever be
returned: that keeps results whole while a vector that a third of all rows share costs k + 1 rows. Equal queries are
searched once.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, as query or as candidate; with fewer candidates than k all are returned; rows with a null id take no part; repeated rows count once; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import check_columns, materialise

SAMPLE = 20_000
BRANCHES = 16
#: Rows in a leaf, about, however many there are.
LEAF = 128
CALIBRATION = 200
BLOCK = 4096


@dataclass
class Tree:
    """`children[i]` are node numbers; a node without children is a leaf. Centres are rows of `centres`."""

    centres: np.ndarray
    children: list[list[int]]

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.zeros(len(x), dtype=np.int64)
        waiting = [0]
        while waiting:
            node = waiting.pop()
            kids = self.children[node]
            if kids and (rows := np.flatnonzero(at == node)).size:
                at[rows] = np.asarray(kids)[_nearest(x[rows], self.centres[kids])]
                waiting += kids
        return at

    def visits(self, q: np.ndarray, most: int, held: np.ndarray | None = None, rows: int = 0) -> list[int]:
        """Leaves in the order of a best-bin-first walk: `most` of them, and on until they hold (`held`, by node) `rows` rows."""
        queue, found, have = [(0.0, 0)], [], 0
        while queue and (len(found) < most or have < rows):
            _, node = heapq.heappop(queue)
            while kids := self.children[node]:
                away = ((self.centres[kids] - q) ** 2).sum(axis=1)
                best = int(away.argmin())
                for k, (d, kid) in enumerate(zip(away.tolist(), kids)):
                    if k != best:
                        heapq.heappush(queue, (d, kid))
                node = kids[best]
            found.append(node)
            have += 0 if held is None else int(held[node])
        return found

    def cells(self, held: np.ndarray, most: int) -> dict[int, tuple[int, int]]:
        """For each leaf, the topmost node above it that holds `most` rows at most (or the leaf), and the rows there."""
        total, found = held.copy(), {}
        for node in range(len(self.children) - 1, -1, -1):  # children come after their parents
            total[node] += sum(total[kid] for kid in self.children[node])
        waiting = [(0, None)]
        while waiting:
            node, cell = waiting.pop()
            cell = node if cell is None and (total[node] <= most or not self.children[node]) else cell
            waiting += [(kid, cell) for kid in self.children[node]]
            if not self.children[node]:
                found[node] = (cell, int(total[cell]))
        return found

    @property
    def leaves(self) -> int:
        return sum(not kids for kids in self.children)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def _kmeans(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    centres = x[random.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def build_tree(sample: np.ndarray, leaf: float, branches: int = BRANCHES, rounds: int = 8, seed: int = 3) -> Tree:
    """Splits nodes until they hold about `leaf` vectors of the sample or cannot be split."""
    random = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0) if len(sample) else sample
    centres, children = [sample.mean(axis=0) if len(sample) else np.zeros(0)], [[]]
    waiting = [(0, sample)]
    while waiting:
        node, x = waiting.pop()
        if len(x) <= max(leaf, 2):
            continue
        k = min(branches, max(2, int(np.ceil(len(x) / max(leaf, 1)))), len(x))
        c = _kmeans(x, k, rounds, random)
        own = _nearest(x, c)
        parts = [p for p in range(k) if (own == p).any()]
        if len(parts) < 2:
            continue
        for p in parts:
            children[node].append(len(children))
            waiting.append((len(children), x[own == p]))
            centres.append(c[p])
            children.append([])
    return Tree(np.array(centres), children)


def usable(v: Column) -> Column:
    """True for vectors that take part."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


def _distances(block: np.ndarray, q: np.ndarray) -> np.ndarray:
    away = block - q
    return np.sqrt((away * away).sum(axis=1))


def _best(ids: np.ndarray, away: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest distances, ties by id."""
    if len(ids) > 4 * k:
        near = np.flatnonzero(away <= np.partition(away, k - 1)[k - 1])
        return near[np.lexsort((ids[near], away[near]))[:k]]
    return np.lexsort((ids, away))[:k]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


@dataclass
class Index:
    tree: Tree
    rows: DataFrame  # leaf, id, v
    visits: int
    k: int
    held: np.ndarray  # rows under each node that is a leaf


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = 0.96) -> Index:
    """Indexes every row and calibrates the leaf visits to the wanted recall."""
    check_columns(vectors, id_col, vector_col)
    v = F.col(vector_col).cast("array<double>")
    fit = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"))).distinct()
    sizes = fit.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = sizes.d if sizes else 0
    order = Window.partitionBy("v").orderBy("id")
    least = fit.where(F.size("v") == size).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1).select("id", "v")
    rows = materialise(least, "vectors")
    n = rows.count()
    some = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(SAMPLE).toPandas()
    tree = build_tree(_matrix(some["v"]) if len(some) else np.zeros((0, size)), max(2, LEAF * min(n, SAMPLE) / max(n, 1)))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pdf.assign(leaf=tree.descend(_matrix(pdf["v"])))

    indexed = materialise(rows.mapInPandas(assign, "id bigint, v array<double>, leaf bigint"), "index") if n else rows.withColumn("leaf", F.lit(0).cast("bigint"))
    held = np.zeros(len(tree.children), dtype=np.int64)
    for row in indexed.groupBy("leaf").count().collect():  # a number for each leaf, at most half as many as the sample
        held[row.leaf] = row["count"]
    made = Index(tree, indexed, tree.leaves, k, held)
    made.visits = calibrate(made, recall)
    return made


def calibrate(made: Index, recall: float) -> int:
    """Leaf visits after which the share `recall` of the calibration vectors' true neighbours lies in visited leaves."""
    probes = made.rows.orderBy(F.xxhash64("id", F.lit(2)), "id").limit(CALIBRATION).toPandas()
    if not len(probes):
        return 1
    ids, q, k = probes["id"].to_numpy(), _matrix(probes["v"]), made.k

    def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if not len(pdf):
                continue
            x, own, leaf = _matrix(pdf["v"]), pdf["id"].to_numpy(), pdf["leaf"].to_numpy()
            for p in range(len(ids)):
                away = np.where(own == ids[p], np.inf, _distances(x, q[p]))
                best = _best(own, away, k)
                yield pd.DataFrame({"probe": p, "id": own[best], "leaf": leaf[best], "away": away[best]})

    order = Window.partitionBy("probe").orderBy("away", "id")
    true = made.rows.mapInPandas(nearest, "probe int, id bigint, leaf bigint, away double").where("away < double('infinity')").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    wanted: dict[int, list[int]] = {}
    for row in true.select("probe", "leaf").collect():
        wanted.setdefault(row.probe, []).append(row.leaf)
    ranks = []
    for p, leaves in wanted.items():
        place = {leaf: r for r, leaf in enumerate(made.tree.visits(q[p], made.tree.leaves))}
        ranks += [place[leaf] + 1 for leaf in leaves]
    return int(np.sort(ranks)[int(np.ceil(recall * len(ranks))) - 1]) if ranks else 1


def search(made: Index, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, id and score: the k nearest found for each query, without the query's own row."""
    k, tree, visits, held = made.k, made.tree, made.visits, made.held
    size = tree.centres.shape[1]
    asked = queries.select(F.col(id_col).cast("bigint").alias("query_id"), F.col(vector_col).cast("array<double>").alias("q"))
    asked = materialise(asked.where(F.col("query_id").isNotNull() & usable(F.col("q")) & (F.size("q") == size)).distinct(), "asked")
    distinct = asked.groupBy("q").agg(F.min("query_id").alias("key"))

    cell_of = tree.cells(held, BLOCK)
    spark = made.rows.sparkSession
    places = F.broadcast(spark.createDataFrame([(leaf, cell, max(1, -(-rows // BLOCK))) for leaf, (cell, rows) in cell_of.items()] or [(0, 0, 1)], "leaf bigint, cell bigint, blocks int"))

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for key, q in zip(pdf["key"], pdf["q"]):
                cells: dict[int, list[int]] = {}
                for leaf in tree.visits(np.asarray(q, dtype=np.float64), visits, held, k + 1):
                    cells.setdefault(cell_of[leaf][0], []).append(leaf)
                blocks = [max(1, -(-cell_of[leaves[0]][1] // BLOCK)) for leaves in cells.values()]
                yield pd.DataFrame({"cell": list(cells), "blocks": blocks, "key": key, "q": [q] * len(cells), "leaves": list(cells.values())})

    walked = distinct.mapInPandas(walk, "cell bigint, blocks int, key bigint, q array<double>, leaves array<bigint>")
    dealt = made.rows.join(places, "leaf").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).select("cell", "block", "leaf", "id", "v")
    walked = walked.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "q", "leaves")

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"key": [], "id": [], "score": []})
        x, ids = _matrix(left["v"]), left["id"].to_numpy()
        here, of = np.unique(left["leaf"].to_numpy(), return_inverse=True)
        parts = []
        for key, q, leaves in zip(right["key"], right["q"], right["leaves"]):
            rows = np.flatnonzero(np.isin(here, leaves)[of])
            if len(rows):
                away = _distances(x[rows], np.asarray(q, dtype=np.float64))
                best = _best(ids[rows], away, k + 1)
                parts.append(pd.DataFrame({"key": key, "id": ids[rows][best], "score": away[best]}))
        return pd.concat(parts) if parts else pd.DataFrame({"key": [], "id": [], "score": []})

    near = dealt.groupBy("cell", "block").cogroup(walked.groupBy("cell", "block")).applyInPandas(compare, "key bigint, id bigint, score double")
    best = near.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("score", "id"))).where(F.col("n") <= k + 1).drop("n")
    named = asked.join(distinct, "q").select("query_id", "key").join(best, "key").where("id <> query_id")
    return named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
