"""Approximate nearest neighbours by largest inner product: vantage-point trees per shard.

A vector x of length at most M becomes the point (x, sqrt(M^2 - |x|^2)) and a query q the point (q, 0): among points of
equal length, the nearest is the one of largest inner product, so a metric tree serves. Cells gather the vectors that are
nearest to one of at most MOST_PIVOTS pivots, a bounded sample; every vector is indexed. A cell is dealt to shards of
about SHARD vectors by a hash of vec_id, so a cell that holds a third of all vectors is many shards. Each shard's tree is built once and staged. It splits at the median distance to a vantage point; a search enters
the far side only if the distance to the border is less than `factor` times the distance of the worst neighbour found so
far. The triangle inequality makes a factor of 1 exact; smaller factors prune more and may miss neighbours.

A query first searches one shard of its own cell. The distance of its k-th neighbour there bounds all further search: it
goes on to the other shards of those cells alone whose ring around the pivot comes nearer than `factor` times the bound.
So on clustered vectors a query meets few shards; on uniformly random ones of many dimensions hardly any cell can be left
out, and the work is queries times shards. Each (shard, QUERIES queries) is one task's work, in blocks that descend
together, and results are merged over shards. Equal vectors share one point of a tree, which keeps its smallest ids (as
many as can ever be asked for), so a vector that a third of all rows hold costs no more than one.

Vectors that are null, zero or hold a null or non-finite component take no part, nor do rows without vec_id. Vectors of each
length are searched by themselves, as a query has no product with others: those of a length that has more than SHARD
vectors by an index of their own, the others by one exact tree a length. Rows of one vec_id and equal vectors count once, others of one vec_id
each. Ties go to the smaller vec_id. Vectors of any length of the table's own are read whole. Empty tables give empty
results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from io import BytesIO
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import discard, staged

K = 20
EVERY = 20
SHARD = 16_384  # vectors, about
MOST_PIVOTS = 1024
QUERIES = 65_536  # of one task, about
BLOCK = 4_096  # queries that descend together
LEAF = 256
#: Recall and visited share at several factors stand in the README.
FACTOR = 0.6


class VantageTree:
    """A tree over points (n, d), as arrays; leaves hold up to LEAF of them, side by side in `order`."""

    def __init__(self, points: np.ndarray, seed: int = 5, leaf: int = LEAF):
        rng = np.random.default_rng(seed)
        order, nodes, open_ = np.arange(len(points)), [], [(0, len(points), -1, 0)]
        while open_:
            start, end, parent, side = open_.pop()
            if parent >= 0:
                nodes[parent][3 + side] = len(nodes)
            rows = order[start:end]
            nodes.append([start, end, -1, -1, -1, 0.0])  # vantage, inner, outer, border
            if len(rows) <= leaf:
                continue
            vantage = rows[rng.integers(len(rows))]
            far = np.linalg.norm(points[rows] - points[vantage], axis=1)
            border = float(np.median(far))
            inner = far < border
            if not inner.any() or inner.all():
                continue  # all at one distance: no border parts them
            order[start:end] = np.concatenate([rows[inner], rows[~inner]])
            nodes[-1][2], nodes[-1][5], middle = vantage, border, start + int(inner.sum())
            open_ += [(middle, end, len(nodes) - 1, 1), (start, middle, len(nodes) - 1, 0)]
        self._keep(points, order, np.array(nodes, np.float64).reshape(-1, 6))

    def _keep(self, points: np.ndarray, order: np.ndarray, nodes: np.ndarray) -> None:
        self.points, self.order, self.table = points, order, nodes
        self.nodes = [(*(int(x) for x in row[:5]), row[5]) for row in nodes.tolist()]
        self.laid = points[order]  # each leaf a slice

    def search(self, queries: np.ndarray, length: float, k: int, factor: float, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and inner products of the k nearest points found for each query, unordered; -1 fills up.

        length: that of all points, so a squared distance is |q|^2 + length^2 - 2 <q, x>. bound: a distance within which
        each query has k neighbours for sure.
        """
        n = len(queries)
        self.q, self.k, self.factor, self.met = queries, k, factor, 0
        self.bound = np.full(n, np.inf) if bound is None else bound
        self.square = (queries * queries).sum(axis=1) + length * length
        self.rows, self.near = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
        self._visit(0, np.arange(n))
        return self.rows, self.near

    def _worst(self, who: np.ndarray) -> np.ndarray:
        """The distance of each query's worst neighbour so far."""
        return np.minimum(self.bound[who], np.sqrt(np.maximum(0, self.square[who] - 2 * self.near[who].min(axis=1))))

    def _visit(self, at: int, who: np.ndarray) -> None:
        if not len(who):
            return
        start, end, vantage, inner, outer, border = self.nodes[at]
        if vantage < 0:
            self.met += len(who) * (end - start)
            for k in range(0, len(who), 1024):
                self._meet(start, end, who[k : k + 1024])
            return
        gap = np.sqrt(np.maximum(0, self.square[who] - 2 * (self.q[who] @ self.points[vantage]))) - border
        within = gap < 0
        self._visit(inner, who[within])
        self._visit(outer, who[~within])
        reach = np.abs(gap) < self.factor * self._worst(who)
        self._visit(outer, who[within & reach])
        self._visit(inner, who[~within & reach])

    def _meet(self, start: int, end: int, who: np.ndarray) -> None:
        got = self.q[who] @ self.laid[start:end].T
        take = min(self.k, end - start)
        best = np.argpartition(-got, take - 1, axis=1)[:, :take] if take < end - start else np.broadcast_to(np.arange(end - start), got.shape)
        near = np.hstack([self.near[who], np.take_along_axis(got, best, 1)])
        names = np.hstack([self.rows[who], self.order[start:end][best]])
        keep = np.argpartition(-near, self.k - 1, axis=1)[:, : self.k]
        self.near[who], self.rows[who] = np.take_along_axis(near, keep, 1), np.take_along_axis(names, keep, 1)


class Shard:
    """A tree over the distinct vectors of a shard, with their ids; to bytes and back."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, length: float, k: int):
        order = np.argsort(ids, kind="stable")
        self.vectors, home = np.unique(vectors[order], axis=0, return_inverse=True)
        home = home.ravel()
        by_point = np.argsort(home, kind="stable")
        place = np.arange(len(home)) - np.searchsorted(home[by_point], home[by_point])
        by_point = by_point[place <= k]  # of each point its smallest ids, one more than can be asked for
        self.ids, self.length = ids[order][by_point], length
        self.begin = np.searchsorted(home[by_point], np.arange(len(self.vectors) + 1))
        self.tree = VantageTree(lifted(self.vectors, length))

    def to_bytes(self) -> bytes:
        out = BytesIO()
        short = self.vectors.astype(np.float32)
        np.savez(out, vectors=short if (short == self.vectors).all() else self.vectors, ids=self.ids, begin=self.begin, length=self.length, order=self.tree.order, nodes=self.tree.table)
        return out.getvalue()

    @classmethod
    def of_bytes(cls, data: bytes) -> Shard:
        got, self = np.load(BytesIO(data)), cls.__new__(cls)
        self.vectors, self.ids, self.begin, self.length = got["vectors"].astype(np.float64), got["ids"], got["begin"], float(got["length"])
        self.tree = VantageTree.__new__(VantageTree)
        self.tree._keep(lifted(self.vectors, self.length), got["order"], got["nodes"])
        return self

    def nearest(self, names: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int, factor: float) -> list[tuple[int, int, float]]:
        """(query, vector, inner product) of up to k + 1 neighbours found for each query, which may be one of them."""
        out = []
        for at in range(0, len(names), BLOCK):
            own = slice(at, at + BLOCK)
            found, _ = self.tree.search(np.hstack([queries[own], np.zeros((len(names[own]), 1))]), self.length, k + 1, factor, bounds[own])
            for name, query, points in zip(names[own].tolist(), queries[own], found):
                points = points[points >= 0]
                scores = (self.vectors[points] * query).sum(axis=1)  # the same sum for equal vectors, wherever they stand
                rows = [(-s, i) for s, p in zip(scores.tolist(), points.tolist()) for i in self.ids[self.begin[p] : self.begin[p + 1]].tolist() if i != name]
                out += [(name, i, -s) for s, i in sorted(rows)[:k]]
        return out


def lifted(vectors: np.ndarray, length: float) -> np.ndarray:
    """The points of one length that stand for vectors."""
    return np.hstack([vectors, np.sqrt(np.maximum(0, length * length - (vectors * vectors).sum(axis=1)))[:, None]])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_list()).astype(np.float64)


def _to_pivots(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (n, pivots)."""
    square = (points * points).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :]
    return np.sqrt(np.maximum(0, square - 2 * points @ pivots.T))


def _celled(pivots: np.ndarray, length: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = _to_pivots(lifted(_matrix(batch["vector"]), length), pivots)
                cell = far.argmin(axis=1)
                yield batch.assign(cell=cell.astype(np.int32), far=far[np.arange(len(batch)), cell])

    return run


def _built(length: float, k: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(rows["vec_id"].to_numpy(), _matrix(rows["vector"]), length, k)
        return pd.DataFrame({"cell": [key[0]], "sub": [key[1]], "tree": [shard.to_bytes()]})

    return run


def _searched(k: int, factor: float):
    def run(trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if trees.empty or queries.empty:
            return pd.DataFrame([], columns=columns)
        found = Shard.of_bytes(trees["tree"].iloc[0]).nearest(queries["vec_id"].to_numpy(), _matrix(queries["vector"]), queries["bound"].to_numpy(np.float64), k, factor)
        return pd.DataFrame(found, columns=columns)

    return run


def _homes(pivots: np.ndarray, cells: list[int]):
    """Each query's nearest cell of those that hold vectors."""
    names = np.array(cells, np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                vectors = _matrix(batch["vector"])
                far = _to_pivots(np.hstack([vectors, np.zeros((len(vectors), 1))]), pivots[names])
                yield batch.assign(cell=names[far.argmin(axis=1)])

    return run


def _routed(pivots: np.ndarray, rings: dict[int, tuple[float, float, int]], length: float, factor: float):
    """Rows (vec_id, vector, bound, cell, sub) of the shards that a query goes on to."""
    cells = np.array(sorted(rings))
    least, most, subs = (np.array([rings[c][j] for c in cells.tolist()]) for j in range(3))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            vectors = _matrix(batch["vector"])
            far = _to_pivots(np.hstack([vectors, np.zeros((len(vectors), 1))]), pivots[cells])
            away = np.maximum(np.maximum(far - most, least - far), 0)
            go = away * (1 - 1e-9) <= factor * batch["bound"].to_numpy(np.float64)[:, None]
            for at in range(0, len(batch), 256):
                own = batch.iloc[at : at + 256]
                row, place = np.nonzero(go[at : at + 256])
                many = subs[place].astype(np.int64)
                row, cell = np.repeat(row, many), np.repeat(cells[place], many)
                sub = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                fresh = (cell != own["cell"].to_numpy()[row]) | (sub > 0)
                row = row[fresh]
                yield pd.DataFrame({"vec_id": own["vec_id"].to_numpy()[row], "vector": own["vector"].to_numpy()[row], "bound": own["bound"].to_numpy()[row], "cell": cell[fresh].astype(np.int32), "sub": sub[fresh].astype(np.int32)})

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard: int = SHARD, per_task: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors found for each query, itself left out.

    vectors and queries: vec_id and embedding.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        doubles = F.transform("embedding", lambda x: x.cast("double"))
        whole = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
        squared = F.aggregate(doubles, F.lit(0.0), lambda acc, x: acc + x * x)
        return df.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(whole & (squared > 0)).select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("d"), F.col("embedding").alias("vector"), squared.alias("square"))

    # vectors stay in their own type where they are stored or sent, and are doubles where they are computed with
    stored = staged(usable(vectors).dropDuplicates(["vec_id", "vector"]), "ann-vectors")
    asked = staged(usable(queries).dropDuplicates(["vec_id", "vector"]).select("vec_id", "vector", "d"), "ann-queries")
    lengths = stored.groupBy("d").agg(F.count("*").alias("n"), F.max("square").alias("longest")).join(asked.groupBy("d").agg(F.count("*").alias("n_asked")), "d")
    large = lengths.filter(F.col("n") > shard).orderBy("d").collect()  # a row for `shard` vectors at most
    few = lengths.filter(F.col("n") <= shard)
    parts = []
    for r in large:
        alike = F.col("d") == r["d"]
        parts.append(_of_length(stored.filter(alike), asked.filter(alike).select("vec_id", "vector"), r["n"], sqrt(r["longest"]), r["n_asked"], k, factor, shard, per_task))
    of_few = few.agg(F.max("longest").alias("longest"), F.max("n_asked").alias("n_asked")).first()
    if of_few["longest"] is not None:
        rare = ~F.col("d").isin([r["d"] for r in large])
        parts.append(_of_few(stored.filter(rare), asked.filter(rare), sqrt(of_few["longest"]), of_few["n_asked"], k, per_task))
    discard(stored)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = reduce(DataFrame.unionByName, parts).dropDuplicates(["query_id", "vec_id", "score"])
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(trees: DataFrame, rows: DataFrame, groups: int, k: int, factor: float) -> DataFrame:
    """query_id, vec_id and score of what rows (vec_id, vector, bound, cell, sub) find in the trees of their shards, in groups of queries."""
    by = ["cell", "sub", "part"]
    copies = trees.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "vec_id"), F.lit(groups)).cast("int"))
    return copies.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(_searched(k, factor), "query_id long, vec_id long, score double")


def _of_few(stored: DataFrame, asked: DataFrame, length: float, n_asked: int, k: int, per_task: int) -> DataFrame:
    """What is found among vectors of lengths of which a shard holds all: a tree a length, searched exactly."""
    trees = staged(stored.select("vec_id", "vector", F.col("d").alias("cell"), F.lit(0).alias("sub")).groupBy("cell", "sub").applyInPandas(_built(length, k), "cell int, sub int, tree binary"), "ann-trees")
    rows = asked.select("vec_id", "vector", F.col("d").alias("cell"), F.lit(0).alias("sub"), F.lit(float("inf")).alias("bound"))
    return _met(trees, rows, -(-n_asked // per_task), k, 1.0)


def _of_length(stored: DataFrame, asked: DataFrame, n: int, length: float, n_asked: int, k: int, factor: float, shard: int, per_task: int) -> DataFrame:
    """What is found among vectors of one length, n of them."""
    kind, asked_kind = (df.schema["vector"].dataType.simpleString() for df in (stored, asked))
    # the index: pivots (a bounded sample), every vector's cell, and a tree a shard
    some = stored.orderBy(F.xxhash64(F.lit("pivot"), "vec_id"), "vec_id").select("vector").limit(min(MOST_PIVOTS, -(-n // shard))).collect()
    pivots = lifted(np.unique(np.array([r["vector"] for r in some], np.float64), axis=0), length)
    celled = staged(stored.select("vec_id", "vector").mapInPandas(_celled(pivots, length), f"vec_id long, vector {kind}, cell int, far double"), "ann-cells")
    rings = {r["cell"]: (r["least"], r["most"], -(-r["n"] // shard)) for r in celled.groupBy("cell").agg(F.min("far").alias("least"), F.max("far").alias("most"), F.count("*").alias("n")).collect()}  # at most MOST_PIVOTS rows
    deal = F.get(F.lit([rings[c][2] if c in rings else 1 for c in range(len(pivots))]), F.col("cell"))
    dealt = celled.select("vec_id", "vector", "cell", F.pmod(F.xxhash64(F.lit("shard"), "vec_id"), deal).cast("int").alias("sub"))
    trees = staged(dealt.groupBy("cell", "sub").applyInPandas(_built(length, k), "cell int, sub int, tree binary"), "ann-trees")
    discard(celled)
    groups = -(-n_asked // per_task)

    # one shard of the own cell, whose k-th neighbour bounds the rest
    home = asked.mapInPandas(_homes(pivots, sorted(rings)), f"vec_id long, vector {asked_kind}, cell int").withColumn("alike", F.count("*").over(Window.partitionBy("vec_id")))
    first = staged(_met(trees, home.drop("alike").withColumns({"sub": F.lit(0), "bound": F.lit(float("inf"))}), groups, k, factor), "ann-first")
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    square = F.aggregate("vector", F.lit(length * length), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    bound = F.when((F.col("n") >= k) & (F.col("alike") == 1), F.sqrt(F.greatest(square - 2 * F.col("least"), F.lit(0.0))) * (1 + 1e-9)).otherwise(F.lit(float("inf")))
    bounded = home.join(kth.withColumnRenamed("query_id", "_id"), F.col("vec_id") == F.col("_id"), "left").select("vec_id", "vector", "cell", F.coalesce(bound, F.lit(float("inf"))).alias("bound"))
    routed = bounded.mapInPandas(_routed(pivots, rings, length, factor), f"vec_id long, vector {asked_kind}, bound double, cell int, sub int")
    return first.union(_met(trees, routed, groups, k, factor))


def op10_approximate_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
