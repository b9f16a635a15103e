"""Centroid clustering: Lloyd's rounds that compare only what has changed.

Vectors become integers, floor(scale * x), so all sums and distances are exact and no order of adding matters. A state
table holds each vector with its owner, its distance to it and the owner before; sums and counts of all clusters are a
second table. A round reads the state with the new centroids, of which some haven't moved. A vector is compared with the
moved ones alone, unless its own centroid has moved away from it: then with all. Others than these can't have become
nearer than its owner. Vectors with a new owner are taken from the old cluster's sums and added to the new one's: signed
integers, summed in each batch before the shuffle, so a round shuffles `k * dimensions` numbers a task at most.

Only centroids and their sums reach the driver. Each round's tables are written into the shared folder, and the state
before is deleted then.

Vectors of another length, null ones and ones with a null, NaN or infinite component take no part. Starts are the k kept
vectors whose hash of key comes first, ties by the vector, null keys last; if there are fewer vectors than k, there are as
many clusters. Ties of distance go to the smaller number; empty clusters keep their centroid. Repeated rows are vectors of
their own. A component beyond 2**27 after scaling raises an error, as its distance fits no long. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import discard, staged

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 40, 5, 64, 256, 2
LARGEST = 1 << 27
#: Up to here, products of components sum exactly in doubles.
IN_DOUBLES = 1 << 20

STATE = "vec_id string, vector binary, owner int, before int, distance long"
TRANSFERS = "cluster int, place int, amount long"


def whole_vectors(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id (as text, which pandas keeps whole beside nulls) and integer vector of the rows that take part."""
    own = F.col(embedding).cast("array<double>")
    sound = F.forall(own, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = vectors.filter((F.size(F.col(embedding)) == dimensions) & sound)
    narrow = F.forall(own, lambda x: F.abs(x) <= float(LARGEST / scale))
    checked = F.when(narrow, F.transform(own, lambda x: F.floor(x * scale).cast("int"))).otherwise(F.raise_error(F.lit("a component is too large to be clustered")).cast("array<int>"))
    return kept.select(F.col(vec_id).cast("string").alias("vec_id"), checked.alias("whole"))


def starts(whole: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The first centroids: the vectors whose hash comes first."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id")), 256)
    first = whole.orderBy(drawn.asc_nulls_last(), "whole").limit(k).collect()
    return np.array([r["whole"] for r in first], np.int64)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= IN_DOUBLES:
        cross = (x.astype(np.float64) @ centroids.T.astype(np.float64)).astype(np.int64)
    else:
        return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    return (x * x).sum(axis=1)[:, None] - 2 * cross + (centroids * centroids).sum(axis=1)


def _nearest(x: np.ndarray, centroids: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the numbered centroids the nearest one, ties to the smaller number, and its distance."""
    d = _distances(x, centroids[numbers])
    at = d.argmin(axis=1)
    return numbers[at], d[np.arange(len(x)), at]


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance of vectors under centroids of which only those of moved (sorted numbers) differ from before."""
    owner, distance = owner.copy(), distance.copy()
    new = owner < 0
    shifted = ~new & np.isin(owner, moved)
    away = new.copy()
    if shifted.any():
        own = ((x[shifted] - centroids[owner[shifted]]) ** 2).sum(axis=1)
        away[shifted] = own > distance[shifted]
        distance[shifted] = own
    if away.any():
        owner[away], distance[away] = _nearest(x[away], centroids, np.arange(len(centroids)))
    rest = ~away
    if len(moved) and rest.any():
        best, d = _nearest(x[rest], centroids, moved)
        better = (d < distance[rest]) | ((d == distance[rest]) & (best < owner[rest]))
        at = np.flatnonzero(rest)[better]
        owner[at], distance[at] = best[better], d[better]
    return owner, distance


def _matrix(column: pd.Series, dimensions: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<i4").reshape(len(column), dimensions).astype(np.int64)


def assigned(state: DataFrame, centroids: np.ndarray, moved: np.ndarray) -> DataFrame:
    """The state after a round of assignments."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = _matrix(batch["vector"], centroids.shape[1])
            before = batch["owner"].to_numpy()
            owner, distance = reassigned(x, before, batch["distance"].to_numpy(), centroids, moved)
            yield batch.assign(owner=owner.astype(np.int32), before=before, distance=distance)

    return state.mapInPandas(run, STATE)


def transfers(state: DataFrame, k: int, dimensions: int) -> DataFrame:
    """What vectors with a new owner take from and add to the sums; place `dimensions` is the count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.pad(_matrix(batch["vector"], dimensions), ((0, 0), (0, 1)), constant_values=1)
            amounts = np.zeros((k, dimensions + 1), np.int64)
            np.add.at(amounts, batch["owner"].to_numpy(), x)
            left = batch["before"].to_numpy()
            np.subtract.at(amounts, left[left >= 0], x[left >= 0])
            cluster, place = np.nonzero(amounts)
            yield pd.DataFrame({"cluster": cluster, "place": place, "amount": amounts[cluster, place]})

    return state.filter("owner <> before").select("vector", "owner", "before").mapInPandas(run, TRANSFERS)


def _means(sums: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of means, exactly; clusters without vectors keep their centroid. sums has k * (dimensions + 1) rows at most."""
    k, dimensions = centroids.shape
    known = {(r["cluster"], r["place"]): int(r["amount"]) for r in sums.collect()}
    out = centroids.copy()
    for c in range(k):
        n = known.get((c, dimensions), 0)
        if n:
            out[c] = [known.get((c, i), 0) // n for i in range(dimensions)]
    return out


def lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, owner and distance of each vector after the rounds and a last assignment, and the centroids."""
    whole = staged(whole_vectors(vectors, dimensions, scale, vec_id, embedding), "clusters-vectors")
    centroids = starts(whole, k, seed).reshape(-1, dimensions)
    if not len(centroids):
        return whole.select(F.col("vec_id").cast("long"), F.lit(0).alias("owner"), F.lit(0).cast("long").alias("distance")), centroids

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"vec_id": batch["vec_id"], "vector": [np.asarray(w, "<i4").tobytes() for w in batch["whole"]], "owner": -1, "before": -1, "distance": 0})

    state, last, sums = whole.mapInPandas(packed, STATE), whole, None
    moved = np.arange(len(centroids))
    for turn in range(rounds + 1):
        state = staged(assigned(state, centroids, moved), "clusters-state")
        discard(last)
        last = state
        if turn == rounds:
            break
        change = transfers(state, len(centroids), dimensions).withColumn("amount", F.col("amount").cast("decimal(38,0)"))
        both = change if sums is None else sums.unionByName(change)
        total = both.groupBy("cluster", "place").agg(F.sum("amount").cast("decimal(38,0)").alias("amount"))
        fresh = staged(total.coalesce(1), "clusters-sums")  # k * (dimensions + 1) rows
        if sums is not None:
            discard(sums)
        sums, old = fresh, centroids
        centroids = _means(sums, old)
        moved = np.flatnonzero((centroids != old).any(axis=1))
    if sums is not None:
        discard(sums)
    return state.select(F.col("vec_id").cast("long"), "owner", "distance"), centroids


def described(clustered: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Each vector with its cluster's and the whole inertia, and a digest of its centroid."""
    spark = clustered.sparkSession
    digests = [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    inertia = clustered.groupBy("owner").agg(F.sum("distance").alias("cluster_inertia"))
    whole = clustered.agg(F.sum("distance").alias("inertia"))
    by_cluster = inertia.crossJoin(F.broadcast(whole)).join(spark.createDataFrame(digests, "owner int, centroid_sha256 string"), "owner")  # whole is one row
    joined = clustered.join(F.broadcast(by_cluster), "owner")  # a row a cluster
    return joined.select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return described(*lloyd(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def _oracle() -> str:
    """Every round written out: vectors and centroids as rows of components, floors of means by remainders."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id, embedding) AS rid, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        "cells AS MATERIALIZED (SELECT rid, unnest(w) AS x, unnest(range(len(w))) AS i FROM kept)",
        f"first AS (SELECT w, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), w) - 1 AS c FROM kept WHERE vec_id IS NOT NULL)",
        f"c0 AS MATERIALIZED (SELECT c, unnest(w) AS x, unnest(range(len(w))) AS i FROM first WHERE c < {CLUSTERS})",
    ]
    for t in range(ROUNDS + 1):
        parts.append(f"d{t} AS (SELECT rid, c, sum((a.x - b.x) * (a.x - b.x)) AS d FROM cells a JOIN c{t} b USING (i) GROUP BY rid, c)")
        parts.append(f"a{t} AS MATERIALIZED (SELECT rid, c, d FROM d{t} QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1)")
        if t < ROUNDS:
            parts.append(f"s{t} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM cells JOIN a{t} USING (rid) GROUP BY c, i)")
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT o.c, o.i, CASE WHEN n IS NULL THEN o.x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM c{t} o LEFT JOIN s{t} USING (c, i))")
    last = f"a{ROUNDS}"
    digest = f"SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY c"
    return f"WITH {', '.join(parts)} SELECT vec_id, c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM {last} JOIN kept USING (rid) JOIN ({digest}) USING (c)"


ORACLE = _oracle()
