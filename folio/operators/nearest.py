"""A vector index of coarse cells: vectors lie with their nearest centre, and a search reads the cells nearest to it.

Centres come from a sample of bounded size (SAMPLE vectors, the first by a hash of their key) by a few rounds of spherical
means, and stay as they are; on the sample it is measured how many cells a query must probe for RECALL. All vectors are filled in, later ones too, as segments of their own: a changed vector is
written anew, alone. Similarity is the cosine in double precision, to 9 places; ties go to the smaller id. Zero, null and
non-finite vectors, and ones of another length than the centres, aren't found.

A batch of queries is joined with the vectors of the cells that it probes in blocks: at most about BLOCK vectors against
GROUP queries in a row, of which each query's k best are kept before they are brought together. So a full cell, or one that
all queries probe, is many rows, and nothing makes pairs of vectors. Probing all cells is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.sources import segments

SAMPLE, ROUNDS = 20_000, 8
#: The share of a sampled vector's NEAR nearest in the sample that the cells it probes must hold, on average of TRIED ones.
RECALL, NEAR, TRIED = 0.95, 10, 500
BLOCK, GROUP = 1024, 256
#: Rows of vectors and cells that a task makes at once.
PLACED = 4096


def unit(vectors: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can be compared, and those at length 1, in doubles."""
    sound = np.array([v is not None and len(v) == size for v in vectors], bool)
    rows = np.array([np.asarray(v, np.float64) for v, s in zip(vectors, sound) if s], np.float64).reshape(-1, size)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((rows * rows).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        sound[np.flatnonzero(sound)[~good]] = False
        return sound, rows[good] / norm[good, None]


def centres(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, recall: float = RECALL) -> tuple[np.ndarray, int]:
    """Centres of cells for vectors (id, embedding), and the cells to probe, from a sample of bounded size; of its most frequent length."""
    drawn = vectors.filter("embedding IS NOT NULL").orderBy(F.xxhash64(F.lit("cells"), "id"), "id").limit(sample).select("embedding").toPandas()["embedding"]
    if not len(drawn):
        return np.zeros((1, 0)), 1
    _, rows = unit(drawn, int(drawn.map(len).mode().min()))
    k = min(len(rows), cells or max(1, int(len(rows) ** 0.5)))
    found = rows[np.random.default_rng(7).permutation(len(rows))[:k]]
    for _ in range(ROUNDS if k else 0):
        owner = (rows @ found.T).argmax(axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, owner, rows)
        norm = np.sqrt((sums * sums).sum(axis=1))
        found = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], found)
    return found, _probes(rows, found, recall) if k else 1


def _probes(rows: np.ndarray, found: np.ndarray, recall: float) -> int:
    """The number of nearest cells that hold a share `recall` of the true neighbours of the first rows."""
    owner, tried = (rows @ found.T).argmax(axis=1), rows[:TRIED]
    near = np.argsort(-(tried @ rows.T), axis=1, kind="stable")[:, 1 : NEAR + 1]
    turn = np.argsort(np.argsort(-(tried @ found.T), axis=1, kind="stable"), axis=1)  # of each cell
    met = np.take_along_axis(turn, owner[near], axis=1).ravel()
    return int(np.sort(met)[int(np.ceil(recall * len(met))) - 1]) + 1 if len(met) else 1


def placed(vectors: DataFrame, found: np.ndarray, probes: int = 1) -> DataFrame:
    """id, vector (at length 1, as bytes) and cell: a row for each of the `probes` cells nearest to a vector (id, embedding)."""
    near = min(probes, len(found))
    most = max(1, PLACED // max(near, 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), most):
                batch = whole.iloc[at : at + most]
                sound, rows = unit(batch["embedding"], found.shape[1])
                cells = np.argsort(-(rows @ found.T), axis=1, kind="stable")[:, :near]
                yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy()[sound], near), "vector": [v for r in rows for v in [r.tobytes()] * near], "cell": cells.ravel().astype(np.int32)})

    return vectors.mapInPandas(run, "id long, vector binary, cell int")


def _keyed(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    return vectors.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("embedding"))


def write(vectors: DataFrame, path: str, key: str = "id", embedding: str = "embedding", cells: int | None = None, sample: int = SAMPLE) -> int:
    """Fills new or changed vectors into the index at path, whose centres are fitted the first time; the segment's number."""
    spark, rows = vectors.sparkSession, _keyed(vectors, key, embedding)
    if not segments.numbers(spark, path):
        found, probes = centres(rows, cells, sample)
        listed = [(i, c.tolist(), probes) for i, c in enumerate(found)]
        spark.createDataFrame(listed, "cell int, centre array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    number = segments.put(placed(rows, centres_of(spark, path)[0]).hint("rebalance", "cell"), rows.select("id").distinct(), path, partition=("cell",))
    segments.compacted(spark, path, ("cell",))
    return number


def centres_of(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    """The index's centres, of which there are no more than the square root of the sample, and the cells to probe."""
    rows = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows]), rows[0]["probes"]


#: Probes all cells.
ALL = 1 << 30


def _blocks(rows: DataFrame, most: int, names: tuple[str, str]) -> DataFrame:
    """Rows of a cell in blocks of about `most`, dealt by a hash of their id."""
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / most).alias("n"))  # a row a cell
    dealt = rows.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n")))
    listed = F.collect_list(F.struct("id", "vector"))
    return dealt.groupBy("cell", "block").agg(listed.alias("x")).select("cell", F.col("x.id").alias(names[0]), F.col("x.vector").alias(names[1]))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, key: str = "id", embedding: str = "embedding", where: Column | None = None) -> DataFrame:
    """query_id, place (from 0), id and similarity of each query's k nearest vectors in `probes` cells, in as many as the sample asked for if None."""
    found, own_probes = centres_of(spark, path)
    size = found.shape[1]
    asked = placed(_keyed(queries, key, embedding), found, probes or own_probes)
    pairs = _blocks(segments.current(spark, path, where).select("id", "vector", "cell"), BLOCK, ("ids", "vectors")).join(_blocks(asked, GROUP, ("query_ids", "queries")), "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # one block and group in arrays at a time
                ids, vectors, query_ids, own = (batch.column(c).slice(at, 1).flatten() for c in ("ids", "vectors", "query_ids", "queries"))
                ids, matrix = ids.to_numpy(), np.frombuffer(b"".join(vectors.to_pylist())).reshape(-1, size)
                scores = np.round(np.frombuffer(b"".join(own.to_pylist())).reshape(-1, size) @ matrix.T, 9)
                order = np.argsort(ids, kind="stable")  # then by score: ties stay by id
                ids, scores = ids[order], scores[:, order]
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                found_ = (np.repeat(query_ids.to_numpy(), best.shape[1]), ids[best].ravel(), np.take_along_axis(scores, best, axis=1).ravel())
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found_], ["query_id", "id", "similarity"])

    hits = pairs.mapInArrow(run, "query_id long, id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")) - 1
    return hits.withColumn("place", place).filter(F.col("place") < k).select("query_id", "place", "id", "similarity")


def index_of(spark: SparkSession, name: str, source: DataFrame, vectors, **options) -> str:
    """The path of this application's index of vectors(), filled where there is none for the files of source as they are."""
    path = f"{segments.shared_folder(spark)}/cells-{name}-{segments.signature(source)}-{spark.sparkContext.applicationId}"
    if not segments.numbers(spark, path):
        write(vectors(), path, **options)
    return path
