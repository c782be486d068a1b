"""A trained inverted-file index with product codes over residuals: train, encode into shards, search, statistics.

The index is a bounded object (centroids and codebooks); the inverted lists are a table (id, list_id, codes, shard).
Searching scores codes by tables of inner products per subspace and can score the best again from the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.seeded import hashed
from .knn import BASE, QUERIES, _matrix


@dataclass(frozen=True)
class Config:
    lists: int = 64
    subspaces: int = 16
    centres: int = 256
    sample: int = 50_000  # the index is fitted on at most so many distinct vectors
    shard_size: int = 50_000_000
    rounds: int = 10
    seed: int = 0

    def __post_init__(self) -> None:
        if self.lists < 1 or not 1 <= self.centres <= 256 or self.sample < 1:
            raise ValueError("lists and sample must be positive, centres 1 to 256")


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray
    books: np.ndarray  # (subspaces, centres, width)


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            centres[:, j] = np.where(count > 0, np.bincount(near, x[:, j], k) / np.maximum(count, 1), centres[:, j])
        gone = np.flatnonzero(count == 0)
        centres[gone] = x[rng.choice(len(x), len(gone))]
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[s : s + 4096] @ centres.T - half, axis=1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def train(vectors: DataFrame, config: Config = Config()) -> Index:
    """Fits coarse centroids, and codebooks on residuals, on a sample of distinct vectors drawn by hash of the id."""
    rows = vectors.where("v is not null").dropDuplicates(["v"]).withColumn("_h", hashed(config.seed, F.col("id"))).orderBy("_h", "id").limit(config.sample).select("v").toArrow()
    if not rows.num_rows:
        raise ValueError("no vectors to train on")
    x = _matrix(rows.column("v"))
    if x.shape[1] % config.subspaces:
        raise ValueError(f"{config.subspaces} subspaces don't divide {x.shape[1]} dimensions")
    rng = np.random.default_rng(config.seed)
    centroids = _kmeans(x, config.lists, config.rounds, rng)
    residual = x - centroids[_nearest(x, centroids)]
    width = x.shape[1] // config.subspaces
    return Index(centroids, np.stack([_kmeans(residual[:, m * width : (m + 1) * width], config.centres, config.rounds, rng) for m in range(config.subspaces)]))


def save(index: Index, spark: SparkSession, path: str) -> None:
    """Stores centroids and codebooks as one parquet table (part, list_id, values), so that training, encoding and
    searching can be jobs of their own. An index that is there already is an error."""
    rows = [("centroid", 0, i, c.tolist()) for i, c in enumerate(index.centroids)] + [("book", m, i, c.tolist()) for m, book in enumerate(index.books) for i, c in enumerate(book)]
    spark.createDataFrame(rows, "part string, sub int, number int, values array<double>").coalesce(1).write.mode("error").parquet(path)


def load(spark: SparkSession, path: str) -> Index:
    """What ``save`` stored; bounded by lists and codebooks."""
    rows = spark.read.parquet(path).orderBy("part", "sub", "number").collect()
    books: dict[int, list[list[float]]] = {}
    for r in rows:
        if r["part"] == "book":
            books.setdefault(r["sub"], []).append(r["values"])
    return Index(np.array([r["values"] for r in rows if r["part"] == "centroid"]), np.array([books[m] for m in sorted(books)]))


def encode(vectors: DataFrame, index: Index, config: Config = Config()) -> DataFrame:
    """(id, list_id, codes, shard) of every vector that isn't null; write it partitioned by shard or list."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        width = ix.books.shape[2]
        for batch in batches:
            x = _matrix(batch.column("v"))
            own = _nearest(x, ix.centroids)
            residual = x - ix.centroids[own] if len(x) else x
            codes = np.stack([_nearest(residual[:, m * width : (m + 1) * width], book) for m, book in enumerate(ix.books)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(ix.books)), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own.astype(np.int32)), pa.array(list(map(bytes, codes)), pa.binary())], names=["id", "list_id", "codes"])

    coded = vectors.where("v is not null").select("id", "v").mapInArrow(run, "id bigint, list_id int, codes binary")
    return coded.withColumn("shard", F.floor(F.col("id") / config.shard_size).cast("int"))


def merge_shards(*shards: DataFrame) -> DataFrame:
    """One table of inverted lists, clustered by list, so that a search reads the lists that it asks."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    return out.repartition("list_id").sortWithinPartitions("list_id", "id")


def code_dedupe(coded: DataFrame) -> DataFrame:
    """(first_id, n_vectors) per distinct list and code."""
    return coded.groupBy("list_id", "codes").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_vectors")).select("first_id", "n_vectors")


def list_stats(coded: DataFrame, index: Index) -> DataFrame:
    from . import knn

    lists = coded.sparkSession.range(len(index.centroids)).select(F.col("id").cast("int").alias("list_id"))
    return knn.list_stats(coded, lists)


def search(queries: DataFrame, coded: DataFrame, index: Index, nprobe: int = 8, k: int = 10, vectors: DataFrame | None = None, rerank: int = 4) -> DataFrame:
    """(q, rank, n, dist): the k best by coded inner product among the ``nprobe`` nearest lists of each query; with
    ``vectors``, the best ``rerank`` times k are scored again exactly. Large lists are cut into blocks."""
    if not 1 <= nprobe <= len(index.centroids):
        raise ValueError("nprobe must be from 1 to the number of lists")
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast(index)
    keep = k * rerank if vectors is not None else k

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        half = (ix.centroids**2).sum(axis=1) / 2
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x):
                near = np.argsort(half - x @ ix.centroids.T, axis=1, kind="stable")[:, :nprobe].astype(np.int32)
                at = pa.array(np.repeat(np.arange(len(x)), nprobe))
                taken = batch.take(at)
                yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("v"), pa.array(near.reshape(-1))], names=["qid", "qv", "list_id"])

    asked = queries.where("v is not null").select("id", "v").mapInArrow(probe, "qid bigint, qv array<float>, list_id int")
    sizes = coded.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / BASE).cast("int").alias("xs")).join(asked.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qs")), "list_id").collect()  # a row per list
    blocks = F.broadcast(spark.createDataFrame([tuple(r) for r in sizes], "list_id int, xs int, qs int"))
    left = asked.join(blocks, "list_id").select("qid", "qv", "list_id", F.pmod(F.xxhash64("qid"), "qs").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"))
    right = coded.join(blocks, "list_id").select("id", "codes", F.col("list_id").alias("ylist"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("yqb"), F.pmod(F.xxhash64("id"), "xs").cast("int").alias("yxb"))
    schema = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])

    def scan(key, a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        ix, q = shared.value, _matrix(a.column("qv"))
        codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(b.num_rows, -1)
        width = ix.books.shape[2]
        score = np.repeat((q @ ix.centroids[key[0].as_py()])[:, None], len(codes), axis=1)
        for m, book in enumerate(ix.books):
            score += (q[:, m * width : (m + 1) * width] @ book.T)[:, codes[:, m]]
        qids, ids = np.asarray(a.column("qid")), np.asarray(b.column("id"))
        if score.shape[1] > keep:
            xi = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        else:
            xi = np.tile(np.arange(score.shape[1]), (len(q), 1))
        return pa.table([pa.array(np.repeat(qids, xi.shape[1])), pa.array(ids[xi.reshape(-1)]), pa.array(np.take_along_axis(score, xi, axis=1).reshape(-1))], schema=schema)

    found = left.groupBy("list_id", "qb", "xb").cogroup(right.groupBy("ylist", "yqb", "yxb")).applyInArrow(scan, "q bigint, n bigint, score double")
    best = lambda t, n: t.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "n"))).where(F.col("rank") <= n)
    top = best(found, keep)
    if vectors is not None:
        from ..functions.vector import dot

        pairs = top.select("q", "n").join(queries.select(F.col("id").alias("q"), F.col("v").alias("_a")), "q").join(vectors.select(F.col("id").alias("n"), F.col("v").alias("_b")), "n")
        top = best(pairs.select("q", "n", F.round(dot(F.col("_a"), F.col("_b")), 9).alias("score")), k)
    return top.select("q", "rank", "n", F.col("score").alias("dist"))
