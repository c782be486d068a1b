"""Exact and inverted-list neighbour search over vectors with given centroids, and its evaluation.

Vectors come as (id BIGINT, v ARRAY<FLOAT>); ids unique, null vectors take no part. Scores are doubles, rounded to
nine places before ranking so that every engine ranks alike; ties go to the smaller id. ``metric`` is ``ip`` (inner
product), ``cosine`` (both largest first) or ``l2`` (squared distance, smallest first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vector as V

QUERIES, BASE = 1024, 8192  # rows of a block


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(rows)
    return np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Larger is nearer."""
    if metric == "l2":
        return 2 * (q @ x.T) - (q**2).sum(axis=1)[:, None] - (x**2).sum(axis=1)[None]
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            q, x = q / np.linalg.norm(q, axis=1)[:, None], x / np.linalg.norm(x, axis=1)[:, None]
    return q @ x.T


def top_k(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, neighbour ids, scores) of the k nearest of one block."""
    for start in range(0, len(q), 256):
        score = np.round(_scores(q[start : start + 256], x, metric), 9)
        score[np.isnan(score)] = -np.inf
        if score.shape[1] > k:
            edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            qi, xi = np.nonzero(score >= edge[:, None])
        else:
            qi, xi = (a.reshape(-1) for a in np.indices(score.shape))
        s = score[qi, xi]
        order = np.lexsort((ids[xi], -s, qi))
        qi, xi, s = qi[order], xi[order], s[order]
        keep = (np.arange(len(qi)) - np.searchsorted(qi, qi) < k) & np.isfinite(s)
        yield q_ids[start : start + 256][qi[keep]], ids[xi[keep]], s[keep]


def _rank(found: DataFrame, k: int, metric: str) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), "n")
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    dist = -F.col("score") if metric == "l2" else F.col("score")
    return ranked.select("q", "rank", "n", (dist + F.lit(0.0)).alias("dist"))


def exact_knn(queries: DataFrame, base: DataFrame, k: int = 10, metric: str = "ip") -> DataFrame:
    """(q, rank, n, dist): the k nearest base vectors of each query vector, itself included.

    The query set meets the base in blocks of 1,024 by 8,192 vectors, each a group of its own, so that no task holds
    more. The base is copied once per block of queries: it is meant for a stated query set, not for all rows."""
    nq = max(1, -(-queries.count() // QUERIES))
    nx = max(1, -(-base.count() // BASE))
    left = queries.where("v is not null").select(F.col("id").alias("qid"), F.col("v").alias("qv"), F.pmod(F.xxhash64("id"), F.lit(nq)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("xb"))
    right = base.where("v is not null").select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("yqb"), F.pmod(F.xxhash64("id"), F.lit(nx)).cast("int").alias("yxb"))
    schema = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        parts = list(top_k(np.asarray(a.column("qid")), _matrix(a.column("qv")), np.asarray(b.column("id")), _matrix(b.column("v")), k, metric))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=schema)

    found = left.groupBy("qb", "xb").cogroup(right.groupBy("yqb", "yxb")).applyInArrow(search, "q bigint, n bigint, score double")
    return _rank(found, k, metric)


# ---- inverted lists over given centroids -------------------------------------------------------------------------
def label_centroids(vectors: DataFrame, label: str, d: int) -> DataFrame:
    """(list_id, centroid): the mean vector per label, rounded to nine places. Null labels and vectors are left out."""
    dims = vectors.where(F.col(label).isNotNull() & F.col("v").isNotNull()).select(F.col(label).alias("list_id"), F.posexplode("v").alias("p", "x"))
    mean = dims.groupBy("list_id", "p").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    return mean.groupBy("list_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("centroid"))


def coarse_assign(vectors: DataFrame, centroids: DataFrame, nprobe: int = 1, most: int = 65_536) -> DataFrame:
    """(id, v, list_id, probe, score): the ``nprobe`` centroids of largest inner product, ties to the smaller list.

    The centroids are counted first: up to ``most`` (a bounded index) they travel to every task; more are an error,
    since a coarse quantiser of that size needs a quantiser of its own."""
    rows = centroids.orderBy("list_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} centroids")
    if not rows:
        return vectors.sparkSession.createDataFrame([], "id bigint, v array<float>, list_id int, probe int, score double")
    shared = vectors.sparkSession.sparkContext.broadcast((np.array([r["list_id"] for r in rows], np.int64), np.array([r["centroid"] for r in rows], np.float64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                at = np.arange(part.num_rows, dtype=np.int64)
                for row, lst, score in top_k(at, _matrix(part.column("v")), names, centres, nprobe, "ip"):
                    taken = part.take(pa.array(row))
                    probe = row.copy()
                    probe = np.arange(len(row)) - np.searchsorted(row, row) + 1
                    yield pa.RecordBatch.from_arrays([taken.column("id"), taken.column("v"), pa.array(lst.astype(np.int32)), pa.array(probe.astype(np.int32)), pa.array(score)], names=["id", "v", "list_id", "probe", "score"])

    return vectors.where("v is not null").select("id", "v").mapInArrow(run, "id bigint, v array<float>, list_id int, probe int, score double")


def list_stats(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(n_lists, n_vectors, max_size, mean_size, largest_list, imbalance): sizes of the lists, empty ones included.
    Imbalance is lists times the sum of squared sizes over the square of their sum: 1 where all are equal."""
    size = centroids.select("list_id").join(assigned.groupBy("list_id").agg(F.count(F.lit(1)).alias("n")), "list_id", "left").select("list_id", F.coalesce("n", F.lit(0)).alias("n"))
    return size.agg(
        F.count(F.lit(1)).alias("n_lists"),
        F.sum("n").alias("n_vectors"),
        F.max("n").alias("max_size"),
        F.round(F.avg("n"), 6).alias("mean_size"),
        F.min_by("list_id", F.struct(-F.col("n"), F.col("list_id"))).alias("largest_list"),
        F.round(F.try_divide(F.count(F.lit(1)) * F.sum(F.col("n") * F.col("n")), F.sum("n") * F.sum("n")), 6).alias("imbalance"),
    )


def ivf_search(queries: DataFrame, base: DataFrame, centroids: DataFrame, nprobe: int = 2, k: int = 10, metric: str = "ip") -> DataFrame:
    """(q, rank, n, dist): the k nearest base vectors of each query among those in its ``nprobe`` nearest lists.

    Lists are cut into blocks by their size, so a list that holds a third of all vectors is searched by many tasks."""
    own = coarse_assign(base, centroids, 1).select("id", "v", "list_id")
    asked = coarse_assign(queries, centroids, nprobe).select("id", "v", "list_id")
    sizes = own.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / BASE).cast("int").alias("xs")).join(asked.groupBy("list_id").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("qs")), "list_id")
    rows = sizes.collect()  # one row per centroid, which coarse_assign has bounded
    blocks = F.broadcast(queries.sparkSession.createDataFrame([tuple(r) for r in rows], "list_id int, xs int, qs int"))
    left = asked.join(blocks, "list_id").select(F.col("id").alias("qid"), F.col("v").alias("qv"), "list_id", F.pmod(F.xxhash64("id"), "qs").cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("xs") - 1)).alias("xb"))
    right = own.join(blocks, "list_id").select("id", "v", F.col("list_id").alias("ylist"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("yqb"), F.pmod(F.xxhash64("id"), "xs").cast("int").alias("yxb"))
    schema = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return schema.empty_table()
        parts = list(top_k(np.asarray(a.column("qid")), _matrix(a.column("qv")), np.asarray(b.column("id")), _matrix(b.column("v")), k, metric))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=schema)

    found = left.groupBy("list_id", "qb", "xb").cogroup(right.groupBy("ylist", "yqb", "yxb")).applyInArrow(search, "q bigint, n bigint, score double")
    return _rank(found, k, metric)


# ---- evaluation --------------------------------------------------------------------------------------------------
def recall_at(truth: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(i, recall): for i = 1..k the mean part of the first i true neighbours that are among the first i found.

    A shared neighbour counts from the larger of its two ranks on, so one join and one aggregation give all i."""
    n = truth.select("q").distinct().count()
    shared = truth.select("q", "n", F.col("rank").alias("a")).join(found.select("q", "n", F.col("rank").alias("b")), ["q", "n"])
    hits = shared.groupBy(F.greatest("a", "b").alias("r")).agg(F.count(F.lit(1)).alias("hits"))
    ranks = truth.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("i"))
    # k rows on either side
    total = ranks.join(F.broadcast(hits), F.col("r") <= F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return total.select("i", F.round(F.try_divide(F.col("hits"), F.col("i") * n), 6).alias("recall"))


def intersection_frequencies(truth: DataFrame, found: DataFrame) -> DataFrame:
    """(n_shared, n_queries): how many queries share how many neighbours with the truth; 0 is listed too."""
    size = truth.select("q").distinct().join(truth.join(found, ["q", "n"], "left_semi").groupBy("q").agg(F.count(F.lit(1)).alias("c")), "q", "left")
    return size.groupBy(F.coalesce("c", F.lit(0)).alias("n_shared")).agg(F.count(F.lit(1)).alias("n_queries"))


def refined(found: DataFrame, queries: DataFrame, base: DataFrame, metric: str = "ip") -> DataFrame:
    """(q, rank, n, dist, refined): each pair scored again from the vectors themselves."""
    score = {"ip": V.dot, "l2": V.squared_distance, "cosine": V.cosine}[metric]
    pairs = found.join(queries.select(F.col("id").alias("q"), F.col("v").alias("_a")), "q").join(base.select(F.col("id").alias("n"), F.col("v").alias("_b")), "n")
    return pairs.select("q", "rank", "n", "dist", F.round(score(F.col("_a"), F.col("_b")), 9).alias("refined"))


def distance_means(**tables: DataFrame) -> DataFrame:
    """(source, mean_dist) of several neighbour tables."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.round(F.avg("dist"), 6).alias("mean_dist")).select(F.lit(name).alias("source"), "mean_dist")
        out = one if out is None else out.unionByName(one)
    return out


def margins(forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(q, n, margin) per nearest neighbour: twice its score over the sum of the mean scores of both sides' neighbours.

    ``forward`` are the neighbours of the queries, ``backward`` those of the base vectors."""
    mean = lambda t, name: t.groupBy(F.col("q").alias("_id")).agg(F.avg("dist").alias(name))
    first = forward.where("rank = 1").select("q", "n", "dist")
    both = first.join(mean(forward, "_a").withColumnRenamed("_id", "q"), "q").join(mean(backward, "_b").withColumnRenamed("_id", "n"), "n")
    return both.select("q", "n", F.round(F.try_divide(2 * F.col("dist"), F.col("_a") + F.col("_b")), 6).alias("margin"))


def consistency(found: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(check, n_bad): queries whose own id isn't first among their neighbours, ids that aren't of the base, queries
    without k neighbours, ranks that repeat."""
    bad_self = found.groupBy("q").agg(F.max((F.col("n") == F.col("q")).cast("int")).alias("own")).where("own = 0")
    unknown = found.join(ids.select(F.col("id").alias("n")), "n", "left_anti")
    short = found.groupBy("q").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") < k)
    twice = found.groupBy("q", "rank").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    out = None
    for name, t in (("self_missing", bad_self), ("unknown_neighbour", unknown), ("short", short), ("rank_repeats", twice)):
        one = t.agg(F.count(F.lit(1)).alias("n_bad")).select(F.lit(name).alias("check"), "n_bad")
        out = one if out is None else out.unionByName(one)
    return out


# ---- the vectors themselves --------------------------------------------------------------------------------------
def vector_stats(vectors: DataFrame) -> DataFrame:
    """(dim, n, min_x, max_x, mean_x, std_x) per dimension over the vectors that aren't null."""
    dims = vectors.select(F.posexplode("v").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return dims.groupBy("dim").agg(F.count("x").alias("n"), F.round(F.min("x"), 6).alias("min_x"), F.round(F.max("x"), 6).alias("max_x"), F.round(F.avg("x"), 6).alias("mean_x"), F.round(F.stddev_samp("x"), 6).alias("std_x"))


def vector_distinct(vectors: DataFrame) -> DataFrame:
    """(first_id, n_copies): the distinct vectors, each by its smallest id. Counted before the shuffle."""
    return vectors.where("v is not null").groupBy("v").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")).select("first_id", "n_copies")


def code_dedupe(vectors: DataFrame, code: Column | None = None) -> DataFrame:
    """(code, first_id, n_vectors): the first id per distinct code; the sign bits by default."""
    coded = vectors.where("v is not null").select("id", (V.sign_code(F.col("v")) if code is None else code).alias("code"))
    return coded.groupBy("code").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_vectors"))


def first_n(vectors: DataFrame, n: int) -> DataFrame:
    """The vectors with the n smallest ids; fewer if there aren't so many."""
    return vectors.orderBy("id").limit(n)


def sample(vectors: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n vectors without replacement, the same whatever the partitions."""
    from ..functions.seeded import hashed

    return vectors.withColumn("_h", hashed(seed, F.col("id"))).orderBy("_h", "id").limit(n).drop("_h")


def gather(wanted: DataFrame, vectors: DataFrame) -> DataFrame:
    """(ord, id, v) of wanted (ord, id): order and repeats are kept by ``ord``; unknown ids are left out."""
    return wanted.select("ord", "id").join(vectors.select("id", "v"), "id").select("ord", "id", "v")
