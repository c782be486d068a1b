"""The k most similar vectors of every vector: inverted lists, score-aware four-bit product codes, exact reranking.

Vectors are scaled to length 1, so the inner product is the cosine.

* Coarse lists: spherical k-means on a bounded sample; every vector goes into the list of its nearest centroid.
* Codes: the residual is cut into subspaces of four numbers, each with 16 centres (four bits). Codebooks and codes
  minimise |e|^2 + (eta - 1) <e, x>^2, where e is the quantisation error and x the vector: error parallel to x costs
  ``eta`` times as much, since it is what disturbs large inner products.
* Search: for a query and each of its ``nprobe`` nearest lists, tables of 16 scores per subspace are joined in twos,
  scaled to 16 bits and summed by code. The best by that score are scored exactly from the vectors themselves.
* Groups: a (list, block of vectors, block of queries) is one group of at most BLOCK vectors and BLOCK queries, so
  that a list which holds a third of all rows is spread over many tasks.

Equal directions are one class; only its first id is indexed, and the first k + 1 ids stand for it in results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import table
from .text import map_arrow

SUB, CENTRES, BLOCK, SALTED = 4, 16, 4096, 10_000


@dataclass(frozen=True)
class Index:
    """Bounded whatever the data: at most 4,096 centroids, and 16 centres per four dimensions."""

    centroids: np.ndarray  # (lists, d)
    books: np.ndarray  # (d / SUB, 16, SUB)
    eta: float


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([_nearest(part, centres, spherical) for part in np.array_split(x, max(1, len(x) // 8192))])
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        gone = count == 0
        total[gone], count[gone] = x[rng.choice(len(x), int(gone.sum()))], 1
        centres = total / count[:, None]
        if spherical:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        centres = centres.astype(np.float32)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray, spherical: bool) -> np.ndarray:
    score = x @ centres.T
    return np.argmax(score if spherical else score - (centres**2).sum(axis=1) / 2, axis=1)


def _encode(residual: np.ndarray, direction: np.ndarray, books: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """Codes that minimise the anisotropic loss, one subspace after another."""
    n, subs = len(residual), len(books)
    parts, dirs = residual.reshape(n, subs, SUB), direction.reshape(n, subs, SUB)
    codes = np.zeros((n, subs), np.uint8)
    along = np.zeros((n, subs), np.float32)
    rows = np.arange(n)
    for step in range(passes + 1):
        total = along.sum(axis=1)
        for m in range(subs):
            gap = parts[:, m, None, :] - books[m][None]
            loss = (gap**2).sum(axis=2)
            parallel = np.einsum("nkd,nd->nk", gap, dirs[:, m])
            if step:  # the first pass has no codes yet: plain nearest centre
                loss += (eta - 1) * ((total - along[:, m])[:, None] + parallel) ** 2
            best = loss.argmin(axis=1)
            codes[:, m] = best
            total += parallel[rows, best] - along[:, m]
            along[:, m] = parallel[rows, best]
    return codes


def fit(sample: np.ndarray, lists: int, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> Index:
    """Fits centroids and codebooks. ``threshold`` is the inner product above which scores matter; it sets eta."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    centroids = _kmeans(sample, lists, rounds, rng, True)
    train = sample[rng.permutation(len(sample))[:16384]]
    residual = train - centroids[_nearest(train, centroids, True)]
    books = np.stack([_kmeans(np.ascontiguousarray(residual[:, m : m + SUB]), CENTRES, rounds, rng, False) for m in range(0, d, SUB)])
    subs, n = d // SUB, len(train)
    slot = np.arange(subs) * CENTRES
    for _ in range(3):
        codes = _encode(residual, train, books, eta)
        # normal equations of all centres at once: sum A'(I + (eta-1) x x')A c = sum A'(I + (eta-1) x x') r
        where = (slot[None] + codes).reshape(-1)
        size = subs * CENTRES * SUB
        wide = np.zeros((n, subs * CENTRES, SUB), np.float32)
        wide[np.repeat(np.arange(n), subs), where] = train.reshape(-1, SUB)
        wide = wide.reshape(n, size)
        count = np.repeat(np.bincount(where, minlength=subs * CENTRES), SUB).astype(np.float64)
        left = (eta - 1) * (wide.T @ wide).astype(np.float64)
        left[np.diag_indices(size)] += count + 1e-3
        flat = residual.reshape(-1, SUB)
        plain = np.stack([np.bincount(where, flat[:, j], subs * CENTRES) for j in range(SUB)], axis=1).reshape(-1)
        right = plain + (eta - 1) * (wide.T @ (train * residual).sum(axis=1)).astype(np.float64) + 1e-3 * books.reshape(-1)
        books = np.linalg.solve(left, right).reshape(subs, CENTRES, SUB).astype(np.float32)
    return Index(centroids, books, eta)


def unit_vectors(vectors: DataFrame, d: int) -> DataFrame:
    """(id, unit) of the rows whose ``embedding`` has d finite numbers and isn't all zeros; ``unit`` is 4 d bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        column = batch.column("embedding")
        good = np.asarray(column.value_lengths().fill_null(-1)) == d
        batch = batch.filter(pa.array(good))
        if not batch.num_rows:
            return None
        x = np.asarray(batch.column("embedding").flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)
        norm = np.linalg.norm(x, axis=1)
        keep = np.isfinite(norm) & (norm > 0)
        unit = (x[keep] / norm[keep][:, None]).astype(np.float32)
        return pa.RecordBatch.from_arrays([batch.column("id").filter(pa.array(keep)), pa.array(list(map(bytes, unit)), pa.binary())], names=["id", "unit"])

    return map_arrow(vectors.where("id is not null and embedding is not null").select("id", "embedding"), run, "id bigint, unit binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, d)


def index_rows(units: DataFrame, index: Index, nprobe: int, d: int) -> DataFrame:
    """(id, unit, list, codes, probes) of each vector: its own list, its code and the lists it asks."""
    shared = units.sparkSession.sparkContext.broadcast(index)  # bounded: see Index

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ix = shared.value
        x = _matrix(batch.column("unit"), d)
        own, codes, probes = [], [], []
        for start in range(0, len(x), 1024):
            part = x[start : start + 1024]
            score = part @ ix.centroids.T
            near = score.argmax(axis=1)
            k = min(nprobe, score.shape[1])
            probes.append(np.argpartition(-score, k - 1, axis=1)[:, :k].astype(np.int32))
            code = _encode(part - ix.centroids[near], part, ix.books, ix.eta)
            codes += map(bytes, code[:, 0::2] << 4 | code[:, 1::2])
            own.append(near.astype(np.int32))
        probe = np.concatenate(probes)
        offsets = np.arange(len(x) + 1, dtype=np.int32) * probe.shape[1]
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("unit"), pa.array(np.concatenate(own)), pa.array(codes, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(probe.reshape(-1)))],
            names=["id", "unit", "list", "codes", "probes"],
        )

    return map_arrow(units, run, "id bigint, unit binary, list int, codes binary, probes array<int>")


def _scan(index: Index, lst: int, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores (vectors x queries) of one list from tables of 16 entries, joined in twos."""
    subs = len(index.books)
    small = np.einsum("qmd,mkd->mkq", q.reshape(len(q), subs, SUB), index.books)  # (subs, 16, queries)
    low = small.min(axis=1)
    scale = np.float32(60000.0 / max(1e-6, float((small.max(axis=1) - low).sum(axis=0).max())))
    steps = np.rint((small - low[:, None]) * scale).astype(np.uint16)
    total = np.zeros((len(codes), len(q)), np.uint16)
    for j in range(subs // 2):
        joined = (steps[2 * j][:, None] + steps[2 * j + 1][None]).reshape(CENTRES * CENTRES, len(q))
        total += joined[codes[:, j]]
    return total.astype(np.float32) / scale + (low.sum(axis=0) + q @ index.centroids[lst])[None]


def _search_group(index: Index, lst: int, base: pa.Table, asked: pa.Table, d: int, k: int, rerank: int, floor: float | None, slack: float) -> pa.Table:
    x, q = _matrix(base.column("unit"), d), _matrix(asked.column("qunit"), d)
    ids, qids = np.asarray(base.column("id")), np.asarray(asked.column("qid"))
    codes = np.frombuffer(b"".join(base.column("codes").to_pylist()), np.uint8).reshape(len(x), -1)
    out_q, out_n, out_s = [], [], []
    for start in range(0, len(q), 512):
        part, names = q[start : start + 512], qids[start : start + 512]
        guess = _scan(index, lst, part, codes).T
        if floor is not None:
            qi, xi = np.nonzero(guess >= floor - slack)
        elif guess.shape[1] <= rerank:
            qi, xi = (a.reshape(-1) for a in np.indices(guess.shape))
        else:
            xi = np.argpartition(-guess, rerank - 1, axis=1)[:, :rerank].reshape(-1)
            qi = np.repeat(np.arange(len(part)), rerank)
        other = names[qi] != ids[xi]
        qi, xi = qi[other], xi[other]
        score = np.empty(len(qi))
        for s in range(0, len(qi), 65536):
            score[s : s + 65536] = np.einsum("nd,nd->n", part[qi[s : s + 65536]].astype(np.float64), x[xi[s : s + 65536]].astype(np.float64))
        if floor is not None:
            keep = score >= floor
            qi, xi, score = qi[keep], xi[keep], score[keep]
        order = np.lexsort((ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        first = np.searchsorted(qi, qi)
        top = np.arange(len(qi)) - first < k
        out_q.append(names[qi[top]])
        out_n.append(ids[xi[top]])
        out_s.append(score[top])
    return pa.table({"q": pa.array(np.concatenate(out_q)), "n": pa.array(np.concatenate(out_n)), "score": pa.array(np.concatenate(out_s))})


def lists_for(n: int) -> int:
    """Number of inverted lists: about the square root of the rows, 16 to 4,096."""
    return int(min(4096, max(16, 2 ** math.ceil(math.log2(max(1.0, math.sqrt(n)))))))


def probes_for(lists: int) -> int:
    """Lists that a query asks where recall counts: an eighth of them, 32 at least. A fixed number would lose
    recall as the lists grow."""
    return max(32, lists // 8)


def knn(vectors: DataFrame, k: int = 10, d: int = 64, nprobe: int | None = None, queries: str | None = None, floor: float | None = None, rerank: int = 64, sample: int = 32768, slack: float = 0.2) -> DataFrame:
    """(q, n, score): for each vector q its k most similar other vectors n by cosine, ties by the smaller id.

    ``vectors`` has (id, embedding), ids unique; other columns are ignored. ``queries`` is a condition on ``id`` that
    names the vectors to search for (all by default). ``nprobe`` is ``probes_for`` the lists by default. With ``floor``, only neighbours of at least that cosine come
    out, and every vector whose coded score is above ``floor - slack`` is scored exactly; else the best ``rerank``
    of each list are. Rows whose embedding is null, all zeros, not finite or not of d numbers take no part. The
    sample the index is fitted on has at most ``sample`` rows (the smallest by hash of the id).
    """
    spark = vectors.sparkSession
    units = table(unit_vectors(vectors, d), "units").withColumn("_h1", F.xxhash64("unit")).withColumn("_h2", F.xxhash64(F.lit(1), "unit"))
    classes = units.groupBy("_h1", "_h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("size"))
    repeated = table(classes.where("size > 1"), "repeated")
    copies = table(units.select("id", "_h1", "_h2").join(repeated, ["_h1", "_h2"]).select("id", "rep", "size"), "copies")
    reps = units.select("id", "unit").join(copies.where("id <> rep").select("id"), "id", "left_anti")
    n = reps.count()
    if not n:
        return spark.createDataFrame([], "q bigint, n bigint, score double")
    rows = reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("unit").toArrow()
    index = fit(_matrix(rows.column("unit"), d), lists_for(n))
    coded = table(index_rows(reps, index, nprobe or probes_for(len(index.centroids)), d), "coded")
    asked = coded.select("id", "unit", F.explode("probes").alias("list"))
    if queries is not None:  # a class is asked for if any of its members is
        named = reps.select("id").join(copies.select(F.col("rep").alias("id")), "id", "left_anti").where(queries).select("id")
        named = named.unionByName(copies.where(queries).select(F.col("rep").alias("id")).distinct())
        asked = asked.join(named, "id", "left_semi")
    # at most 4,096 lists: sizes fit the driver, and the block table is a literal
    size = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {r["list"]: r["n"] for r in asked.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = spark.createDataFrame([(int(i), -(-size[i] // BLOCK), -(-wanted.get(i, 0) // BLOCK) or 1) for i in size], "list int, xs int, qs int")
    base = (
        coded.select("id", "unit", "codes", "list").join(F.broadcast(blocks), "list")
        .withColumn("xb", F.pmod(F.xxhash64("id"), "xs").cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("qs") - 1))).drop("xs", "qs")
    )
    asked = (
        asked.join(F.broadcast(blocks), "list")
        .withColumn("qb", F.pmod(F.xxhash64(F.lit(5), "id"), "qs").cast("int")).withColumn("xb", F.explode(F.sequence(F.lit(0), F.col("xs") - 1))).drop("xs", "qs")
    )
    shared = spark.sparkContext.broadcast(index)
    schema = pa.schema([("q", pa.int64()), ("n", pa.int64()), ("score", pa.float64())])

    def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        return _search_group(shared.value, key[0].as_py(), left, right, d, k, rerank, floor, slack).cast(schema)

    key = ["list", "xb", "qb"]
    asked = asked.select(F.col("id").alias("qid"), F.col("unit").alias("qunit"), *(F.col(c).alias(f"q{c}") for c in key))
    found = base.groupBy(*key).cogroup(asked.groupBy(*(f"q{c}" for c in key))).applyInArrow(search, "q bigint, n bigint, score double")
    return _with_copies(found, copies, k, queries)


def _with_copies(found: DataFrame, copies: DataFrame, k: int, queries: str | None) -> DataFrame:
    """From the neighbours of classes to those of vectors. Of any class, its first k + 1 ids can be neighbours, and the
    members of a class of more than k have no others. Large classes are joined in parts of about SALTED members."""
    found = table(found, "found")
    w = Window.partitionBy("rep").orderBy("id")
    first = table(copies.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).select("rep", "id", "size"), "first")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "n")
    near = found.join(first.select(F.col("rep").alias("n"), F.col("id").alias("_n")), "n", "left").select("q", F.coalesce("_n", "n").alias("n"), "score")
    near = near.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")
    asked = copies if queries is None else copies.where(queries)
    small = asked.where(F.col("size") <= k).select(F.col("rep").alias("q"), F.col("id").alias("_q"))
    alone = near.join(copies.select(F.col("rep").alias("q")).distinct(), "q", "left_anti")
    near = alone.unionByName(near.join(small, "q").select(F.col("_q").alias("q"), "n", "score"))
    salts = F.ceil(F.col("size") / SALTED).cast("int")
    own = asked.select("rep", F.col("id").alias("q"), F.pmod(F.xxhash64("id"), salts).cast("int").alias("_salt"))
    other = first.select("rep", F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("_salt"))
    same = own.join(other, ["rep", "_salt"]).where("q <> n").select("q", "n", F.lit(1.0).alias("score"))
    return near.where("q <> n").unionByName(same).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def mutual_pairs(vectors: DataFrame, k: int = 10, floor: float = 0.87, nprobe: int = 8, **options: object) -> DataFrame:
    """(a, b), a < b: one is among the k most similar of the other, and their cosine is at least ``floor``."""
    near = knn(vectors, k=k, nprobe=nprobe, floor=floor, **options)
    return near.select(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b")).distinct()


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Part of the exact neighbours (q, n) that were found."""
    both = exact.select("q", "n").join(found.select("q", "n"), ["q", "n"], "left_semi").count()
    return both / max(1, exact.count())
