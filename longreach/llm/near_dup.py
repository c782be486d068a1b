"""Near-duplicate records: one-permutation MinHash, banded buckets, Bayesian pruning, exact verification.

Similarity of two texts: the Jaccard index of their sets of character n-grams, in lower case and with each
run of spaces, tabs and line ends made one space.

1. Every text gets ``BANDS x ROWS`` MinHash values of 8 bits: ROWS independent permutations, each split into
   BANDS bins (one-permutation hashing, empty bins densified). Band b holds bin b of all permutations, so its
   rows are independent, and its key is one 64-bit number.
2. Texts with the same digest are one class; only the class's smallest id goes on.
3. Texts with a band in common meet. Buckets above ``TILE`` members are cut into pairs of blocks, each in a
   group of its own, so that no task ever holds a large bucket.
4. The MinHash values of a candidate pair are compared in steps; it is dropped as soon as the posterior
   probability of reaching the threshold falls below ``tolerance`` (uniform prior). The first step, the first value
   of each band, is taken where the pair meets, before anything is shuffled; so a bucket of texts that aren't alike
   leaves next to no pairs. Short texts fill few bins, and the others repeat them: their values count for as many as
   there are filled bins.
5. What remains is verified exactly on the whole texts.

Classes, buckets and texts with very many partners are joined in parts (``salted_join``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import salted_join, table, table_state
from .text import code_points, map_arrow

BANDS, ROWS, TILE, SALTED = 64, 7, 256, 10_000
_SPACE = re.compile(r"[ \t\r\n]+")


def normal(text: str) -> str:
    return _SPACE.sub(" ", text.lower())


def gram_hashes(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 32-bit hashes of each run of n code points."""
    m = len(points) - n + 1
    low, high = points[:m].copy(), points[:m] * np.uint32(0xC2B2AE35)
    for k in range(1, n):
        low *= np.uint32(0x85EBCA6B)
        low += points[k : m + k]
        low ^= low >> np.uint32(15)
        high *= np.uint32(0x27D4EB2F)
        high += points[k : m + k]
        high ^= high >> np.uint32(13)
    return low, high


@lru_cache(None)
def _detours() -> np.ndarray:
    """For each bin, the order in which an empty bin looks at the others."""
    rng = np.random.default_rng(20240229)
    return np.stack([rng.permutation(BANDS) for _ in range(BANDS)])


def _densify(values: np.ndarray) -> None:
    """Fills empty bins, in place, from the first filled bin of their own order."""
    empty = values == 0xFFFFFFFF
    rows = np.flatnonzero(empty.any(axis=1))
    if not len(rows):
        return
    source, holes, order = values[rows].copy(), empty[rows], _detours()
    out = source.copy()
    for step in range(BANDS):
        r, b = np.nonzero(holes)
        if not len(r):
            break
        taken = source[r, order[b, step]]
        good = taken != 0xFFFFFFFF
        out[r[good], b[good]] = taken[good] + np.uint32(0x9E3779B1 * (step + 1) & 0xFFFFFFFF)
        holes[r[good], b[good]] = False
    values[rows] = out


def band_keys(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(len(texts), BANDS) int64: byte 7 of a key is its band, bytes 0..6 the band's MinHash values; and how many
    of the BANDS bins are filled. Every text must have at least n code points."""
    filled = np.empty(len(texts), np.int32)
    out = np.zeros((len(texts), BANDS, 8), np.uint8)
    out[:, :, 7] = np.arange(BANDS, dtype=np.uint8)
    start = 0
    while start < len(texts):
        end, size = start, 0
        while end < len(texts) and (end == start or size + len(texts[end]) <= 60_000):
            size += len(texts[end])
            end += 1
        points, lengths = code_points(texts[start:end])
        low, high = gram_hashes(points, n)
        owner = np.repeat(np.arange(end - start, dtype=np.int64), lengths)
        inside = owner[: len(low)] == owner[n - 1 :]
        low, high, base = low[inside], high[inside], owner[: len(low)][inside] << 6
        for r in range(ROWS):
            value = low * np.uint32((2654435761 + 0x5851F42 * r) & 0xFFFFFFFF | 1)
            value += high * np.uint32((0x165667B1 + 0x3C6EF372 * r) & 0xFFFFFFFF | 1)
            value ^= value >> np.uint32(15)
            value *= np.uint32(0x2C1B3C6D)
            value ^= value >> np.uint32(12)
            value *= np.uint32(0x297A2D39)
            value ^= value >> np.uint32(15)
            least = np.full((end - start) * BANDS, 0xFFFFFFFF, np.uint32)
            np.minimum.at(least, base + (value >> np.uint32(26)), value & np.uint32(0x3FFFFFF))
            least = least.reshape(-1, BANDS)
            if r == 0:
                filled[start:end] = (least != 0xFFFFFFFF).sum(axis=1)
            _densify(least)
            out[start:end, :, r] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
        start = end
    return out.view(np.int64).reshape(len(texts), BANDS), filled


def sign(records: DataFrame, n: int) -> DataFrame:
    """(tbl, rec, digest, filled, sketch, keys) of each record whose text has an n-gram. The sketch is the first value of
    each band."""
    import hashlib

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep, texts = [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            if t is not None and len(t := normal(t)) >= n:
                keep.append(i)
                texts.append(t)
        if not texts:
            return None
        keys, filled = band_keys(texts, n)
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * BANDS
        taken = batch.take(pa.array(keep))
        return pa.RecordBatch.from_arrays(
            [
                taken.column("tbl"),
                taken.column("rec"),
                pa.array([hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts], pa.binary()),
                pa.array(filled),
                pa.array(list(map(bytes, keys.view(np.uint8).reshape(len(texts), BANDS, 8)[:, :, 0])), pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
            ],
            names=["tbl", "rec", "digest", "filled", "sketch", "keys"],
        )

    return map_arrow(records.select("tbl", "rec", "text"), run, "tbl string, rec bigint, digest binary, filled int, sketch binary, keys array<bigint>")


@lru_cache(None)
def least_matches(threshold: float, tolerance: float, compared: int) -> int:
    """The fewest equal values among ``compared`` with P(similarity >= threshold) >= tolerance."""
    s = (np.arange(2000) + 0.5) / 2000
    equal = s + (1 - s) / 256  # 8-bit values also agree by chance
    with np.errstate(divide="ignore"):
        lp, lq = np.log(equal), np.log1p(-equal)

    def enough(m: int) -> bool:
        weight = m * lp + (compared - m) * lq
        weight = np.exp(weight - weight.max())
        return weight[s >= threshold].sum() / weight.sum() >= tolerance

    return bisect_left(range(compared + 1), True, key=enough) if enough(compared) else compared


@lru_cache(64)
def _least(threshold: float, tolerance: float, compared: int) -> np.ndarray:
    """For each number of filled bins, the fewest equal values among ``compared``: with few bins, the values are worth
    that part of them, and so are the equal ones."""
    worth = [max(1, compared * m // BANDS) for m in range(BANDS + 1)]
    return np.array([least_matches(threshold, tolerance, w) * compared // w for w in worth])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _prune_sketches(pairs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """First step: the pairs whose sketches (the first value of each band) leave the threshold probable."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        equal = (_bytes(batch.column("sketch_a"), BANDS) == _bytes(batch.column("sketch_b"), BANDS)).sum(axis=1)
        filled = np.minimum(np.asarray(batch.column("filled_a")), np.asarray(batch.column("filled_b")))
        keep = pa.array(np.flatnonzero(equal >= _least(threshold, tolerance, BANDS)[filled]))
        return pa.RecordBatch.from_arrays([batch.column(c).take(keep) for c in ("tbl", "rec_a", "rec_b")], names=["tbl", "rec_a", "rec_b"])

    return map_arrow(pairs, run, "tbl string, rec_a bigint, rec_b bigint")


def _probable(a: np.ndarray, b: np.ndarray, filled: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """The places of the pairs that are left after all steps, eight bands each."""
    alive = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    for start in range(0, BANDS, 8):
        equal[alive] += (a[alive, start : start + 8] == b[alive, start : start + 8]).sum(axis=(1, 2))
        alive = alive[equal[alive] >= _least(threshold, tolerance, (start + 8) * ROWS)[filled[alive]]]
    return alive


def exact_similarity(pairs: list[tuple[str, str]], n: int) -> np.ndarray:
    """Jaccard index of the n-gram sets of each pair of normalised texts, without hashing."""
    known: dict[str, np.ndarray] = {}
    distinct = list({t for p in pairs for t in p})
    points, lengths = code_points(distinct)
    alphabet = np.unique(points)
    bits = max(1, int(len(alphabet)).bit_length())
    if bits * n > 63:
        sets = {t: {t[i : i + n] for i in range(len(t) - n + 1)} for t in distinct}
        return np.array([len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for a, b in pairs])
    dense = np.searchsorted(alphabet, points).astype(np.int64)
    ends = np.cumsum(lengths)
    for t, end, size in zip(distinct, ends, lengths):
        p, m = dense[end - size : end], int(size) - n + 1
        packed = np.zeros(max(0, m), np.int64)
        for k in range(n if m > 0 else 0):
            packed = packed << bits | p[k : m + k]
        packed.sort()
        known[t] = packed[np.flatnonzero(np.diff(packed, prepend=-1))]
    out = np.zeros(len(pairs))
    for i, (a, b) in enumerate(pairs):
        x, y = known[a], known[b]
        both = np.concatenate([x, y])
        both.sort()
        shared = int((both[1:] == both[:-1]).sum())
        out[i] = shared / max(1, len(x) + len(y) - shared)
    return out


def _verify(pairs: DataFrame, threshold: float, n: int, tolerance: float) -> DataFrame:
    """Prunes by all values, then computes the similarity of what is left."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        a, b = (np.asarray(batch.column(c).flatten()).view(np.uint8).reshape(-1, BANDS, 8)[:, :, :ROWS] for c in ("keys_a", "keys_b"))
        filled = np.minimum(np.asarray(batch.column("filled_a")), np.asarray(batch.column("filled_b")))
        batch = batch.take(pa.array(_probable(a, b, filled, threshold, tolerance)))
        done: dict[str, str] = {}
        texts = [batch.column(c).to_pylist() for c in ("text_a", "text_b")]
        for column in texts:
            for t in column:
                if t not in done:
                    done[t] = normal(t)
        scores = np.zeros(batch.num_rows)
        for start in range(0, batch.num_rows, 64):
            part = slice(start, start + 64)
            scores[part] = exact_similarity([(done[a], done[b]) for a, b in zip(texts[0][part], texts[1][part])], n)
        keep = pa.array(np.flatnonzero(scores >= threshold))
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(keep) for c in ("tbl", "rec_a", "rec_b")), pa.array(scores).take(keep)], names=["tbl", "rec_a", "rec_b", "similarity"])

    return map_arrow(pairs, run, "tbl string, rec_a bigint, rec_b bigint, similarity double")


def tiled_pairs(members: DataFrame, group: list[str], item: str, size: str, carry: tuple[str, ...] = (), tile: int | None = None) -> DataFrame:
    """All pairs a < b of the distinct items of each group, without a large group in any task: a group of more
    than ``tile`` rows is cut into blocks, and each pair of blocks is a join key of its own. ``size`` is the
    column that has the number of rows of the group; columns to ``carry`` come along with both items."""
    rows = (
        members.withColumn("_blocks", F.ceil(F.col(size) / (tile or TILE)).cast("int"))
        .withColumn("_block", F.pmod(F.xxhash64(F.col(item)), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(*group, item, *carry, "_block", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"))
    )
    key = [*group, "_low", "_high"]
    side = lambda s: rows.select(*key, F.col(item).alias(f"rec_{s}"), F.col("_block").alias(f"_block_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in carry))
    meet = (F.col("rec_a") < F.col("rec_b")) & ((F.col("_low") == F.col("_high")) | (F.col("_block_a") != F.col("_block_b")))
    return side("a").join(side("b"), key).where(meet).select(*group, "rec_a", "rec_b", *(f"{c}_{s}" for c in carry for s in "ab"))


def link_representatives(records: DataFrame, threshold: float = 0.7, n: int = 5, tolerance: float = 1e-4, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts, and all links between the classes.

    ``records`` has (tbl, rec, text), ``rec`` unique in ``tbl``; other columns are ignored. Returns
    ``members`` (tbl, rec, rep, n_members), one row per record with an n-gram, and ``links`` (tbl, rec_a, rec_b,
    similarity) between representatives, rec_a < rec_b. Null, empty and shorter texts are in neither. A band has
    the first ``rows`` of its values as its key: with 7, a pair of similarity 0.7 shares one of the 64 with probability
    0.995; with 5, one of similarity 0.6 does with 0.994.
    """
    signed = table(sign(records, n), "signed")
    classes = signed.groupBy("tbl", "digest").agg(F.min("rec").alias("rep"), F.count(F.lit(1)).alias("n_members"))
    repeated = table(classes.where("n_members > 1"), "repeated")
    copies = table(salted_join(signed.select("tbl", "rec", "digest"), repeated, ["tbl", "digest"], ["rec"], "n_members").select("tbl", "rec", "rep", "n_members"), "copies")
    others = copies.where("rec <> rep").select("tbl", "rec")
    unique = signed.join(others, ["tbl", "rec"], "left_anti")
    mask = (0xFF << 56 | (1 << 8 * rows) - 1) - (1 << 64)  # the band and its first values
    banded = unique.select("tbl", "rec", F.explode("keys").alias("key")).withColumn("key", F.col("key").bitwiseAND(F.lit(mask)))
    sizes = table(banded.groupBy("tbl", "key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "sizes")
    buckets = table(salted_join(banded, sizes, ["tbl", "key"], ["rec"], "_n"), "buckets")
    met = tiled_pairs(buckets.join(signed.select("tbl", "rec", "filled", "sketch"), ["tbl", "rec"]), ["tbl", "key"], "rec", "_n", ("filled", "sketch"))
    candidates = table(_prune_sketches(met, threshold, tolerance).distinct(), "candidates")
    degree = candidates.select("tbl", F.explode(F.array("rec_a", "rec_b")).alias("rec")).groupBy("tbl", "rec").agg(F.count(F.lit(1)).alias("_degree"))
    degree = table(degree, "degree")  # small beside the records: each table is joined to it before they meet
    values = table(degree.join(signed.select("tbl", "rec", "filled", "keys"), ["tbl", "rec"]).join(records.select("tbl", "rec", "text").join(degree.select("tbl", "rec"), ["tbl", "rec"]), ["tbl", "rec"]), "values")
    side = lambda s: values.select("tbl", F.col("rec").alias(f"rec_{s}"), F.col("_degree").alias(f"_degree_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("filled", "keys", "text")))
    pairs = salted_join(salted_join(candidates, side("a"), ["tbl", "rec_a"], ["rec_b"], "_degree_a"), side("b"), ["tbl", "rec_b"], ["rec_a"], "_degree_b")
    links = table(_verify(pairs, threshold, n, tolerance), "links")
    single = unique.join(repeated.select("tbl", F.col("rep").alias("rec")), ["tbl", "rec"], "left_anti")
    members = copies.unionByName(single.select("tbl", "rec", F.col("rec").alias("rep"), F.lit(1).cast("bigint").alias("n_members")))
    return members, links


def similar_pairs(records: DataFrame, threshold: float = 0.7, n: int = 5) -> DataFrame:
    """All pairs (tbl, rec_a, rec_b), rec_a < rec_b, with similarity of at least ``threshold``, equal texts included.

    Its size is that of the result; ``groups`` gives the same links without writing out the pairs of copies."""
    members, links = link_representatives(records, threshold, n)
    copies = members.where("n_members > 1")
    within = tiled_pairs(copies, ["tbl", "rep"], "rec", "n_members").select("tbl", "rec_a", "rec_b")

    salts = F.ceil(F.col("n_members") / SALTED).cast("int")

    def spread(df: DataFrame, side: str) -> DataFrame:
        """Every member of a class instead of its representative; large classes are joined in parts of about SALTED."""
        own = copies.select("tbl", F.col("rep").alias(side), F.col("rec").alias(f"_{side}"), F.pmod(F.xxhash64("rec"), salts).cast("int").alias("_salt"))
        parts = copies.where("rec = rep").select("tbl", F.col("rep").alias(side), salts.alias("_parts"))
        salted = df.join(parts, ["tbl", side], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        return salted.join(own, ["tbl", side, "_salt"], "left").withColumn(side, F.coalesce(f"_{side}", side)).drop(f"_{side}", "_salt", "_parts")

    across = spread(spread(links.select("tbl", "rec_a", "rec_b"), "rec_a"), "rec_b")
    across = across.select("tbl", F.least("rec_a", "rec_b").alias("rec_a"), F.greatest("rec_a", "rec_b").alias("rec_b"))
    return across.unionByName(within)


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(tbl, rec, root): the smallest record of each node's connected component, by alternating large and small
    stars; the number of rounds grows with the logarithm of the longest path, and no star is collected."""
    edges = table(links.select("tbl", F.greatest("rec_a", "rec_b").alias("u"), F.least("rec_a", "rec_b").alias("v")).distinct(), "edges")
    now = table_state(edges)
    while now[0]:
        both = edges.unionByName(edges.select("tbl", F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("tbl", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n")), "least")
        large = salted_join(both, least, ["tbl", "u"], ["v"], "_n").where("v > u").select("tbl", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = table(large, "large")
        low = table(large.groupBy("tbl", "u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "low")
        small = salted_join(large, low, ["tbl", "u"], ["v"], "_n")
        small = small.where("v <> m").select("tbl", F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("tbl", "u", F.col("m").alias("v")))
        edges = table(small.where("u <> v").distinct(), "edges")
        before, now = now, table_state(edges)
        if now == before:
            break
    return nodes.join(edges.select("tbl", F.col("u").alias("rec"), F.col("v").alias("root")), ["tbl", "rec"], "left").withColumn("root", F.coalesce("root", "rec"))


def groups(records: DataFrame, threshold: float = 0.7, n: int = 5) -> DataFrame:
    """(tbl, rec, class_id, group_id, n_copies, n_links): one row per record with an n-gram. ``class_id`` is the
    smallest record with the same text, ``group_id`` the smallest record reachable over links, ``n_copies`` the
    size of the class and ``n_links`` the number of other classes that are similar to it."""
    members, links = link_representatives(records, threshold, n)
    degree = links.select("tbl", F.explode(F.array("rec_a", "rec_b")).alias("rep")).groupBy("tbl", "rep").agg(F.count(F.lit(1)).alias("n_links"))
    linked = degree.select("tbl", F.col("rep").alias("rec"))
    roots = components(links, linked).select("tbl", F.col("rec").alias("rep"), "root")
    reps = members.where("rec = rep").select("tbl", "rep", "n_members").join(degree, ["tbl", "rep"], "left").join(roots, ["tbl", "rep"], "left")
    known = reps.select("tbl", "rep", F.col("n_members").alias("n_copies"), F.coalesce("root", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"))
    joined = salted_join(members.select("tbl", "rec", "rep"), table(known, "known"), ["tbl", "rep"], ["rec"], "n_copies")
    return joined.select("tbl", "rec", F.col("rep").alias("class_id"), "group_id", "n_copies", "n_links")


def corpus_and_paths(corpus: DataFrame, paths: DataFrame) -> DataFrame:
    """Both tables as (tbl, rec, text); a path's text is its elements that aren't null, joined by a line feed."""
    return corpus.select(F.lit("custom_text_corpus").alias("tbl"), F.col("doc_ord").alias("rec"), F.col("content").alias("text")).unionByName(
        paths.select(F.lit("organized_text_corpus").alias("tbl"), F.col("path_id").alias("rec"), F.array_join(F.filter("content_path", lambda x: x.isNotNull()), "\n").alias("text"))
    )
