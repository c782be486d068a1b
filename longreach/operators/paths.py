"""Documents ordered into bounded, related paths over a neighbour graph.

The walk and the merge are sequential by definition, but fall apart over the connected components of the graph:
components are found in parallel, each is walked in one task, and clusters are numbered by their first document, which
gives the order of one walk over everything. A component of any size is walked whole, with all of its edges: each step
depends on all steps before it, so that a component is a sequence, not a group that could be split. Its task holds no
texts and no vectors, only numbers: about 200 bytes a document, its input included (two million documents: 406 MB, 42 s).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ngram_similarity
from ..runtime import salted_join, table, table_state

CLUSTER_SIZE, FIRST, LAST = 21, 2, 10  # the ranks that a walk looks at


def neighbour_lists(knn: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, near): the neighbours of ranks 2 to 10 in order, at most nine, for every id; none where there are none."""
    near = knn.where(F.col("rank").between(FIRST, LAST)).groupBy(F.col("q").alias("id")).agg(F.array_sort(F.collect_list(F.struct("rank", "n"))).alias("s"))
    return ids.select("id").join(near, "id", "left").select("id", F.coalesce(F.transform("s", lambda x: x["n"]), F.array().cast("array<bigint>")).alias("near"))


CHUNK = 1_000_000  # edges that a task contracts at once


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v), v < u: edges with the same connections, of which each task replaces every chunk of its own by stars around
    the smallest id of what the chunk connects."""

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = list(range(len(nodes)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in zip(flat[: len(u)].tolist(), flat[len(u) :].tolist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        least = nodes[[find(i) for i in range(len(nodes))]]
        return pa.RecordBatch.from_arrays([pa.array(nodes[least < nodes]), pa.array(least[least < nodes])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield stars(*(np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("u", "v")))
                held = []
        if sum(b.num_rows for b in held):
            yield stars(*(np.concatenate([np.asarray(b.column(c)) for b in held]) for c in ("u", "v")))

    return edges.mapInArrow(run, "u bigint, v bigint")


def components(near: DataFrame) -> DataFrame:
    """(id, component): the smallest id that can be reached over neighbour edges in either direction.

    Tasks contract their own edges, then alternating large and small stars join what is left; rounds grow with the
    logarithm of the longest path, and no component is ever collected. Hubs are joined in parts."""
    edges = near.select("id", F.explode("near").alias("n")).where("id <> n").select(F.greatest("id", "n").alias("u"), F.least("id", "n").alias("v")).distinct()
    edges = table(contracted(edges).distinct(), "edges")
    now = table_state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n")), "least")
        large = table(salted_join(both, least, ["u"], ["v"], "_n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = table(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "low")
        small = salted_join(large, low, ["u"], ["v"], "_n")
        edges = table(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        before, now = now, table_state(edges)
        if now == before:
            break
    return near.select("id").join(edges.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


class Graph:
    """Neighbour lists of the documents of one component, as places in the sorted ids; neighbours elsewhere are left out."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, lengths: np.ndarray):
        self.ids = ids
        place = np.minimum(np.searchsorted(ids, values), len(ids) - 1).astype(np.int32)
        known = ids[place] == values
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), lengths)[known]
        self.place = place[known]
        self.start = np.searchsorted(owner, np.arange(len(ids) + 1)).astype(np.int64)

    def __getitem__(self, i: int) -> list[int]:
        return self.place[self.start[i] : self.start[i + 1]].tolist()


def walk(graph: Graph, size: int, first_extra: bool) -> tuple[np.ndarray, np.ndarray]:
    """The places of one component in the order of the walk, and where its clusters begin in it: from the smallest unseen
    document, always on to the first unseen neighbour; a new cluster begins where there is none or the cluster is full.
    ``first_extra``: the first cluster takes one document more."""
    n = len(graph.ids)
    seen = bytearray(n)
    order, begins = np.empty(n, np.int32), []
    pointer, current, room = 0, 0, 0
    for k in range(n):
        step = None
        if room > 0:
            step = next((p for p in graph[current] if not seen[p]), None)
        if step is None:
            pointer = seen.index(0, pointer)
            step = pointer
            room = size + (first_extra and not begins)
            begins.append(k)
        order[k] = step
        seen[step] = 1
        current, room = step, room - 1
    return order, np.array(begins, np.int64)


def merge(graph: Graph, order: np.ndarray, begins: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cluster) of what is left when clusters below ``size`` are dissolved, in order: each document goes directly
    before its first neighbour that is in another cluster at that time; without one, or if that one was dropped itself, it
    is dropped. Clusters grow without a cap. Clusters are linked lists, so that a document moves in constant time."""
    n = len(order)
    count = np.diff(np.append(begins, n))
    home = np.empty(n, np.int32)
    home[order] = np.repeat(np.arange(len(begins)), count)
    end = n  # stands before the first and behind the last document of a cluster
    after, before = np.full(n + 1, end, np.int32), np.full(n + 1, end, np.int32)
    after[order[:-1]], before[order[1:]] = order[1:], order[:-1]
    lasts = np.append(begins[1:], n) - 1
    after[order[lasts]], before[order[begins]] = end, end
    head = order[begins].copy()
    dropped = bytearray(n)
    for i in range(len(begins)):
        if count[i] >= size or not count[i]:
            continue
        d = int(head[i])
        count[i] = 0
        while d != end:
            follows = int(after[d])
            goal = next((p for p in graph[d] if home[p] != i), None)
            if goal is None or dropped[goal]:
                dropped[d] = 1
            else:
                to, left = home[goal], int(before[goal])
                home[d], before[d], after[d], before[goal] = to, left, goal, d
                if left == end:
                    head[to] = d
                else:
                    after[left] = d
                count[to] += 1
            d = follows
    out, cluster = [], []
    for i in np.flatnonzero(count).tolist():
        d = int(head[i])
        while d != end:
            out.append(d)
            cluster.append(i)
            d = int(after[d])
    return np.array(out, np.int32), np.array(cluster, np.int64)


def clusters(knn: DataFrame, ids: DataFrame, merged: bool = False, size: int = CLUSTER_SIZE, strict: bool = False) -> DataFrame:
    """(seed, pos, id): the walk over ``knn`` (q, rank, n) and all ``ids``, or what is left after the merge. The seed is
    the first document of the cluster in the walk. ``strict``: no cluster above ``size``; else the very first takes
    one more. A dissolved cluster has no rows."""
    near = table(neighbour_lists(knn, ids), "near")
    rows = near.join(components(near), "id")
    first = ids.agg(F.min("id")).first()[0]

    def run(_key, t):
        t = t.sort_by("id")
        values, lists = np.asarray(t.column("id")), pa.concat_arrays(t.column("near").chunks)
        graph = Graph(values, np.asarray(lists.flatten()), np.asarray(lists.value_lengths()))
        order, begins = walk(graph, size, not strict and values[0] == first)
        seeds = values[order[begins]]
        if merged:
            order, cluster = merge(graph, order, begins, size)
        else:
            cluster = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
        pos = np.arange(len(order)) - np.searchsorted(cluster, cluster)
        return pa.table([pa.array(seeds[cluster]), pa.array(pos.astype(np.int32)), pa.array(values[order])], names=["seed", "pos", "id"])

    return table(rows.groupBy("component").applyInArrow(run, "seed bigint, pos int, id bigint"), "walked")


def numbered(walked: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(cluster_id, pos, id): clusters by ascending seed, from 0. Ranks are summed over ranges of seeds, not in one task."""
    seeds = (walked if seeds is None else seeds).select("seed").distinct()
    return walked.join(dense_ranks(seeds, "seed", "cluster_id"), "seed").select("cluster_id", "pos", "id")


def dense_ranks(keys: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): the place of each distinct key in ascending order, from 0, by range partitions and their counts."""
    ranged = table(keys.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per shuffle partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(key))
    return ranged.withColumn("_r", inside).join(F.broadcast(before.select("_part", "_before")), "_part").select(key, (F.col("_r") - 1 + F.col("_before")).cast("bigint").alias(name))


def greedy_walk(knn: DataFrame, ids: DataFrame, size: int = CLUSTER_SIZE, strict: bool = False) -> DataFrame:
    """(cluster_id, pos, id): the greedy walk; every id is in exactly one cluster."""
    return numbered(clusters(knn, ids, False, size, strict))


def merged_clusters(knn: DataFrame, ids: DataFrame, size: int = CLUSTER_SIZE) -> DataFrame:
    """(cluster_id, pos, id): the walk after small clusters are dissolved; numbers are those of the walk."""
    before = clusters(knn, ids, False, size)
    return numbered(clusters(knn, ids, True, size), before)


def cluster_stats(assigned: DataFrame, size: int = CLUSTER_SIZE, exclusive: bool = False) -> DataFrame:
    """(n_clusters, n_docs, mean_size, q25, q50, q75, n_full): sizes of the clusters. Quartiles interpolate between
    ranks 1..n; ``exclusive`` takes position p (n + 1) instead and clips it to the range."""
    sizes = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("s"))
    base = [F.count(F.lit(1)).alias("n_clusters"), F.sum("s").alias("n_docs"), F.round(F.avg("s"), 6).alias("mean_size")]
    full = F.count_if(F.col("s") >= size).alias("n_full")
    if not exclusive:
        return sizes.agg(*base, *(F.round(F.percentile("s", p), 6).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)), full)
    # sizes repeat: their histogram is as short as the largest cluster
    histogram = sizes.groupBy("s").agg(F.count(F.lit(1)).alias("c"))
    running = histogram.withColumn("upto", F.sum("c").over(Window.orderBy("s"))).agg(F.sum("c").alias("n"), F.array_sort(F.collect_list(F.struct("upto", "s"))).alias("h"))

    def at(p: float) -> Column:
        place = F.greatest(F.lit(1.0), F.least(p * (F.col("n") + 1), F.col("n").cast("double")))
        value = lambda r: F.element_at(F.filter("h", lambda e: e["upto"] >= r), 1)["s"]
        low = value(F.floor(place))
        return F.round(low + (place - F.floor(place)) * (value(F.ceil(place)) - low), 6)

    return sizes.agg(*base, full).crossJoin(running.select(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"))).select("n_clusters", "n_docs", "mean_size", "q25", "q50", "q75", "n_full")


# ---- near-duplicate filter along a path --------------------------------------------------------------------------
def near_dup_kept(contents: Column, threshold: float = 0.75, n: int = 3, head: int = 100) -> Column:
    """The positions (from 0) of an array of texts that are kept: a text goes where the n-gram Jaccard index of its
    first ``head`` characters with those of the last kept text is above the threshold.

    Where both are too short for an n-gram, or a text is null, it goes too, but later texts are compared with it. The
    first text that isn't null stays."""
    start = F.struct(F.array().cast("array<int>").alias("kept"), F.lit(None).cast("string").alias("prev"), F.lit(0).alias("i"))

    def step(acc: Column, text: Column) -> Column:
        nothing = text.isNull()
        first = acc["prev"].isNull()

        def decided(similar: Column) -> Column:
            keep = ~nothing & (first | (similar.isNotNull() & (similar <= threshold)))
            moved = ~nothing & (first | similar.isNull() | (similar <= threshold))
            return F.struct(F.when(keep, F.concat(acc["kept"], F.array(acc["i"]))).otherwise(acc["kept"]).alias("kept"), F.when(moved, text).otherwise(acc["prev"]).alias("prev"), (acc["i"] + 1).alias("i"))

        # an array of one, so that the similarity is computed once and not at each of its places
        return F.get(F.transform(F.array(ngram_similarity(text, acc["prev"], n, head)), decided), F.lit(0))

    return F.aggregate(contents, start, step, lambda acc: acc["kept"])


def filter_paths(paths: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``paths`` with ``id_path`` and ``content_path`` without near-duplicates; ids beyond the contents are dropped. A
    path of which nothing is left has empty arrays, a null path stays null."""
    kept = paths.withColumn("_kept", near_dup_kept(F.col("content_path"), threshold))
    pick = lambda c: F.transform("_kept", lambda i: F.get(F.col(c), i))
    return kept.withColumns({"id_path": pick("id_path"), "content_path": pick("content_path")}).drop("_kept")


def document_paths(assigned: DataFrame, corpus: DataFrame, threshold: float = 0.75, size: int = 64) -> DataFrame:
    """(cluster_id, id_path, content_path): each cluster's documents in order, without near-duplicates.

    ``corpus`` is (id, content). Clusters are bounded by the walk; merged ones are as large as their parts."""
    rows = assigned.join(corpus.select("id", "content"), "id")
    paths = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("id").cast("string").alias("id"), "content"))).alias("s"))
    paths = paths.select("cluster_id", F.transform("s", lambda x: x["id"]).alias("id_path"), F.transform("s", lambda x: x["content"]).alias("content_path"))
    return filter_paths(paths, threshold)
