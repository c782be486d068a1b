"""One configuration for building and searching an index, sweeps over its parameters, and resumable batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ivf, knn
from .knn import _matrix


@dataclass(frozen=True)
class SearchConfig:
    """Checked when made; values that don't fit each other are errors here, not in the middle of a job."""

    d: int
    k: int = 10
    nprobe: int = 8
    metric: str = "ip"
    batch_rows: int = 50_000_000
    index: ivf.Config = field(default_factory=ivf.Config)

    def __post_init__(self) -> None:
        if self.d < 1 or self.k < 1 or self.batch_rows < 1:
            raise ValueError("d, k and batch_rows must be positive")
        if self.metric not in ("ip", "l2", "cosine"):
            raise ValueError(f"unknown metric {self.metric!r}")
        if not 1 <= self.nprobe <= self.index.lists:
            raise ValueError("nprobe must be from 1 to the number of lists")
        if self.d % self.index.subspaces:
            raise ValueError("subspaces must divide d")


def expand(config: SearchConfig, **values: list) -> list[SearchConfig]:
    """A configuration per combination of values: ``expand(c, nprobe=[1, 2], k=[10])``."""
    return [replace(config, **dict(zip(values, combination))) for combination in product(*values.values())]


def nprobe_sweep(queries: DataFrame, base: DataFrame, centroids: DataFrame, nprobes: list[int], k: int = 10) -> DataFrame:
    """(nprobe, i, recall) against exact search, for each number of lists."""
    truth = knn.exact_knn(queries, base, k)
    out = None
    for n in nprobes:
        one = knn.recall_at(truth, knn.ivf_search(queries, base, centroids, n, k), k).select(F.lit(n).alias("nprobe"), "i", "recall")
        out = one if out is None else out.unionByName(one)
    return out


def evaluate(queries: DataFrame, base: DataFrame, config: SearchConfig) -> dict[str, DataFrame]:
    """Exact and approximate search in both directions, and what compares them: recall, intersections, refined scores,
    means of scores, and margins above 1.05."""
    index = ivf.train(base, config.index)
    coded = ivf.encode(base, index, config.index)
    exact = knn.exact_knn(queries, base, config.k, "ip")
    found = ivf.search(queries, coded, index, config.nprobe, config.k)
    again = knn.refined(found, queries, base)
    back = knn.exact_knn(base.join(exact.where("rank = 1").select(F.col("n").alias("id")).distinct(), "id"), queries, config.k, "ip")
    return {
        "exact": exact,
        "approximate": found,
        "refined": again,
        "recall": knn.recall_at(exact, found, config.k),
        "intersections": knn.intersection_frequencies(exact, found),
        "means": knn.distance_means(exact=exact, approximate=found, refined=again.select(F.col("refined").alias("dist"))),
        "margins": knn.margins(exact, back).where("margin > 1.05"),
    }


def linear_transform(vectors: DataFrame, matrix: np.ndarray) -> DataFrame:
    """(id, v) with each vector multiplied by ``matrix`` (d x m), such as a rotation or a projection before an index."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(matrix, np.float64))  # d x m numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if batch.num_rows:
                x = (_matrix(batch.column("v")) @ m).astype(np.float32)
                offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.reshape(-1)))], names=["id", "v"])

    return vectors.where("v is not null").select("id", "v").mapInArrow(run, "id bigint, v array<float>")


def hadamard(d: int, m: int) -> np.ndarray:
    """The first m columns of the d x d matrix of signs (-1)^(common bits of row and column), over the root of d."""
    common = np.arange(d)[:, None] & np.arange(m)[None]
    parity = np.array([[bin(c).count("1") & 1 for c in row] for row in common])
    return (1 - 2 * parity) / np.sqrt(d)


def search_in_batches(queries: DataFrame, path: str, batch_rows: int, search: Callable[[DataFrame], DataFrame], most: int | None = None) -> int:
    """Searches batches of ``batch_rows`` consecutive ids, each into a folder of its own under ``path``. Finished batches
    are passed over, so a job that broke off goes on where it was; returns how many were searched."""
    spark = queries.sparkSession
    last = queries.agg(F.max("id")).first()[0]
    done = 0
    for number in range(0 if last is None else last // batch_rows + 1):
        folder = f"{path}/batch={number}"
        try:
            spark.read.parquet(folder)
            continue
        except AnalysisException:
            pass
        if most is not None and done >= most:
            break
        search(queries.where((F.col("id") >= number * batch_rows) & (F.col("id") < (number + 1) * batch_rows))).write.mode("overwrite").parquet(folder)
        done += 1
    return done
