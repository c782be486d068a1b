"""Documents packed into containers of fixed capacity by the sum-of-squares rule.

With N(g) the number of open containers that have g tokens left, an item goes where the sum of N(g)^2 afterwards is
smallest: levels are kept even, so that some container fits whatever comes next. Documents above the capacity are cut
at natural boundaries into pieces within it (splitter), and only these.

Documents are spread by a hash over groups of about GROUP items, each packed by one task. Containers that a group leaves
less than ``full`` filled are opened again and their items packed once more, group sizes being equal, so that waste per
group doesn't add up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import table
from .splitter import pieces
from .text import rate_tokens, with_rate

GROUP = 50_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item, in order, and the tokens left in each container. Sizes are 1..capacity."""
    open_at = np.zeros(capacity + 1, np.int64)  # N(g); N(0) and N(capacity) stay 0 in the sum
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    left: list[int] = []
    out = np.empty(len(sizes), np.int64)
    for i, s in enumerate(map(int, sizes)):
        # taking a container at gap g: 2 (N(g - s) - N(g)) + 2, without the first term and with 1 at g = s
        change = np.empty(capacity - s + 1, np.int64)  # for gaps s..capacity; the last stands for a new one
        np.subtract(open_at[: capacity - s + 1], open_at[s:], out=change)
        change *= 2
        change += 2
        change[0] = 1 - 2 * open_at[s]
        change[:-1][open_at[s:capacity] == 0] = np.iinfo(np.int64).max
        change[-1] = 2 * open_at[capacity - s] + 1 if s < capacity else 0
        gap = s + int(change.argmin())
        if gap == capacity:
            container = len(left)
            left.append(capacity)
        else:
            container = stacks[gap].pop()
            open_at[gap] -= 1
        out[i] = container
        rest = left[container] - s
        left[container] = rest
        if rest:
            stacks[rest].append(container)
            open_at[rest] += 1
    return out, np.array(left, np.int64)


def _packed(items: DataFrame, groups: int, capacity: int, full: float, first: int) -> DataFrame:
    """(doc_id, piece, n_tokens, container, settled) of items spread over ``groups``, numbered from ``first``."""

    def run(key, group: pa.Table) -> pa.Table:
        group = group.sort_by([("_order", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        container, left = sum_of_squares(np.asarray(group.column("n_tokens")), capacity)
        settled = capacity - left >= full * capacity
        # the number of a container: its group, then its place in it
        names = (np.int64(first + key[0].as_py()) << 32) + container
        return pa.table([group.column("doc_id"), group.column("piece"), group.column("n_tokens"), pa.array(names), pa.array(settled[container])], names=["doc_id", "piece", "n_tokens", "container", "settled"])

    spread = items.select("doc_id", "piece", "n_tokens", F.xxhash64(F.lit(first), "doc_id", "piece").alias("_order")).withColumn("_group", F.pmod(F.col("_order"), F.lit(groups)).cast("int"))
    return spread.groupBy("_group").applyInArrow(lambda key, t: run(key, t.drop_columns(["_group"])), "doc_id bigint, piece int, n_tokens bigint, container bigint, settled boolean")


def sized(documents: DataFrame, rates: DataFrame) -> DataFrame:
    """(doc_id, text, rate, n_tokens): the token size of each text under its language."""
    rated = with_rate(documents.select("doc_id", "text", "lang"), F.col("lang"), rates)
    return rated.select("doc_id", "text", F.col("_rate").alias("rate"), rate_tokens(F.coalesce(F.octet_length("text"), F.lit(0)), F.col("_rate")).alias("n_tokens"))


def pack(documents: DataFrame, rates: DataFrame, capacity: int, group: int = GROUP, full: float = 0.9) -> DataFrame:
    """(doc_id, piece, n_tokens, container): every document with at least one token in a container of ``capacity``.

    ``documents`` has (doc_id, text, lang); other columns are ignored. A document above the capacity comes as
    pieces 0, 1, ...; any other is piece 0 and whole. Null and empty texts have no tokens and no container.
    Repeated texts are packed one by one. The result depends on the rows only, not on their partitions."""
    rows = sized(documents, rates)
    whole = rows.where((F.col("n_tokens") > 0) & (F.col("n_tokens") <= capacity)).select("doc_id", F.lit(0).alias("piece"), "n_tokens")
    over = rows.where(F.col("n_tokens") > capacity).select(F.col("doc_id").alias("rec"), "text", "rate")
    rate = over.select(F.col("rec").alias("doc_id"), "rate")
    cut = pieces(over, capacity, 0).select(F.col("rec").alias("doc_id"), "piece", "n_bytes")
    cut = cut.join(rate, "doc_id").select("doc_id", "piece", rate_tokens(F.col("n_bytes"), F.col("rate")).alias("n_tokens"))
    items = table(whole.unionByName(cut), "items")
    groups = max(1, -(-items.count() // group))
    once = table(_packed(items, groups, capacity, full, 0), "packed")
    again = table(once.where("not settled").select("doc_id", "piece", "n_tokens"), "again")
    rest = max(1, -(-again.count() // group))
    twice = _packed(again, rest, capacity, full, groups)
    return once.where("settled").unionByName(twice).select("doc_id", "piece", "n_tokens", "container")


def split_documents(packed: DataFrame) -> DataFrame:
    """(doc_id) of the documents that came as several pieces."""
    return packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")


def usage(packed: DataFrame, capacity: int) -> DataFrame:
    """(n_containers, n_tokens, n_unused, share_used): one row."""
    total = packed.agg(F.count_distinct("container").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    room = F.col("n_containers") * capacity
    return total.select("n_containers", "n_tokens", (room - F.col("n_tokens")).alias("n_unused"), F.round(F.try_divide(F.col("n_tokens"), room), 6).alias("share_used"))


def breaches(packed: DataFrame, documents: DataFrame, rates: DataFrame, capacity: int) -> DataFrame:
    """(rule, id): where a packing breaks its rules; empty for a right one. ``over``: a container above the capacity;
    ``missing``: a document with tokens that isn't packed; ``unknown``: one packed that has none; ``split``: one of several
    pieces that would fit whole; ``short``: one whose pieces hold fewer tokens than it."""
    size = sized(documents, rates).where("n_tokens > 0").select("doc_id", F.col("n_tokens").alias("size"))
    mine = packed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("held"))
    both = size.join(mine, "doc_id", "full")
    rule = F.when(F.col("n").isNull(), "missing").when(F.col("size").isNull(), "unknown").when((F.col("n") > 1) & (F.col("size") <= capacity), "split").when(F.col("held") < F.col("size"), "short")
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("t")).where(F.col("t") > capacity).select(F.lit("over").alias("rule"), F.col("container").alias("id"))
    return both.select(rule.alias("rule"), F.col("doc_id").alias("id")).where("rule is not null").unionByName(over)
