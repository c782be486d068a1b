"""Documents packed into contexts by a token budget, and token histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import seeded


def context_numbers(tokens: Column, limit: Column) -> Column:
    """For an array of token counts, the number (from 0) of each element's context: a context is closed by the element
    that brings its sum to ``limit`` or above. Null counts are 0."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("c"), F.lit(0).cast("bigint").alias("sum"))

    def step(acc: Column, t: Column) -> Column:
        total = acc["sum"] + F.coalesce(t, F.lit(0))
        full = total >= limit
        return F.struct(F.concat(acc["out"], F.array(acc["c"])).alias("out"), (acc["c"] + full.cast("int")).alias("c"), F.when(full, 0).otherwise(total).cast("bigint").alias("sum"))

    return F.aggregate(tokens, start, step, lambda acc: acc["out"])


def pack_paths(paths: DataFrame, tokens: Column, mode: str = "random", low: int = 1600, high: int = 3200, seed: int = 0) -> DataFrame:
    """(path_id, context, first_pos, n_docs, n_tokens): contexts of each path.

    ``paths`` has (path_id, content_path); ``tokens`` is the array of token counts of its documents. ``random``: each
    path draws a limit from [low, high]; the document that crosses it is included, and what is left at the end is a
    context too. ``whole``: one context per path. Empty and null paths have none."""
    limit = seeded.between(seed, F.lit(low), F.lit(high), F.col("path_id"))
    number = context_numbers(F.col("_t"), limit) if mode == "random" else F.transform("_t", lambda _: F.lit(0))
    docs = paths.select("path_id", tokens.alias("_t")).select("path_id", F.posexplode(F.arrays_zip(F.col("_t").alias("t"), number.alias("c"))).alias("pos", "d"))
    return docs.groupBy("path_id", F.col("d.c").alias("context")).agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("d.t"), F.lit(0)).alias("n_tokens"))


def token_histogram(items: DataFrame, by: str, upper: int = 32_768, step: int = 2_048) -> DataFrame:
    """(by, bucket, n, n_over): items per bucket of ``step`` tokens; the last takes everything above ``upper``, which
    ``n_over`` counts. Every bucket is listed for every value of ``by``; null counts are left out, and negative or zero
    ones fall into bucket 0."""
    span = upper // step + 1
    bucket = F.greatest(F.least(F.ceil(F.col("token_count") / F.lit(float(step))), F.lit(span)) - 1, F.lit(0)).cast("int")
    counted = items.where("token_count is not null").groupBy(F.col(by).alias("_by"), bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("token_count") > upper).alias("n_over"))
    every = items.where("token_count is not null").select(F.col(by).alias("_by")).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(span - 1))))
    same = F.col("a._by").eqNullSafe(F.col("b._by")) & (F.col("a.bucket") == F.col("b.bucket"))
    return every.alias("a").join(counted.alias("b"), same, "left").select(F.col("a._by").alias(by), "a.bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_over", F.lit(0)).alias("n_over"))
