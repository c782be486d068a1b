"""Text helpers shared by the training-text operators; Arrow and numpy only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` on each Arrow batch; batches that give nothing are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts in one array, and the length of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    raw = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), lengths


def language_code(lang: Column) -> Column:
    """First two letters in lower case; ``und`` where the label is null or blank."""
    code = F.lower(F.substring(F.trim(lang), 1, 2))
    return F.when(code.isNull() | (code == ""), F.lit("und")).otherwise(code)


def with_rate(df: DataFrame, lang: Column, rates: DataFrame, into: str = "_rate") -> DataFrame:
    """Adds the tokens per byte of each row's language; languages without a rate get that of ``und``.

    ``rates`` has one row per language (six here); at most 10,000 rows are accepted, so it may be broadcast.
    """
    rows = rates.where("lang is not null and tokens_per_byte is not null").limit(10_001).collect()
    if len(rows) > 10_000:
        raise ValueError("token rates: more than 10,000 languages")
    table = {r["lang"]: float(r["tokens_per_byte"]) for r in rows}
    pairs = [x for k in sorted(table) for x in (F.lit(k), F.lit(table[k]))]
    if not pairs:
        return df.withColumn(into, F.lit(None).cast("double"))
    known = F.create_map(*pairs)
    return df.withColumn(into, F.coalesce(F.try_element_at(known, language_code(lang)), F.lit(table.get("und")).cast("double")))


def limit_row(limits: DataFrame, purpose: str) -> tuple[int, int]:
    """``max_tokens`` and ``overlap_tokens`` of one purpose."""
    row = limits.where(F.col("purpose") == purpose).limit(1).collect()
    if not row:
        raise ValueError(f"size limits: no row for {purpose!r}")
    return int(row[0]["max_tokens"]), int(row[0]["overlap_tokens"] or 0)


def rate_tokens(n_bytes: Column, rate: Column) -> Column:
    """Bytes times rate, rounded up. The product is first rounded at the ninth place, so that the
    binary form of a rate never lifts a product that is whole."""
    return F.ceil(F.round(n_bytes * rate, 9)).cast("bigint")
