"""Text and vector files in, tables with explicit keys out, and the sinks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import table

CORPUS = T.StructType([T.StructField("id", T.StringType()), T.StructField("content", T.StringType())])
PATHS = T.StructType([T.StructField("id_path", T.ArrayType(T.StringType())), T.StructField("content_path", T.ArrayType(T.StringType()))])


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType = CORPUS, strict: bool = True) -> DataFrame:
    """One row per line. A malformed line fails the read; with ``strict`` off its fields are null. Globs are fine."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, line, value): every line with its number from 0, counted in parallel.

    Spark splits files; each split's lines are numbered in their order, and splits are put in order by their start. The
    numbering is written nowhere: store it, since it depends on the files being the same."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"), "value")
    counts = raw.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(counts.withColumn("_before", before).select("file", "_start", "_first", "_before"), ["file", "_start"]).select("file", (F.col("_before") + F.col("_at") - F.col("_first")).alias("line"), "value")


def line_counts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n_lines), an unterminated last line included."""
    return spark.read.text(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n_lines"))


def file_offsets(counts: DataFrame, file: str = "file", n: str = "n_lines") -> DataFrame:
    """(file, n_lines, first_ord): the ordinal of each file's first row, files in order of name. One row per file."""
    w = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(file, n, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("first_ord"))


def with_ordinals(lines: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds ``doc_ord``, dense over all files, to (file, line, ...)."""
    return lines.join(file_offsets(counts).select("file", "first_ord"), "file").withColumn("doc_ord", F.col("first_ord") + F.col("line")).drop("first_ord")


def read_vectors(spark: SparkSession, files: list[tuple[str, str]], d: int, dtype: str = "float32", rows_per_task: int = 65_536) -> DataFrame:
    """(file, row, v) of matrix files, each a (path, format) with format ``raw`` or ``npy``.

    Files are cut into ranges of rows; a task seeks to its range and reads no more. Paths must be visible to all
    executors (any file system that Arrow knows). Wrong sizes and unknown formats are errors."""
    from pyarrow import fs

    width = d * np.dtype(dtype).itemsize
    ranges = []
    for path, fmt in files:
        store, local = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        size = store.get_file_info(local).size
        if fmt == "npy":
            with store.open_input_file(local) as f:
                version = np.lib.format.read_magic(f)
                shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                head = f.tell()
            if fortran or len(shape) != 2 or shape[1] != d or kind != np.dtype(dtype):
                raise ValueError(f"{path}: {shape} of {kind}, not rows of {d} {dtype}")
        elif fmt == "raw":
            head = 0
        else:
            raise ValueError(f"{path}: unknown format {fmt!r}")
        if (size - head) % width:
            raise ValueError(f"{path}: {size - head} bytes aren't rows of {width}")
        n = (size - head) // width
        ranges += [(path, head, s, min(n, s + rows_per_task)) for s in range(0, n, rows_per_task)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, head, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                store, local = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                with store.open_input_file(local) as f:
                    f.seek(head + start * width)
                    x = np.frombuffer(f.read((end - start) * width), dtype).astype(np.float32)
                offsets = np.arange(end - start + 1, dtype=np.int32) * d
                yield pa.RecordBatch.from_arrays([pa.array([path] * (end - start)), pa.array(np.arange(start, end)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(x))], names=["file", "row", "v"])

    plan = spark.createDataFrame(ranges, "path string, head bigint, start bigint, end bigint")
    return plan.repartition(max(1, len(ranges)), "path", "start").mapInArrow(run, "file string, row bigint, v array<float>")


def write_vectors(vectors: DataFrame, path: str) -> DataFrame:
    """Writes (id, v), sorted by id over all files, as raw matrices of floats under ``path``; (file, n, first_id) per file.

    A file is named by the first id that it holds and is written as a whole, so a task that runs again replaces it. Null
    vectors are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        parts, first, n = [], None, 0
        for batch in batches:
            if batch.num_rows:
                first = batch.column("id")[0].as_py() if first is None else first
                parts.append(np.asarray(batch.column("v").flatten()).astype(np.float32))
                n += batch.num_rows
        if n:
            name = f"{path}/{first:020d}.raw"
            store, local = fs.FileSystem.from_uri(name) if "://" in name else (fs.LocalFileSystem(), name)
            store.create_dir(local.rpartition("/")[0])
            with store.open_output_stream(local) as f:
                for x in parts:
                    f.write(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([first], pa.int64())], names=["file", "n", "first_id"])

    rows = vectors.where("v is not null").select("id", "v").repartitionByRange("id").sortWithinPartitions("id")
    return table(rows.mapInArrow(run, "file string, n bigint, first_id bigint"), "files")


def sniff_format(size: int, d: int, itemsize: int = 4) -> str:
    """``raw`` if so many bytes are whole rows, else ``npy``."""
    return "raw" if size % (d * itemsize) == 0 else "npy"


def describe_vectors(vectors: DataFrame, *by: str) -> DataFrame:
    """(by..., size, d): the catalog of stored vectors; d is null where lengths differ."""
    length = F.size("v")
    return vectors.where("v is not null").groupBy(*by).agg(F.count(F.lit(1)).alias("size"), F.when(F.min(length) == F.max(length), F.min(length)).alias("d"))


def write_jsonl(df: DataFrame, path: str, files: int | None = None, key: str | None = None) -> None:
    """One JSON object per line, characters as they are. With ``files`` and ``key``, so many files by ranges of key."""
    (df.repartitionByRange(files, key) if files and key else df).write.mode("error").json(path)


def write_partitioned(df: DataFrame, path: str, *by: str) -> None:
    """Parquet in a folder per value: insertion places, or type, language and domain."""
    df.write.mode("error").partitionBy(*by).parquet(path)


def pending(rows: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys aren't in ``done`` yet: resuming by key, not by counting lines."""
    return rows.join(done.select(*keys).distinct(), list(keys), "left_anti")
