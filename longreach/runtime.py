"""Session settings and tables that cut lineage.

Everything that outlives one stage is written as a parquet table into the shared folder named by
``spark.checkpoint.dir``; a folder of our own is used only where that setting is absent (local tests).
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: str | None = None
_WRITTEN: list[str] = []


def session(app: str = "longreach", cores: str | int = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the operators assume; ``conf`` wins over them. The master is that of the cluster
    that submitted the program, and local only where there is none."""
    builder = SparkSession.builder
    if not SparkConf().contains("spark.master"):  # set by spark-submit
        builder = builder.master(f"local[{cores}]")
    builder = (
        builder.appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or a local one where it is unset."""
    global _OWN_DIR
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="longreach-")
        atexit.register(shutil.rmtree, _OWN_DIR, ignore_errors=True)
    return _OWN_DIR


def table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back: the lineage ends at files."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/longreach-{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def table_state(df: DataFrame) -> tuple[int, int]:
    """Number of rows and a checksum of them that doesn't depend on their order."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0)).alias("x")).first()
    return row["n"], row["x"]


HOT, PARTS = 10_000, 1024  # rows of a key above which a join is salted; parts that the rows of such keys fall into at first


def salted_join(rows: DataFrame, values: DataFrame, key: list[str], by: list[str], size: str, hot: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``values``, which has few rows per ``key`` and in ``size`` how many of the other have it.

    Rows of a key with more than HOT rows are spread by a hash of ``by`` over parts of about HOT rows, and its values
    are copied once per part, so that no task gets all rows of a key whatever the plan. Where no key is hot, it is a plain
    join. Hot keys are told to the rows by PARTS copies of each: they are a small part of what they stand for, and they
    are joined, not broadcast. ``size`` may count fewer rows than there are, as long as it grows with them."""
    hot = HOT if hot is None else hot
    many = values.where(F.col(size) > hot).select(*key, F.ceil(F.col(size) / hot).cast("int").alias("_parts")).distinct()
    if many.isEmpty():
        return rows.join(values, key)
    told = many.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    spread = rows.withColumn("_at", F.pmod(F.xxhash64(*by), F.lit(PARTS)).cast("int")).join(told, [*key, "_at"], "left").drop("_at")
    spread = spread.withColumn("_part", F.pmod(F.xxhash64(F.lit(1), *by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copies = values.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(size) / hot).cast("int") - 1))))
    return spread.join(copies, [*key, "_part"]).drop("_part")


def drop_tables(spark: SparkSession) -> int:
    """Deletes what ``table`` has written in this process; call it when no result that reads from it is needed."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    dropped = 0
    while _WRITTEN:
        path = hadoop.Path(_WRITTEN.pop())
        dropped += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return dropped


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
