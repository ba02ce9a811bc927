"""What the operators share: the documents table, cut points and links to components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where that is unset and all runs on this machine (tests), a folder of this session."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='quirespark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame, name: str, rebalance: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: what follows doesn't run df again, and a lost executor loses none of it.

    rebalance: the table is much smaller than what it is made from; AQE chooses the number of its files by size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if rebalance else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Most rows of an Arrow batch: texts are long, and a batch is held by the executor and by its Python worker.
BATCH = 1000


def give_back() -> None:
    """Returns free memory to the system. Python workers outlive their tasks, and what they hold counts beside the next stages of their executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def returning(f):
    """f, which gives free memory back when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def map_arrow(df: DataFrame, f, schema) -> DataFrame:
    """df.mapInArrow(f, schema) in small batches."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, BATCH)
    return df.mapInArrow(returning(f), schema)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of links(a, b) reaches.

    Alternates large-star and small-star rounds, each an aggregation and an equi-join, until
    every node hangs directly on the smallest of its component. No group is gathered in a task:
    minima are aggregated before the shuffle and written, so that both sides of the join back have plain
    exchanges, whose partitions AQE splits where many edges share a node.
    """
    stars = cut(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links", True)
    seen = None
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", True)
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large", True)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least", True)
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v")
        stars = cut(small.distinct(), "stars", True)
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
