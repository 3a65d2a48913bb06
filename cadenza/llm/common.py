"""Shared pieces of the training-data operators: staged tables, batch slicing, components."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.session import app_scratch, delete_path

# Functions of this package travel to the executors with their code: nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules["cadenza.llm"])


def worker_cache() -> dict:
    """A dict that lives as long as the Python worker, for tables that are dear to build."""
    name = "_cadenza_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stages:
    """Parquet tables in the shared folder that cut the lineage of a job.

    Every executor reads them, so a lost executor costs a re-read and no
    recomputation. ``drop`` removes a table that no later plan reads; results are
    lazy and read the others, which ``session.clear_scratch`` removes when they are written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, app_scratch(spark, "llm", f"{name}-{uuid.uuid4().hex[:12]}")
        self.n = 0
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        out._stage_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        delete_path(self.spark, df._stage_path)


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 1 << 21,
           max_rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of about ``max_bytes`` of text, so a task's
    Python memory depends on that size (or on one longest text) only."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        lengths = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and (size + n > max_bytes or i - start >= max_rows):
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield batch.slice(start, len(lengths) - start)


def components(edges: DataFrame, stages: Stages) -> DataFrame:
    """Connected components of the links (a, b) over longs: rows (node, root), root the smallest node.

    Alternating large-star and small-star: each round is joins and grouped
    minima over edges, so no component ever meets in one task, and the number
    of rounds grows with the logarithm of the longest chain. Each round is a
    staged table; the one before it is dropped. It ends when every node has one
    link and none is linked to a node that has one itself: links go to smaller
    nodes, so each star's centre is its component's smallest. Nodes without a
    link are not in the result, self links are ignored, repeated links count once.
    """
    cur = stages.put(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        twice = cur.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
        chained = cur.select("a").join(cur.select(F.col("b").alias("a")), "a", "left_semi")
        if twice.union(chained).isEmpty():
            return cur.toDF("node", "root")
        both = cur.union(cur.select("b", "a")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
                 .where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", "m")).distinct())
        new = stages.put(small, "small")
        stages.drop(cur)
        cur = new
