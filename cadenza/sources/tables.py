"""Parquet table scans and the tag-store / song-table views over them.

Every reader returns a lazy DataFrame; Catalyst prunes columns and pushes
filters into the Parquet scan, so callers select only what they use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@dataclass(frozen=True)
class TagStore:
    """The three normalised tag tables with explicit integer keys.

    tids(tid_id bigint, tid string)
    tags(tag_id bigint, tag string)
    tid_tag(tid_id bigint, tag_id bigint, val double, tag_ord)
    ``tag_ord`` is the row order the store returns a song's tags in (any
    orderable type; here a pair); the first-tag-wins rule needs it, and a
    plain table has no row order.

    A store may derive its rows from texts, each tag's text its own id. It then
    gives ``found`` (tid_id, found_tags) of the songs with tags, and ``rows``: the
    rows of ``tid_tag`` whose tag meets a condition, tested before any shuffle; a
    second condition may leave out whole texts, words and single blanks, first.
    """

    tids: DataFrame
    tags: DataFrame
    tid_tag: DataFrame
    found: DataFrame | None = None
    rows: Callable[..., DataFrame] | None = None


def tag_store(spark: SparkSession, sf_dir: str) -> TagStore:
    """Tag store over the driver tables: orders = tids, part = tags,
    lineitem = tid_tag (song = order, tag = part name, val = quantity)."""
    orders = read_table(spark, sf_dir, "orders")
    part = read_table(spark, sf_dir, "part")
    lineitem = read_table(spark, sf_dir, "lineitem")
    tids = orders.select(F.col("o_orderkey").alias("tid_id"),
                         F.col("o_orderkey").cast("string").alias("tid"))
    tags = part.select(F.col("p_partkey").alias("tag_id"), F.col("p_name").alias("tag"))
    tid_tag = lineitem.select(
        F.col("l_orderkey").alias("tid_id"),
        F.col("l_partkey").alias("tag_id"),
        F.col("l_quantity").alias("val"),
        F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")).alias("tag_ord"),
    )
    return TagStore(tids, tags, tid_tag)


def song_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Song rows over ``documents``: msd_id = doc_id, artist = source,
    title = 'doc <id>', lyrics file name derived from both."""
    docs = read_table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("msd_id"),
        F.col("source").alias("msd_artist"),
        F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("msd_title"),
        F.col("doc_id"),
    )
