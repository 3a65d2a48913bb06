"""Sharding by longest-processing-time scheduling.

Groups that must stay together (documents of equal text) go, largest first, to
the shard with the least bytes, taken from a heap. Groups of equal size are
interchangeable, so the schedule is made from the histogram of group sizes:
its rows are distinct sizes, at most the square root of twice the total bytes (sizes
that differ add up), streamed through one task in falling order. Groups find their shard by
their rank within their size; ranks and slots are numbered in buckets with
running offsets, so neither a frequent size nor a large shard meets in one task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Stages

SHARDS = 40
#: Bytes that each document takes beside its text.
OVERHEAD = 16
#: Parts in which the groups of one size, and the documents of one shard, are numbered.
RANK_BUCKETS, SLOT_BUCKETS = 64, 1024

_GROUP = ["g1", "g2"]


class Schedule:
    """The heap of (load, shard)."""

    def __init__(self, shards: int):
        self.heap = [(0, k) for k in range(shards)]

    def place(self, size: int, count: int) -> list[int]:
        """Give ``count`` groups of ``size`` one by one to the least-loaded shard; how many each shard gets."""
        got = [0] * len(self.heap)
        if count > len(self.heap) and size > 0:
            self._fill(size, count, got)
            count -= sum(got)
        for _ in range(count):
            load, k = self.heap[0]
            heapq.heapreplace(self.heap, (load + size, k))
            got[k] += 1
        return got

    def _fill(self, size: int, count: int, got: list[int]) -> None:
        """Most of many equal groups at once: all turns that surely come before the last.

        In the end the loads of the shards that got some differ by at most one size, so each turn
        that starts more than one size under their mean has been taken.
        """
        order = sorted(self.heap)
        total, level = 0, 0
        for m, (load, _) in enumerate(order, 1):
            total += load
            level = (total + count * size) // m
            if m < len(order) and order[m][0] >= level:
                break
        for i, (load, k) in enumerate(order):
            if (n := (level - size - load) // size) > 0:
                got[k] = n
                order[i] = (load + n * size, k)
        heapq.heapify(order)
        self.heap = order


def schedule(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(gsize, to, ends) from (gsize, n): the shards that get groups of a size, and the running number of groups up to each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Schedule(shards)
        for b in batches:
            got = [np.array(plan.place(s, n)) for s, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            to = [np.flatnonzero(g) for g in got]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t.astype(np.int32) for t in to], pa.list_(pa.int32())),
                 pa.array([np.cumsum(g[t]) for g, t in zip(got, to)], pa.list_(pa.int64()))], names=["gsize", "to", "ends"])

    return (sizes.select("gsize", "n").repartition(1).sortWithinPartitions(F.desc("gsize"))
            .mapInArrow(run, "gsize long, to array<int>, ends array<long>"))


def _numbered(rows: DataFrame, by: str, bucket: str, order: list, name: str) -> DataFrame:
    """Column ``name``: the place of each row among those of equal ``by``, from 0, numbered bucket by bucket."""
    each = Window.partitionBy(by, bucket).orderBy(*order)
    counts = rows.groupBy(by, bucket).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(by, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return (rows.withColumn("__in", F.row_number().over(each) - 1).join(starts, [by, bucket])
            .withColumn(name, (F.col("__in") + F.col("__start")).cast("long")).drop("__in", "__start", bucket))


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): every row of ``docs`` placed, equal texts in one shard.

    size: UTF-8 bytes of the text plus 16; slot: 0, 1, 2, ... within the shard.

    * null text: no bytes, one group with the empty text; null doc_id: placed like any other;
    * equal group sizes: the shard that the heap gives next (equal loads: the smaller number), groups by hash;
    * repeated rows: each has its own slot; a group larger than a shard's share fills its shard alone;
    * empty table: empty result; extra columns are not read.
    """
    stages = Stages(docs.sparkSession, "sharding")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stages.put(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
            "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("g1"),
            F.xxhash64(F.lit(1), text).alias("g2")), "rows")
    groups = stages.put(rows.groupBy(*_GROUP).agg(F.sum("size").alias("gsize")), "groups")
    plan = stages.put(schedule(groups.groupBy("gsize").agg(F.count("*").alias("n")), shards), "schedule")
    ranked = _numbered(groups.withColumn("__b", F.pmod("g1", F.lit(RANK_BUCKETS))), "gsize", "__b", _GROUP, "rank")
    # sorted and merged: the plan has a row for each size, which is too much to broadcast in the long run
    placed = ranked.join(plan.hint("merge"), "gsize").select(
        *_GROUP, F.expr("element_at(to, 1 + size(filter(ends, e -> e <= rank)))").alias("shard"))
    out = stages.put(rows.join(placed, _GROUP).drop(*_GROUP), "placed")
    out = out.withColumn("__b", F.pmod(F.xxhash64("doc_id"), F.lit(SLOT_BUCKETS)))
    return _numbered(out, "shard", "__b", ["doc_id", "size", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", "shard", "slot")
