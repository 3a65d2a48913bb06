"""2-D neighbour embedding (t-SNE) of a bounded number of vectors.

The published plot shows the first few hundred words; ``limit`` is that number, and all tables here are bounded by it. Spark finds
each point's nearest neighbours and searches its bandwidth, point by point in parallel; the symmetric neighbour graph is
stored. A step broadcasts the positions (two numbers a point), tasks compute the forces on their own points, and
the driver moves all points with momentum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.sources.sinks import discard, materialise

#: Steps in all, those of them with the attraction raised, and by how much; points of a task. The size of a step is the
#: number of points over 12, 10 at least.
STEPS, EARLY, RAISED, TASK_POINTS = 60, 15, 4.0, 256


def bandwidth(d2: np.ndarray, perplexity: float) -> np.ndarray:
    """Neighbour probabilities of one point from squared distances, their entropy the logarithm of ``perplexity``."""
    low, high, beta = 0.0, np.inf, 1.0 / max(d2.mean(), 1e-12)
    for _ in range(60):
        p = np.exp(-beta * (d2 - d2.min()))
        p /= p.sum()
        if -(p * np.log(np.maximum(p, 1e-300))).sum() > np.log(perplexity):
            low, beta = beta, beta * 2 if high == np.inf else (beta + high) / 2
        else:
            high, beta = beta, (beta + low) / 2
    return p


def neighbour_graph(points: DataFrame, perplexity: float) -> DataFrame:
    """``(i, j, p)``: for each point its nearest three times ``perplexity`` others, both directions added up.

    points: ``(i, vec)``, numbered from 0; as many as the caller's limit, so each task may hold them all."""
    table = points.orderBy("i").toArrow()
    x = np.array(table["vec"].to_pylist(), float)
    shared = points.sparkSession.sparkContext.broadcast(x)
    k = min(len(x) - 1, int(3 * perplexity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in b.column(0).to_pylist():
                d2 = ((shared.value - shared.value[i]) ** 2).sum(axis=1)
                d2[i] = np.inf
                near = np.argsort(d2, kind="stable")[:k]
                p = bandwidth(d2[near], min(perplexity, k)) / (2 * len(shared.value))
                rows += [(a, c, v) for j, v in zip(near.tolist(), p.tolist()) for a, c in ((i, j), (j, i))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))]
                                             if rows else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())],
                                             names=["i", "j", "p"])

    return points.select("i").mapInArrow(run, "i long, j long, p double").groupBy("i", "j").agg(F.sum("p").alias("p"))


def forces(y: np.ndarray, i: np.ndarray, near: list[np.ndarray], p: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
    """(attraction, unscaled repulsion, sum of all similarities) of the points ``i`` among the positions ``y``."""
    diff = y[i][:, None, :] - y[None, :, :]
    q = 1 / (1 + (diff ** 2).sum(axis=2))
    q[np.arange(len(i)), i] = 0
    push = (q[:, :, None] ** 2 * diff).sum(axis=1)
    pull = np.array([((w * q[a, j])[:, None] * diff[a, j]).sum(axis=0) for a, (j, w) in enumerate(zip(near, p))]).reshape(-1, 2)
    return pull, push, float(q.sum())


def neighbour_embedding(vectors: DataFrame, id_col: str, vec_col: str, limit: int = 500, perplexity: float = 30.0,
                        steps: int = STEPS) -> DataFrame:
    """``(id, x, y)`` of the first ``limit`` vectors by id; NULL vectors take no part. The same input gives the same plot."""
    spark = vectors.sparkSession
    first = (vectors.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
             .orderBy("id").limit(limit).toArrow())
    schema = f"id {vectors.schema[id_col].dataType.simpleString()}, x double, y double"
    ids, n = first["id"].to_pylist(), len(first)
    rate = max(10.0, n / 12)
    if n < 3:
        return spark.createDataFrame([(v, float(a), 0.0) for a, v in enumerate(ids)], schema)
    x = np.array(first["vec"].to_pylist())
    points = spark.createDataFrame([(a, v.tolist()) for a, v in enumerate(x)], "i long, vec array<double>")
    graph = materialise(neighbour_graph(points, min(perplexity, (n - 1) / 3)).groupBy("i").agg(
        F.collect_list(F.struct("j", "p")).alias("near")), "neighbours")
    centred = x - x.mean(axis=0)
    axes = np.linalg.svd(centred, full_matrices=False)[2][:2]
    axes *= np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] < 0, -1, 1)[:, None]
    y = np.zeros((n, 2))
    y[:, : len(axes)] = centred @ axes.T
    y *= 1e-2 / max(y.std(), 1e-12)
    speed, gain, own = np.zeros_like(y), np.ones_like(y), graph.coalesce(max(1, n // TASK_POINTS))
    for step in range(steps):
        shared = spark.sparkContext.broadcast(y)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                i = b.column(0).to_numpy()
                near = [[(e["j"], e["p"]) for e in row] for row in b.column(1).to_pylist()]
                pull, push, z = forces(shared.value, i, [np.array([j for j, _ in r], int) for r in near],
                                       [np.array([p for _, p in r]) for r in near])
                rows = np.column_stack([pull, push])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows.tolist(), pa.list_(pa.float64())),
                                                  pa.array([z / len(i)] * len(i))], names=["i", "f", "z"])

        got = own.mapInArrow(run, "i long, f array<double>, z double").toArrow().sort_by("i")
        shared.destroy()
        f, z = np.array(got["f"].to_pylist()), float(np.sum(got["z"].to_numpy()))
        grad = 4 * ((RAISED if step < EARLY else 1.0) * f[:, :2] - f[:, 2:] / max(z, 1e-12))
        gain = np.maximum(0.01, np.where(np.sign(grad) != np.sign(speed), gain + 0.2, gain * 0.8))
        speed = (0.5 if step < EARLY else 0.8) * speed - rate * gain * grad
        y = y + speed
        y -= y.mean(axis=0)
    discard(graph)
    return spark.createDataFrame([(v, float(a), float(b)) for v, (a, b) in zip(ids, y)], schema)
