"""Exact nearest vectors by multi-resolution segment statistics.

Vectors are integers, floor(256 * x). For a cut of the components into
segments, a vector's row of (root of length times mean, root of length times deviation)
per segment gives a lower bound of the squared distance of two vectors:
|q - x|^2 >= |s(q) - s(x)|^2, with |s(q)| = |q|. Since |q - x|^2 = |q|^2 + |x|^2 - 2 qx,
the bound says that the inner product is at most s(q) s(x). The search goes from
one segment to many, drops every pair whose bound is below the query's k-th score so far, and computes
the exact integer score of the pairs left.

The statistics are stored once with the vectors. Queries are taken in blocks of bounded size;
a block is sent to the tasks that stream the stored vectors, so these are never shuffled again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cadenza.llm.common import Stages

#: Numbers of segments, coarse to fine; those with under two components a segment are left out.
LEVELS = (1, 4, 16)
SCALE = 256
#: Queries of a block (on average), queries and vectors that are compared at a time.
BLOCK, STEP, CHUNK = 16384, 256, 2048
#: Candidates of the best coarse bound that are scored first for a query without k scores, as a multiple of k.
PROBES = 4
#: Share of pairs left from which a matrix product over all of them is cheaper than one pair after another.
DENSE = 0.1
#: The sums behind a bound are rounded; this share of the two lengths' product is far more than they can lose.
SLACK = 1e-9
#: Integers up to here are exact in a double, and so are all sums of products whose lengths' product stays below.
EXACT = 2.0 ** 53


def levels(dim: int, wanted: tuple[int, ...] = LEVELS) -> list[int]:
    return [s for s in wanted if 2 * s <= dim]


def statistics(x: np.ndarray, wanted: tuple[int, ...] = LEVELS) -> np.ndarray:
    """Rows of all levels side by side: for each segment the root of its length times mean, and times deviation."""
    out = [np.empty((len(x), 0))]
    for s in levels(x.shape[1], wanted):
        ends = np.linspace(0, x.shape[1], s + 1).astype(int)
        size = np.diff(ends)
        mean = np.add.reduceat(x, ends[:-1], axis=1) / size
        square = np.add.reduceat((x - np.repeat(mean, size, axis=1)) ** 2, ends[:-1], axis=1)
        out += [mean * np.sqrt(size), np.sqrt(square)]
    return np.hstack(out)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec): rows with an id and a vector without null or non-finite components; once each."""
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vec"))
            .where("vec_id IS NOT NULL AND vec IS NOT NULL AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) "
                   "AND abs(x) < double('Infinity'))").distinct())


def _by_length(vecs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length that the rows of a list column have."""
    offsets = vecs.offsets.to_numpy()
    sizes = np.diff(offsets)
    flat = vecs.values.to_numpy(zero_copy_only=False)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)[None, :]]


def build_index(rows: DataFrame, stages: Stages, wanted: tuple[int, ...] = LEVELS) -> DataFrame:
    """(vec_id, vec, stats): integers (as doubles, each exact) and statistics of every level, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in _by_length(b.column(1)):
                x = np.floor(SCALE * x)
                stats = statistics(x, wanted)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(at)), _lists(x), _lists(stats)], names=["vec_id", "vec", "stats"])

    return stages.put(rows.mapInArrow(run, "vec_id long, vec array<double>, stats array<double>"), "index")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


class Block:
    """Queries of one length and their best k so far, each a pair (score, id), best first."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, stats: np.ndarray, k: int, wanted: tuple[int, ...] = LEVELS):
        self.ids, self.q, self.stats, self.k = ids, vecs, stats, k
        self.length = np.sqrt((vecs ** 2).sum(axis=1))
        ends = np.cumsum([0] + [2 * s for s in levels(vecs.shape[1], wanted)])
        self.parts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
        # scores are integers; as objects only if some are beyond the exact range of a double
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]
        self.least = np.full(len(ids), -np.inf)  # k-th score so far, rounded down
        self.scored = 0

    def meet(self, ids: np.ndarray, x: np.ndarray, stats: np.ndarray) -> None:
        """Bounds from coarse to fine, then exact scores of the pairs that may be among a query's k."""
        length = np.sqrt((x ** 2).sum(axis=1))
        for a in range(0, len(self.ids), STEP):
            part = slice(a, min(a + STEP, len(self.ids)))
            slack = SLACK * self.length[part][:, None] * length[None, :] + SLACK
            bound = (self.stats[part, self.parts[0]] @ stats[:, self.parts[0]].T if self.parts
                     else self.length[part][:, None] * length[None, :]) + slack
            bound[self.ids[part][:, None] == ids[None, :]] = -np.inf
            if np.isneginf(self.least[part]).any() and len(ids) > PROBES * self.k:
                top = np.argpartition(-bound, PROBES * self.k, axis=1)[:, : PROBES * self.k]
                row = np.repeat(np.arange(len(top)), top.shape[1])
                ok = np.isfinite(bound[row, top.ravel()])
                self._keep(a, row[ok], top.ravel()[ok], ids, x, length)
                bound[row, top.ravel()] = -np.inf
            alive = (bound >= self.least[part][:, None]) & np.isfinite(bound)
            for level in self.parts[1:]:
                share = alive.mean()
                if share > DENSE:
                    alive &= self.stats[part, level] @ stats[:, level].T + slack >= self.least[part][:, None]
                elif share:
                    row, col = np.nonzero(alive)
                    fine = _pairs(self.stats[part, level], stats[:, level], row, col) + slack[row, col]
                    gone = fine < self.least[part][row]
                    alive[row[gone], col[gone]] = False
            row, col = np.nonzero(alive)
            if len(row):
                self._keep(a, row, col, ids, x, length, dense=alive.mean() > DENSE)

    def _keep(self, a: int, row: np.ndarray, col: np.ndarray, ids: np.ndarray, x: np.ndarray, length: np.ndarray,
              dense: bool = False) -> None:
        """Exact scores of the pairs, and each query's best k with those it had."""
        self.scored += len(row)
        q = self.q[a: a + STEP]
        exact = (self.length[a: a + STEP].max() * length.max()) < EXACT if len(row) else True
        if exact:
            score = (q @ x.T)[row, col] if dense else _pairs(q, x, row, col)
        else:
            score = np.array([sum(int(s) * int(t) for s, t in zip(q[r], x[c])) for r, c in zip(row, col)], object)
        # of each query's scores here, those under its own k-th are out at once
        keep = score >= self.least[a + row] if exact else np.ones(len(row), bool)
        row, col, score = row[keep], col[keep], score[keep]
        order = np.lexsort((ids[col], -score.astype(np.float64), row)) if exact else np.array(
            sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[col[i]])), int)
        row, col, score = row[order], col[order], score[order]
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else []
        for at, end in zip(begin, [*begin[1:], len(row)]):
            i = a + row[at]
            end = min(end, at + self.k)
            new = list(zip(map(int, score[at:end]), map(int, ids[col[at:end]])))
            self.best[i] = sorted(self.best[i] + new, key=lambda p: (-p[0], p[1]))[: self.k]
            if len(self.best[i]) == self.k:
                least = self.best[i][-1][0]
                self.least[i] = least if abs(least) < EXACT else np.nextafter(float(least), -np.inf)


def _pairs(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    out = np.empty(len(row))
    for i in range(0, len(row), step):
        out[i: i + step] = np.einsum("ij,ij->i", a[row[i: i + step]], b[col[i: i + step]])
    return out


def _matrices(b: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, vectors, statistics) for each length of vector in an index batch."""
    stats = b.column(2)
    ids = b.column(0).to_numpy(zero_copy_only=False)
    for at, x in _by_length(b.column(1)):
        yield ids[at], x, next(s for _, s in _by_length(stats.take(pa.array(at))))


FOUND = "qrow long, query_id long, vec_id long, score long"


def search_block(index: DataFrame, block: pa.Table, k: int, wanted: tuple[int, ...] = LEVELS) -> DataFrame:
    """(qrow, query_id, vec_id, score): the k best of every task for every query of the block."""
    shared = index.sparkSession.sparkContext.broadcast(
        [(len(ids), ids, x, s) for ids, x, s in _matrices(block.combine_chunks().to_batches()[0])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = {x.shape[1]: Block(ids, x, s, k, wanted) for _, ids, x, s in shared.value}
        for b in batches:
            for at in range(0, b.num_rows, CHUNK):
                for ids, x, s in _matrices(b.slice(at, CHUNK)):
                    if x.shape[1] in blocks:
                        blocks[x.shape[1]].meet(ids, x, s)
        first = 0
        for q in blocks.values():
            rows = [(first + i, int(q.ids[i]), v, s) for i, best in enumerate(q.best) for s, v in best]
            first += len(q.ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)],
                names=["qrow", "query_id", "vec_id", "score"])

    return index.mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, wanted: tuple[int, ...] = LEVELS, block: int = BLOCK,
          id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): exactly the k largest integer inner products for each row whose id is divisible by ``every``.

    * null ids, and vectors that are null or hold null or non-finite components: neither query nor candidate;
    * zero vectors take part; vectors of different lengths never meet, an empty one meets empty ones with score 0;
    * equal scores: the smaller vec_id first; repeated rows (same id and vector) count once; rows of one id with other
      vectors are queries, and candidates, of their own, but never for a query of their id;
    * scores are exact for components of any size; one that a long can't hold ends the job with an error;
    * fewer candidates than k: all of them; empty table: empty result; extra columns are not read.

    Every query meets every vector, as the statement of the work asks; the number of scans of the index is the number
    of queries over ``block``.
    """
    spark = vectors.sparkSession
    stages = Stages(spark, "segments")
    index = build_index(usable(vectors, id_col, vector_col), stages, wanted)
    queries = index.where(F.col("vec_id") % every == 0)
    blocks = math.ceil(queries.count() / block)
    schema = "query_id long, rank int, vec_id long, score long"
    if not blocks:
        return spark.createDataFrame([], StructType.fromDDL(schema))
    dealt = stages.put(queries.withColumn("block", F.expr(f"CAST(pmod(xxhash64(vec_id, vec), {blocks}) AS INT)"))
                       .repartition(blocks, "block"), "queries") if blocks > 1 else queries.withColumn("block", F.lit(0))
    done = []
    for i in range(blocks):
        part = dealt.where(F.col("block") == i).select("vec_id", "vec", "stats").toArrow()
        if len(part):
            found = search_block(index, part, k, wanted)
            done.append(stages.put(found.selectExpr(
                "query_id", "CAST(row_number() OVER (PARTITION BY qrow ORDER BY score DESC, vec_id) AS INT) AS rank",
                "vec_id", "score").where(f"rank <= {k}"), f"found-{i}"))
    return spark.read.schema(schema).parquet(*[d._stage_path for d in done])


#: The same in DuckDB, over ``embeddings``.
ORACLE = """
WITH e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
