"""Approximate nearest neighbours on robust-pruned directed graphs.

Vectors are dealt into shards of bounded size by hash. In each shard a directed
graph is grown in batches: a greedy beam search for every new vector proposes
neighbours, relaxed distance pruning keeps a diverse few of them, and backward
edges are pruned alike. A query walks every shard's graph with a beam;
its nearest over all shards are kept, with scores in double precision.

The largest inner product becomes a nearest-neighbour problem by one more component that
gives all vectors the same length; a query has 0 there, so its order is that of the
inner product. Equal vectors are one node with its smallest ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Stages

#: Vectors in a shard (on average), out-edges of a node, beam while building and while searching, relaxation of the pruning.
SHARD_ROWS, DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA = 4000, 24, 48, 96, 1.2
#: Queries that meet one shard in one task, and queries walked in step.
BLOCK, STEP = 8192, 256
#: Beam entries that a query opens at a time.
OPEN = 4


class Graph:
    """Directed graph over one shard. ``x``: rows of equal length (the last component fills up); neighbours -1-padded."""

    def __init__(self, x: np.ndarray, neighbours: np.ndarray | None = None, degree: int = DEGREE):
        n = len(x)
        self.n, self.degree = n, degree
        self.x = np.vstack([x, np.zeros((1, x.shape[1]))]).astype(np.float32)  # the last row stands for "none"
        self.out = np.full((n + 1, degree), n, np.int32)
        if neighbours is not None:
            self.out[:n] = np.where(neighbours < 0, n, neighbours)
        self.start = int((self.x[:n] @ self.x[:n].mean(axis=0)).argmax()) if n else 0

    def search(self, q: np.ndarray, beam: int, start: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search of many queries in step: (ids, similarity), most similar first, ``n`` for none."""
        m, n = len(q), self.n
        beam = min(beam, n)
        ids = np.full((m, beam), n, np.int32)
        sim = np.full((m, beam), -np.inf, np.float32)
        ids[:, 0] = self.start if start is None else start
        sim[:, 0] = q @ self.x[ids[0, 0]]
        opened = np.zeros((m, beam), bool)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        seen[:, ids[0, 0]] = True
        act = np.arange(m)
        while len(act):
            todo = ~opened[act] & (ids[act] < n)
            some = todo.any(axis=1)
            act, todo = act[some], todo[some]
            if not len(act):
                break
            first = todo & (np.cumsum(todo, axis=1) <= OPEN)
            opened[act] |= first
            row, col = np.nonzero(first)
            cand = np.full((len(act), OPEN, self.degree), n, np.int32)
            cand[row, (np.cumsum(first, axis=1) - 1)[row, col]] = self.out[ids[act[row], col]]
            cand = np.sort(cand.reshape(len(act), -1), axis=1)
            cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
            cand[seen[act[:, None], cand]] = n
            seen[act[:, None], cand] = True
            got = np.einsum("qd,qcd->qc", q[act], self.x[cand])
            got[cand == n] = -np.inf
            all_sim = np.concatenate([sim[act], got], axis=1)
            top = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
            sim[act] = np.take_along_axis(all_sim, top, 1)
            ids[act] = np.take_along_axis(np.concatenate([ids[act], cand], axis=1), top, 1)
            opened[act] = np.take_along_axis(np.concatenate([opened[act], np.zeros(cand.shape, bool)], axis=1), top, 1)
        ids[~np.isfinite(sim)] = n
        return ids, sim

    def prune(self, nodes: np.ndarray, cand: np.ndarray, alpha: float = ALPHA) -> None:
        """Set the nodes' edges: nearest candidates first, each drops those that it is much nearer to than the node is."""
        x, n = self.x, self.n
        cand = np.sort(np.where(cand == nodes[:, None], n, cand), axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n
        sim = np.einsum("pd,pcd->pc", x[nodes], x[cand])
        sim[cand == n] = -np.inf
        order = np.argsort(-sim, axis=1, kind="stable")
        cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
        v = x[cand]
        # all rows are equally long, so a squared distance is twice the length's square less the similarity
        square = (x[nodes] ** 2).sum(axis=1)
        to_node = 2 * (square[:, None] - sim)
        between = 2 * (square[:, None, None] - v @ v.transpose(0, 2, 1))
        alive = cand < n
        out = np.full((len(nodes), self.degree), n, np.int32)
        rows = np.arange(len(nodes))
        for r in range(self.degree):
            pick = alive.argmax(axis=1)
            ok = alive[rows, pick]
            if not ok.any():
                break
            out[ok, r] = cand[rows, pick][ok]
            alive &= alpha * alpha * between[rows, pick] > to_node
            alive[rows, pick] = False
            alive &= ok[:, None]
        self.out[nodes] = out

    def build(self, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 42) -> None:
        """Insert all nodes in a seeded order, in batches that double up to a twentieth of the shard."""
        n = self.n
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        order = np.concatenate([[self.start], order[order != self.start]]).astype(np.int32) if n else order
        done, size = 1, 1
        while done < n:
            new = order[done: done + size]
            found, _ = self.search(self.x[new], beam)
            self._link(new, found, alpha)
            done += len(new)
            size = min(2 * size, max(32, n // 20), STEP)

    def _link(self, new: np.ndarray, found: np.ndarray, alpha: float) -> None:
        self.prune(new, found, alpha)
        src = np.repeat(new, self.degree)
        dst = self.out[new].ravel()
        src, dst = src[dst < self.n], dst[dst < self.n]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(count.max()) if len(count) else 0
        extra = np.full((len(nodes), width), self.n, np.int32)
        within = np.arange(len(dst)) - np.repeat(first, count)
        extra[np.repeat(np.arange(len(nodes)), count), within] = src
        both = np.concatenate([self.out[nodes], extra], axis=1)
        full = (both < self.n).sum(axis=1) > self.degree
        room = np.sort(both[~full], axis=1)[:, : self.degree]
        self.out[nodes[~full]] = room
        for a in range(0, int(full.sum()), STEP):
            part = np.flatnonzero(full)[a: a + STEP]
            self.prune(nodes[part], both[part], alpha)

    def edges(self) -> list[list[int]]:
        return [r[r < self.n].tolist() for r in self.out[: self.n]]


def _matrix(column: pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(flat), -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vec): rows with an id and a vector that is not null, not zero and finite throughout; once each."""
    vec = F.col(vector_col).cast("array<double>")
    return (vectors.select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))
            .where("vec_id IS NOT NULL AND size(vec) > 0 AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) "
                   "AND exists(vec, x -> x <> 0)").distinct())


def build_index(rows: DataFrame, stages: Stages, k: int, shard_rows: int = SHARD_ROWS, degree: int = DEGREE,
                beam: int = BUILD_BEAM, alpha: float = ALPHA) -> DataFrame:
    """(dim, shard, node, vec, members, edges): every distinct vector as a node; members: its k + 1 smallest ids."""
    few = rows.selectExpr("*", "row_number() OVER (PARTITION BY vec ORDER BY vec_id) AS n").where(f"n <= {k + 1}")
    nodes = stages.put(few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "nodes")
    size = nodes.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)")).alias("m")).first()
    shards, longest = max(1, math.ceil(size["n"] / shard_rows)), float(size["m"] or 0)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("first")
        x = _matrix(table["vec"])
        fill = np.sqrt(np.maximum(0, longest - (x ** 2).sum(axis=1)))
        graph = Graph(np.column_stack([x, fill]), degree=degree)
        graph.build(beam, alpha)
        return pa.table({"dim": table["dim"], "shard": table["shard"], "node": pa.array(np.arange(len(x)), pa.int32()),
                         "vec": table["vec"], "members": table["members"],
                         "edges": pa.array(graph.edges(), pa.list_(pa.int32()))})

    dealt = nodes.select(F.size("vec").alias("dim"), F.expr(f"CAST(pmod(xxhash64(vec), {shards}) AS INT)").alias("shard"),
                         "vec", "members", F.expr("members[0]").alias("first"))
    return stages.put(dealt.groupBy("dim", "shard").applyInArrow(
        build, "dim int, shard int, node int, vec array<double>, members array<long>, edges array<int>"), "index")


def search_index(index: DataFrame, queries: DataFrame, stages: Stages, k: int, beam: int = SEARCH_BEAM,
                 block: int = BLOCK, degree: int = DEGREE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, its own row left out.

    queries: (vec_id, vec). Every block of queries meets every shard once; a task holds one shard and one block.
    """
    total = queries.count()
    blocks = max(1, math.ceil(total / block))
    longest = index.agg(F.max(F.expr("aggregate(vec, 0D, (s, x) -> s + x * x)"))).first()[0] or 0.0
    places = index.selectExpr("dim AS in_dim", "shard AS in_shard").distinct()
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (queries.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec"), F.size("vec").alias("dim"),
                            F.expr(f"CAST(pmod(xxhash64(vec_id), {blocks}) AS INT)").alias("block"))
             .join(places, F.col("dim") == F.col("in_dim"))
             .select("query_id", "qvec", "dim", F.col("in_shard").alias("shard"), "block"))
    kind = pa.schema([("query_id", pa.int64()), ("first", pa.int64()), ("score", pa.float64()),
                      ("members", pa.list_(pa.int64()))])

    def walk(nodes: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(nodes) or not len(asked):
            return kind.empty_table()
        nodes = nodes.sort_by("node")
        x, q = _matrix(nodes["vec"]), _matrix(asked["qvec"])
        edges = nodes["edges"].combine_chunks()
        n = np.diff(edges.offsets.to_numpy())
        out = np.full((len(x), degree), -1, np.int32)
        out[np.repeat(np.arange(len(x)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = edges.flatten().to_numpy()
        graph = Graph(np.column_stack([x, np.sqrt(np.maximum(0, longest - (x ** 2).sum(axis=1)))]), out, degree)
        qs, ids, scores = [], [], []
        asked_id = asked["query_id"].to_numpy()
        for a in range(0, len(q), STEP):
            part = q[a: a + STEP]
            found, _ = graph.search(np.column_stack([part, np.zeros(len(part))]).astype(np.float32), beam)
            exact = (x[np.minimum(found, len(x) - 1)] * part[:, None, :]).sum(axis=2)
            exact[found >= len(x)] = -np.inf
            top = np.lexsort((found, -exact), axis=1)[:, : k + 1]  # nodes are numbered by their smallest id: ties go to it
            got, score = np.take_along_axis(found, top, 1), np.take_along_axis(exact, top, 1)
            ok = got < len(x)
            qs.append(np.repeat(asked_id[a: a + STEP], ok.sum(axis=1)))
            ids.append(got[ok])
            scores.append(score[ok])
        at = pa.array(np.concatenate(ids))
        members = nodes["members"].combine_chunks().take(at)
        first = members.flatten().take(pa.array(members.offsets.to_numpy()[:-1] - members.offsets[0].as_py()))
        return pa.Table.from_arrays([pa.array(np.concatenate(qs)), first, pa.array(np.concatenate(scores)), members], schema=kind)

    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(
        walk, "query_id long, first long, score double, members array<long>")
    best = found.selectExpr("*", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS n").where(f"n <= {k + 1}")
    return (best.select("query_id", "score", F.explode("members").alias("vec_id")).where("vec_id <> query_id")
            .selectExpr("query_id", "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank",
                        "vec_id", "score").where(f"rank <= {k}"))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS, degree: int = DEGREE,
            build_beam: int = BUILD_BEAM, search_beam: int = SEARCH_BEAM, alpha: float = ALPHA, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products found for each row whose id is divisible by ``every``.

    * null ids, and vectors that are null, empty, zero, or hold null or non-finite components: neither query nor candidate;
    * vectors of different lengths never meet; equal vectors: one node, all found together, ties to the smaller id;
    * repeated rows (same id and vector) count once; an id with several vectors is a query, or a candidate, with each;
    * fewer candidates than k: all of them; empty table: empty result; extra columns are not read.
    """
    stages = Stages(vectors.sparkSession, "graph")
    rows = stages.put(usable(vectors, id_col, vector_col), "rows")
    index = build_index(rows, stages, k, shard_rows, degree, build_beam, alpha)
    return search_index(index, rows.where(F.col("vec_id") % every == 0), stages, k, search_beam, degree=degree)
