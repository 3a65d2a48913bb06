"""SimHash near-duplicate detection by a binary-trie self-join.

A fingerprint's bits are a path in a binary trie. Two tries' node pairs are
walked together: equal branches keep the error budget, differing branches
spend one, and a pair whose budget is spent is pruned with all below it.

How the walk is spread over a cluster: two 64-bit fingerprints that differ
in at most ``k`` bits agree on one of ``k + 1`` blocks of bits. Each block in
turn is taken as the leading bits of the trie, so only sub-tries under one
equal node must be walked against themselves; such a node is a task's key. A
node with too many fingerprints is opened further as *node pairs*: its rows
are sent to each pair of deeper nodes within the budget, again and again, until
every pair is small. Nothing is capped: the opening ends at the last bit, where a
node holds one fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Stages, components, slices

BITS = 64
SEED = 42
#: Bits by which a crowded trie node is opened at a time.
OPEN_BITS = 6
#: Fingerprints under one node pair from which it is opened (a size, not a cap: the result is the same for any).
CROWDED = 50_000
#: Rows that a task gathers before it walks them.
CHUNK = 1 << 17


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (XXH64, seed 42); 0 for null or no word."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return 0
    norm = b" ".join(words)
    if n < width:
        hashes = [xxhash.xxh64_intdigest(norm, SEED)]
    else:
        size = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        h = xxhash.xxh64_intdigest
        hashes = [h(norm[s:e], SEED) for s, e in zip((ends - size)[: n - width + 1].tolist(), ends[width - 1:].tolist())]
    ones, total = np.zeros(BITS, np.int64), len(hashes)
    for at in range(0, total, 1 << 15):
        part = np.array(hashes[at: at + (1 << 15)], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, fp long")


def _blocks(k: int) -> list[tuple[int, int]]:
    """(offset, width) of k + 1 blocks that cover the 64 bits."""
    cuts = [round(i * BITS / (k + 1)) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _deltas(bits: int, budget: int) -> list[int]:
    return [d for d in range(1 << bits) if d.bit_count() <= budget]


NODE = ["blk", "key", "depth", "pa", "pb"]


def _tasks(fps: DataFrame, k: int) -> tuple[DataFrame, int]:
    """Rows (blk, key, depth, pa, pb, side, spent, rest, fp): a fingerprint under the top node of each block."""
    rest_bits = BITS - min(w for _, w in _blocks(k))
    parts = []
    for i, (o, w) in enumerate(_blocks(k)):
        high = f"(shiftleft(shiftrightunsigned(fp, {o + w}), {o}))" if o + w < BITS else "0L"
        low = f"(fp & {(1 << o) - 1}L)" if o else "0L"
        parts.append(f"struct({i} AS blk, shiftrightunsigned(fp, {o}) & {(1 << w) - 1}L AS key, {high} | {low} AS rest)")
    out = fps.select("fp", F.explode(F.expr(f"array({', '.join(parts)})")).alias("p")).selectExpr(
        "p.blk", "p.key", "0 AS depth", "0L AS pa", "0L AS pb", "0 AS side", "0 AS spent", "p.rest", "fp")
    return out, rest_bits


def _open(rows: DataFrame, depth: int, step: int, rest_bits: int, k: int) -> DataFrame:
    """Send each row of a crowded node pair to the pairs of nodes ``step`` bits deeper that the budget allows."""
    shift = rest_bits - depth - step
    deltas = ", ".join(f"struct({d}L AS d, {d.bit_count()} AS n)" for d in _deltas(step, k))
    x = f"(shiftrightunsigned(rest, {shift}) & {(1 << step) - 1}L)"
    return (rows.select("*", F.expr(f"explode(array({deltas}))").alias("e")).where(f"spent + e.n <= {k}")
            .withColumn("x", F.expr(x)).withColumn("y", F.expr(f"{x} ^ e.d")).selectExpr(
                "blk", "key", f"{depth + step} AS depth",
                f"shiftleft(pa, {step}) | CASE side WHEN 0 THEN least(x, y) WHEN 1 THEN x ELSE y END AS pa",
                f"shiftleft(pb, {step}) | CASE side WHEN 0 THEN greatest(x, y) WHEN 1 THEN y ELSE x END AS pb",
                "CASE WHEN side <> 0 THEN side WHEN x = y THEN 0 WHEN x < y THEN 1 ELSE 2 END AS side",
                "spent + e.n AS spent", "rest", "fp"))


class _Forest:
    """Union-find over the rows of one chunk, by whole arrays of links."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while not np.array_equal(self.up, nxt := self.up[self.up]):
            self.up = nxt
        return self.up

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            up = self.roots()
            a, b = up[a], up[b]
            keep = a != b
            a, b = a[keep], b[keep]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _pairs(alo, ahi, blo, bhi):
    """All (i, j) of the given ranges; within one range only i < j."""
    na, nb = ahi - alo, bhi - blo
    n = na * nb
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = alo[which] + at // nb[which], blo[which] + at % nb[which]
    keep = (alo[which] != blo[which]) | (i < j)
    return i[keep], j[keep]


def walk(seg: np.ndarray, rest: np.ndarray, fp: np.ndarray, starts: list[np.ndarray], k: int, rest_bits: int,
         forest: _Forest, leaf: int = 64, width: int = 1 << 15) -> None:
    """Walk node pairs together. ``seg``: ascending number of each row's node; ``rest``: its path, sorted in a node.

    starts: (alo, ahi, blo, bhi) row ranges of the first node pairs. Links go to ``forest``.
    """
    path = (seg.astype(np.uint64) << np.uint64(rest_bits)) | rest.astype(np.uint64)
    stack = [(rest_bits - 1, *starts, np.full(len(starts[0]), k))]
    while stack:
        bit, alo, ahi, blo, bhi, left = stack.pop()
        if len(alo) > width:
            stack += [(bit, *(x[s: s + width] for x in (alo, ahi, blo, bhi, left))) for s in range(0, len(alo), width)]
            continue
        small = (ahi - alo) * (bhi - blo) <= leaf if bit >= 0 else np.ones(len(alo), bool)
        if small.any():
            i, j = _pairs(alo[small], ahi[small], blo[small], bhi[small])
            near = np.bitwise_count(fp[i] ^ fp[j]) <= k
            forest.link(i[near], j[near])
            alo, ahi, blo, bhi, left = (x[~small] for x in (alo, ahi, blo, bhi, left))
        if not len(alo):
            continue
        one = np.uint64(1) << np.uint64(bit)

        def middle(lo, hi):
            cut = (path[lo] & ~np.uint64(2 * int(one) - 1)) | one
            return np.clip(np.searchsorted(path, cut), lo, hi)

        am, bm, same = middle(alo, ahi), middle(blo, bhi), alo == blo
        child = [np.concatenate(x) for x in (
            (alo, am, alo, am[~same]), (am, ahi, am, ahi[~same]),
            (blo, bm, bm, blo[~same]), (bm, bhi, bhi, bm[~same]),
            (left, left, left - 1, left[~same] - 1))]
        alo, ahi, blo, bhi, left = child
        ok = (left >= 0) & (ahi > alo) & (bhi > blo) & ~((alo == blo) & (ahi - alo < 2))
        if ok.any():
            stack.append((bit - 1, *(x[ok] for x in child)))


def _walk_rows(cols: list[np.ndarray], k: int, rest_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), a forest of each node pair's, from whole tasks sorted by node, side and path."""
    *node, side, rest, fp = cols
    n = len(fp)
    new = np.ones(n, bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in node], axis=0)
    task = np.cumsum(new) - 1
    seg_new = new.copy()
    seg_new[1:] |= side[1:] != side[:-1]
    seg = np.cumsum(seg_new) - 1
    seg_lo = np.flatnonzero(seg_new)
    seg_hi = np.append(seg_lo[1:], n)
    seg_side, seg_task = side[seg_lo], task[seg_lo]
    own = (seg_side == 0) & (seg_hi - seg_lo > 1)
    cross = np.flatnonzero((seg_side[:-1] == 1) & (seg_side[1:] == 2) & (seg_task[:-1] == seg_task[1:]))
    starts = [np.concatenate(x) for x in ((seg_lo[own], seg_lo[cross]), (seg_hi[own], seg_hi[cross]),
                                          (seg_lo[own], seg_lo[cross + 1]), (seg_hi[own], seg_hi[cross + 1]))]
    forest = _Forest(n)
    if len(starts[0]):
        walk(seg, rest, fp.view(np.uint64), starts, k, rest_bits, forest)
    up = forest.roots()
    linked = np.flatnonzero(up != np.arange(n))
    return fp[linked], fp[up[linked]]


def links(fps: DataFrame, stages: Stages, max_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """(a, b): links that join every pair of distinct fingerprints (column fp) at ``max_bits`` or fewer differing bits.

    Per node pair a spanning forest of its near pairs, not all of them: what can be reached is
    the same, and its size follows the rows.
    """
    rows, rest_bits = _tasks(fps, max_bits)
    done, depth = [], 0
    while depth < rest_bits:
        hot = rows.groupBy(*NODE).count().where(F.col("count") > crowded).drop("count")
        if hot.isEmpty():
            break
        hot = stages.put(hot, "crowded")
        step = min(OPEN_BITS, rest_bits - depth)
        done.append(rows.join(hot, NODE, "left_anti"))
        rows = stages.put(_open(rows.join(hot, NODE, "left_semi").select(rows.columns), depth, step, rest_bits, max_bits),
                          "opened")
        depth += step
    for part in done:
        rows = rows.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            cols = [np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(len(NODE) + 3)]
            n = len(cols[0])
            cut = n
            if not last:  # up to the last node pair, which may go on in the next batch
                new = np.any([c[1:] != c[:-1] for c in cols[: len(NODE)]], axis=0)
                cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            held.clear()
            if cut < n:
                held.append(pa.RecordBatch.from_arrays([pa.array(c[cut:]) for c in cols], names=names))
            if cut:
                a, b = _walk_rows([c[:cut] for c in cols], max_bits, rest_bits)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        names = [*NODE, "side", "rest", "fp"]
        for batch in batches:
            held.append(batch)
            if sum(len(b) for b in held) >= CHUNK:
                yield from flush(False)
        if held:
            yield from flush(True)

    return (rows.select(*NODE, "side", "rest", "fp").repartition(*NODE)
            .sortWithinPartitions(*NODE, "side", "rest").mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id).

    fingerprint: 16 hex digits of the SimHash over ``width``-word shingles.
    component_id: the smallest doc_id that is reached over links of at most
    ``max_bits`` differing bits, the document itself included.

    * null, empty or blank text: fingerprint 0, linked like any other;
    * fewer words than ``width``: the whole sequence is the one shingle;
    * equal texts, repeated rows: the same fingerprint, hence the same component, one result row for each input row;
    * null doc_id: kept, with the component's smallest id (null if no row of it has one);
    * empty table: empty result; extra columns are not read.
    """
    stages = Stages(docs.sparkSession, "simhash")
    fps = stages.put(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = stages.put(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = components(links(nodes.select("fp"), stages, max_bits, crowded), stages)
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "rep", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, width: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` with one document of each near-duplicate group: the smallest doc_id.

    Rows that repeat the staying doc_id count as that document, one of them stays; rows without doc_id stay, as no
    component can name them.
    """
    found = Stages(docs.sparkSession, "keep").put(near_duplicates(docs, width, max_bits), "classes")
    gone = found.where("doc_id IS NOT NULL AND doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    kept = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    if found.where("doc_id IS NOT NULL AND doc_id = component_id").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    named = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    return named.unionByName(kept.where("doc_id IS NULL"))
