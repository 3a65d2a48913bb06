"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on hashes of ``MIN_TILE`` words in a
row (seeds, rolled Karp-Rabin style); an item of fewer words is one seed. In scripts without
blanks each character is a word. For each document and item that share
enough seeds, running Karp-Rabin passes of falling length mark the longest
matches that don't overlap marked words; the share of the item's words under
tiles is its coverage, whatever the order of the pieces in the document.

Seeds of the benchmark reach the document scan as a bit filter of a size that follows their number
up to a bound, so only documents with a likely seed emit rows and only those are shuffled; the
filter has no false negatives and the join that follows drops false positives.

A template that stands in many documents and items does not pair them all: of each item the
seeds that most documents hold are set aside, as long as all words under them fall short of the
coverage. A pair that reaches it has another seed, so candidates come from the rest alone.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import Stages, slices

#: Words of the shortest tile, and of a seed.
MIN_TILE = 5
#: Share of an item's words under tiles from which a document is contaminated.
COVERAGE = 0.5
#: Items of fewer words stand in clean texts by chance: they are reported, but no document is dropped for one.
LEAST_WORDS = 3
#: Bits of the seed filter for each seed of the benchmark, and its bounds (2 and 32 MB); all are powers of two.
BITS_PER_SEED, FILTER_BITS, MOST_BITS = 16, 1 << 24, 1 << 28

# Fixed ranges: scripts written without blanks between words (Thai, Lao, Burmese, Khmer; kana, bopomofo, Han).
_BARE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3100-\u312f\u31a0-\u31bf\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff" \
        "\U00020000-\U0003ffff"
_WORD = re.compile(f"[^\\W{_BARE}]+|(?!\\W)[{_BARE}]")
_BASE = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def seeds(tokens: list[str], m: int = MIN_TILE) -> np.ndarray:
    """Rolling hash of every ``m`` words in a row, as signed longs."""
    n = len(tokens) - m + 1
    if n < 1:
        return np.empty(0, np.int64)
    h = xxhash.xxh64_intdigest
    one = np.array([h(w) for w in tokens], np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(m):
        out = out * np.uint64(_BASE) + one[j: j + n]
    out ^= (out >> np.uint64(29)) + np.uint64(m)  # seeds of other lengths are other hashes
    return (out * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a seed; with ``bits`` a power of two it is the same on signed and unsigned numbers."""
    return h & (bits - 1), (h >> 32) & (bits - 1)


def _size(bits: int) -> int:
    if bits < 64 or bits & (bits - 1):
        raise ValueError(f"the filter's bits must be a power of two from 64 on, not {bits}")
    return bits


def _rows(df: DataFrame, id_col: str, text_col: str, lengths: list[int] | int, passes: np.ndarray | None, bits: int) -> DataFrame:
    """(id, t, n, h, at): per text and distinct seed its positions.

    ``lengths``: the words of a seed, for benchmark items one number, the most; for documents all that items have, and
    a filter that passes only seeds that may be the benchmark's.
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(passes) if passes is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            ids, ts, ns, hs, ats = [], [], [], [], []
            for i, t, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                tokens = words(text)
                found = [seeds(tokens, k) for k in (lengths if shared is not None else [max(1, min(lengths, len(tokens)))])]
                h, pos = np.concatenate(found), np.concatenate([np.arange(len(f)) for f in found])
                if shared is not None and len(h):
                    a, c = _bits(h, bits)
                    hit = (shared.value[a >> 3] >> (a & 7) & shared.value[c >> 3] >> (c & 7) & 1).astype(bool)
                    h, pos = h[hit], pos[hit]
                if not len(h):
                    continue
                order = np.argsort(h, kind="stable")
                h, pos = h[order], pos[order]
                cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                hs += h[cut].tolist()
                ats += np.split(pos, cut[1:])
                ids += [i] * len(cut)
                ts += [t] * len(cut)
                ns += [len(tokens)] * len(cut)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ts, pa.int64()), pa.array(ns, pa.int32()), pa.array(hs, pa.int64()),
                 pa.array(ats, pa.list_(pa.int32()))], names=["id", "t", "n", "h", "at"])

    return (df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("t"),
                      F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "id long, t long, n int, h long, at array<int>"))


def _filter(seed_rows: DataFrame, bits: int) -> np.ndarray:
    """The seeds' bit filter; what comes to the driver is at most bits / 64 words."""
    at = F.explode(F.array(F.expr(f"h & {bits - 1}L"), F.expr(f"shiftright(h, 32) & {bits - 1}L")))
    got = (seed_rows.select(at.alias("b")).groupBy(F.expr("shiftright(b, 6)").alias("w"))
           .agg(F.expr("bit_or(shiftleft(1L, CAST(b & 63 AS INT)))").alias("m")).toArrow())
    out = np.zeros(bits // 64, np.int64)
    out[got["w"].to_numpy()] = got["m"].to_numpy()
    return out.view(np.uint8)


def tiles(pairs: list[tuple[list[int], list[int]]], m: int = MIN_TILE, n_item: int | None = None
          ) -> list[tuple[int, int, int]]:
    """Greedy string tiling by running Karp-Rabin: (length, document position, item position) of each tile.

    pairs: for each shared seed its positions in the document and in the item. A match of s words is a run of
    s - m + 1 seeds. Longer matches go first; ties to the smaller item, then document position.
    """
    doc = {p: g for g, (d, _) in enumerate(pairs) for p in d}
    item = {p: g for g, (_, i) in enumerate(pairs) for p in i}
    used_d: set[int] = set()
    used_i: set[int] = set()
    out: list[tuple[int, int, int]] = []
    mod, base = (1 << 61) - 1, 1_000_003

    def free(seq: dict[int, int], used: set[int]) -> list[list[int]]:
        """Runs of seed positions next to each other all of whose words are unmarked."""
        runs: list[list[int]] = []
        for p in sorted(seq):
            if any(q in used for q in range(p, p + m)):
                continue
            if runs and runs[-1][-1] == p - 1:
                runs[-1].append(p)
            else:
                runs.append([p])
        return runs

    def windows(runs: list[list[int]], seq: dict[int, int], k: int) -> Iterator[tuple[int, int]]:
        """(rolling hash, first position) of every k seeds in a row."""
        top = pow(base, k, mod)
        for run in runs:
            h = 0
            for j, p in enumerate(run):
                h = (h * base + seq[p] + 1) % mod
                if j >= k:
                    h = (h - (seq[run[j - k]] + 1) * top) % mod
                if j >= k - 1:
                    yield h, run[j - k + 1]

    def scan(s: int) -> list[tuple[int, int, int]]:
        """Matches of s or more unmarked words, each as long as it goes to the right."""
        k = s - m + 1
        dr, ir = free(doc, used_d), free(item, used_i)
        d_end = {p: run[-1] for run in dr for p in run}
        i_end = {p: run[-1] for run in ir for p in run}
        at = defaultdict(list)
        for h, p in windows(dr, doc, k):
            at[h].append(p)
        found = []
        for h, i in windows(ir, item, k):
            for d in at.get(h, ()):
                most = min(d_end[d] - d, i_end[i] - i) + 1
                n = 0
                while n < most and doc[d + n] == item[i + n]:
                    n += 1
                if n >= k:
                    found.append((n + m - 1, d, i))
        return found

    s = max(m, (n_item or (max(item, default=0) + m)) // 2)
    while True:
        found = scan(s)
        longest = max((x[0] for x in found), default=0)
        if longest > 2 * s:
            s = longest
            continue
        queue: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, d, i in found:
            queue[n].append((i, d))
        for n in range(longest, s - 1, -1):
            for i, d in sorted(queue.pop(n, ())):
                ok = next((j for j in range(n) if d + j in used_d or i + j in used_i), n)
                if ok == n:
                    out.append((n, d, i))
                    used_d.update(range(d, d + n))
                    used_i.update(range(i, i + n))
                elif ok >= s:  # what is left of it waits for its own length
                    queue[ok].append((i, d))
        if s == m:
            return sorted(out, key=lambda x: x[2])
        s = max(m, s // 2)


def _rare(items: DataFrame, hits: DataFrame, coverage: float, m: int) -> DataFrame:
    """(item_id, it, h): of every item the seeds from which candidates come; see the module's docstring."""
    often = hits.groupBy("h").agg(F.count("*").alias("df"))
    rows = items.join(often, "h").groupBy("item_id", "it").agg(
        F.first("n_words").alias("n_words"), F.collect_list(F.struct("df", "h", "i")).alias("seeds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, its, hs = [], [], []
            for i, t, n, found in zip(*(c.to_pylist() for c in b.columns)):
                aside: set[int] = set()
                for x in sorted(found, key=lambda x: (-x["df"], x["h"])):
                    under = aside.union(*(range(p, min(p + m, n)) for p in x["i"]))
                    if len(under) < coverage * n:
                        aside = under
                    else:
                        ids.append(i)
                        its.append(t)
                        hs.append(x["h"])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, its, hs)], names=["item_id", "it", "h"])

    return rows.mapInArrow(run, "item_id long, it long, h long")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, m: int = MIN_TILE,
                 filter_bits: int | None = None, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id") -> DataFrame:
    """(doc_id, t, item_id, n_words, matched, coverage, tiles) for each document and item at or above ``coverage``.

    t hashes the document's text; tiles lists (length, document word, item word).

    * null or empty texts, and items without a word, are in no row; an item of fewer than ``m`` words matches whole or not at all;
    * very long texts are read whole; a passage that repeats in a document counts once, as an item's word has one tile;
    * equal documents each get their row; a row repeated with the same doc_id and text gets one, so do repeated items;
    * null doc_id or item_id: reported with a null there; empty tables: empty result; extra columns are not read.

    ``filter_bits`` (a power of two) is set by the number of the benchmark's seeds if it is not given. Beyond what its
    bound holds more false hits reach the join; none is lost.
    """
    stages = Stages(docs.sparkSession, "tiling")
    items = stages.put(_rows(benchmark, item_col, text_col, m, None, 0).distinct(), "items")
    counted = items.agg(F.count("*").alias("n"), F.collect_set(F.least("n", F.lit(m))).alias("lengths")).first()
    lengths = sorted(counted["lengths"]) or [m]  # at most m numbers
    bits = _size(filter_bits or min(MOST_BITS, max(FILTER_BITS, 1 << (BITS_PER_SEED * counted["n"]).bit_length())))
    hits = stages.put(_rows(docs, id_col, text_col, lengths, _filter(items, bits), bits), "hits").select(
        F.col("id").alias("doc_id"), "t", "h", F.col("at").alias("d")).distinct()
    items = items.select(F.col("id").alias("item_id"), F.col("t").alias("it"), F.col("n").alias("n_words"), "h", F.col("at").alias("i"))
    item = F.struct("item_id", "it").alias("item")  # a null id is a value of its own
    rare = _rare(items, hits, coverage, m).select(item, "h")
    pairs = hits.select(F.struct("doc_id", "t").alias("doc"), "h").join(rare, "h").select("doc", "item").distinct()
    shared = (pairs.join(items.select(item, "n_words", "h", "i"), "item")
              .join(hits.select(F.struct("doc_id", "t").alias("doc"), "h", "d"), ["doc", "h"])
              .groupBy("doc.doc_id", "doc.t", "item.item_id", "item.it", "n_words")
              .agg(F.collect_list(F.struct("d", "i")).alias("pairs"), F.sum(F.size("i")).alias("n_seeds"))
              .where(F.col("n_seeds") * m >= F.col("n_words") * coverage))  # no tile holds more than m words a seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(3).to_pylist()
            got = [tiles([(x["d"], x["i"]) for x in p.as_py()], min(m, k), k) for p, k in zip(b.column(4), n)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(j) for j in range(4)), pa.array([sum(x[0] for x in g) for g in got], pa.int32()),
                 pa.array([[list(x) for x in g] for g in got], pa.list_(pa.list_(pa.int32())))],
                names=["doc_id", "t", "item_id", "n_words", "matched", "tiles"])

    return (shared.select("doc_id", "t", "item_id", "n_words", "pairs")
            .mapInArrow(run, "doc_id long, t long, item_id long, n_words int, matched int, tiles array<array<int>>")
            .withColumn("coverage", F.col("matched") / F.col("n_words")).where(F.col("coverage") >= coverage)
            .select("doc_id", "t", "item_id", "n_words", "matched", "coverage", "tiles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least_words: int = LEAST_WORDS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item of ``least_words`` or more at or above ``coverage``."""
    found = Stages(docs.sparkSession, "decontaminate").put(
        contaminated(docs, benchmark, coverage, id_col=id_col, text_col=text_col).where(F.col("n_words") >= least_words)
        .select("doc_id", "t").distinct(), "found")
    found = found.toDF("__did", "__t")
    return docs.join(found, docs[id_col].cast("long").eqNullSafe(found["__did"])
                     & (F.xxhash64(docs[text_col].cast("string")) == found["__t"]), "left_anti")
