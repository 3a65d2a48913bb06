"""Skip-gram (centre, context) pairs.

Pairs are generated inside each document row from its token array -
no self-join and no shuffle: ``posexplode`` the centres, then take the
neighbours at offsets ``-w..w`` from the same array. A 20,000-word text
is still one row, so the work splits by document across tasks.

* all-pairs mode: every neighbour inside the window (exact);
* sampled mode: ``num_skips`` neighbours per centre without replacement,
  chosen by a seeded hash of (seed, doc, pos, neighbour position).
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.vocab import stacks
from cadenza.sources.sinks import deal


def _offsets(skip_window: int) -> Column:
    offs = [o for o in range(-skip_window, skip_window + 1) if o != 0]
    return F.array(*[F.lit(o) for o in offs])


def _explode_pairs(docs: DataFrame, tokens: Column, doc_col: str, skip_window: int,
                   choose) -> DataFrame:
    """Build every document's (pos, centre, context) array in one expression
    over its token array and explode it once. The token array is never
    copied into the exploded rows (that would cost O(n^2) per document)."""
    t = docs.select(F.col(doc_col).alias("doc_id"), tokens.alias("_t"))
    n = F.size("_t")

    def per_centre(i):
        cands = F.filter(F.transform(_offsets(skip_window), lambda o: i + o),
                         lambda p: (p >= 0) & (p < n))
        return F.transform(choose(i, cands), lambda p: F.struct(
            i.alias("pos"), F.element_at("_t", i + 1).alias("centre"),
            F.element_at("_t", p + 1).alias("context")))

    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), per_centre))
    return t.select("doc_id", F.explode(F.when(n > 0, pairs)).alias("p")).select(
        "doc_id", F.col("p.pos").cast("int").alias("pos"), "p.centre", "p.context")


def skipgram_pairs(docs: DataFrame, tokens: Column, skip_window: int = 1,
                   doc_col: str = "doc_id", kind: str = "string") -> DataFrame:
    """All pairs within ``skip_window`` on both sides, inside each document.
    Output ``(doc_id, pos, centre, context)``; ``kind``: type of the tokens (word ids are ints).

    For each offset o the pairs are two aligned slices of the token array
    zipped together (centres t[0..n-o), contexts t[o..n) and the mirror
    image), so a document is turned into pairs with a handful of array
    operations instead of one small array per centre."""
    t = docs.select(F.col(doc_col).alias("doc_id"), tokens.alias("_t"))
    n = F.size("_t")
    pair = f"array<struct<pos:int,centre:{kind},context:{kind}>>"
    empty = F.array().cast(pair)
    parts = []
    for o in range(1, skip_window + 1):
        m = n - o
        head = F.slice("_t", 1, F.greatest(m, F.lit(0)))
        tail = F.slice("_t", 1 + o, F.greatest(m, F.lit(0)))
        fwd = F.arrays_zip(F.sequence(F.lit(0), m - 1).alias("pos"), head.alias("centre"), tail.alias("context"))
        bwd = F.arrays_zip(F.sequence(F.lit(o), n - 1).alias("pos"), tail.alias("centre"), head.alias("context"))
        parts.append(F.when(m > 0, fwd.cast(pair))
                     .otherwise(empty))
        parts.append(F.when(m > 0, bwd.cast(pair))
                     .otherwise(empty))
    pairs = F.concat(*parts)
    return t.select("doc_id", F.explode(pairs).alias("p")).select(
        "doc_id", F.col("p.pos").cast("int").alias("pos"), "p.centre", "p.context")


def skipgram_sampled(docs: DataFrame, tokens: Column, skip_window: int = 1, num_skips: int = 2,
                     seed: int = 42, doc_col: str = "doc_id") -> DataFrame:
    """``num_skips`` distinct neighbours per centre (seeded choice)."""
    if num_skips > 2 * skip_window:
        raise ValueError("num_skips must be <= 2 * skip_window")
    def choose(i, cands):
        keyed = F.transform(cands, lambda p: F.struct(
            F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string"),
                              i.cast("string"), p.cast("string"))).alias("k"),
            p.alias("p")))
        return F.transform(F.slice(F.array_sort(keyed), 1, num_skips), lambda s: s["p"])

    return _explode_pairs(docs, tokens, doc_col, skip_window, choose)


def counted_pairs(docs: DataFrame, tokens: Column, skip_window: int = 1) -> DataFrame:
    """``(centre, context, n)``: the counts of ``skipgram_pairs``, all pairs within ``skip_window``.

    Each Arrow batch of documents counts its own pairs as numbers, so a pair is a row once a batch, not once an
    occurrence; the batches' counts are then added up (partially in every task)."""

    def run(batches):
        for b in batches:
            rows = b.column(0)
            size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(size)), size)
            coded = rows.flatten().cast(pa.string()).dictionary_encode()
            code, k = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
            keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for o in range(1, skip_window + 1):
                same = doc[o:] == doc[:-o]
                key, n = np.unique((code[:-o] * k + code[o:])[same], return_counts=True)
                keys += [key, key % k * k + key // k]
                counts += [n, n]
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key // k)), coded.dictionary.take(pa.array(key % k)),
                                              pa.array(n)], names=["centre", "context", "n"])

    return (docs.select(tokens.alias("_t")).mapInArrow(run, "centre string, context string, n long")
            .groupBy("centre", "context").agg(F.sum("n").alias("n")))


#: Centres of a document that draw their neighbours at a time.
CENTRES = 1 << 16


def counted_samples(docs: DataFrame, tokens: Column, skip_window: int = 1, num_skips: int = 2, seed: int = 42,
                    doc_col: str = "doc_id") -> DataFrame:
    """``(centre, context, n)``: the counts of ``skipgram_sampled``, the same neighbours by the same hashes.

    The texts are dealt by document, so tasks get even shares. A stack of documents draws its neighbours and counts its pairs as
    numbers: a pair is a row once a stack, not once an occurrence. Only centres with more neighbours than ``num_skips`` need
    hashes."""
    if num_skips > 2 * skip_window:
        raise ValueError("num_skips must be <= 2 * skip_window")
    offsets, cut = np.array([o for o in range(-skip_window, skip_window + 1) if o != 0], np.int64), stacks(1)

    def drawn(doc: bytes, names: list[bytes], begin: int) -> tuple[np.ndarray, np.ndarray]:
        """(centres, contexts): places of the pairs of a document's centres from ``begin`` on, ``CENTRES`` at most."""
        n = len(names)
        centre = np.arange(begin, min(n, begin + CENTRES))[:, None]
        place = centre + offsets
        ok = (place >= 0) & (place < n)
        row, col = np.nonzero(ok & (ok.sum(axis=1, keepdims=True) > num_skips))
        head = [doc + c + b"|" for c in names[begin:begin + CENTRES]]
        drawn_by = b"".join([md5(head[i] + names[j]).digest() for i, j in zip(row.tolist(), place[row, col].tolist())])
        high, low = np.zeros(ok.shape, np.uint64), np.zeros(ok.shape, np.uint64)
        high[row, col], low[row, col] = np.frombuffer(drawn_by, ">u8").reshape(-1, 2).T
        first = np.lexsort((low, high, ~ok), axis=1)[:, :num_skips]  # equal ones stay in the order of their places
        taken = np.take_along_axis(ok, first, 1)
        return np.broadcast_to(centre, taken.shape)[taken], np.take_along_axis(place, first, 1)[taken]

    def run(batches):
        for whole in batches:
            for b in cut([whole]):
                rows = b.column(1)
                size = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                coded = rows.flatten().cast(pa.string()).dictionary_encode("encode")
                code, k = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
                keys, at = [np.empty(0, np.int64)], 0
                for doc, n in zip(b.column(0).to_pylist(), size.tolist()):
                    names = [b"%d" % i for i in range(n)]
                    for begin in range(0, n, CENTRES):
                        # concat_ws leaves a null out
                        centre, context = drawn((f"{seed}|" if doc is None else f"{seed}|{doc}|").encode(), names, begin)
                        keys.append(code[at + centre] * k + code[at + context])
                    at += n
                key, n = np.unique(np.concatenate(keys), return_counts=True)
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(key // k)), coded.dictionary.take(pa.array(key % k)),
                                                  pa.array(n, pa.int64())], names=["centre", "context", "n"])

    dealt = deal(docs, doc_col).select(F.col(doc_col).cast("string").alias("doc_id"), tokens.alias("_t"))
    return (dealt.mapInArrow(run, "centre string, context string, n long").groupBy("centre", "context").agg(F.sum("n").alias("n")))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """Co-occurrence counts ``(centre, context, n)`` (partial aggregation)."""
    return pairs.groupBy("centre", "context").agg(F.count(F.lit(1)).alias("n"))
