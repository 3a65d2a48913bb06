"""SentencePiece encoding (merge type) with seeded merge-dropout, and lossless decoding.

A text is cut where no piece can cross; each span is merged by an agenda
that takes the best-scored candidate pair, leftmost first, until none is
left. Under dropout each candidate that the agenda gives out is skipped if a
bit keyed by (seed, document, span number, turn) says so; a skipped candidate
comes back only as part of a new pair. With dropout 0 the ids are those of the
model's own library.

Spans of up to ``SHORT`` characters run their agendas in step, as rows of one array;
a span without a skipped turn takes its cached result, longer ones use a heap.
The vocabulary file is read where the tasks run: its path is a parameter.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import slices, worker_cache

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Skipped candidates, in 256ths (24 / 256 is about one in eleven), and the seed of the draws.
DROPOUT, SEED = 24, 42
#: Longest span whose agenda runs in step with others: it has at most 3 * (SHORT - 1) < 64 turns.
SHORT = 21
#: Spans of a text worked on at a time, and spans whose plain result a worker remembers.
SPANS, REMEMBERED = 200_000, 400_000
_NONE = np.int32(1 << 30)
_MARK = "▁"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the key reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def skip_bits(seed: int, docs: np.ndarray, spans: np.ndarray, block: int, dropout: int) -> np.ndarray:
    """64 independent bits a span, each set with probability dropout / 256: the turns 64 * block and on to skip.

    docs, spans: the document's id and the span's number in it, as signed longs.
    """
    out = np.zeros(len(spans), np.uint64)
    if dropout <= 0:
        return out
    if dropout >= 256:
        return ~out
    key = _mix(docs.view(np.uint64) + np.array([seed * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64))
    base = _mix(spans.view(np.uint64) * np.uint64(0xD1B54A32D192ED03) + key)
    some = False
    for b in range(8):  # from the lowest bit of the probability: an OR for a 1, an AND for a 0
        if one := dropout >> b & 1 or some:
            draw = _mix(base + np.array([(block * 8 + b + 1) * 0x9E3779B97F4A7C15 % (1 << 64)], np.uint64))
            out = out | draw if dropout >> b & 1 else out & draw
            some = bool(one)
    return out


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., n[0] numbers, then those of the next."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Table:
    """Exact look-up of 64-bit keys in arrays: levels of one slot a key, clashes go to the next level."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.uint64, np.uint64, np.ndarray]] = []
        self.keys = keys
        left, n = np.arange(len(keys)), len(keys)
        rng = np.random.default_rng(1)
        while len(left):
            bits = max(4, int(np.ceil(np.log2(len(left) + 1))) + 3)
            factor = np.uint64(int(rng.integers(1, 1 << 63)) * 2 + 1)
            shift = np.uint64(64 - bits)
            slot = np.full(1 << bits, n, np.int32)
            at = (keys[left].astype(np.uint64) * factor) >> shift
            slot[at] = left
            self.levels.append((factor, shift, slot))
            left = left[slot[at] != left]
        self.padded = np.append(keys, -1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 if it isn't there."""
        out = np.full(keys.shape, -1, np.int32)
        for factor, shift, slot in self.levels:
            at = slot[(keys.astype(np.uint64) * factor) >> shift]
            out = np.where(self.padded[at] == keys, at, out)
        return out


@dataclass
class Vocabulary:
    """Merge-type model: pieces, their bytes, and the pairs that make a piece."""

    size: int
    raw: pa.Array  # bytes of each id
    chars: dict[str, int]  # id of each one-character piece
    byte_ids: list[int]
    pairs: _Table  # left * size + right
    made: np.ndarray  # id that the pair makes
    rank: np.ndarray  # order on the agenda, equal for equal scores
    pair_of: dict[tuple[int, int], tuple[int, int]]
    spans: re.Pattern

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        byte_ids = [0] * 256
        raw: list[bytes] = []
        plain: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if model.is_byte(i):
                byte_ids[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                raw.append(b"")
            else:
                plain[p] = i
                raw.append(p.replace(_MARK, " ").encode())
        scores = sorted({-model.get_score(i) for i in plain.values()})
        order = {s: n for n, s in enumerate(scores)}
        pair_of = {}
        for p, i in plain.items():
            for cut in range(1, len(p)):
                a, b = plain.get(p[:cut]), plain.get(p[cut:])
                if a is not None and b is not None:
                    pair_of[a, b] = (i, order[-model.get_score(i)])
        keys = np.array([a * size + b for a, b in pair_of], np.int64)
        made = np.array([x for x, _ in pair_of.values()] + [-1], np.int32)
        rank = np.array([r for _, r in pair_of.values()] + [_NONE], np.int32)
        # Cut before a run of blanks; and between word and other characters if no piece holds both side by side.
        word, other = r"[^\W_]", rf"[^\w{_MARK}]"
        if any(re.search(f"[^{_MARK}]{_MARK}", p) for p in plain):
            spans = re.compile(r"(?s).+")
        elif any(re.search(f"{word}{other}|{other}{word}", p) for p in plain):
            spans = re.compile(r" *[^ ]+| +")
        else:
            run = r"(?:[^\W_]+|[^\w ]+)"
            spans = re.compile(rf" *_*{run}(?:_+{run})*_*| *_+| +")
        chars = {p.replace(_MARK, " "): i for p, i in plain.items() if len(p) == 1}
        return Vocabulary(size, pa.array(raw, pa.binary()), chars, byte_ids, _Table(keys), made, rank, pair_of, spans)

    def symbols(self, span: str) -> list[int]:
        """Ids of a span's characters; one that the model lacks gives its bytes, which merge with nothing."""
        out = []
        for ch in span:
            i = self.chars.get(ch)
            out += [i] if i is not None else [self.byte_ids[b] for b in ch.encode("utf-8", "surrogatepass")]
        return out

    def merge_long(self, symbols: list[int], skip) -> list[int]:
        """The agenda of one span as a heap; ``skip(turn)`` tells whether a candidate is skipped."""
        ids, n = list(symbols), len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (p := self.pair_of.get((ids[i], ids[j]))):
                heapq.heappush(heap, (p[1], i, j, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        turn = 0
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if ids[i] != a or right[i] != j or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            turn += 1
            if skip(turn - 1):
                continue
            ids[i], ids[j] = self.pair_of[a, b][0], -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [x for x in ids if x >= 0]

    def merge_short(self, ids: np.ndarray, skips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many spans in step: in each turn every row takes its best candidate.

        ids: a row of symbols for each span, -1 after its end. Returns (all rows' ids end to end, their number by row).
        """
        n, width = ids.shape
        pad = width + 2  # a dead column at either end, so that every symbol has neighbours
        sym = np.full((n, pad), -1, np.int32)
        sym[:, 1:-1] = ids
        rank = np.full((n, pad), _NONE, np.int32)
        rank[:, 1:-2] = self.rank[self._pair(sym[:, 1:-2], sym[:, 2:-1])]
        at = np.arange(n * pad, dtype=np.int64).reshape(n, pad)
        after, before = (at + 1).ravel(), (at - 1).ravel()
        sym, flat = sym.ravel(), rank.ravel()
        live = np.arange(n)
        turn = 0
        while len(live):
            p = rank[live].argmin(axis=1) + live * pad
            go = flat[p] < _NONE
            live, p = live[go], p[go]
            drop = (skips[live] >> np.uint64(turn)) & np.uint64(1) == 1
            flat[p[drop]] = _NONE
            turn += 1
            p = p[~drop]
            q = after[p]
            new = self.made[self._pair(sym[p], sym[q])]
            nxt, prv = after[q], before[p]
            sym[p], sym[q], flat[q] = new, -1, _NONE
            after[p], before[nxt] = nxt, p
            flat[p] = self.rank[self._pair(new, sym[nxt])]
            flat[prv] = self.rank[self._pair(sym[prv], new)]
        left = sym >= 0
        return sym[left], left.reshape(n, pad).sum(axis=1)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of each pair of symbols, -1 if it makes no piece."""
        return np.where((a < 0) | (b < 0), -1, self.pairs.find(a.astype(np.int64) * self.size + b))


class Encoder:
    """Encodes and decodes lists of texts; remembers the plain result of the spans it has met."""

    def __init__(self, vocabulary: Vocabulary, dropout: int = DROPOUT, seed: int = SEED):
        self.v, self.dropout, self.seed = vocabulary, dropout, seed
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # span -> its number in the arrays below
        self.symbols, self.plain = np.empty(0, np.int32), np.empty(0, np.int32)
        self.symbol_at, self.plain_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _matrix(self, spans: np.ndarray, width: int) -> np.ndarray:
        start, n = self.symbol_at[spans], self.symbol_at[spans + 1] - self.symbol_at[spans]
        col = np.arange(width)
        return np.where(col < n[:, None], self.symbols[np.minimum(start[:, None] + col, len(self.symbols) - 1)], -1)

    def _groups(self, spans: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """Places in ``spans``, a few thousand of about the same length at a time, and their greatest length."""
        size = self.symbol_at[spans + 1] - self.symbol_at[spans]
        lo = 0
        for hi in (3, 5, 7, 9, 12, 16, SHORT):
            group = np.flatnonzero((size > lo) & (size <= hi))
            lo = hi
            for a in range(0, len(group), 4096):
                yield group[a: a + 4096], hi

    def _learn(self, spans: list[str]) -> None:
        first = len(self.known)
        rows = [self.v.symbols(s) for s in spans]
        self.known.update(zip(spans, range(first, first + len(spans))))
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        self.symbols = np.concatenate([self.symbols, np.fromiter((x for r in rows for x in r), np.int32, int(size.sum()))])
        self.symbol_at = np.concatenate([self.symbol_at, self.symbol_at[-1] + np.cumsum(size)])
        fresh = np.arange(first, first + len(spans))
        parts, n = [], np.zeros(len(spans), np.int64)
        order = []
        for group, width in self._groups(fresh):
            flat, count = self.v.merge_short(self._matrix(fresh[group], width), np.zeros(len(group), np.uint64))
            parts.append(flat)
            n[group] = count
            order.append(group)
        for i in np.flatnonzero(size > SHORT):
            parts.append(np.array(self.v.merge_long(rows[i], lambda turn: False), np.int32))
            n[i] = len(parts[-1])
            order.append(np.array([i]))
        # from the order of the groups back to that of the spans
        order, values = np.concatenate(order), np.concatenate(parts)
        start = np.empty(len(spans), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        self.plain = np.concatenate([self.plain, values[_ranges(start, n)]])
        self.plain_at = np.concatenate([self.plain_at, self.plain_at[-1] + np.cumsum(n)])

    def _numbers(self, spans: list[str]) -> np.ndarray:
        get = self.known.get
        at = np.array([get(s, -1) for s in spans], np.int64)
        while len(missing := np.flatnonzero(at < 0)):
            new = list(dict.fromkeys(spans[i] for i in missing.tolist()))
            if len(self.known) + len(new) > REMEMBERED:  # all make way
                missing = np.arange(len(spans))
                new = list(dict.fromkeys(spans))
                self._forget()
            self._learn(new)
            get = self.known.get
            at[missing] = [get(spans[i]) for i in missing.tolist()]
        return at

    def _spans(self, spans: list[str], skips: np.ndarray, long_skip) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all spans end to end, and their number by span. skips: the first 64 turns' bits of each span."""
        at = self._numbers(spans)
        start, n = self.plain_at[at], self.plain_at[at + 1] - self.plain_at[at]
        values, total = [self.plain], len(self.plain)
        if self.dropout > 0:
            size = self.symbol_at[at + 1] - self.symbol_at[at]
            # An agenda without a skip takes as many turns as it merges: no bit among those, no difference.
            turns = (np.uint64(1) << np.minimum(size - n, 63).astype(np.uint64)) - np.uint64(1)
            odd = np.flatnonzero(((skips & turns) != 0) & (size <= SHORT))
            for group, width in self._groups(at[odd]):
                part = odd[group]
                flat, count = self.v.merge_short(self._matrix(at[part], width), skips[part])
                start[part], n[part] = total + np.cumsum(count) - count, count
                values.append(flat)
                total += len(flat)
            for i in np.flatnonzero(size > SHORT).tolist():
                symbols = self.symbols[self.symbol_at[at[i]]: self.symbol_at[at[i] + 1]].tolist()
                values.append(np.array(self.v.merge_long(symbols, long_skip(i)), np.int32))
                start[i], n[i] = total, len(values[-1])
                total += len(values[-1])
        return np.concatenate(values)[_ranges(start, n)], n

    def encode(self, texts: list[str | None], docs: list[int | None]) -> pa.Array:
        """list<int32> ids of each text; null for null, empty for the empty text."""
        ids: list[np.ndarray] = []
        counts = np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[tuple[int, int, int]] = []  # text, its first span number here, how many

        def flush() -> None:
            if not held:
                return
            sizes = np.array([n for _, _, n in owner])
            starts = np.cumsum(sizes) - sizes
            doc = np.repeat(np.array([docs[t] or 0 for t, _, _ in owner], np.int64), sizes)
            number = np.arange(len(held)) + np.repeat(np.array([first for _, first, _ in owner]) - starts, sizes)
            skips = skip_bits(self.seed, doc, number, 0, self.dropout)

            def long_skip(i: int):
                blocks: dict[int, int] = {}

                def skip(turn: int) -> bool:
                    b = turn >> 6
                    if b not in blocks:
                        blocks[b] = int(skip_bits(self.seed, doc[i: i + 1], number[i: i + 1], b, self.dropout)[0])
                    return bool(blocks[b] >> (turn & 63) & 1)

                return skip

            flat, n = self._spans(held, skips, long_skip)
            ids.append(flat)
            per = np.add.reduceat(n, starts)
            for (t, _, _), k in zip(owner, per):
                counts[t] += k
            held.clear()
            owner.clear()

        for t, text in enumerate(texts):
            if not text:
                continue
            first = 0
            for part in self._parts(" " + text):
                held += part
                owner.append((t, first, len(part)))
                first += len(part)
                if len(held) >= SPANS:
                    flush()
        flush()
        flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
        offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)),
                                        mask=pa.array([t is None for t in texts]))

    def _parts(self, text: str) -> Iterator[list[str]]:
        if len(text) < 1 << 20:
            yield self.v.spans.findall(text)
            return
        part: list[str] = []
        for m in self.v.spans.finditer(text):
            part.append(m.group())
            if len(part) >= SPANS:
                yield part
                part = []
        if part:
            yield part

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of list<int32> ids: the pieces' bytes end to end without the first blank; null for null."""
        flat = ids.flatten()
        taken = pc.take(self.v.raw, flat)
        ends = np.append(0, np.cumsum(pc.binary_length(taken).to_numpy(zero_copy_only=False)))
        data = b"" if not len(flat) else taken.buffers()[2].to_pybytes()
        n = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
        cut = np.append(0, np.cumsum(n))
        base = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset] if len(flat) else 0
        valid = ids.is_valid().to_pylist()
        return pa.array([data[base + ends[a]: base + ends[b]][1:].decode("utf-8", "replace") if ok else None
                         for a, b, ok in zip(cut[:-1], cut[1:], valid)], pa.string())


def encoder(path: str, dropout: int, seed: int) -> Encoder:
    """One encoder for each worker and set of parameters."""
    cache = worker_cache()
    if (path, dropout, seed) not in cache:
        if ("vocabulary", path) not in cache:
            cache["vocabulary", path] = Vocabulary.load(path)
        cache[path, dropout, seed] = Encoder(cache["vocabulary", path], dropout, seed)
    return cache[path, dropout, seed]


def encode(docs: DataFrame, path: str = MODEL, dropout: int = DROPOUT, seed: int = SEED, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, lossless): ids of each whole text; lossless: decoding them gives the text back.

    * null text: null ids, 0 tokens, lossless; empty text: no id; a character that the model lacks, the mark U+2581
      included, goes as its bytes;
    * the draws depend on seed, doc_id (null as 0), the span's number and the agenda's turn: the same row gets the same
      ids on any cluster, equal texts under different ids get different ones, repeated rows the same;
    * a very long text is worked on in runs of spans; empty table: empty result; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, dropout, seed)
        for b in slices(batches, "text"):
            texts = b.column(1).to_pylist()
            ids = enc.encode(texts, b.column(0).to_pylist())
            same = pa.array([x == y for x, y in zip(enc.decode(ids).to_pylist(), texts)])
            n = pc.fill_null(pc.list_value_length(ids), 0)
            yield pa.RecordBatch.from_arrays([b.column(0), ids, n, same], names=["doc_id", "ids", "n_tokens", "lossless"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, ids array<int>, n_tokens int, lossless boolean"))


def decode(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each list of ids; null for null, empty for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, 0, 0)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), enc.decode(part.column(1))], names=["doc_id", "text"])

    return (encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
            .mapInArrow(run, "doc_id long, text string"))
