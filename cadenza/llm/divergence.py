"""How far the sources of a language differ in their words, by a frequent-pattern tree of term rows.

A group is a (lang, source) pair; its smoothed share of a kept term is p = 1 + floor(10^9 (count + 1) / (N + V)).
Two groups' divergence sums f(p, q) = floor((p - q)^2 / q) over all kept terms of the language. Most counts are zero, so
the sum starts from V times f of the two shares of a zero, plus

* for each group and count the number of its terms with that count, times what the count changes against a zero;
* for each term that both have, what is then still missing: f(p, q) - f(p, 0) - f(0, q) + f(0, 0).

The last comes from the tree: a term's row, its nonzero (source, count) items in the order of the sources,
is inserted with the number of terms that have the same row. Each node and each of its ancestors are one pair of items,
corrected once for all terms below the node. Rows are sorted and range-partitioned, so a task holds one stretch of the
tree, of which it keeps the current path alone; sums of tasks add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.common import Stages, slices

#: A kept term stands in so many documents of its language; ranks of the part `term`; unit of the shares.
MIN_DOCS, TOP_TERMS, UNIT = 3, 200, 10 ** 9
#: Distinct (lang, source, term) that a task adds up before it hands them on, and rows that it hands on at a time; bytes of
#: a text that are cut at a time.
HELD, ROWS, CUT = 200_000, 1 << 16, 1 << 22
#: Pairs of items that are corrected at a time, and pairs of sources whose sums a task holds.
COMBINATIONS, PAIRS = 1 << 18, 1 << 20
#: Salt of the join that pairs the sources of a language, none of which is then the work of one task.
SALT = 16

#: Bytes that belong to terms: A-Z lower-cased, a-z and everything beyond ASCII; others become blanks.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(text: str, cut: int = CUT) -> Iterator[list[bytes]]:
    raw = text.encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + cut)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _folded(texts: pa.StringArray) -> pa.StringArray:
    """The texts with blanks in place of what belongs to no term, A-Z lower-cased: as many bytes, so the offsets hold."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = b"" if data is None else data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().translate(_FOLD)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(raw))


def _counted(texts: pa.StringArray, group: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of a few documents, or of one whose pieces are counted one by one."""
    parts = []
    if len(texts) == 1 and len(texts[0].as_py()) > CUT:
        pieces = (pa.array([words], pa.list_(pa.binary())).cast(pa.list_(pa.string())) for words in _words(texts[0].as_py(), CUT))
    else:
        pieces = [pc.ascii_split_whitespace(_folded(texts))]
    for lists in pieces:
        words = lists.flatten()
        doc = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        real = pc.greater(pc.binary_length(words), 0)
        doc, coded = doc[real.to_numpy(zero_copy_only=False)], words.filter(real).dictionary_encode()
        code, k = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        pair, n = np.unique(doc * k + code, return_counts=True)  # once for each document and term
        key, at, docs = np.unique(group[pair // k] * k + pair % k, return_inverse=True, return_counts=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, n)
        parts.append(pa.table([pa.array(key // k), coded.dictionary.take(pa.array(key % k)), pa.array(total), pa.array(docs, pa.int64())],
                              names=["group", "term", "n", "docs"]))
    if len(parts) == 1:
        return parts[0]
    whole = _added(parts)
    return whole.set_column(3, "docs", pa.array(np.ones(len(whole), np.int64)))


def _added(parts: list[pa.Table]) -> pa.Table:
    """Tables of ``_counted`` as one, each group and term once."""
    if len(parts) == 1:
        return parts[0]
    got = pa.concat_tables(parts).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([got["group"], got["term"], got["n_sum"], got["docs_sum"]], names=["group", "term", "n", "docs"])


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; a row without term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple, int] = {}
        parts: list[pa.Table] = []
        held = 0

        def rows(t: pa.Table) -> Iterator[pa.RecordBatch]:
            names = list(number)
            lang, source = (pa.array([g[i] for g in names], pa.string()) for i in (0, 1))
            whole = pa.table([pa.chunked_array([x.take(c) for c in t["group"].chunks], pa.string()) for x in (lang, source)]
                             + [t["term"], t["n"], t["docs"]], names=["lang", "source", "term", "n", "docs"])
            yield from whole.to_batches(max_chunksize=ROWS)

        for b in slices(batches, "t"):
            group = np.array([number.setdefault(g, len(number)) for g in zip(*(b.column(i).to_pylist() for i in (1, 2)))], np.int64)
            parts.append(_counted(b.column(0).cast(pa.string()), group))
            held += len(parts[-1])
            if held > 2 * HELD:
                parts = [_added(parts)]
                held = len(parts[0])
                if held > HELD:
                    yield from rows(parts.pop())
                    held = 0
        if parts:
            yield from rows(_added(parts))
        if number:
            none = pa.nulls(len(number), pa.string())
            zero = pa.array(np.zeros(len(number), np.int64))
            yield from rows(pa.table([pa.array(range(len(number)), pa.int64()), none, zero, zero], names=["group", "term", "n", "docs"]))

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in
            ((text_col, "t"), (lang_col, "lang"), (source_col, "source"))]
    return (docs.select(*text).mapInArrow(run, "lang string, source string, term string, n long, docs long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def _share(count: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT (count + 1) / (total + terms)), exact; null without terms."""
    return F.expr(f"1 + (CAST({UNIT} AS DECIMAL(11, 0)) * (CAST({count} AS DECIMAL(20, 0)) + 1)) "
                  f"div nullif(CAST({total} AS DECIMAL(20, 0)) + {terms}, 0)")


def _f(p: str, q: str) -> str:
    """Exact: shares are at most UNIT + 1, so their difference's square fits a long."""
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def _f_array(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Tree:
    """The current path of a tree whose rows come sorted, and the sums of corrections of all closed nodes.

    An item is (source, count, share of the count, share of a zero). ``insert`` closes the nodes that the new row
    doesn't share; a closed node hands its multiplicity to its parent, so each node is corrected once.
    """

    def __init__(self):
        self.source: list[int] = []
        self.count: list[int] = []
        self.p: list[int] = []
        self.zero: list[int] = []
        self.times: list[int] = []
        self.open: list[list] = [[] for _ in range(8)]  # ancestors' source, p, zero; nodes' source, p, zero, times; ends
        self.sums: dict[int, int] = {}
        self.nodes = 0

    def insert(self, source: list[int], count: list[int], p: list[int], zero: list[int], times: int) -> None:
        shared = 0
        for a, b, c, d in zip(source, self.source, count, self.count):
            if a != b or c != d:
                break
            shared += 1
        self.close(shared)
        for kept, new in ((self.source, source), (self.count, count), (self.p, p), (self.zero, zero)):
            kept.extend(new[shared:])
        self.times.extend([0] * (len(source) - shared))
        if source:
            self.times[-1] += times

    def close(self, depth: int) -> None:
        """Nodes deeper than ``depth`` are done: each meets its ancestors."""
        up_source, up_p, up_zero, source, p, zero, times, width = self.open
        for d in range(len(self.source) - 1, depth - 1, -1):
            up_source.extend(self.source[:d])
            up_p.extend(self.p[:d])
            up_zero.extend(self.zero[:d])
            for to, what in ((source, self.source), (p, self.p), (zero, self.zero), (times, self.times)):
                to.append(what[d])
            width.append(d)
            if d:
                self.times[d - 1] += self.times[d]
            self.nodes += 1
        for kept in (self.source, self.count, self.p, self.zero, self.times):
            del kept[depth:]
        if len(up_source) > COMBINATIONS:
            self.correct()

    def correct(self) -> None:
        a, pa_, za, *node, width = (np.array(c, np.int64) for c in self.open)
        for c in self.open:
            c.clear()
        b, pb, zb, m = (np.repeat(c, width) for c in node)
        if not len(a):
            return
        rest = lambda p, z, q, y: m * (_f_array(p, q) - _f_array(p, y) - _f_array(z, q) + _f_array(z, y))
        key = np.concatenate([(a << 32) | b, (b << 32) | a])
        value = np.concatenate([rest(pa_, za, pb, zb), rest(pb, zb, pa_, za)])
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for k, v in zip(key[begin].tolist(), np.add.reduceat(value, begin).tolist()):
            self.sums[k] = self.sums.get(k, 0) + v

    def take(self) -> list[tuple[int, int, int]]:
        """(source, other source, sum) of all that is corrected so far; the sums begin anew."""
        out = [(k >> 32, k & 0xFFFFFFFF, v) for k, v in self.sums.items()]
        self.sums = {}
        return out


def corrections(rows: DataFrame) -> DataFrame:
    """(lang, source, item, v): the tree's corrections, partly summed, from (lang, row, times)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, lang, number, names = Tree(), None, {}, []

        def out(lang):
            got = tree.take()
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(got), pa.string()), pa.array([names[a] for a, _, _ in got], pa.string()),
                 pa.array([names[b] for _, b, _ in got], pa.string()), pa.array([v for *_, v in got], pa.int64())],
                names=["lang", "source", "item", "v"])

        for b in batches:
            items = b.column(1)
            offsets = items.offsets.to_numpy().tolist()
            source, count, p, zero = (items.values.field(i).to_pylist() for i in range(4))
            source = [number.setdefault(s, len(number)) for s in source]
            names.extend(list(number)[len(names):])
            for i, (of, times) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if of != lang:
                    tree.close(0)
                    tree.correct()
                    if lang is not None:
                        yield out(lang)
                    lang = of
                s = slice(offsets[i], offsets[i + 1])
                tree.insert(source[s], count[s], p[s], zero[s], times)
                if len(tree.sums) > PAIRS:
                    yield out(lang)
        tree.close(0)
        tree.correct()
        if lang is not None:
            yield out(lang)

    # ranges of short keys, one number an item: rows that begin alike lie together, and so they do in the sort below
    key = F.transform("row", lambda x: F.hash(x["source"], x["n"]))
    sorted_rows = rows.withColumn("key", key).repartitionByRange("lang", "key").sortWithinPartitions("lang", "row")
    return sorted_rows.select("lang", "row", "times").mapInArrow(run, "lang string, source string, item string, v long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): each group against every other source of its language, and its typical terms.

    Part ``pair``: every other source, by divergence; part ``term``: the group's ``top_terms`` terms of a larger share than
    in the whole language, by divergence. Equal values rank by item.

    * null text, lang or source: the empty string; a group without terms takes part with counts of zero;
    * a language without kept terms: all its pairs have value 0; one with a single source has no pairs;
    * every row is a document, so repeated rows count each; very long texts are cut into words piece by piece;
    * empty table: empty result; extra columns are not read.

    A term's row has as many items as sources have the term, and the result one row for each ordered pair of sources
    of a language: the work beyond the one pass over the texts grows with these.
    """
    stages = Stages(docs.sparkSession, "divergence")
    counts = stages.put(term_counts(docs, text_col, lang_col, source_col), "counts")
    one = Window.partitionBy("lang", "term")
    kept = stages.put(
        counts.where("term IS NOT NULL").select(
            "lang", "source", "term", "n", F.sum("n").over(one).alias("total"), F.sum("docs").over(one).alias("docs"),
            (F.min("source").over(one) == F.col("source")).cast("long").alias("head")).where(F.col("docs") >= min_docs), "kept")
    langs = kept.groupBy("lang").agg(F.sum("head").alias("terms"), F.sum("n").alias("of_lang"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("of_group"))
    groups = stages.put(
        counts.select("lang", "source").distinct().join(langs, "lang", "left").join(sums, ["lang", "source"], "left")
        .na.fill(0, ["terms", "of_lang", "of_group"]).withColumn("zero", _share("0", "of_group", "terms")), "groups")

    items = stages.put(
        kept.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "n", "zero", _share("n", "of_group", "terms").alias("p"),
            _share("total", "of_lang", "terms").alias("q")), "items")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (items.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                         F.expr(_f("p", "q")).alias("value"))
             .withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms))

    salted = groups.withColumn("salt", F.expr(f"CAST(pmod(xxhash64(source), {SALT}) AS INT)"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"),
                           F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    pairs = stages.put(salted.join(others, ["lang", "salt"]).where("source <> item").select(
        "lang", "source", "item", "zero", "item_zero", "terms"), "pairs")
    base = pairs.selectExpr("lang", "source", "item", f"coalesce(terms * ({_f('zero', 'item_zero')}), 0) AS v")
    alone = (items.groupBy("lang", "source", "n", "p", "zero").agg(F.count("*").alias("times"))
             .join(pairs.select("lang", "source", "item", "item_zero"), ["lang", "source"])
             .selectExpr("lang", f"""inline(array(
                 struct(source, item, times * ({_f('p', 'item_zero')} - {_f('zero', 'item_zero')}) AS v),
                 struct(item AS source, source AS item, times * ({_f('item_zero', 'p')} - {_f('item_zero', 'zero')}) AS v)))"""))
    rows = (items.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "n", "p", "zero"))).alias("row"))
            .groupBy("lang", "row").agg(F.count("*").alias("times")))
    value = F.sum(F.col("v").cast("decimal(20,0)")).cast("long")
    found = (base.unionByName(alone).unionByName(corrections(rows)).groupBy("lang", "source", "item").agg(value.alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value")
             .withColumn("rank", F.row_number().over(by_value)))
    return found.unionByName(terms)


#: The same in DuckDB, over ``documents``: every kept term of every pair.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
l AS (SELECT lang, count(*) AS v, sum(total) AS of_lang FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
s AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS of_group FROM g LEFT JOIN c USING (lang, source) GROUP BY g.lang, g.source),
a AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
             (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (s.of_group + l.v))::HUGEINT AS p,
             (1 + 1000000000::HUGEINT * (k.total + 1) // (l.of_lang + l.v))::HUGEINT AS q
      FROM s JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
      FROM a x JOIN a y USING (lang, term) WHERE x.source <> y.source GROUP BY x.lang, x.source, y.source),
pair AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0)::BIGINT AS value
         FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
         LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM a WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
      FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""
