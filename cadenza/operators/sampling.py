"""Seeded, exact and distributed ordering operators: global rank, three-way
split, epoch batches, class balancing by oversampling, downsampling.

Random order = order of ``md5(seed | key)``, so results are reproducible
and an SQL engine can check them. An exact *global* position is computed
without a single-partition window:

1. bucket = first ``hex_digits`` hex characters of the hash (uniform, so
   no bucket is hot even when a class or source holds a third of the rows);
2. rows per bucket -> running offsets (at most 16**hex_digits rows per
   partition);
3. ``row_number`` inside each bucket + the bucket offset.

Where only a cut is needed (splits, remainders, downsampling) no row is
ranked: the one row at each cut position gives a boundary ``(hash, key)``,
found from the keys alone, and every row is labelled by comparing its own
``(hash, key)`` with it. The wide rows are read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.text import line_shuffle


def hash_key(seed, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def _same(left: DataFrame, right: DataFrame, cols: list[str]) -> Column:
    """Null-safe equality on ``cols`` of left and ``_r_<col>`` of right."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[c].eqNullSafe(right[f"_r_{c}"])
    return cond


def _renamed(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in df.columns])


def _bucket_offsets(keys: DataFrame, part: list[str], carry: list[str]) -> DataFrame:
    """Per (partition, bucket): rows ``_n``, rows before ``_lo``, partition size ``_t`` and the carried columns."""
    counts = keys.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(c) for c in carry])
    w = Window.partitionBy(*part).orderBy("_b")
    return counts.select(*part, *carry, "_b", "_n",
                         (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_lo"),
                         F.sum("_n").over(Window.partitionBy(*part)).alias("_t"))


def _keyed(df: DataFrame, key: Column, seed, hex_digits: int) -> DataFrame:
    return (df.withColumn("_h", hash_key(seed, key)).withColumn("_k", key.cast("string"))
            .withColumn("_b", F.conv(F.substring("_h", 1, hex_digits), 16, 10).cast("int")))


def global_rank(df: DataFrame, key: Column, seed=42, partition: list[str] | None = None,
                hex_digits: int = 4, rank_col: str = "rank", size_col: str | None = None) -> DataFrame:
    """Add the exact 0-based position of each row in ``md5(seed|key)`` order
    (within ``partition`` if given, NULL being a partition of its own);
    optionally the partition size too.

    ``key`` must identify a row (ties are broken by it)."""
    part = list(partition or [])
    d = _keyed(df, key, seed, hex_digits)
    off = _renamed(_bucket_offsets(d.select(*part, "_b"), part, []).drop("_n"), [*part, "_b"])
    j = d.join(off, _same(d, off, [*part, "_b"]))
    r = F.row_number().over(Window.partitionBy(*part, "_b").orderBy("_h", "_k")) - 1 + F.col("_lo")
    out = j.withColumn(rank_col, r.cast("long"))
    if size_col:
        out = out.withColumnRenamed("_t", size_col)
    return out.drop("_h", "_k", "_b", "_lo", "_t", *[f"_r_{c}" for c in [*part, "_b"]])


#: Partitions up to which the boundary table is fetched and handed out as a
#: literal; a larger one stays a distributed table (same labels either way).
LITERAL_BOUNDARIES = 50_000


def seeded_cut(df: DataFrame, key: Column, seed, labels: list[str], thresholds,
               partition: list[str] | None = None, carry: list[str] | None = None,
               hex_digits: int = 4, label_col: str = "cut") -> DataFrame:
    """Label every row by where its position in ``md5(seed|key)`` order
    (within ``partition``, NULL included) falls among ascending thresholds:
    ``labels[i]`` for positions in ``[thr[i-1], thr[i])``.

    ``thresholds(off)`` returns one Column per cut, evaluated on the small
    per-(partition, bucket) table ``off`` that has ``_t`` (partition size)
    and the ``carry`` columns (constant within a partition).

    The row at each cut position is found from a key-only projection: bucket
    counts name its bucket, and only that bucket is ranked. There is one
    boundary per partition and cut, whatever the number of rows, and rows
    compare their ``(hash, key)`` with it."""
    part = list(partition or [])
    carry = list(carry or [])
    keys = _keyed(df.select(*part, *[c for c in carry if c not in part], key.alias("_key")), F.col("_key"), seed, hex_digits)
    off = _bucket_offsets(keys, part, carry)
    cuts = thresholds(off)
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.greatest(c, F.lit(0)).alias("c")) for i, c in enumerate(cuts)]))
    edge = (off.select(*part, "_b", "_n", "_lo", at.alias("_at"))
            .where((F.col("_at.c") >= F.col("_lo")) & (F.col("_at.c") < F.col("_lo") + F.col("_n")))
            .select(*part, "_b", F.col("_at.i").alias("_i"), (F.col("_at.c") - F.col("_lo")).alias("_in")))
    edge = _renamed(edge, [*part, "_b"])
    hit = keys.join(edge, _same(keys, edge, [*part, "_b"]))
    pos = F.row_number().over(Window.partitionBy(*part, "_i", "_b").orderBy("_h", "_k")) - 1
    bounds = (hit.withColumn("_pos", pos).where(F.col("_pos") == F.col("_in"))
              .groupBy(*part).agg(*[F.max(F.when(F.col("_i") == i, F.struct("_h", "_k"))).alias(f"_c{i}")
                                    for i in range(len(cuts))]))
    bounds = _renamed(bounds, part)
    rows = bounds.limit(LITERAL_BOUNDARIES + 1).collect()
    d = df.withColumn("_h", hash_key(seed, key)).withColumn("_k", key.cast("string"))
    if not part:  # one row of boundaries: literals in the label expression
        one = rows[0] if rows else None
        ends = [F.lit(None) if one is None or one[f"_c{i}"] is None else
                F.struct(F.lit(one[f"_c{i}"]["_h"]).alias("_h"), F.lit(one[f"_c{i}"]["_k"]).alias("_k"))
                for i in range(len(cuts))]
    else:
        if len(rows) <= LITERAL_BOUNDARIES:
            bounds = F.broadcast(df.sparkSession.createDataFrame(rows, bounds.schema))
        d = d.join(bounds, _same(d, bounds, part), "left")
        ends = [F.col(f"_c{i}") for i in range(len(cuts))]
    own = F.struct("_h", "_k")
    lab = F.lit(labels[-1])
    for end, name in reversed(list(zip(ends, labels))):  # no boundary: the cut lies at or beyond the end
        lab = F.when(end.isNull() | (own < end), F.lit(name)).otherwise(lab)
    return d.withColumn(label_col, lab).drop("_h", "_k", *([f"_c{i}" for i in range(len(cuts))] + [f"_r_{c}" for c in part]
                                                           if part else []))


def three_way_split(df: DataFrame, key: Column, seed=42, cuts=(0.8, 0.9),
                    hex_digits: int = 4, with_rank: bool = False) -> DataFrame:
    """Shuffle, then cut at ``int(c1*n)`` and ``int(c2*n)``:
    split = 'train' / 'dev' / 'test'. Without ``with_rank`` the rows are not
    shuffled (see ``seeded_cut``)."""
    if with_rank:
        r = global_rank(df, key, seed, hex_digits=hex_digits, size_col="_n_all")
        c1 = F.floor(F.col("_n_all") * F.lit(cuts[0]))
        c2 = F.floor(F.col("_n_all") * F.lit(cuts[1]))
        split = (F.when(F.col("rank") < c1, "train").when(F.col("rank") < c2, "dev")
                 .otherwise("test"))
        return r.withColumn("split", split).drop("_n_all")
    return seeded_cut(df, key, seed, ["train", "dev", "test"],
                      lambda off: [F.floor(F.col("_t") * F.lit(cuts[0])), F.floor(F.col("_t") * F.lit(cuts[1]))],
                      hex_digits=hex_digits, label_col="split")


def epoch_batches(df: DataFrame, key: Column, epochs: int, batch_size: int, seed=42,
                  hex_digits: int = 4) -> DataFrame:
    """Per epoch a fresh seeded order; batch = position div batch size.
    Output rows: df + (epoch, position, batch).

    Only the keys are repeated per epoch and ranked; the rows of ``df`` meet
    their positions in one join by key."""
    keys = df.select(key.cast("string").alias("_ek")).withColumn(
        "epoch", F.explode(F.sequence(F.lit(1), F.lit(int(epochs)))))
    r = global_rank(keys, F.concat_ws("|", F.col("epoch").cast("string"), F.col("_ek")), seed, partition=["epoch"],
                    hex_digits=hex_digits, rank_col="position")
    r = r.withColumn("batch", F.floor(F.col("position") / batch_size).cast("long"))
    return df.withColumn("_ek", key.cast("string")).join(r, "_ek").drop("_ek")


def balance_classes(df: DataFrame, label: str, key: Column, text_col: str | None = "lyrics",
                    seed=42, hex_digits: int = 4, group: list[str] | None = None) -> DataFrame:
    """M8: oversample every class up to the largest one.

    A class with n rows and target T gets ``floor((T-n)/n)`` full copies and
    a sample without replacement of the remaining rows; copied rows get
    their lines shuffled (F10). Originals are kept (copy = 0). NULL is a
    class like any other. ``group`` balances separately per group (e.g. per
    split). One pass over the rows: each is repeated where it is read."""
    g = list(group or [])
    part = list(dict.fromkeys([*g, label]))
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    missing = F.max("_n").over(Window.partitionBy(*g)) - F.col("_n")
    plan = counts.withColumn("_m", missing).select(
        *part, F.floor(F.col("_m") / F.col("_n")).cast("int").alias("_copies"), (F.col("_m") % F.col("_n")).alias("_rest"))
    rows = plan.limit(LITERAL_BOUNDARIES + 1).collect()  # one row per class: fetched once, or left distributed
    plan = _renamed(plan, part)
    if len(rows) <= LITERAL_BOUNDARIES:
        plan = F.broadcast(df.sparkSession.createDataFrame(rows, plan.schema))
    j = df.join(plan, _same(df, plan, part)).drop(*[f"_r_{c}" for c in part])
    # the first `_rest` rows of each class in seeded order get one copy more
    picked = seeded_cut(j, key, f"{seed}|pad", ["more", "same"], lambda off: [F.col("_rest")],
                        partition=part, carry=["_rest"], hex_digits=hex_digits, label_col="_pick")
    top = F.col("_copies") + F.when(F.col("_pick") == "more", 1).otherwise(0)
    out = picked.withColumn("copy", F.explode(F.sequence(F.lit(0), top)))
    if text_col:
        shuffled = line_shuffle(F.col(text_col), F.concat_ws("|", key.cast("string"), F.col("copy").cast("string")), seed)
        out = out.withColumn(text_col, F.when(F.col("copy") > 0, shuffled).otherwise(F.col(text_col)))
    return out.drop("_copies", "_rest", "_pick")


def downsample_class(df: DataFrame, label: str, cls: str, key: Column, fraction_num: int = 1,
                     fraction_den: int = 2, seed=42, hex_digits: int = 4) -> DataFrame:
    """Keep the first ``floor(n * num / den)`` rows (seeded order) of one
    class; other classes untouched."""
    mine = F.coalesce(F.col(label) == cls, F.lit(False))
    cut = seeded_cut(df.withColumn("_mine", mine), key, seed, ["keep", "drop"],
                     lambda off: [F.when(F.col("_mine"), F.floor(F.col("_t") * fraction_num / fraction_den))
                                  .otherwise(F.col("_t"))],
                     partition=["_mine"], hex_digits=hex_digits, label_col="_pick")
    return cut.where(F.col("_pick") == "keep").drop("_pick", "_mine")


def class_codes(df: DataFrame, label: str, code_col: str = "label_code") -> DataFrame:
    """Sorted distinct labels -> 0..K-1; NULL -> -1. The K-row code table
    (one row per class) is fetched once and broadcast, or left distributed: rows dealt by class would land in few tasks."""
    codes = (df.select(label).where(F.col(label).isNotNull()).distinct()
             .withColumn(code_col, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int")))
    rows = codes.limit(LITERAL_BOUNDARIES + 1).collect()
    if len(rows) <= LITERAL_BOUNDARIES:
        codes = F.broadcast(df.sparkSession.createDataFrame(rows, codes.schema))
    return df.join(codes, label, "left").withColumn(
        code_col, F.coalesce(F.col(code_col), F.lit(-1)))
