"""Exact, deterministic stratified train/val/test split and fold assignment.

Rows of each class are ranked by ``md5(seed:key)``; the first round(70%) go
to train, the next up to round(85%) to val, the rest to test.  Per-class
counts are therefore exact (within rounding), the split is stable for a
given key and seed, independent of partitioning, and needs no ``rand()``.
Stratified k folds reuse the same rank: ``fold = rank % k`` on train rows.

``stratified_split`` computes every row's rank and fold.  ``selected_split``
gives the same split without them: it selects the two rows of each class at
which the split changes and compares every row with those, so the input is
neither joined nor shuffled; with ``ties`` the rows that hold a border's key, if
several do, are numbered apart, so class counts stay exact where keys repeat.
Rows whose key or label is null belong to no class and are left out by both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewise.operators.prefix import bucketed_rank, hex_bucket
from gradewise.roles import Roles
from gradewise.session import bounded_broadcast, ensure_checkpoint_dir

SEED = 42
TRAIN_PER_MILLE = 700
TRAIN_VAL_PER_MILLE = 850
N_FOLDS = 5
LITERAL_CLASSES = 1_000  # classes whose borders are literals of the projection; more are joined


def split_hash(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def cut(n: Column, per_mille: int) -> Column:
    """round(n * per_mille / 1000), half up.  Exact: a non-integer quotient
    of an integer by 1000 is at least 1/1000 away from the next integer."""
    return F.floor((n * per_mille + 500) / 1000)


def stratified_split(
    df: DataFrame,
    roles: Roles,
    seed: int = SEED,
    train_per_mille: int = TRAIN_PER_MILLE,
    train_val_per_mille: int = TRAIN_VAL_PER_MILLE,
    n_folds: int = N_FOLDS,
) -> DataFrame:
    """Adds ``split`` ('train'|'val'|'test'), ``class_rank`` and ``fold``
    (train rows only, else NULL)."""
    h = split_hash(F.col(roles.key), seed)
    ranked = bucketed_rank(
        df.withColumn("_h", h),
        [roles.label],
        hex_bucket(F.col("_h")),
        [F.col("_h"), F.col(roles.key)],
    )
    n, r = F.col("_n"), F.col("_rank")
    t1 = cut(n, train_per_mille)
    t2 = cut(n, train_val_per_mille)
    split = F.when(r < t1, "train").when(r < t2, "val").otherwise("test")
    return ranked.select(
        *df.columns,
        split.alias("split"),
        r.alias("class_rank"),
        F.when(r < t1, (r % n_folds).cast("int")).alias("fold"),
    )


def split_borders(df: DataFrame, roles: Roles, seed: int = SEED, train_per_mille: int = TRAIN_PER_MILLE,
                  train_val_per_mille: int = TRAIN_VAL_PER_MILLE) -> DataFrame:
    """label, ``_val`` and ``_test``: for each class the (hash, key) of the first
    row that is no longer train, and of the first that is test (null: none), with
    ``_ties``, how many rows of that key lie before it.

    Distributed selection: rows per (class, hash prefix) say which prefix holds a
    wanted rank, and only the rows of that prefix (one of 65,536) are ranked.  Rows
    that share a key share a split."""
    label = roles.label
    ensure_checkpoint_dir(df.sparkSession)
    rows = (df.select(F.col(label), F.col(roles.key).alias("_key")).where(F.col(label).isNotNull() & F.col("_key").isNotNull())
            .withColumn("_h", split_hash(F.col("_key"), seed)).withColumn("_bkt", hex_bucket(F.col("_h"))))
    classes = Window.partitionBy(label)
    upto = classes.orderBy("_bkt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum("_c").over(classes)
    wanted = F.array(*[F.struct(F.lit(name).alias("border"), cut(n, p).alias("rank"))
                       for name, p in (("_val", train_per_mille), ("_test", train_val_per_mille))])
    counted = (rows.groupBy(label, "_bkt").agg(F.count(F.lit(1)).alias("_c"))
               .select(label, "_bkt", "_c", F.sum("_c").over(upto).alias("_upto"), wanted.alias("_wanted")))
    holding = (counted.select(label, "_bkt", (F.col("_upto") - F.col("_c")).alias("_off"), "_upto", F.explode("_wanted").alias("_w"))
               .where((F.col("_off") <= F.col("_w.rank")) & (F.col("_w.rank") < F.col("_upto")))
               .select(label, "_bkt", F.col("_w.border").alias("_border"), (F.col("_w.rank") - F.col("_off") + 1).alias("_place")).checkpoint())
    ordered = Window.partitionBy(label, "_border").orderBy("_h", "_key")
    found = (rows.join(bounded_broadcast(holding, holding.count()), [label, "_bkt"])
             .withColumns({"_row": F.row_number().over(ordered), "_first": F.rank().over(ordered)}).where(F.col("_row") == F.col("_place"))
             .select(label, "_border", F.struct("_h", "_key", (F.col("_row") - F.col("_first")).alias("_ties")).alias("_at")))
    return counted.select(label).distinct().join(
        found.groupBy(label).agg(*[F.max(F.when(F.col("_border") == b, F.col("_at"))).alias(b) for b in ("_val", "_test")]), label, "left")


def selected_split(df: DataFrame, roles: Roles, seed: int = SEED, train_per_mille: int = TRAIN_PER_MILLE,
                   train_val_per_mille: int = TRAIN_VAL_PER_MILLE, ties: bool = False) -> DataFrame:
    """Adds ``split`` as ``stratified_split`` does, in a projection of ``df``.
    Rows that share a key share a split, or with ``ties`` are cut at the exact count."""
    label, key = F.col(roles.label), F.col(roles.key)
    borders = split_borders(df, roles, seed, train_per_mille, train_val_per_mille).checkpoint()
    known = df.where(label.isNotNull() & key.isNotNull())
    n = borders.count()
    if not n:
        return known.withColumn("split", F.lit(None).cast("string"))
    if n <= LITERAL_CLASSES:
        kinds, key_kind = df.schema[roles.label].dataType, df.schema[roles.key].dataType
        rows = borders.collect()

        def border(name: str) -> Column:
            pairs = []
            for r in rows:
                at = r[name]
                pairs += [F.lit(r[roles.label]).cast(kinds),
                          F.struct(F.lit(at["_h"] if at else None).cast("string").alias("_h"), F.lit(at["_key"] if at else None).cast(key_kind).alias("_key"),
                                   F.lit(at["_ties"] if at else None).cast("int").alias("_ties"))]
            return F.element_at(F.create_map(*pairs), label)

        known = known.withColumns({"_val": border("_val"), "_test": border("_test")})
    else:
        known = known.join(bounded_broadcast(borders, n), roles.label)
    known = known.withColumn("_own", F.struct(split_hash(key, seed).alias("_h"), key.alias("_key")))
    at = lambda b: F.struct(f"{b}._h", f"{b}._key")
    below = lambda b: F.col(f"{b}._h").isNull() | (F.col("_own") < at(b))
    split = lambda train, val: F.when(train, "train").when(val, "val").otherwise("test").alias("split")
    shared = borders.where((F.col("_val._ties") > 0) | (F.col("_test._ties") > 0)) if ties else None
    if shared is None or shared.isEmpty():
        return known.select(*df.columns, split(below("_val"), below("_test")))
    same = lambda b: F.coalesce((F.col("_own") == at(b)) & (F.col(f"{b}._ties") > 0), F.lit(False))
    tied = same("_val") | same("_test")
    place = F.row_number().over(Window.partitionBy(roles.label, "_own").orderBy("_own"))
    few = known.where(tied).withColumn("_place", place)
    first = lambda b: below(b) | (same(b) & (F.col("_place") <= F.col(f"{b}._ties")))
    return (known.where(~tied).select(*df.columns, split(below("_val"), below("_test")))
            .unionByName(few.select(*df.columns, split(first("_val"), first("_test")))))
