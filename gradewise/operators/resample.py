"""Class weighting and synthetic minority oversampling (SMOTE).

Class weights n / (k * n_c) come from one grouped count; the weight joins
back as a k-row map literal.  SMOTE brings every non-majority class to the
majority count: each class member seeds floor/ceil(m_c / n_c) synthetic rows
(spread evenly by its class rank), the md5 of (seed, key, j) picks one of its k
nearest same-class neighbours and the interpolation factor, and the new
point is x + lambda * (neighbour - x).  Neighbours come from the exact
blocked kNN of :mod:`gradewise.operators.neighbors`, partitioned by class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewise.operators.neighbors import knn_lists
from gradewise.operators.prefix import bucketed_rank, hex_bucket

SEED_DRAWS = 1_000  # synthetic rows of a seed that are drawn together


def class_weights(counts: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """counts: *by, label, n  ->  *by, label, n, weight = N / (k * n) within ``by``."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    return counts.select(
        *by, label, "n",
        (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n"))).alias("weight"),
    )


def weight_column(df: DataFrame, label: str, weights: DataFrame) -> Column:
    """Weight of each row's class as a map-literal lookup (k entries)."""
    rows = weights.select(label, "weight").collect()
    m = F.create_map(*[x for r in rows for x in (F.lit(r[label]), F.lit(float(r["weight"])))])
    return F.coalesce(F.try_element_at(m, F.col(label)), F.lit(1.0))


def smote_plan_counts(counts: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """*by, label, n_before, n_synthetic, n_after (= majority count within ``by``)."""
    w = Window.partitionBy(*(by or [F.lit(1)]))
    mx = F.max("n").over(w)
    return counts.select(
        *by, label, F.col("n").alias("n_before"), (mx - F.col("n")).alias("n_synthetic"), mx.alias("n_after")
    )


def hex_int(col: str | Column, start: int) -> Column:
    """Eight hex digits of an md5 as a number below 2**32: a draw that any engine can repeat."""
    return F.conv(F.substring(col, start, 8), 16, 10).cast("long")


def smote(df: DataFrame, key: str, label: str, vec: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic rows for every non-majority class.

    ``df``: key, label, vec (array<double>).  Returns label, seed_key, j,
    neighbour_key, lambda, vec."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n_max = counts.agg(F.max("n_c")).first()[0]
    minority = [r[label] for r in counts.filter(F.col("n_c") < n_max).collect()]
    if not minority:
        return df.sparkSession.createDataFrame([], f"{label} int, seed_key string, j int, neighbour_key string, lambda double, {vec} array<double>")
    src = df.filter(F.col(label).isin(minority))
    nn = knn_lists(src, src, key, vec, k, partition=label, exclude_self=True)
    # rank within class by key hash: spreads the remainder evenly
    ranked = src.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    ranked = bucketed_rank(ranked, [label], hex_bucket(F.col("_h")), [F.col("_h"), F.col(key)])
    m = F.lit(n_max) - F.col("_n")
    per_seed = F.floor(m / F.col("_n")).cast("int") + F.when(F.col("_rank") < m % F.col("_n"), 1).otherwise(0)
    # neighbours per seed = min(k, n_c - 1); a singleton class has none and
    # cannot seed synthetic rows
    seeds = ranked.withColumns({"_per": per_seed, "_k": F.least(F.lit(k), F.col("_n") - 1)}).filter(
        (F.col("_per") > 0) & (F.col("_k") > 0)).select(F.col(key).alias("seed_key"), label, F.col(vec).alias("_x"), "_k", "_per")
    numbered = F.transform("near", lambda n, i: F.struct((i + 1).alias("rank"), n["ref_key"].alias("ref_key")))
    near = nn.select(F.col("query_key").alias("seed_key"), numbered.alias("_near")).groupBy("seed_key").agg(
        F.flatten(F.collect_list("_near")).alias("_near"))  # a key may stand in several classes
    # vectors are nearly all that crosses the shuffles, so a seed's goes there once a neighbour, with the numbers
    # of the rows that fall on it (of SEED_DRAWS at a time), and not once a synthetic row
    # (merged: the planner takes vectors for small and would send them all to every executor)
    s = seeds.hint("merge").join(near, "seed_key").withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_per") - 1, F.lit(SEED_DRAWS))))

    def hashed(j: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("seed_key").cast("string"), j.cast("string")))

    def drawn(j: Column) -> Column:
        return F.struct(j.alias("j"), (F.pmod(hex_int(hashed(j), 1), F.col("_k")) + 1).cast("int").alias("rank"))

    numbers = F.sequence(F.col("_from"), F.least(F.col("_from") + (SEED_DRAWS - 1), F.col("_per") - 1))
    s = s.withColumn("_draws", F.transform(numbers, drawn)).withColumn("_near", F.explode("_near"))
    own = F.transform(F.filter("_draws", lambda d: d["rank"] == F.col("_near.rank")), lambda d: d["j"])
    s = s.select(label, "seed_key", "_x", F.col("_near.ref_key").alias("neighbour_key"), own.alias("_js")).filter(F.size("_js") > 0)
    vecs = df.select(F.col(key).alias("neighbour_key"), F.col(vec).alias("_y"))
    s = s.join(vecs.hint("merge"), "neighbour_key").withColumn("j", F.explode("_js"))
    s = s.withColumn("lambda", hex_int(hashed(F.col("j")), 9) / float(1 << 32))
    new = F.zip_with("_x", "_y", lambda a, b: a + F.col("lambda") * (b - a))
    return s.select(label, "seed_key", "j", "neighbour_key", "lambda", new.alias(vec))
