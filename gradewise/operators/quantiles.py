"""Exact quantiles (linear interpolation, = ``quantile_cont``) in two scans.

``percentile`` buffers every value of a group in one task, and a class may
hold a third of all rows.  Here the first scan builds a mergeable rank sketch
per group (``percentile_approx``, rank error at most n / ``ACCURACY``) and reads
from it a bracket of values around every target rank.  The second scan counts
each distinct value inside a bracket and all values of a gap between brackets
together (map-side partial aggregation), so what is left to sort is a few
ten-thousandths of the rows.  Running sums of those counts give exact ranks; a
target whose rank lies in a bracket is found.  Should a sketch have missed, the
rank lies in a gap, and the second scan is repeated with brackets ``WIDEN``
times as wide, up to the whole range, so the result is exact in any case.
Everything stays in Spark; the driver sees counts only.

Null and NaN values take no part; a null group is a group like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradewise.operators.prefix import running_sum_by_bins
from gradewise.session import bounded_broadcast, ensure_checkpoint_dir

ACCURACY = 10_000
MARGIN = 2.0 / ACCURACY  # share of ranks on either side of a target that its bracket covers at first
WIDEN = 50
SORT_MAX = 200_000  # rows ranked by one window per group; beyond it ranges of values are ranked apart


def exact_quantiles(df: DataFrame, group_cols: list[str], value_col: str, probs: list[float]) -> DataFrame:
    """Returns *group_cols, q (double), value (double), n (long)."""
    ensure_checkpoint_dir(df.sparkSession)
    d = df.select(F.struct(F.lit(0).alias("all"), *group_cols).alias("_g"), F.col(value_col).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    groups = [F.col("_g")[c].alias(c) for c in group_cols]
    margin = MARGIN
    sketch, n_groups = _sketch(d, probs, margin)
    while True:
        found = _ranked(d, sketch, n_groups).checkpoint()
        if margin >= 1 or not found.filter("_missed").limit(1).count():
            break
        margin *= WIDEN
        sketch, n_groups = _sketch(d, probs, margin)
    low, high = (F.max(F.when(F.col("_t.upper") == u, F.col("_value"))) for u in (False, True))
    out = found.groupBy("_g", F.col("_t.q").alias("q")).agg(low.alias("_low"), high.alias("_high"), F.max("_t.share").alias("_share"), F.max("n").alias("n"))
    between = F.when(F.col("_share") == 0, F.col("_low")).otherwise(F.col("_low") + F.col("_share") * (F.col("_high") - F.col("_low")))
    return out.select(*groups, "q", between.alias("value"), "n")


def _sketch(d: DataFrame, probs: list[float], margin: float) -> tuple[DataFrame, int]:
    """One row per group: ``n``, ``_los`` and ``_his`` (borders of the brackets)
    and ``_targets`` (the ranks, from 0, on either side of each quantile)."""
    asked = [min(max(p, 0.0), 1.0) for q in probs for p in (q - margin, q + margin)]
    s = F.col("_s")
    los = [F.lit(float("-inf")) if q - margin <= 0 else s[2 * i] for i, q in enumerate(probs)]
    his = [F.lit(float("inf")) if q + margin >= 1 else s[2 * i + 1] for i, q in enumerate(probs)]
    targets = []
    for q in probs:
        place = (F.col("n") - 1) * F.lit(float(q))
        for upper, rank in ((False, F.floor(place)), (True, F.ceil(place))):
            targets.append(F.struct(F.lit(float(q)).alias("q"), F.lit(upper).alias("upper"), rank.cast("long").alias("rank"),
                                    (place - F.floor(place)).alias("share")))
    out = (d.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", asked, ACCURACY).alias("_s"))
           .select("_g", "n", F.array(*los).alias("_los"), F.array(*his).alias("_his"), F.array(*targets).alias("_targets")).checkpoint())
    return out, out.count()


def _ranked(d: DataFrame, sketch: DataFrame, n_groups: int) -> DataFrame:
    """Every target with the value at its rank (``_missed``: the rank lies
    among the different values of a gap)."""
    v = F.col("_v")
    inside = F.exists(F.arrays_zip("_los", "_his"), lambda b: (b["_los"] <= v) & (v <= b["_his"]))
    held = d.join(bounded_broadcast(sketch.select("_g", "_los", "_his"), n_groups), "_g")
    # a gap is known by the number of brackets that end below it
    gap = F.when(inside, F.lit(-1)).otherwise(F.size(F.filter("_his", lambda h: h < v)))
    counts = (held.select("_g", v, gap.alias("_gap"), F.when(inside, v).alias("_own"))
              .groupBy("_g", "_gap", "_own").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_last"))
              .select("_g", "_c", "_least", "_last").checkpoint())
    if counts.count() <= SORT_MAX:
        upto = Window.partitionBy("_g").orderBy("_last").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        summed = counts.withColumn("cum__c", F.sum("_c").over(upto))
    else:
        summed = running_sum_by_bins(counts, ["_g"], "_last", ["_c"])
    below = F.col("cum__c") - F.col("_c")
    summed = (summed.join(bounded_broadcast(sketch.select("_g", "n", "_targets"), n_groups), "_g")
              .withColumn("_hit", F.filter("_targets", lambda t: (below <= t["rank"]) & (t["rank"] < F.col("cum__c")))))
    return summed.select("_g", "n", F.explode("_hit").alias("_t"), F.col("_last").alias("_value"), (F.col("_least") < F.col("_last")).alias("_missed"))
