"""Separability: two-sample Kolmogorov-Smirnov, exact binary AUC, PCA.

KS and AUC need cumulative counts over a value order inside few keys
(17 features, 2 comparisons).  Values are first grouped (ties collapse, so
the gap is taken after each tie group), then running sums use the bucketed
prefix sum of :mod:`gradewise.operators.prefix` so no window runs over a
whole feature in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.operators.prefix import running_sum_by_bins
from gradewise.session import bounded_broadcast

KS_TERMS = 100


def ks_pvalue(d: Column, n_a: Column, n_b: Column) -> Column:
    """Asymptotic two-sided p with the small-sample correction
    lambda = (sqrt(ne) + 0.12 + 0.11 / sqrt(ne)) * D, ne = na nb / (na + nb);
    p = 2 sum_j (-1)^(j-1) exp(-2 j^2 lambda^2), clipped to [0, 1]."""
    ne = F.when((n_a > 0) & (n_b > 0), n_a * n_b / (n_a + n_b))  # NULL if a class is absent
    lam = (F.sqrt(ne) + 0.12 + 0.11 / F.sqrt(ne)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(KS_TERMS)), F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) * F.exp(-2.0 * j * j * lam * lam),
    )
    p = F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(p)


def ks_two_sample(df: DataFrame, features: list[str], label: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """feature, ks_{a}vs{b}, p_{a}vs{b} for every class pair."""
    classes = sorted({c for p in pairs for c in p})
    long = df.filter(F.col(label).isin(classes)).select(
        F.col(label).alias("_y"), *[F.col(f).cast("double").alias(f) for f in features]
    ).unpivot(["_y"], features, "feature", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counts = long.groupBy("feature", "value").agg(
        *[F.count_if(F.col("_y") == c).alias(f"c{c}") for c in classes])
    cum = running_sum_by_bins(counts, ["feature"], "value", [f"c{c}" for c in classes])
    tots = cum.groupBy("feature").agg(*[F.sum(f"c{c}").alias(f"n{c}") for c in classes])
    j = cum.join(bounded_broadcast(tots, len(features)), "feature")  # one row per feature
    aggs = []
    for a, b in pairs:
        ok = (F.col(f"n{a}") > 0) & (F.col(f"n{b}") > 0)  # ANSI-safe: NULL if a class is absent
        gap = F.when(ok, F.abs(F.col(f"cum_c{a}") / F.col(f"n{a}") - F.col(f"cum_c{b}") / F.col(f"n{b}")))
        aggs.append(F.max(gap).alias(f"ks_{a}vs{b}"))
    d = j.groupBy("feature").agg(*aggs).join(tots, "feature")
    out = [F.col("feature")]
    for a, b in pairs:
        out += [F.col(f"ks_{a}vs{b}"),
                ks_pvalue(F.col(f"ks_{a}vs{b}"), F.col(f"n{a}").cast("double"), F.col(f"n{b}").cast("double")).alias(f"p_{a}vs{b}")]
    return d.select(*out)


def auc_binary(df: DataFrame, score: str, positive: Column, negative: Column, name: str) -> DataFrame:
    """Exact Mann-Whitney AUC = P(score_pos > score_neg) + P(tie) / 2.

    Grouped by distinct score; negatives strictly below each score come from
    the bucketed running sum.  Computed as an integer ratio
    sum(pos * (2 * neg_below + neg)) / (2 * P * N)."""
    g = df.select(F.col(score).cast("double").alias("s"), positive.alias("_p"), negative.alias("_n")).filter(
        (F.col("_p") | F.col("_n")) & F.col("s").isNotNull() & ~F.isnan("s")
    ).groupBy("s").agg(F.count_if("_p").alias("pos"), F.count_if("_n").alias("neg"))
    g = g.withColumn("_k", F.lit(name))
    cum = running_sum_by_bins(g, ["_k"], "s", ["neg"])
    num = (F.col("pos").cast("decimal(38,0)") * (2 * (F.col("cum_neg") - F.col("neg")) + F.col("neg")).cast("decimal(38,0)"))
    agg = cum.groupBy("_k").agg(
        F.sum(num).alias("num"), F.sum("pos").alias("P"), F.sum("neg").alias("N")
    )
    return agg.select(
        F.col("_k").alias("comparison"),
        F.when((F.col("P") > 0) & (F.col("N") > 0),
               F.col("num").cast("double") / (2.0 * F.col("P").cast("double") * F.col("N").cast("double"))).alias("auc"),
        F.col("P").cast("long").alias("n_pos"), F.col("N").cast("long").alias("n_neg"),
    )


def pca(df: DataFrame, cols: list[str], k: int = 3, key: str | None = None):
    """Standardise (mean-centred, population std), fit Spark ML PCA and fix
    each component's sign so its largest-magnitude loading is positive.

    Returns (projected DataFrame with pc1..pck, explained-variance rows)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from gradewise.operators.scale import apply_standard, fit_standard

    stats = fit_standard(df, cols)
    z = apply_standard(df, stats)
    vec = VectorAssembler(inputCols=cols, outputCol="_x").transform(z)
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(vec)
    pcm = model.pc.toArray()
    signs = []
    for j in range(k):
        col = pcm[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    proj = model.transform(vec).select(*([key] if key else []), vector_to_array("_pc").alias("_a"))
    proj = proj.select(*([key] if key else []), *[(F.col("_a")[j] * signs[j]).alias(f"pc{j + 1}") for j in range(k)])
    ev = model.explainedVariance.toArray()
    spark = df.sparkSession
    var = spark.createDataFrame(
        [(j + 1, float(ev[j]), float(sum(ev[: j + 1]))) for j in range(k)],
        "component int, explained_variance_ratio double, cumulative_ratio double",
    )
    return proj, var, math.fsum(ev)
