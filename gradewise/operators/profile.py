"""Profiling aggregates: the data behind the reference's EDA figures.

Each profile is one or two aggregations over the table (wide aggregates, or
an ``unpivot`` to (feature, value) followed by a group-by with partial
aggregation); per-feature constants (min, max, quantiles) are computed once
and collected as a handful of scalars.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradewise.operators.quantiles import exact_quantiles
from gradewise.session import bounded_broadcast, counted_broadcast


def present(col: str) -> Column:
    """A column as double, with NaN as null: both are missing values."""
    v = F.col(col).cast("double")
    return F.when(~F.isnan(v), v)


def schema_table(df: DataFrame) -> DataFrame:
    """Position, column, type and non-null count, in one pass over the table."""
    wide = df.agg(*[F.count(c).alias(f"nn_{c}") for c in df.columns])
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("column_name"), F.lit(t).alias("data_type"),
                 F.col(f"nn_{c}").alias("non_null"))
        for i, (c, t) in enumerate(df.dtypes)
    ])
    return wide.select(F.inline(rows))


def nulls(df: DataFrame) -> DataFrame:
    """column_name, n_rows, n_null — one pass over the table."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    aggs += [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    return wide.unpivot(["_n"], df.columns, "column_name", "n_null").select(
        "column_name", F.col("_n").alias("n_rows"), F.col("n_null").cast("long").alias("n_null")
    )


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))))


CORR_PASS = 12  # pairwise correlations in one aggregation, within the codegen field limit


def minmax(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[x for c in cols for x in (F.min(present(c)).alias(f"lo_{c}"), F.max(present(c)).alias(f"hi_{c}"))]).first()
    return {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in cols}


def bin_expr(col: str, lo: float, hi: float, n_bins: int):
    """The bin of a value; null where the value is missing."""
    v = present(col)
    if hi is None or lo is None or hi <= lo:
        return F.when(v.isNotNull(), F.lit(0))
    return F.when(v.isNotNull(), F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * F.lit(n_bins)), F.lit(n_bins - 1)).cast("int"))


def histogram(df: DataFrame, cols: list[str], n_bins: int = 20, by: list[str] | None = None,
              bins: dict[str, int] | None = None,
              ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Equal-width histogram per feature (optionally per ``by`` group):
    feature, [by], bin, n_bins, bin_lo, bin_hi, n.  ``ranges`` reuses
    per-feature ranges already computed (saves a pass)."""
    by = list(by or [])
    mm = ranges or minmax(df, cols)
    nb = {c: (bins or {}).get(c, n_bins) for c in cols}
    binned = df.select(*by, *[bin_expr(c, *mm[c], nb[c]).alias(c) for c in cols])
    long = binned.unpivot(by, cols, "feature", "bin").filter(F.col("bin").isNotNull())
    counts = long.groupBy("feature", *by, "bin").agg(F.count(F.lit(1)).alias("n"))
    lo = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(mm[c][0]))])
    hi = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(mm[c][1]))])
    nbm = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(nb[c]))])
    width = (F.element_at(hi, F.col("feature")) - F.element_at(lo, F.col("feature"))) / F.element_at(nbm, F.col("feature"))
    return counts.select(
        "feature", *by, "bin", F.element_at(nbm, F.col("feature")).alias("n_bins"),
        (F.element_at(lo, F.col("feature")) + F.col("bin") * width).alias("bin_lo"),
        (F.element_at(lo, F.col("feature")) + (F.col("bin") + 1) * width).alias("bin_hi"),
        "n",
    )


def auto_bins(df: DataFrame, cols: list[str], ranges: dict[str, tuple[float, float]] | None = None) -> dict[str, int]:
    """NumPy 'auto' rule: the smaller of the Sturges and Freedman-Diaconis
    bin widths; exact quartiles."""
    long = df.unpivot([], cols, "feature", "value").select("feature", F.col("value").cast("double").alias("value"))
    qs = exact_quantiles(long, ["feature"], "value", [0.25, 0.75]).collect()
    mm = ranges or minmax(df, cols)
    q = {(r["feature"], r["q"]): r["value"] for r in qs}
    n = {r["feature"]: r["n"] for r in qs}
    out = {}
    for c in cols:
        lo, hi = mm[c]
        rng = (hi - lo) if hi is not None else 0.0
        if not n.get(c) or rng <= 0:
            out[c] = 1
            continue
        sturges = rng / (math.log2(n[c]) + 1.0)
        iqr = q[(c, 0.75)] - q[(c, 0.25)]
        fd = 2.0 * iqr * n[c] ** (-1.0 / 3.0)
        width = min(fd, sturges) if fd > 0 else sturges
        out[c] = max(1, math.ceil(rng / width))
    return out


def kde(df: DataFrame, cols: list[str], grid: int = 200, fine_bins: int = 512, cut: float = 3.0) -> DataFrame:
    """Gaussian KDE on a grid from a fine histogram: O(bins x grid) per
    feature.  Scott bandwidth h = std * n^(-1/5); grid over
    [min - cut*h, max + cut*h].  The histogram has at least ``fine_bins`` bins
    and at least eight in a bandwidth, so it stays finer than the kernel as
    the bandwidth shrinks.  Missing values are left out.

    feature, point, x, density."""
    long = df.select(*[present(c).alias(c) for c in cols]).unpivot([], cols, "feature", "v").filter(F.col("v").isNotNull())
    st = long.groupBy("feature").agg(
        F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd")
    )
    st = st.withColumns({
        "h": F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)),
    })
    st = st.withColumn("nb", F.when(F.col("h") > 0, F.greatest(F.lit(fine_bins).cast("long"), F.ceil(8 * (F.col("hi") - F.col("lo")) / F.col("h"))))
                       .otherwise(F.lit(fine_bins).cast("long"))).withColumn("w", (F.col("hi") - F.col("lo")) / F.col("nb"))
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.col("nb")), F.col("nb") - 1)
               ).otherwise(F.lit(0)).cast("long")
    hist = (
        long.join(bounded_broadcast(st.select("feature", "lo", "hi", "nb"), len(cols)), "feature")
        .groupBy("feature", b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
        .groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("hist"))
    )
    pts = st.select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("point")).withColumn(
        "x", F.col("lo") - cut * F.col("h") + F.col("point") * ((F.col("hi") - F.col("lo") + 2 * cut * F.col("h")) / (grid - 1))
    )
    j = pts.join(hist, "feature")
    dens = F.aggregate(
        "hist", F.lit(0.0),
        lambda acc, e: acc + e["c"] * F.exp(
            -0.5 * F.pow((F.col("x") - (F.col("lo") + (e["bin"] + 0.5) * F.col("w"))) / F.col("h"), 2)
        ),
    ) / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))
    dens = F.when(F.col("h") > 0, dens)  # constant feature: no bandwidth, NULL density
    return j.select("feature", "point", "x", dens.alias("density"))


def box_stats(df: DataFrame, cols: list[str], by: str) -> DataFrame:
    """Per (feature, class): q1, median, q3, iqr, whiskers snapped to the
    data (1.5 IQR rule) and the outlier count."""
    long = (df.select(by, *[present(c).alias(c) for c in cols]).unpivot([by], cols, "feature", "value")
            .filter(F.col("value").isNotNull()))
    qs = exact_quantiles(long, ["feature", by], "value", [0.25, 0.5, 0.75])
    q = qs.groupBy("feature", by).agg(
        F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
        F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"),
    ).withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumns({"fence_lo": F.col("q1") - 1.5 * F.col("iqr"), "fence_hi": F.col("q3") + 1.5 * F.col("iqr")})
    v = F.col("value")
    agg = long.join(counted_broadcast(q), ["feature", by]).groupBy("feature", by).agg(
        F.min(F.when(v >= F.col("fence_lo"), v)).alias("whisker_lo"),
        F.max(F.when(v <= F.col("fence_hi"), v)).alias("whisker_hi"),
        F.count_if((v < F.col("fence_lo")) | (v > F.col("fence_hi"))).alias("n_outliers"),
        F.count(F.lit(1)).alias("n"),
    )
    return q.join(agg, ["feature", by])


def correlation(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every pair (a before b in column order).

    Spark ML ``Correlation.corr``: column means, then one tree-aggregated
    pass of mean-centred outer products (BLAS ``spr``, k(k+1)/2 doubles per
    partition) — numerically stable and O(k^2) per row.  (A wide aggregate of
    k(k-1)/2 ``corr`` buffers exceeds the codegen field limit and runs
    interpreted.)  A pair uses the rows where both of its columns are present:
    pairs with a column that has missing values are computed apart, a few
    ``corr`` aggregates in a pass."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    d = df.select(*[present(c).alias(c) for c in cols])
    missing = d.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    full = [c for c in cols if not missing[c]]
    value: dict[tuple[str, str], float | None] = {}
    if len(full) > 1 and missing["_n"]:
        vec = VectorAssembler(inputCols=full, outputCol="_v").transform(d.select(*full))
        m = Correlation.corr(vec, "_v", "pearson").first()[0].toArray()
        value.update({(a, b): float(m[i, j]) for i, a in enumerate(full) for j, b in enumerate(full)})
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    rest = [p for p in pairs if p not in value]
    for at in range(0, len(rest), CORR_PASS):
        part = rest[at:at + CORR_PASS]
        got = d.agg(*[F.corr(a, b).alias(f"c{k}") for k, (a, b) in enumerate(part)]).first()
        value.update({p: got[f"c{k}"] for k, p in enumerate(part)})
    rows = [(a, b, value[a, b]) for a, b in pairs]
    return df.sparkSession.createDataFrame(rows, "feature_a string, feature_b string, corr double")
