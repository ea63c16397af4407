"""Profiling and separability queries over columns with missing values, and
their DuckDB SQL, which leaves missing values out explicitly.

The stand-in table has no nulls; here two lineitem columns get them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gradewise.operators import profile as prof
from gradewise.operators.separability import auc_binary, ks_two_sample
from gradewise.sources.tables import table

COLUMNS = {
    "qty": "CASE WHEN l_linenumber = 3 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END",
    "price": "CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(l_extendedprice AS DOUBLE) END",
    "discount": "CAST(l_discount AS DOUBLE)",
    "flag": "CAST(CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE 2 END AS INTEGER)",
}
GAPPY = ["qty", "price"]


def rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {c}" for c, e in COLUMNS.items()])


def _hist(h, by):
    return h.select("feature", *by, "bin", F.col("n_bins").cast("int").alias("n_bins"),
                    F.round("bin_lo", 6).alias("bin_lo"), F.round("bin_hi", 6).alias("bin_hi"), "n")


def q_histogram(spark, sf_dir):
    return _hist(prof.histogram(rows(spark, sf_dir), GAPPY, 20), [])


def q_histogram_by_class(spark, sf_dir):
    return _hist(prof.histogram(rows(spark, sf_dir), GAPPY, 20, by=["flag"]), ["flag"])


def q_kde(spark, sf_dir):
    k = prof.kde(rows(spark, sf_dir), GAPPY)
    return k.select("feature", "point", F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


def q_corr(spark, sf_dir):
    c = prof.correlation(rows(spark, sf_dir), list(COLUMNS))
    return c.select("feature_a", "feature_b", F.round("corr", 6).alias("corr"))


def q_ks(spark, sf_dir):
    k = ks_two_sample(rows(spark, sf_dir), GAPPY, "flag", [(0, 1)])
    return k.select("feature", F.round("ks_0vs1", 6).alias("ks_0vs1"))


def q_auc(spark, sf_dir):
    a = auc_binary(rows(spark, sf_dir), "price", F.col("flag") == 1, F.col("flag") == 0, "1_vs_0")
    return a.select("comparison", F.round("auc", 6).alias("auc"), "n_pos", "n_neg")


QUERIES = {
    "missing_histogram": q_histogram,
    "missing_histogram_by_class": q_histogram_by_class,
    "missing_kde": q_kde,
    "missing_corr": q_corr,
    "missing_ks": q_ks,
    "missing_auc": q_auc,
}


def _with(body: str) -> str:
    cols = ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items())
    long = " UNION ALL ".join(f"SELECT '{c}' AS feature, flag, {c} AS v FROM m WHERE {c} IS NOT NULL" for c in GAPPY)
    return f"WITH m AS (SELECT {cols} FROM lineitem), lg AS ({long}), {body}"


def _histogram(by: str) -> str:
    return _with(f"""mm AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM lg GROUP BY feature),
bn AS (SELECT lg.feature, flag, CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin, lo, hi FROM lg JOIN mm USING (feature))
SELECT feature, {by} bin, 20 AS n_bins, round(lo + bin * ((hi - lo) / 20), 6) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS bin_hi,
  count(*) AS n FROM bn GROUP BY feature, {by} bin, lo, hi""")


def _kde() -> str:
    return _with(f"""st AS (SELECT feature, count(v) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd FROM lg GROUP BY feature),
s2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st),
s3 AS (SELECT *, greatest(512, CAST(ceil(8 * (hi - lo) / h) AS BIGINT)) AS nb FROM s2), s4 AS (SELECT *, (hi - lo) / nb AS w FROM s3),
hc AS (SELECT lg.feature, CAST(least(floor((v - lo) / (hi - lo) * nb), nb - 1) AS BIGINT) AS bin, count(*) AS c FROM lg JOIN s3 USING (feature) GROUP BY ALL),
pts AS (SELECT s4.*, p AS point, lo - 3.0 * h + p * ((hi - lo + 2 * 3.0 * h) / 199) AS x FROM s4, range(0, 200) t(p))
SELECT feature, CAST(point AS INTEGER) AS point, round(any_value(x), 6) AS x,
  round(sum(c * exp(-0.5 * pow((x - (lo + (bin + 0.5) * w)) / h, 2))) / (any_value(n) * any_value(h) * {math.sqrt(2 * math.pi)!r}), 6) AS density
FROM pts JOIN hc USING (feature) GROUP BY feature, point""")


def _corr() -> str:
    names = list(COLUMNS)
    return _with("z AS (SELECT 1) " + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({a}, {b}), 6) AS corr FROM m WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
        for i, a in enumerate(names) for b in names[i + 1:]))


def _ks() -> str:
    return _with("""c AS (SELECT feature, v, count(*) FILTER (WHERE flag = 0) AS c0, count(*) FILTER (WHERE flag = 1) AS c1
  FROM lg WHERE flag IN (0, 1) GROUP BY feature, v),
k AS (SELECT feature, sum(c0) OVER w / sum(c0) OVER (PARTITION BY feature) - sum(c1) OVER w / sum(c1) OVER (PARTITION BY feature) AS d
  FROM c WINDOW w AS (PARTITION BY feature ORDER BY v))
SELECT feature, round(max(abs(d)), 6) AS ks_0vs1 FROM k GROUP BY feature""")


def _auc() -> str:
    return _with("""g AS (SELECT v, count(*) FILTER (WHERE flag = 1) AS p, count(*) FILTER (WHERE flag = 0) AS q
  FROM lg WHERE feature = 'price' AND flag IN (0, 1) GROUP BY v),
r AS (SELECT *, sum(q) OVER (ORDER BY v) - q AS below FROM g)
SELECT '1_vs_0' AS comparison, round(CAST(sum(p * (2 * below + q)) AS DOUBLE) / (2.0 * sum(p) * sum(q)), 6) AS auc,
  CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg FROM r""")


def oracle_sql() -> dict[str, str]:
    return {
        "missing_histogram": _histogram(""),
        "missing_histogram_by_class": _histogram("flag,"),
        "missing_kde": _kde(),
        "missing_corr": _corr(),
        "missing_ks": _ks(),
        "missing_auc": _auc(),
    }
