import numpy as np
import pytest
from pyspark.sql import functions as F

from gradewise.operators import profile as prof
from gradewise.operators.quantiles import exact_quantiles
from gradewise.operators.separability import auc_binary, ks_pvalue, ks_two_sample


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.concatenate([rng.normal(size=3000), np.zeros(500), rng.integers(0, 5, 800).astype(float)])
    g = np.array(["a"] * 3000 + ["b"] * 1300)
    df = spark.createDataFrame([(str(x), float(v)) for x, v in zip(g, vals)], "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.75, 0.9]).collect()}
    for grp in ("a", "b"):
        sub = vals[g == grp]
        for q in (0.25, 0.5, 0.75, 0.9):
            assert got[(grp, q)] == pytest.approx(np.percentile(sub, q * 100), abs=1e-12)


def test_exact_quantiles_rank_ranges_apart_beyond_the_sort_limit(spark, monkeypatch):
    import gradewise.operators.quantiles as qm
    monkeypatch.setattr(qm, "SORT_MAX", 3)
    vals = [float(x) for x in np.random.default_rng(2).exponential(size=400)]
    df = spark.createDataFrame([("k", v) for v in vals], "g string, v double")
    got = {r["q"]: r["value"] for r in qm.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.99]).collect()}
    for q in (0.1, 0.5, 0.99):
        assert got[q] == pytest.approx(np.percentile(vals, q * 100), abs=1e-12)


def test_exact_quantiles_widen_brackets_that_a_sketch_missed(spark, monkeypatch):
    import gradewise.operators.quantiles as qm
    monkeypatch.setattr(qm, "ACCURACY", 20)  # rank error of a twentieth, far above the margin
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"), F.hash("id").cast("double").alias("v"))
    rows = df.collect()
    for r in qm.exact_quantiles(df, ["g"], "v", [0.1, 0.5, 0.75]).collect():
        v = [x["v"] for x in rows if x["g"] == r["g"]]
        assert r["value"] == pytest.approx(np.percentile(v, r["q"] * 100), abs=1e-6) and r["n"] == len(v)


def test_exact_quantiles_scan_the_input_twice(spark):
    """Whatever the spacing of values, and with null groups, NaN and infinities."""
    looked = spark.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            looked.add(b.num_rows)
            yield b

    inf = float("inf")
    vals = [10.0 ** (e / 10) for e in range(-3000, 3000)]
    rows = [("a", v) for v in vals] + [(None, 1.0), (None, 4.0), ("i", -inf), ("i", 2.0), ("i", inf), ("n", float("nan")), ("n", None)]
    df = spark.createDataFrame(rows, "g string, v double").mapInArrow(look, "g string, v double")
    got = {(r["g"], r["q"]): r["value"] for r in exact_quantiles(df, ["g"], "v", [0.25, 0.5]).collect()}
    assert looked.value == 2 * len(rows)
    assert got[None, 0.5] == 2.5 and got["i", 0.5] == 2.0 and ("n", 0.5) not in got
    assert got["a", 0.25] == pytest.approx(np.percentile(vals, 25), rel=1e-12)
    assert exact_quantiles(df.limit(0), ["g"], "v", [0.5]).count() == 0


def test_histogram_counts_cover_rows(spark):
    df = spark.range(0, 1000).select(F.col("id").cast("double").alias("x"))
    h = prof.histogram(df, ["x"], 20).collect()
    assert sum(r["n"] for r in h) == 1000 and len(h) == 20
    assert {r["n"] for r in h} == {50}


def test_ks_identical_and_published_pvalue(spark):
    rows = [(0, float(i % 7)) for i in range(50)] + [(1, float(i % 7)) for i in range(50)]
    df = spark.createDataFrame(rows, "y int, x double")
    r = ks_two_sample(df, ["x"], "y", [(0, 1)]).first()
    assert r["ks_0vs1"] == 0.0 and r["p_0vs1"] == 1.0
    p = spark.range(1).select(ks_pvalue(F.lit(0.224), F.lit(107.0), F.lit(273.0)).alias("p")).first()["p"]
    assert round(p, 4) == 0.0007   # published: separability table, first row


def test_ks_against_brute_force(spark):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 30, 400).astype(float), rng.integers(5, 35, 300).astype(float)
    df = spark.createDataFrame([(0, float(v)) for v in a] + [(1, float(v)) for v in b], "y int, x double")
    got = ks_two_sample(df, ["x"], "y", [(0, 1)]).first()["ks_0vs1"]
    grid = np.union1d(a, b)
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert got == pytest.approx(d, abs=1e-12)


def test_auc_against_brute_force(spark):
    rng = np.random.default_rng(4)
    s = rng.integers(0, 50, 600).astype(float)
    y = (rng.random(600) < 0.3 + s / 100).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    got = auc_binary(df, "s", F.col("y") == 1, F.col("y") == 0, "t").first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    want = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert got == pytest.approx(want, abs=1e-12)


def test_box_stats_whiskers(spark):
    vals = list(range(1, 21)) + [100]
    df = spark.createDataFrame([(0, float(v)) for v in vals], "y int, x double")
    r = prof.box_stats(df, ["x"], "y").first()
    q1, q3 = np.percentile(vals, 25), np.percentile(vals, 75)
    assert (r["q1"], r["q3"]) == (q1, q3)
    assert r["whisker_hi"] == 20.0 and r["n_outliers"] == 1


def test_running_sum_two_level_bins(spark, monkeypatch):
    import gradewise.operators.prefix as px
    monkeypatch.setattr(px, "BIN_TARGET_ROWS", 50)
    # dense cluster of distinct values plus far outliers: one level-1 bin is heavy
    vals = [i * 1e-6 for i in range(900)] + [1000.0, 2000.0]
    df = spark.createDataFrame([("a", v, 1) for v in vals], "k string, v double, c int")
    got = {r["v"]: r["cum_c"] for r in px.running_sum_by_bins(df, ["k"], "v", ["c"], n_bins=8).collect()}
    for i, v in enumerate(sorted(vals)):
        assert got[v] == i + 1


def test_ks_and_auc_with_an_absent_class_give_null(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (4, 3.0)], "y int, x double")
    r = ks_two_sample(df, ["x"], "y", [(0, 1), (0, 4)]).first()
    assert r["ks_0vs1"] is None and r["ks_0vs4"] == 1.0
    a = auc_binary(df, "x", F.col("y") == 1, F.col("y") == 0, "t").collect()
    assert all(row["auc"] is None for row in a)


def test_kde_constant_feature_is_null_not_an_error(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(50)], "c double, v double")
    rows = prof.kde(df, ["c", "v"], grid=10).collect()
    assert all(r["density"] is None for r in rows if r["feature"] == "c")
    assert all(r["density"] is not None and r["density"] >= 0 for r in rows if r["feature"] == "v")
