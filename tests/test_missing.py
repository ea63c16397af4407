"""Missing values, caps that are gone, and written tables."""

import math
import os
import shutil

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gradewise.operators import encode as enc
from gradewise.operators import prefix as px
from gradewise.operators import profile as prof
from gradewise.operators.quantiles import exact_quantiles
from gradewise.operators.resample import smote
from gradewise.operators.separability import auc_binary, ks_two_sample
from gradewise.roles import Roles

NAN = float("nan")


def test_histogram_leaves_missing_out(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (2.0,), (None,), (NAN,)], "x double")
    got = {r["bin"]: r["n"] for r in prof.histogram(df, ["x"], 4).collect()}
    assert got == {0: 1, 2: 1, 3: 1}


def test_kde_is_the_exact_sum(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=400), [40.0]])  # a wide range for the bandwidth
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (NAN,)], "x double")
    h = v.std(ddof=1) * len(v) ** -0.2
    for r in prof.kde(df, ["x"], grid=40, fine_bins=8).collect():
        exact = np.exp(-0.5 * ((r["x"] - v) / h) ** 2).sum() / (len(v) * h * math.sqrt(2 * math.pi))
        assert r["density"] == pytest.approx(exact, rel=0.02, abs=1e-4)


def test_ks_and_auc_leave_missing_out(spark):
    rows = [(0, 0.0), (0, 1.0), (0, None), (0, NAN), (1, 5.0), (1, 6.0)]
    df = spark.createDataFrame(rows, "y int, x double")
    assert ks_two_sample(df, ["x"], "y", [(0, 1)]).first()["ks_0vs1"] == 1.0
    r = auc_binary(df, "x", F.col("y") == 1, F.col("y") == 0, "t").first()
    assert (r["auc"], r["n_pos"], r["n_neg"]) == (1.0, 2, 2)


def test_correlation_is_pairwise_complete(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.normal(size=60), rng.normal(size=60), rng.normal(size=60)
    rows = [(float(x), float(y) if i % 3 else None, float(z) if i % 5 else NAN) for i, (x, y, z) in enumerate(zip(a, b, c))]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    want = df.toPandas().corr()
    for r in prof.correlation(df, ["a", "b", "c"]).collect():
        assert r["corr"] == pytest.approx(want.loc[r["feature_a"], r["feature_b"]], abs=1e-9)


def test_box_leaves_missing_out(spark):
    df = spark.createDataFrame([(0, float(v)) for v in range(9)] + [(0, None), (0, NAN)], "y int, x double")
    r = prof.box_stats(df, ["x"], "y").first()
    assert (r["median"], r["n"]) == (4.0, 9)


@pytest.mark.parametrize("sort_max", [200_000, 500])
def test_quantiles_over_six_hundred_decades(spark, monkeypatch, sort_max):
    import gradewise.operators.quantiles as qm
    monkeypatch.setattr(qm, "SORT_MAX", sort_max)
    n = 20_000 if sort_max == 500 else 300_000
    df = spark.range(n).select(F.lit("g").alias("g"), F.pow(F.lit(10.0), F.col("id") / n * 600 - 300).alias("v"))
    got = {r["q"]: r["value"] for r in exact_quantiles(df, ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect()}
    v = np.sort(np.array([r["v"] for r in df.collect()]))
    for q, x in got.items():
        assert x == pytest.approx(np.percentile(v, q * 100), rel=1e-9)


def test_quantiles_with_heavy_ties(spark, monkeypatch):
    import gradewise.operators.quantiles as qm
    monkeypatch.setattr(qm, "SORT_MAX", 50)
    v = [0.0] * 3000 + [math.nextafter(0, 1) * k for k in range(1, 400)] + [1e308, -1e308]
    df = spark.createDataFrame([("g", x) for x in v], "g string, v double")
    for r in exact_quantiles(df, ["g"], "v", [0.01, 0.5, 0.95, 1.0]).collect():
        assert r["value"] == pytest.approx(float(np.percentile(v, r["q"] * 100)), abs=1e-320)


def test_running_sum_ranges_are_even(spark, monkeypatch):
    monkeypatch.setattr(px, "BIN_TARGET_ROWS", 2_000)
    sizes = []
    checkpointed = type(spark.range(1)).checkpoint

    def seen(self, *a, **k):
        out = checkpointed(self, *a, **k)
        sizes.append(out.groupBy("k", "_bkt").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", seen)
    df = spark.range(40_000).select(F.lit("a").alias("k"), F.exp(F.col("id") / 100).alias("v"), F.lit(1).alias("c"))
    out = px.running_sum_by_bins(df, ["k"], "v", ["c"])
    assert out.agg(F.max("cum_c")).first()[0] == 40_000 and out.select("cum_c").distinct().count() == 40_000
    assert sizes[0] < 2 * 2_000


def roles():
    return Roles(key="id", label="y", continuous=("x",), categorical=("c",), ordered=())


def category_rows(spark, n, levels, folds, text=False):
    c = (F.col("id") % levels)
    return spark.range(n).select(
        "id", F.lit(1.0).alias("x"), (F.concat(F.lit("x"), c) if text else c.cast("int")).alias("c"),
        (F.col("id") % 3).cast("int").alias("y"), F.when(F.col("id") % 10 < 8, "train").otherwise("test").alias("split"),
        F.floor(F.col("id") / 7 % folds).cast("int").alias("fold"))


@pytest.mark.parametrize("map_rows", [20_000, 0])
@pytest.mark.parametrize("text", [False, True])
def test_target_encoding_with_ten_folds(spark, monkeypatch, map_rows, text):
    monkeypatch.setattr(enc.apply_lookup, "__defaults__", (None, map_rows, *enc.apply_lookup.__defaults__[2:]))
    df = category_rows(spark, 400, 5, 10, text)
    out, cols = enc.target_oof(df, roles())
    pdf = df.toPandas()
    train = pdf[pdf.split == "train"]
    got = {r["id"]: r[cols[0]] for r in out.collect()}
    assert out.count() == 400
    for r in pdf.itertuples():
        rest = train[train.c == r.c]
        if r.split == "train":
            rest = rest[rest.fold != r.fold]
        assert got[r.id] == pytest.approx(rest.y.mean() if len(rest) else train.y.mean())


def test_onehot_of_two_thousand_levels(spark):
    df = category_rows(spark, 8_000, 2_000, 3).filter("id < 6000 or split = 'test'")
    rows = enc.onehot_vector(df, roles()).select("c", "split", "onehot").collect()
    train = {r["c"] for r in rows if r["split"] == "train"}
    seen = {}
    for r in rows:
        assert len(r["onehot"].indices) == (1 if r["c"] in train else 0)
        if len(r["onehot"].indices):
            assert seen.setdefault(int(r["onehot"].indices[0]), r["c"]) == r["c"]
    assert len(seen) == len(train)
    scaled = enc.onehot_vector(category_rows(spark, 100, 4, 2, text=True), roles(), scale=True).select("c", "split", "onehot").collect()
    counts = {}
    for r in scaled:
        if r["split"] == "train":
            counts[r["c"]] = counts.get(r["c"], 0) + 1
    for r in scaled:
        p = counts[r["c"]] / 80
        assert r["onehot"].values[0] == pytest.approx(1 / math.sqrt(p * (1 - p)))


def test_smote_with_a_class_of_one(spark):
    rows = [(i, 0, [float(i), 1.0]) for i in range(8)] + [(i, 1, [float(i), 2.0]) for i in range(8, 11)] + [(99, 2, [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id int, y int, v array<double>")
    out = smote(df, "id", "y", "v").collect()
    assert {r["y"] for r in out} == {1} and len(out) == 5


def test_written_tables_follow_their_inputs(spark, tmp_path):
    from gradewise.plans.queries import QUERIES
    d = str(tmp_path / "sf")
    os.makedirs(d)
    for t in ("lineitem", "orders", "customer", "part", "supplier"):
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", d)
        os.chmod(f"{d}/{t}.parquet", 0o644)
    n = lambda name, c: QUERIES[name](spark, d).agg(F.sum(c)).first()[0]
    assert n("split_summary", "n") == 6000 and QUERIES["io_clean_table"](spark, d).count() == 6000
    pq.write_table(pq.read_table("/root/testdata/sf0.001/lineitem.parquet").slice(0, 1000), f"{d}/lineitem.parquet")
    spark.catalog.refreshByPath(d)
    assert n("split_summary", "n") == 1000 and QUERIES["io_clean_table"](spark, d).count() == 1000
