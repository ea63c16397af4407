"""Forests in parts: their sizes against forests put together by hand."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gradewise.operators import forests
from gradewise.operators import models as M
from gradewise.operators.tune import grid


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 3))
    y = (x[:, 0] * x[:, 1] > 0).astype(int) + (x[:, 2] > 1)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x array<double>, _y int")
    return df.select("i", array_to_vector("x").alias(M.FEATURES), F.col("_y").cast("double").alias(M.LABEL), "_y").persist()


def test_votes_of_every_size_are_means_of_the_trees_votes(rows):
    train, val = rows.where("i < 350"), rows.where("i >= 350")
    forest = forests.fit_parts(M.RFParams(max_depth=4, min_instances=1, class_weight=None), [3, 5], train, None)
    assert [(n, m.stages[-1].getNumTrees) for n, m in forest.parts] == [(3, 3), (2, 2)]
    got = {r["trees"]: r["accuracy"] for r in forest.sizes(val, "_y").collect()}
    data = val.orderBy("i").collect()
    truth = np.array([r["_y"] for r in data])
    votes = np.zeros((len(data), 3))
    seen = 0
    for n, model in forest.parts:
        for tree in model.stages[-1].trees:
            votes += [tree.predictProbability(r[M.FEATURES]).toArray() for r in data]
        seen += n
        assert got[seen] == pytest.approx((votes.argmax(axis=1) == truth).mean())
    out = forest.transform(val).orderBy("i").select(vector_to_array("probability").alias("p"), "prediction").collect()
    assert np.array([r["p"] for r in out]) == pytest.approx(votes / 5)
    assert [r["prediction"] for r in out] == votes.argmax(axis=1).tolist()


def test_search_fits_shared_trees_once(rows, monkeypatch):
    fitted = []
    real = M.fit
    monkeypatch.setattr(M, "fit", lambda est, train: fitted.append(est.getNumTrees()) or real(est, train))
    cfgs = grid({"class_weight": [None], "max_depth": [2, 4], "min_instances": [1], "num_trees": [2, 4, 7]})
    found, best, forest = forests.search(
        cfgs, lambda c: M.RFParams(c["num_trees"], c["max_depth"], c["min_instances"], None), rows.where("i < 350"), rows.where("i >= 350"))
    assert fitted == [2, 2, 3, 2, 2, 3]
    assert [{k: r[k] for k in cfgs[0]} for r in found] == cfgs
    assert sum(n for n, _ in forest.parts) == cfgs[best]["num_trees"]
    assert found[best]["val_f1_macro"] == max(r["val_f1_macro"] for r in found)
    top = forest.importances(["a", "b", "c"])
    assert sum(v for _, v in top) == pytest.approx(1) and top[0][1] >= top[-1][1]
    with pytest.raises(ValueError):
        forests.Forest([(3, None)]).prefix(2)


def test_search_fits_unbounded_and_deepest_trees_once(rows, monkeypatch):
    """Spark ML's forests end at that depth; those weighted per bootstrap do not."""
    fitted = []
    real = forests.fit_parts
    monkeypatch.setattr(forests, "fit_parts", lambda p, *a: fitted.append((p.class_weight, p.max_depth)) or real(p, *a))
    cfgs = grid({"class_weight": [None, "balanced_subsample"], "max_depth": [None, 3, M.DEEPEST], "min_instances": [1], "num_trees": [2]})
    found, *_ = forests.search(cfgs, lambda c: M.RFParams(c["num_trees"], c["max_depth"], c["min_instances"], c["class_weight"]),
                               rows.where("i < 350"), rows.where("i >= 350"))
    assert fitted == [(None, M.DEEPEST), (None, 3), ("balanced_subsample", None), ("balanced_subsample", 3), ("balanced_subsample", M.DEEPEST)]
    assert [{k: r[k] for k in cfgs[0]} for r in found] == cfgs
    assert {k: v for k, v in found[0].items() if k != "max_depth"} == {k: v for k, v in found[2].items() if k != "max_depth"}


def test_parts_weighted_per_bootstrap_take_part_in_searches(rows):
    train, val = rows.where("i < 350"), rows.where("i >= 350")
    cfgs = grid({"class_weight": ["balanced_subsample"], "max_depth": [None], "min_instances": [1], "num_trees": [2, 6]})
    found, best, forest = forests.search(
        cfgs, lambda c: M.RFParams(c["num_trees"], c["max_depth"], c["min_instances"], c["class_weight"]), train, val)
    assert [r["num_trees"] for r in found] == [2, 6]
    part = forest.parts[0][1]
    assert len(part.trees) == 2 and part.classes == 3
    right = forest.transform(val).filter(F.col("prediction") == F.col("_y")).count()
    assert right / val.count() == pytest.approx(found[best]["val_accuracy"])
    with pytest.raises(ValueError):
        M.random_forest(M.RFParams(class_weight="balanced_subsample"))


def test_training_rows_are_dealt_to_small_tasks(spark, rows, monkeypatch):
    """However few partitions the rows come in, no task of a fit holds more than PART_ROWS (some slack for dealing)."""
    monkeypatch.setattr(M, "PART_ROWS", 20)
    one = rows.coalesce(1)
    sizes = M.dealt(one).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 25 and max(r["count"] for r in sizes) <= 40 and sum(r["count"] for r in sizes) == 500
    seen = []
    monkeypatch.setattr(M, "Pipeline", lambda stages: type("P", (), {"fit": lambda self, df: seen.append(df.rdd.getNumPartitions())})())
    M.fit(None, one)
    assert seen[0] >= 25
    monkeypatch.setattr(M, "PART_ROWS", 500)
    assert M.dealt(one) is one


def test_one_large_partition_is_dealt_to_all_cores(spark, monkeypatch):
    """Also below PART_ROWS rows; a fit of one task leaves the other cores idle."""
    monkeypatch.setattr(M, "LEAST_ROWS", 10_000)
    cores = spark.sparkContext.defaultParallelism
    one = spark.range(0, 20_000, 1, 1)
    sizes = [r["count"] for r in M.dealt(one).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == cores and max(sizes) <= 2 * 20_000 / cores and sum(sizes) == 20_000
    even = spark.range(0, 20_000, 1, cores)
    assert M.dealt(even) is even


def test_shallow_forests_write_no_node_ids(spark, rows):
    """Their lineage is short; deep ones cut it now and then."""
    assert M.random_forest(M.RFParams()).getCheckpointInterval() == -1
    assert M.random_forest(M.RFParams(max_depth=None)).getCheckpointInterval() == 10
    at = spark.sparkContext.getCheckpointDir()
    files = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(at).count()
    spark.range(1).checkpoint()  # a folder without files cannot be read
    before = files()
    M.fit(M.random_forest(M.RFParams(num_trees=2, max_depth=12, min_instances=1, class_weight=None)), rows)
    assert files() == before
