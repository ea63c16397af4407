import pytest
from pyspark.sql import functions as F

from gradewise.operators import split as split_module
from gradewise.operators.split import selected_split, stratified_split
from gradewise.roles import STUDENT_ROLES as R
from gradewise.roles import Roles
from gradewise.sources.standin import student_table

from conftest import SF_SMALL


def _summary(df):
    return {(r["GradeClass"], r["split"]): r["n"] for r in df.groupBy("GradeClass", "split").count().withColumnRenamed("count", "n").collect()}


def test_split_counts_exact(spark):
    df = student_table(spark, SF_SMALL)
    sp = stratified_split(df, R)
    counts = {r["GradeClass"]: r["count"] for r in df.groupBy("GradeClass").count().collect()}
    summ = _summary(sp)
    for c, n in counts.items():
        tr, va, te = summ.get((c, "train"), 0), summ.get((c, "val"), 0), summ.get((c, "test"), 0)
        assert tr + va + te == n
        assert abs(tr - 0.70 * n) <= 1 and abs(tr + va - 0.85 * n) <= 1


def test_split_disjoint_covering_and_stable_under_repartition(spark):
    df = student_table(spark, SF_SMALL)
    a = stratified_split(df, R).select(R.key, "split", "fold")
    b = stratified_split(df.repartition(7), R).select(R.key, "split", "fold")
    assert a.count() == df.count() == a.select(R.key).distinct().count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_folds_balanced_per_class(spark):
    sp = stratified_split(student_table(spark, SF_SMALL), R).filter(F.col("split") == "train")
    per = sp.groupBy("GradeClass", "fold").count().collect()
    by = {}
    for r in per:
        by.setdefault(r["GradeClass"], []).append(r["count"])
    for counts in by.values():
        assert len(counts) == 5 and max(counts) - min(counts) <= 1


@pytest.mark.parametrize("literals", [1_000, 2])
def test_selected_split_is_the_ranked_one(spark, monkeypatch, literals):
    monkeypatch.setattr(split_module, "LITERAL_CLASSES", literals)
    roles = Roles(key="k", label="y", continuous=(), categorical=())
    sizes = {"one": 1, "two": 2, "three": 3, "seven": 7, "many": 4000, None: 5}
    rows = [(f"{y}-{i}" if i != 3 else None, y, i) for y, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k string, y string, x int")
    want = stratified_split(df, roles).select("k", "y", "x", "split")
    got = selected_split(df.repartition(5), roles)
    assert got.columns == ["k", "y", "x", "split"]
    assert sorted(got.collect()) == sorted(want.collect())
    assert selected_split(df.limit(0), roles).count() == 0


def test_selected_split_neither_shuffles_nor_joins(spark):
    df = student_table(spark, SF_SMALL).checkpoint()
    out = selected_split(df, R)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Exchange", "Window", "Join", "Sort") if w in plan]
    assert out.select(R.key, "split").exceptAll(stratified_split(df, R).select(R.key, "split")).count() == 0


def test_selected_split_with_ties_keeps_exact_counts(spark):
    """A border falls among the copies of one key: 7 of 10 are train, 1 or 2 val."""
    roles = Roles(key="k", label="y", continuous=(), categorical=())
    rows = [("same", "a", i) for i in range(10)] + [(f"k{i // 3}", "b", i) for i in range(60)] + [(f"u{i}", "c", i) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, y string, x int").repartition(4)
    want = stratified_split(df, roles).groupBy("k", "y", "split").count()
    got = selected_split(df, roles, ties=True)
    assert got.columns == ["k", "y", "x", "split"] and got.select("x", "y").distinct().count() == len(rows)
    assert sorted(got.groupBy("k", "y", "split").count().collect()) == sorted(want.collect())


def test_written_split_is_not_ranked(spark, monkeypatch):
    """Only what needs ranks and folds ranks the rows; profiles do without the split."""
    from gradewise.plans import queries as q

    ranked, kept = [], []
    monkeypatch.setattr(q, "stratified_split", lambda *a: ranked.append(1))
    monkeypatch.setattr(q, "materialized", lambda s, name, code, inputs, build: kept.append(name) or build())
    out = q.split_table(spark, SF_SMALL)
    assert not ranked and kept == ["student_split", "student"]
    assert out.columns[-1] == "split"
    kept.clear()
    q.standin(spark, SF_SMALL)
    assert kept == ["student"]
