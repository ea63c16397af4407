"""Evaluation core against values published by the reference (as literals)."""

import pytest

from gradewise.operators import metrics as met
from gradewise.operators.tune import grid, select_best

# Classification report of the reference's final MLP (test split).
PUBLISHED = {
    "0": (0.8571428571428571, 0.375, 0.5217391304347826, 16.0),
    "1": (0.8, 0.7804878048780488, 0.7901234567901234, 41.0),
    "2": (0.7818181818181819, 0.7413793103448276, 0.7610619469026548, 58.0),
    "3": (0.7647058823529411, 0.8387096774193549, 0.8, 62.0),
    "4": (0.9312169312169312, 0.967032967032967, 0.9487870619946092, 182.0),
    "accuracy": (0.8607242339832869,) * 4,
    "macro avg": (0.8269767705061822, 0.7405219519350397, 0.7643423192244341, 359.0),
    "weighted avg": (0.8600361739473652, 0.8607242339832869, 0.8556092646761126, 359.0),
}


def _conf_matrix():
    # rows sum to supports, columns to predicted totals
    m = [[6, 0, 5, 5, 0], [0, 32, 0, 9, 0], [0, 0, 43, 2, 13], [1, 8, 1, 52, 0], [0, 0, 6, 0, 176]]
    return m


def _cells(spark, m):
    rows = [(i, j, m[i][j]) for i in range(5) for j in range(5) for _ in range(m[i][j])]
    df = spark.createDataFrame(rows, "y int, p int, n int")
    return met.confusion_cells(df, "y", "p")


def test_matrix_margins():
    m = _conf_matrix()
    assert [sum(r) for r in m] == [16, 41, 58, 62, 182]
    assert [sum(m[i][j] for i in range(5)) for j in range(5)] == [7, 40, 55, 68, 189]


def test_classification_report_matches_published(spark):
    rep = {r["label"]: r for r in met.classification_report(_cells(spark, _conf_matrix())).collect()}
    for lab, vals in PUBLISHED.items():
        got = rep[lab]
        assert (got["precision"], got["recall"], got["f1_score"], got["support"]) == pytest.approx(vals, abs=1e-12)


def test_macro_f1_is_mean_of_class_f1_not_harmonic(spark):
    m = met.macro(_cells(spark, _conf_matrix())).first()
    assert m["f1_macro"] == pytest.approx(0.7643423192244341)
    hm = 2 * m["precision_macro"] * m["recall_macro"] / (m["precision_macro"] + m["recall_macro"])
    assert abs(hm - m["f1_macro"]) > 0.01


def test_never_predicted_class_and_normalisations(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (1, 1)], "y int, p int")
    cells = met.confusion_cells(df, "y", "p")
    assert cells.count() == 9 and sum(r["n"] for r in cells.collect()) == 4
    pc = {r["label"]: r for r in met.per_class(cells).collect()}
    assert pc[1]["precision"] == 1.0 and pc[0]["precision"] == 0.5
    by_pred = {(r["label"], r["prediction"]): r["share"] for r in met.normalized(cells, "pred").collect()}
    assert by_pred[(1, 1)] == 1.0 and by_pred[(0, 2)] == 0.0
    ann = {(r["label"], r["prediction"]): r["annotation"] for r in met.annotated(cells).collect()}
    assert ann[(1, 0)] == "0.50\n(1)"


def test_grid_order_and_best_rule():
    g = grid({"b": [1, 2], "a": ["x", "y"]})
    assert g == [{"a": "x", "b": 1}, {"a": "x", "b": 2}, {"a": "y", "b": 1}, {"a": "y", "b": 2}]
    # First rows of the reference's MLP search table (f1, loss).
    rows = [{"val_f1_macro": 0.7993, "val_loss": 0.5538}, {"val_f1_macro": 0.7988, "val_loss": 0.5535},
            {"val_f1_macro": 0.79930000001, "val_loss": 0.5}]
    assert select_best(rows, "val_f1_macro", "val_loss") == 2
    assert select_best(rows[:2], "val_f1_macro", "val_loss") == 0


def test_rf_with_leak_column_beats_majority_and_ranks_it_first(spark):
    from conftest import SF_SMALL
    from gradewise.plans import model_queries as mq
    m = mq.q_model_rf(spark, SF_SMALL).first()
    maj = [r for r in __import__("gradewise.plans.queries", fromlist=["x"]).q_model_comparison(spark, SF_SMALL).collect()
           if r["model"] == "majority"][0]
    assert m["accuracy"] > maj["accuracy"] + 0.2
    assert mq.q_rf_importance(spark, SF_SMALL).orderBy("rank").first()["feature"] == "GPA"
