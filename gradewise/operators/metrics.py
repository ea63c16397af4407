"""Confusion matrices, per-class and macro metrics, classification report.

The only pass over scored rows is one ``groupBy(model, label, prediction)``
count (partial aggregation map-side).  Everything after works on the
k x k cell table per model, which is tiny regardless of the data size.
Labels considered are those in y_true U y_pred, as the reference's metrics
do; zero-division gives 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABEL, PRED, N = "label", "prediction", "n"


def confusion_cells(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """All k x k cells per ``by`` group with zero counts filled in.

    Columns: *by, label, prediction, n (bigint).  The cell table (at most
    groups x k x k rows) is persisted: the label set, the zero fill and every
    downstream metric branch read it instead of rescanning the scored rows."""
    by = list(by or [])
    cells = df.groupBy(*by, F.col(label).alias(LABEL), F.col(pred).alias(PRED)).agg(
        F.count(F.lit(1)).alias(N)
    ).persist()
    labs = (
        cells.select(*by, F.explode(F.array(LABEL, PRED)).alias("_l"))
        .groupBy(*by)
        .agg(F.array_sort(F.collect_set("_l")).alias("_labs"))
    )
    grid = labs.select(*by, F.explode("_labs").alias(LABEL), "_labs").select(
        *by, LABEL, F.explode("_labs").alias(PRED)
    )
    return grid.join(cells, [*by, LABEL, PRED], "left").select(
        *by, LABEL, PRED, F.coalesce(F.col(N), F.lit(0)).cast("long").alias(N)
    ).persist()


def normalized(cells: DataFrame, how: str, by: list[str] | None = None) -> DataFrame:
    """Share of each cell: 'true' (row), 'pred' (column) or 'all'."""
    by = list(by or [])
    part = {"true": [*by, LABEL], "pred": [*by, PRED], "all": by}[how]
    w = Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))
    tot = F.sum(N).over(w)
    return cells.withColumn("share", F.when(tot > 0, F.col(N) / tot).otherwise(F.lit(0.0)))


def per_class(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """label, support, predicted, tp, precision, recall, f1 per class."""
    by = list(by or [])
    sup = cells.groupBy(*by, LABEL).agg(
        F.sum(N).alias("support"), F.sum(F.when(F.col(LABEL) == F.col(PRED), F.col(N)).otherwise(0)).alias("tp")
    )
    prd = cells.groupBy(*by, F.col(PRED).alias(LABEL)).agg(F.sum(N).alias("predicted"))
    j = sup.join(prd, [*by, LABEL])
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    out = j.select(*by, LABEL, F.col("support").cast("long").alias("support"),
                   F.col("predicted").cast("long").alias("predicted"), F.col("tp").cast("long").alias("tp"),
                   p.alias("precision"), r.alias("recall"))
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.withColumn("f1", f1)


def macro(cells: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy, precision_macro, recall_macro, f1_macro per ``by`` group."""
    by = list(by or [])
    pc = per_class(cells, by)
    return pc.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.avg("precision").alias("precision_macro"),
        F.avg("recall").alias("recall_macro"),
        F.avg("f1").alias("f1_macro"),
    )


def classification_report(cells: DataFrame) -> DataFrame:
    """Rows per class, then 'accuracy' (value repeated in every column),
    'macro avg' and 'weighted avg' (support = total)."""
    pc = per_class(cells)
    classes = pc.select(
        F.col(LABEL).cast("string").alias("label"), "precision", "recall",
        F.col("f1").alias("f1_score"), F.col("support").cast("double").alias("support"),
    )
    tot = pc.agg(
        (F.sum("tp") / F.sum("support")).alias("acc"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").cast("double").alias("n"),
    )
    acc = tot.select(F.lit("accuracy").alias("label"), F.col("acc").alias("precision"), F.col("acc").alias("recall"),
                     F.col("acc").alias("f1_score"), F.col("acc").alias("support"))
    mac = tot.select(F.lit("macro avg").alias("label"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                     F.col("mf").alias("f1_score"), F.col("n").alias("support"))
    wtd = tot.select(F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"), F.col("wr").alias("recall"),
                     F.col("wf").alias("f1_score"), F.col("n").alias("support"))
    return classes.unionByName(acc).unionByName(mac).unionByName(wtd)


def share_text(n_col: str, total_col: str) -> F.Column:
    """'x.xx' share n/total rounded half-up to 2 decimals in integer math."""
    q = F.floor((F.col(n_col) * 200 + F.col(total_col)) / (F.col(total_col) * 2)).cast("long")
    q = F.when(F.col(total_col) > 0, q).otherwise(F.lit(0))
    return F.concat((q / 100).cast("long").cast("string"), F.lit("."), F.lpad((q % 100).cast("string"), 2, "0"))


def annotated(cells: DataFrame) -> DataFrame:
    """Row-normalised share with the count: '0.83\\n(12)'."""
    w = Window.partitionBy(LABEL)
    c = cells.withColumn("_tot", F.sum(N).over(w))
    return c.select(LABEL, PRED, N, F.concat(share_text(N, "_tot"), F.lit("\n("), F.col(N).cast("string"), F.lit(")")).alias("annotation"))
