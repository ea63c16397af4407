"""Model training and scoring on Spark ML.

Training is distributed by Spark ML itself (tree histograms are aggregations
over partitions); the driver only holds the model.  Features come from the
encoders (scaled, train-fitted) and are assembled into one vector column.

Spark ML's forests end at depth 30, which is what ``max_depth=None`` gives
here.  Boosting over all classes and forests weighted per bootstrap are
:mod:`gradewise.operators.trees`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradewise.operators.metrics import confusion_cells, macro

FEATURES = "features"
LABEL = "label_d"
DEEPEST = 30  # of a tree in Spark ML
SHALLOW = 15  # depth up to which node ids are not checkpointed (some 200 bytes a row at 50 trees)
PART_ROWS = 500_000  # of a task that grows trees
LEAST_ROWS = 50_000  # of a partition that is worth dealing anew


def assembled(df: DataFrame, cols: list[str], label: str, keep: list[str] | None = None) -> DataFrame:
    va = VectorAssembler(inputCols=cols, outputCol=FEATURES, handleInvalid="keep")
    out = va.transform(df.select(*(keep or []), *cols, label))
    return out.select(*(keep or []), FEATURES, F.col(label).cast("double").alias(LABEL), F.col(label).alias("_y"))


@dataclass(frozen=True)
class RFParams:
    num_trees: int = 50
    max_depth: int | None = 12
    min_instances: int = 2
    class_weight: str | None = "balanced"
    seed: int = 42


def random_forest(p: RFParams, weight_col: str | None = None) -> RandomForestClassifier:
    if p.class_weight == "balanced_subsample":
        raise ValueError("weights per bootstrap: see forests.fit_parts")
    depth = DEEPEST if p.max_depth is None else p.max_depth
    rf = RandomForestClassifier(
        featuresCol=FEATURES, labelCol=LABEL, numTrees=p.num_trees, maxDepth=depth,
        minInstancesPerNode=p.min_instances, featureSubsetStrategy="sqrt", seed=p.seed,
        # more tree nodes split per pass over the data, node ids cached
        # instead of re-shipping trees every iteration; a level of shallow trees is an
        # iteration or a few, too short a lineage to write every row's nodes for
        maxMemoryInMB=1024, cacheNodeIds=True, checkpointInterval=-1 if depth <= SHALLOW else 10,
    )
    if weight_col and p.class_weight:
        rf.setWeightCol(weight_col)
    return rf


def scored_metrics(pred: DataFrame, model_name: str, digits: int | None = 4) -> DataFrame:
    """Macro metrics of a scored DataFrame (columns _y, prediction)."""
    p = pred.select(F.col("_y").cast("int").alias("y"), F.col("prediction").cast("int").alias("p"))
    m = macro(confusion_cells(p, "y", "p")).withColumn("model", F.lit(model_name))
    cols = ["accuracy", "precision_macro", "recall_macro", "f1_macro"]
    return m.select("model", *[(F.round(c, digits) if digits is not None else F.col(c)).alias(c) for c in cols])


def importances(model, cols: list[str]) -> list[tuple[str, float]]:
    """(column, share), greatest first, of a fitted pipeline or :class:`~gradewise.operators.trees.TreeModel`."""
    imp = model.stages[-1].featureImportances.toArray() if isinstance(model, PipelineModel) else model.importances()
    return sorted(zip(cols, [float(x) for x in imp]), key=lambda t: (-t[1], t[0]))


def dealt(train: DataFrame) -> DataFrame:
    """``train``, dealt evenly to full rounds of all cores where a partition has more than ``PART_ROWS`` rows or
    (from ``LEAST_ROWS`` on) over 1.5 times its share.  A forest holds every row
    with its draws and nodes in all trees, about 1 KB at 50 trees, and a task reads its rows again on each level."""
    sizes = train.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    most, total = sizes[0] or 0, sizes[1] or 0
    cores = train.sparkSession.sparkContext.defaultParallelism
    if most <= min(PART_ROWS, max(LEAST_ROWS, math.ceil(1.5 * total / cores))):
        return train
    return train.repartition(cores * math.ceil(total / (cores * PART_ROWS)))


def fit(est, train: DataFrame) -> PipelineModel:
    return Pipeline(stages=[est]).fit(dealt(train))
