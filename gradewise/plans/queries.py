"""Registered queries: ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (or data Spark derives from them), so
its work grows with the data.  Computed columns carry the same aliases as
the oracle SQL in :mod:`gradewise.plans.oracle`; doubles are rounded to 6
places (metric tables to 4, as the reference's result tables are).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.functions import repair as _repair
from gradewise.functions.features import BASE_COLUMNS, FEATURE_SETS, derived
from gradewise.functions.repair import is_rejected, repair_decimal
from gradewise.operators import encode as enc
from gradewise.operators import metrics as met
from gradewise.operators import prefix as _prefix
from gradewise.operators import profile as prof
from gradewise.operators import rules
from gradewise.operators import split as _split
from gradewise.operators.scale import apply_standard, fit_standard
from gradewise.operators.separability import auc_binary, ks_two_sample
from gradewise.operators.split import selected_split, stratified_split
from gradewise.roles import STUDENT_ROLES
from gradewise.session import shared_path
from gradewise.sources import standin as _standin
from gradewise.sources import tables as _tables
from gradewise.sources.files import read_csv, write_csv
from gradewise.sources.materialize import materialized
from gradewise.sources.standin import row_key_expr, student_table
from gradewise.sources.tables import table

R = STUDENT_ROLES
DIGITS = 6
METRIC_DIGITS = 4

# Display names used by the reference's report.
DISPLAY_NAMES = {
    "StudentID": "Matrícula",
    "Age": "edad",
    "StudyTimeWeekly": "tiempo de estudio semanal",
    "Absences": "ausencias",
    "GPA": "promedio general (GPA)",
    "GradeClass": "clase de calificación",
    "Gender": "género",
    "Ethnicity": "grupo étnico",
    "ParentalEducation": "educación parental",
    "Tutoring": "tutorías",
    "ParentalSupport": "apoyo parental",
    "Extracurricular": "actividades extracurriculares",
    "Sports": "deportes",
    "Music": "música",
    "Volunteering": "voluntariado",
}

# Metric display labels of the comparison chart.
METRIC_LABELS = {
    "accuracy": "Exactitud",
    "precision_macro": "Precisión macro",
    "recall_macro": "Sensibilidad macro",
    "f1_macro": "Puntaje F1 macro",
}


def rounded(cols: list[str], digits: int = DIGITS) -> list:
    return [F.round(F.col(c), digits).alias(c) for c in cols]


def _r(col, digits: int = DIGITS):
    return F.round(col, digits)


STANDIN_COLUMNS = [R.key, *R.features, R.label, "prediction"]


def student_inputs(sf_dir: str) -> list[str]:
    """The tables that the stand-in is joined from."""
    return [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("lineitem", "orders", "customer", "part", "supplier")]


def joined_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in, joined and written once to the shared folder and read back
    by every query (see sources/materialize.py)."""
    return materialized(spark, "student", (_standin, _tables), student_inputs(sf_dir), lambda: student_table(spark, sf_dir))


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in + ``split``, written once.  The split is selected, so writing it
    neither shuffles nor sorts the rows."""
    return materialized(spark, "student_split", (_standin, _tables, _split, _prefix), student_inputs(sf_dir),
                        lambda: selected_split(joined_table(spark, sf_dir), R, ties=True))


def fold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in + split, rank and fold, written once, for what needs every row's rank."""
    return materialized(spark, "student_folds", (_standin, _tables, _split, _prefix), student_inputs(sf_dir),
                        lambda: stratified_split(joined_table(spark, sf_dir), R))


def standin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The student stand-in columns (no key and no label is null)."""
    return joined_table(spark, sf_dir).select(*STANDIN_COLUMNS)


def test_rows(spark, sf_dir) -> DataFrame:
    return split_table(spark, sf_dir).filter(F.col("split") == "test")


# ---------------------------------------------------------------- sources

def q_features_base(spark, sf_dir):
    df = standin(spark, sf_dir)
    return df.select(R.key, *[_r(F.col(c)).alias(c) if c in ("StudyTimeWeekly", "GPA") else F.col(c)
                              for c in R.features], R.label)


def _version_path(spark, stem: str, sf_dir: str) -> str:
    tag = hashlib.md5(sf_dir.encode()).hexdigest()[:10]
    return shared_path(spark, f"{stem}_{spark.sparkContext.applicationId}_{tag}")


def q_io_csv_roundtrip(spark, sf_dir):
    """CSV sink (directory, header, no index) then a schema-first CSV scan."""
    df = q_features_base(spark, sf_dir)
    path = _version_path(spark, "features_base_csv", sf_dir)
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


def raw_decimal_table(spark, sf_dir) -> DataFrame:
    """Text column with malformed decimals derived from lineitem keys."""
    li = table(spark, sf_dir, "lineitem")
    key = row_key_expr()
    b = F.conv(F.substring(F.md5(key), 1, 2), 16, 10).cast("int") % 8
    s = lambda c: F.col(c).cast("long").cast("string")
    raw = (
        F.when(b == 0, F.lit(""))
        .when(b == 1, F.lit(None).cast("string"))
        .when(b == 2, F.lit("n/a"))
        .when(b == 3, s("l_linenumber"))
        .when(b == 4, F.concat((F.col("l_orderkey") % 1000).cast("string"), F.lit("."),
                               (F.col("l_partkey") % 1000).cast("string"), F.lit("."),
                               (F.col("l_suppkey") % 100).cast("string")))
        .otherwise(F.concat(F.lit(" "), s("l_quantity"), F.lit("."), (F.col("l_partkey") % 97).cast("string"), F.lit(" ")))
    )
    return li.select(key.alias("row_key"), raw.alias("raw_text"))


def q_clean_repair_decimal(spark, sf_dir):
    raw = raw_decimal_table(spark, sf_dir)
    return raw.select("row_key", "raw_text", repair_decimal(F.col("raw_text")).alias("repaired"),
                      is_rejected(F.col("raw_text")).cast("int").alias("rejected"))


def q_io_clean_table(spark, sf_dir):
    """Raw -> clean materialisation: reuse the clean table of the same raw
    files and code if its write ended, else repair and write it; then read it back."""
    return materialized(
        spark, "clean_table", (raw_decimal_table, _repair), [f"{sf_dir.rstrip('/')}/lineitem.parquet"],
        lambda: raw_decimal_table(spark, sf_dir).select("row_key", repair_decimal(F.col("raw_text")).alias("StudyTimeWeekly")))


def q_profile_schema(spark, sf_dir):
    return prof.schema_table(standin(spark, sf_dir))


def q_project_rename(spark, sf_dir):
    df = q_features_base(spark, sf_dir)
    return df.withColumnsRenamed({k: v for k, v in DISPLAY_NAMES.items() if k in df.columns})


# ------------------------------------------------------------- features

def _feature_set(name: str):
    def q(spark, sf_dir):
        df = standin(spark, sf_dir)
        cols = FEATURE_SETS[name]
        out = df.select(R.key, *BASE_COLUMNS, *[c.alias(n) for n, c in derived(cols).items()])
        return out.select(R.key, *[c for c in BASE_COLUMNS if c != "StudyTimeWeekly"],
                          *rounded(["StudyTimeWeekly", *cols]))
    q.__name__ = f"q_features_{name}"
    return q


# ------------------------------------------------------------- profiling

def q_profile_nulls(spark, sf_dir):
    return prof.nulls(standin(spark, sf_dir))


def q_profile_class_dist(spark, sf_dir):
    d = prof.class_distribution(standin(spark, sf_dir), R.label)
    return d.select(R.label, "n", _r(F.col("share")).alias("share"))


def _hist_out(h: DataFrame, by: list[str]) -> DataFrame:
    return h.select("feature", *by, "bin", F.col("n_bins").cast("int").alias("n_bins"),
                    _r(F.col("bin_lo")).alias("bin_lo"), _r(F.col("bin_hi")).alias("bin_hi"), "n")


def q_profile_histogram(spark, sf_dir):
    return _hist_out(prof.histogram(standin(spark, sf_dir), list(R.continuous), 20), [])


def q_profile_histogram_by_class(spark, sf_dir):
    df = standin(spark, sf_dir)
    cols = list(R.continuous)
    mm = prof.minmax(df, cols)  # one pass, shared by the bin rule and the binning
    return _hist_out(prof.histogram(df, cols, by=[R.label], bins=prof.auto_bins(df, cols, mm), ranges=mm), [R.label])


def q_profile_kde(spark, sf_dir):
    k = prof.kde(standin(spark, sf_dir), list(R.continuous))
    return k.select("feature", "point", _r(F.col("x")).alias("x"), _r(F.col("density")).alias("density"))


def q_profile_box_by_class(spark, sf_dir):
    b = prof.box_stats(standin(spark, sf_dir), list(R.continuous), R.label)
    dbl = ["q1", "median", "q3", "iqr", "fence_lo", "fence_hi", "whisker_lo", "whisker_hi"]
    return b.select("feature", R.label, *rounded(dbl), F.col("n_outliers").cast("long").alias("n_outliers"), "n")


def q_profile_corr(spark, sf_dir):
    c = prof.correlation(standin(spark, sf_dir), [*R.features, R.label])
    return c.select("feature_a", "feature_b", _r(F.col("corr")).alias("corr"))


# -------------------------------------------------------- split, weights

def q_split_stratified(spark, sf_dir):
    return fold_table(spark, sf_dir).select(R.key, R.label, "split", "class_rank", "fold")


def q_split_summary(spark, sf_dir):
    return split_table(spark, sf_dir).groupBy("split", R.label).agg(F.count(F.lit(1)).alias("n"))


def _train_counts(spark, sf_dir) -> DataFrame:
    return split_table(spark, sf_dir).filter(F.col("split") == "train").groupBy(R.label).agg(F.count(F.lit(1)).alias("n"))


def q_class_weights(spark, sf_dir):
    from gradewise.operators.resample import class_weights
    return class_weights(_train_counts(spark, sf_dir), R.label).select(R.label, "n", _r(F.col("weight")).alias("weight"))


def q_smote_counts(spark, sf_dir):
    from gradewise.operators.resample import smote_plan_counts
    return smote_plan_counts(_train_counts(spark, sf_dir), R.label)


# -------------------------------------------------------------- encoders

def _encoded(kind: str, scale: bool):
    def q(spark, sf_dir):
        df = split_table(spark, sf_dir)
        out, cols = enc.encode(df, R, kind, scale=scale)
        if not scale:
            cols = [c for c in cols if c not in R.continuous]
        dbl = [c for c in cols if dict(out.dtypes)[c] in ("double", "float")]
        return out.select(R.key, "split", *[(_r(F.col(c)).alias(c) if c in dbl else F.col(c)) for c in cols])
    q.__name__ = f"q_encode_{kind}"
    return q


def q_scale_standard(spark, sf_dir):
    df = split_table(spark, sf_dir)
    stats = fit_standard(df.filter(F.col("split") == "train"), list(R.continuous))
    out = apply_standard(df, stats)
    return out.select(R.key, "split", *rounded(list(R.continuous)))


def q_encode_target_oof(spark, sf_dir):
    out, cols = enc.target_oof(fold_table(spark, sf_dir), R)
    return out.select(R.key, "split", *rounded(cols))


def q_embedding_dims(spark, sf_dir):
    from gradewise.operators.embeddings import embedding_dims
    return embedding_dims(standin(spark, sf_dir), list(R.categorical))


# ------------------------------------------------------------ evaluation

def _cells(spark, sf_dir) -> DataFrame:
    return met.confusion_cells(test_rows(spark, sf_dir), R.label, "prediction")


def q_confusion_counts(spark, sf_dir):
    return _cells(spark, sf_dir)


def _norm(how: str):
    def q(spark, sf_dir):
        c = met.normalized(_cells(spark, sf_dir), how)
        return c.select("label", "prediction", "n", _r(F.col("share")).alias("share"))
    q.__name__ = f"q_confusion_norm_{how}"
    return q


def q_confusion_annotated(spark, sf_dir):
    return met.annotated(_cells(spark, sf_dir))


def q_confusion_errors(spark, sf_dir):
    c = met.normalized(_cells(spark, sf_dir), "true")
    return c.filter(F.col("label") != F.col("prediction")).select(
        "label", "prediction", "n", _r(F.col("share")).alias("share"))


def _two_models(spark, sf_dir) -> DataFrame:
    t = test_rows(spark, sf_dir)
    a = t.select(F.lit("rule_gross").alias("model"), R.label, "prediction")
    b = t.select(F.lit("rule_net_096").alias("model"), R.label,
                 rules.rule_prediction(F.col("GPA"), "0.96", list(rules.BASE_CUTS)).alias("prediction"))
    return a.unionByName(b)


def q_confusion_compare(spark, sf_dir):
    cells = met.confusion_cells(_two_models(spark, sf_dir), R.label, "prediction", ["model"])
    return cells.groupBy("label", "prediction").pivot("model", ["rule_gross", "rule_net_096"]).agg(
        F.sum("n")).select("label", "prediction", F.col("rule_gross").cast("long").alias("n_rule_gross"),
                           F.col("rule_net_096").cast("long").alias("n_rule_net_096"))


def q_confusion_pivot(spark, sf_dir):
    cells = _cells(spark, sf_dir).persist()
    labels = sorted(r[0] for r in cells.select("prediction").distinct().collect())
    return cells.groupBy("label").agg(*[F.sum(F.when(F.col("prediction") == v, F.col("n")).otherwise(0)).cast("long").alias(f"p{v}")
                                        for v in labels])


def q_per_class_pr(spark, sf_dir):
    pc = met.per_class(_cells(spark, sf_dir))
    return pc.select("label", "support", "predicted", "tp", *rounded(["precision", "recall", "f1"]))


def q_metrics_macro(spark, sf_dir):
    return met.macro(_cells(spark, sf_dir)).select(*rounded(["accuracy", "precision_macro", "recall_macro", "f1_macro"]))


def q_classification_report(spark, sf_dir):
    return met.classification_report(_cells(spark, sf_dir)).select(
        "label", *rounded(["precision", "recall", "f1_score", "support"]))


def _comparison(spark, sf_dir) -> DataFrame:
    sp = split_table(spark, sf_dir)
    train_counts = sp.filter(F.col("split") == "train").groupBy(R.label).agg(F.count(F.lit(1)).alias("n"))
    major = train_counts.orderBy(F.col("n").desc(), F.col(R.label)).first()[R.label]
    t = sp.filter(F.col("split") == "test")
    scored = _two_models(spark, sf_dir).unionByName(
        t.select(F.lit("majority").alias("model"), R.label, F.lit(major).cast("int").alias("prediction")))
    m = met.macro(met.confusion_cells(scored, R.label, "prediction", ["model"]), ["model"])
    return m.select("model", *rounded(["accuracy", "precision_macro", "recall_macro", "f1_macro"], METRIC_DIGITS))


def q_model_comparison(spark, sf_dir):
    return _comparison(spark, sf_dir).orderBy(F.col("f1_macro").desc(), F.col("accuracy").desc(), "model")


def q_reshape_metrics_long(spark, sf_dir):
    wide = _comparison(spark, sf_dir)
    long = wide.unpivot(["model"], list(METRIC_LABELS), "metrica", "valor")
    return long.replace(METRIC_LABELS, subset=["metrica"])


def _val_grid(spark, sf_dir) -> DataFrame:
    val = split_table(spark, sf_dir).filter(F.col("split") == "val")
    return rules.grid_metrics(val, R.label)


def q_topk_configs(spark, sf_dir):
    g = _val_grid(spark, sf_dir).select(
        "grid_index", "config",
        *[_r(F.col(c), METRIC_DIGITS).alias(f"val_{c}") for c in ("accuracy", "precision_macro", "recall_macro", "f1_macro")],
        _r(F.col("loss"), METRIC_DIGITS).alias("val_loss"),
    )
    return g.orderBy(F.col("val_f1_macro").desc(), F.col("val_accuracy").desc(), "grid_index").limit(10)


def q_best_config(spark, sf_dir):
    g = _val_grid(spark, sf_dir)
    best = g.orderBy(F.round("f1_macro", 5).desc(), F.col("loss"), F.col("grid_index")).limit(1)
    return best.select("grid_index", "config", _r(F.col("f1_macro"), METRIC_DIGITS).alias("val_f1_macro"),
                       _r(F.col("loss")).alias("val_loss"))


def q_auc_binary(spark, sf_dir):
    t = test_rows(spark, sf_dir)
    y = F.col(R.label)
    a = auc_binary(t, "GPA", y == 0, y == 1, "0_vs_1")
    b = auc_binary(t, "GPA", y == 0, y != 0, "0_vs_rest")
    return a.unionByName(b).select("comparison", _r(F.col("auc")).alias("auc"), "n_pos", "n_neg")


def q_ks_two_sample(spark, sf_dir):
    df = standin(spark, sf_dir)
    feats = BASE_COLUMNS + FEATURE_SETS["v1"]
    d = df.select(R.label, *[F.col(c) for c in BASE_COLUMNS], *[c.alias(n) for n, c in derived(FEATURE_SETS["v1"]).items()])
    ks = ks_two_sample(d, feats, R.label, [(0, 1), (0, 4)])
    return ks.select("feature", *rounded(["ks_0vs1", "p_0vs1", "ks_0vs4", "p_0vs4"]))


# ---------------------------------------------- strategies on the fixture

def _train_shares(spark, sf_dir) -> list[float]:
    rows = _train_counts(spark, sf_dir).collect()
    tot = sum(r["n"] for r in rows)
    by = {r[R.label]: r["n"] / tot for r in rows}
    return [by.get(c, 1.0) for c in range(5)]


def q_predict_thresholds(spark, sf_dir):
    shares = _train_shares(spark, sf_dir)
    t = test_rows(spark, sf_dir).withColumn("_p", rules.softmax_probs(F.col("GPA")))
    return t.select(R.key, R.label, rules.argmax(F.col("_p")).alias("pred_argmax"),
                    rules.thresholded(F.col("_p"), [F.lit(s) for s in shares]).alias("pred_thresholded"))


def q_predict_ordinal(spark, sf_dir):
    t = test_rows(spark, sf_dir)
    probs = rules.ordinal_class_probs(rules.cumulative_probs(F.col("GPA")))
    return t.select(R.key, R.label, rules.argmax(probs).alias("pred_ordinal"))


def q_predict_two_stage(spark, sf_dir):
    t = test_rows(spark, sf_dir).withColumn("_p", rules.softmax_probs(F.col("GPA")))
    rest = F.slice(F.col("_p"), 1, 4)
    return t.select(R.key, R.label, rules.two_stage(F.col("_p")[4], rest).alias("pred_two_stage"))


# ------------------------------------------------- other given tables

LABEL_TARGETS = ["quality", "toxic"]
EVENT_PAIRS = [("click", "purchase"), ("view", "purchase")]


def _label_counts(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select(*LABEL_TARGETS)
    return lab.unpivot([], LABEL_TARGETS, "target", "value").groupBy("target", "value").agg(F.count(F.lit(1)).alias("n"))


def q_class_weights_labels(spark, sf_dir):
    """Class weights n / (k * n_c) for each binary target of ``labels``."""
    from gradewise.operators.resample import class_weights
    return class_weights(_label_counts(spark, sf_dir), "value", ("target",)).withColumn("weight", _r(F.col("weight")))


def q_smote_counts_labels(spark, sf_dir):
    """SMOTE plan per binary target of ``labels``: every minority value is
    brought to the majority count."""
    from gradewise.operators.resample import smote_plan_counts
    return smote_plan_counts(_label_counts(spark, sf_dir), "value", ("target",))


def q_profile_histogram_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", "value")
    return _hist_out(prof.histogram(ev, ["value"], 20, by=["event_type"]), ["event_type"])


def q_ks_events(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("event_type", "value")
    ks = ks_two_sample(ev, ["value"], "event_type", EVENT_PAIRS)
    cols = [c for a, b in EVENT_PAIRS for c in (f"ks_{a}vs{b}", f"p_{a}vs{b}")]
    return ks.select("feature", *rounded(cols))


# ------------------------------------------------------------ neighbours


def embedding_split(spark, sf_dir) -> DataFrame:
    """Embeddings as array<double>, split stratified by label on vec_id,
    written once."""
    from gradewise.roles import Roles
    roles = Roles(key="vec_id", label="label", continuous=(), categorical=())

    def split() -> DataFrame:
        e = table(spark, sf_dir, "embeddings").select(
            "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
        return selected_split(e, roles)

    return materialized(spark, "embedding_split", (_split, _prefix), [f"{sf_dir.rstrip('/')}/embeddings.parquet"], split)


def q_knn_classify(spark, sf_dir):
    from gradewise.operators.neighbors import knn_classify
    sp = embedding_split(spark, sf_dir)
    refs = sp.filter(F.col("split") == "train")
    qs = sp.filter(F.col("split") != "train")
    return knn_classify(qs, refs, "vec_id", "vec", "label", k=7)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources / projection
    "features_base": q_features_base,
    "io_csv_roundtrip": q_io_csv_roundtrip,
    "io_clean_table": q_io_clean_table,
    "clean_repair_decimal": q_clean_repair_decimal,
    "profile_schema": q_profile_schema,
    "project_rename": q_project_rename,
    "features_v1": _feature_set("v1"),
    "features_v4": _feature_set("v4"),
    "features_v2_ext": _feature_set("v2_ext"),
    # profiling
    "profile_nulls": q_profile_nulls,
    "profile_class_dist": q_profile_class_dist,
    "profile_histogram": q_profile_histogram,
    "profile_histogram_by_class": q_profile_histogram_by_class,
    "profile_kde": q_profile_kde,
    "profile_box_by_class": q_profile_box_by_class,
    "profile_corr": q_profile_corr,
    # split / weights
    "split_stratified": q_split_stratified,
    "split_summary": q_split_summary,
    "class_weights": q_class_weights,
    "smote_counts": q_smote_counts,
    # encoders
    "scale_standard": q_scale_standard,
    "encode_label": _encoded("label", True),
    "encode_ordinal": _encoded("ordinal", True),
    "encode_onehot": _encoded("onehot", False),
    "encode_target_oof": q_encode_target_oof,
    "encode_loo": _encoded("leave_one_out", False),
    "encode_frequency": _encoded("frequency", False),
    "encode_binary": _encoded("binary", False),
    "encode_hashing": _encoded("hashing", False),
    "embedding_dims": q_embedding_dims,
    # evaluation
    "confusion_counts": q_confusion_counts,
    "confusion_norm_true": _norm("true"),
    "confusion_norm_pred": _norm("pred"),
    "confusion_norm_all": _norm("all"),
    "confusion_annotated": q_confusion_annotated,
    "confusion_errors": q_confusion_errors,
    "confusion_compare": q_confusion_compare,
    "confusion_pivot": q_confusion_pivot,
    "per_class_pr": q_per_class_pr,
    "metrics_macro": q_metrics_macro,
    "classification_report": q_classification_report,
    "model_comparison": q_model_comparison,
    "reshape_metrics_long": q_reshape_metrics_long,
    "topk_configs": q_topk_configs,
    "best_config": q_best_config,
    "auc_binary": q_auc_binary,
    "ks_two_sample": q_ks_two_sample,
    "predict_thresholds": q_predict_thresholds,
    "predict_ordinal": q_predict_ordinal,
    "predict_two_stage": q_predict_two_stage,
    # other given tables
    "class_weights_labels": q_class_weights_labels,
    "smote_counts_labels": q_smote_counts_labels,
    "profile_histogram_events": q_profile_histogram_events,
    "ks_events": q_ks_events,
    # neighbours
    "knn_classify": q_knn_classify,
}
