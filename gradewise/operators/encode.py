"""Categorical encoders fitted on train rows, applied to every split.

Fitting never looks at the rows twice: all categorical columns are unpivoted
into one long (feature, value, fold) stream and aggregated in one group-by
(partial aggregation map-side, so the shuffle carries only per-level sums).
The result is a small lookup that is persisted, size-checked and joined back
with a broadcast hash join per column.

Input rows carry ``split``, and for the out-of-fold encoding ``fold``, from
:func:`stratified_split`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewise.operators.scale import apply_standard, fit_standard
from gradewise.roles import Roles
from gradewise.session import BROADCAST_MAX_ROWS

def is_train() -> Column:
    return F.col("split") == "train"


HASH_BUCKETS = 4


class CategoryStats:
    """Per (feature, value, fold) label sums and counts over train rows."""

    def __init__(self, df: DataFrame, roles: Roles, cols: list[str] | None = None):
        self.roles = roles
        self.cols = list(cols or roles.categorical)
        # keys are integers, or texts when any column holds texts
        self.text = any(df.schema[c].dataType.simpleString() in ("string", "boolean") for c in self.cols)
        train = df.filter(is_train()).select(
            F.col(roles.label).cast("long").alias("_y"),
            F.col("fold") if "fold" in df.columns else F.lit(None).cast("int").alias("fold"),
            *[F.col(c).cast("string" if self.text else "long").alias(c) for c in self.cols],
        )
        long = train.unpivot(["_y", "fold"], self.cols, "feature", "value")
        self.table = (
            long.groupBy("feature", "value", "fold")
            .agg(F.sum("_y").alias("fold_sum"), F.count(F.lit(1)).alias("fold_n"))
            .persist()
        )
        self.n_rows = self.table.count()
        tot = self.table.filter(F.col("feature") == self.cols[0]).agg(
            F.sum("fold_sum").alias("s"), F.sum("fold_n").alias("n")
        ).first()
        self.label_sum = int(tot["s"] or 0)
        self.n_train = int(tot["n"] or 0)
        self.global_mean = self.label_sum / self.n_train if self.n_train else 0.0

    def per_value(self) -> DataFrame:
        return self.table.groupBy("feature", "value").agg(
            F.sum("fold_sum").alias("tot_sum"), F.sum("fold_n").alias("tot_n")
        )

    def levels(self) -> dict[str, list]:
        """Every column's levels in order.  They name one-hot columns, so the
        driver has to know them; :func:`onehot_vector` does without columns."""
        rows = self.table.select("feature", "value").distinct().collect()
        out: dict[str, list] = {c: [] for c in self.cols}
        for r in rows:
            if r["value"] is not None:
                out[r["feature"]].append(r["value"] if self.text else int(r["value"]))
        return {c: sorted(v) for c, v in out.items()}


# Fitted lookups up to this many rows are applied as map literals (one
# codegen'd projection, no join); larger ones by a broadcast hash join when
# under BROADCAST_MAX_ROWS, else by a shuffle join without the heavy levels.
MAP_LITERAL_MAX_ROWS = 20_000
HEAVY_SHARE = 1 / 200  # of the rows; a level above it is not shuffled


def _key(value: Column, fold: Column | None, slots: int, text: bool) -> Column:
    """One key for a value and, where the lookup has one, a fold of -1 or
    more: ``slots`` is above every fold + 1, so no two pairs share a key."""
    if text:
        v = value.cast("string")
        return v if fold is None else F.concat(fold.cast("string"), F.lit("/"), v)
    v = value.cast("long")
    return v if fold is None else v * slots + (fold + 1)


def apply_lookup(df: DataFrame, lookup: DataFrame, cols: list[str], enc_cols: list[str],
                 out_name, fold_key: Column | None = None,
                 map_max_rows: int = MAP_LITERAL_MAX_ROWS, broadcast_max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Attach ``enc_cols`` of the (feature, value[, fold]) ``lookup`` to each
    row for every categorical column in ``cols``; output columns are named
    ``out_name(col, enc_col)``.  Missing keys give NULL."""
    lookup = lookup.persist()
    text = lookup.schema["value"].dataType.simpleString() == "string"
    sizes = lookup.agg(F.count(F.lit(1)).alias("n"), (F.max("fold") if fold_key is not None else F.lit(0)).alias("f")).first()
    n, slots = sizes["n"], (sizes["f"] or 0) + 2
    if n <= map_max_rows:
        per: dict[str, list] = {c: [] for c in cols}
        for r in lookup.collect():
            if r["feature"] in per and r["value"] is not None:
                per[r["feature"]].append(r)
        exprs = {}
        for c in cols:
            key = _key(F.col(c), fold_key, slots, text)
            for e in enc_cols:
                kv = []
                for r in per[c]:
                    if text:
                        k = r["value"] if fold_key is None else f"{r['fold']}/{r['value']}"
                    else:
                        k = int(r["value"]) if fold_key is None else int(r["value"]) * slots + int(r["fold"]) + 1
                    kv += [F.lit(k), F.lit(r[e])]
                exprs[out_name(c, e)] = F.try_element_at(F.create_map(*kv), key) if kv else F.lit(None)
        lookup.unpersist()
        return df.withColumns(exprs)
    out = df
    for c in cols:
        sub = lookup.filter(F.col("feature") == c).select(
            _key(F.col("value"), F.col("fold") if fold_key is not None else None, slots, text).alias("_lk"),
            *[F.col(e).alias(out_name(c, e)) for e in enc_cols],
        )
        key = _key(F.col(c), fold_key, slots, text)
        if n <= broadcast_max_rows:
            out = out.join(F.broadcast(sub), key == F.col("_lk"), "left").drop("_lk")
        else:
            out = lookup_join(out, sub, key)
    return out


def heavy_keys(df: DataFrame, key: Column, share: float = HEAVY_SHARE) -> list:
    """Keys that more than ``share`` of the rows hold, at most 1 / ``share``."""
    counts = df.select(key.alias("_lk")).groupBy("_lk").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        total = counts.agg(F.sum("n")).first()[0] or 0
        return sorted(r["_lk"] for r in counts.filter(F.col("_lk").isNotNull() & (F.col("n") > share * total)).collect())
    finally:
        counts.unpersist()


def lookup_join(df: DataFrame, sub: DataFrame, key: Column) -> DataFrame:
    """Left join with a lookup too large to broadcast (unique ``_lk``).  Rows of
    heavy keys meet a broadcast of those keys' lookup rows, rows without a key meet
    nothing; only the rest is shuffled, so no task gets all rows of a level."""
    heavy = heavy_keys(df, key)
    often = key.isNull() | key.isin(heavy)
    few = F.broadcast(sub.filter(F.col("_lk").isin(heavy)))
    parts = [df.filter(often).join(few, key == F.col("_lk"), "left"), df.filter(~often).join(sub, key == F.col("_lk"), "left")]
    return parts[0].unionByName(parts[1]).drop("_lk")


def target_oof(df: DataFrame, roles: Roles, stats: CategoryStats | None = None) -> tuple[DataFrame, list[str]]:
    """Out-of-fold target mean for train rows, full train mean for val/test,
    global train mean for unseen levels; no smoothing."""
    stats = stats or CategoryStats(df, roles)
    t = stats.table
    tot = stats.per_value()
    oof = (
        t.join(tot, ["feature", "value"])
        .select(
            "feature", "value", "fold",
            F.when(
                F.col("tot_n") - F.col("fold_n") > 0,
                (F.col("tot_sum") - F.col("fold_sum")) / (F.col("tot_n") - F.col("fold_n")),
            ).alias("enc"),
        )
    )
    full = tot.select("feature", "value", F.lit(-1).alias("fold"), (F.col("tot_sum") / F.col("tot_n")).alias("enc"))
    lookup = oof.unionByName(full)
    fold_key = F.when(is_train(), F.col("fold")).otherwise(F.lit(-1))
    names = {c: f"{c}_target" for c in stats.cols}
    out = apply_lookup(df, lookup, stats.cols, ["enc"], lambda c, e: names[c], fold_key)
    g = F.lit(stats.global_mean)
    out = out.withColumns({n: F.coalesce(F.col(n), g) for n in names.values()})
    return out, list(names.values())


def leave_one_out(df: DataFrame, roles: Roles, stats: CategoryStats | None = None) -> tuple[DataFrame, list[str]]:
    """Train rows: (S - y) / (N - 1) when N > 1 else the global mean;
    val/test: S / N, unseen -> global mean."""
    stats = stats or CategoryStats(df, roles)
    lookup = stats.per_value()
    out = apply_lookup(df, lookup, stats.cols, ["tot_sum", "tot_n"], lambda c, e: f"_{c}_{e}")
    g = F.lit(stats.global_mean)
    y = F.col(roles.label).cast("double")
    exprs = {}
    for c in stats.cols:
        S, N = F.col(f"_{c}_tot_sum"), F.col(f"_{c}_tot_n")
        exprs[f"{c}_loo"] = (
            F.when(is_train(), F.when(N > 1, (S - y) / (N - 1)).otherwise(g))
            .otherwise(F.coalesce(S / N, g))
        )
    out = out.withColumns(exprs).drop(*[f"_{c}_{e}" for c in stats.cols for e in ("tot_sum", "tot_n")])
    return out, list(exprs)


def frequency(df: DataFrame, roles: Roles, stats: CategoryStats | None = None) -> tuple[DataFrame, list[str]]:
    """Share of train rows with the level; unseen -> 0."""
    stats = stats or CategoryStats(df, roles)
    lookup = stats.per_value().select("feature", "value", (F.col("tot_n") / F.lit(max(stats.n_train, 1))).alias("enc"))
    names = {c: f"{c}_freq" for c in stats.cols}
    out = apply_lookup(df, lookup, stats.cols, ["enc"], lambda c, e: names[c])
    out = out.withColumns({n: F.coalesce(F.col(n), F.lit(0.0)) for n in names.values()})
    return out, list(names.values())


def onehot(df: DataFrame, roles: Roles, stats: CategoryStats | None = None) -> tuple[DataFrame, list[str]]:
    """One indicator per train level (sorted); unseen level -> all zeros."""
    stats = stats or CategoryStats(df, roles)
    levels = stats.levels()
    cols = {}
    for c in stats.cols:
        for lv in levels[c]:
            cols[f"{c}_{lv}"] = F.when(F.col(c) == lv, 1).otherwise(0)
    return df.withColumns(cols), list(cols)


def onehot_vector(df: DataFrame, roles: Roles, out: str = "onehot", scale: bool = False,
                  cols: list[str] | None = None) -> DataFrame:
    """The indicators of all columns as one sparse vector, for any number of
    levels and for texts or integers.  Levels are fitted on train rows; an unseen
    level has no indicator, null is a level of its own.  ``scale`` divides each indicator by its train
    deviation sqrt(p (1 - p)), taken from the level counts alone; the mean is
    not subtracted, since that would make the vector dense."""
    from pyspark.ml.feature import ElementwiseProduct, OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.linalg import Vectors

    cols = list(cols or roles.categorical)
    text = df.withColumns({f"_t_{c}": F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols})
    train = text.filter(is_train())
    index = StringIndexer(inputCols=[f"_t_{c}" for c in cols], outputCols=[f"_i_{c}" for c in cols],
                          handleInvalid="keep", stringOrderType="alphabetAsc").fit(train)
    # the indexer's last index stands for unseen levels: dropped, it has no indicator
    hot = OneHotEncoder(inputCols=[f"_i_{c}" for c in cols], outputCols=[f"_h_{c}" for c in cols], dropLast=True)
    indexed = index.transform(text)
    wide = hot.fit(indexed).transform(indexed)
    vec = VectorAssembler(inputCols=[f"_h_{c}" for c in cols], outputCol="_v").transform(wide)
    if scale:
        counts = (train.unpivot([], [f"_t_{c}" for c in cols], "feature", "value")
                  .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a level, as the index
        n_of = {(r["feature"], r["value"]): r["n"] for r in counts}
        n = train.count()
        factors = []
        for c, labels in zip(cols, index.labelsArray):
            ps = [n_of.get((f"_t_{c}", lv), 0) / max(n, 1) for lv in labels]
            factors += [1.0 / math.sqrt(p * (1 - p)) if 0 < p < 1 else 0.0 for p in ps]
        vec = ElementwiseProduct(inputCol="_v", outputCol=out, scalingVec=Vectors.dense(factors)).transform(vec)
    else:
        vec = vec.withColumnRenamed("_v", out)
    return vec.drop(*[f"{p}{c}" for c in cols for p in ("_t_", "_i_", "_h_")], "_v")


def binary_bits(max_value: int) -> int:
    return max(1, math.ceil(math.log2(max_value + 1 if max_value > 0 else 2)))


def binary(df: DataFrame, roles: Roles, fit_on: str = "all") -> tuple[DataFrame, list[str]]:
    """Bit columns ``{col}_bit{i}``, least significant first.  The bit width
    comes from the column max over all rows (reference parity) or train."""
    src = df if fit_on == "all" else df.filter(is_train())
    mx = src.agg(*[F.max(c).alias(c) for c in roles.categorical]).first()
    cols = {}
    for c in roles.categorical:
        for i in range(binary_bits(int(mx[c] or 0))):
            cols[f"{c}_bit{i}"] = F.shiftright(F.col(c).cast("long"), i).bitwiseAND(1).cast("int")
    return df.withColumns(cols), list(cols)


def hash_bucket(col: str, n_buckets: int = HASH_BUCKETS) -> Column:
    """int(first 8 hex digits of md5('col=value')) mod n."""
    digest = F.md5(F.concat(F.lit(f"{col}="), F.col(col).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n_buckets).cast("int")


def hashing(df: DataFrame, roles: Roles, n_buckets: int = HASH_BUCKETS) -> tuple[DataFrame, list[str]]:
    cols = {}
    for c in roles.categorical:
        b = hash_bucket(c, n_buckets)
        for i in range(n_buckets):
            cols[f"{c}_hash{i}"] = F.when(b == i, 1).otherwise(0)
    return df.withColumns(cols), list(cols)


def label(df: DataFrame, roles: Roles) -> tuple[DataFrame, list[str]]:
    return df, list(roles.categorical)


def ordinal(df: DataFrame, roles: Roles) -> tuple[DataFrame, list[str]]:
    """The ordered categoricals as doubles; numerically the same as label."""
    return df.withColumns({c: F.col(c).cast("double") for c in roles.ordered}), list(roles.categorical)


ENCODERS = {
    "label": label,
    "ordinal": ordinal,
    "onehot": onehot,
    "target": target_oof,
    "leave_one_out": leave_one_out,
    "frequency": frequency,
    "binary": binary,
    "hashing": hashing,
}


def encode(df: DataFrame, roles: Roles, kind: str, scale: bool = True,
           digits: int | None = None) -> tuple[DataFrame, list[str]]:
    """Continuous block + encoded categorical block, then standard scaling
    fitted on train rows over every feature column."""
    if kind not in ENCODERS:
        raise ValueError(f"unknown encoding: {kind!r}")
    out, enc_cols = ENCODERS[kind](df, roles)
    feats = list(roles.continuous) + enc_cols
    if scale:
        out = apply_standard(out, fit_standard(out.filter(is_train()), feats), digits)
    return out, feats
