"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on DuckDB with the driver's tables registered as views.
Shared pieces (the student stand-in, the split) are CTE fragments; the
per-query SQL is assembled from them.  Doubles are rounded to 6 places on
both sides; integer sums are cast to BIGINT (DuckDB sums to HUGEINT).
"""

from __future__ import annotations

from gradewise.roles import STUDENT_ROLES

R = STUDENT_ROLES
CATS = list(R.categorical)
CONT = list(R.continuous)

STANDIN = """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                 CAST(l_suppkey AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS row_key,
  CAST(15 + p_size % 4 AS INTEGER) AS Age,
  CAST(l_orderkey % 2 AS INTEGER) AS Gender,
  CAST(c_nationkey % 4 AS INTEGER) AS Ethnicity,
  CAST(s_nationkey % 5 AS INTEGER) AS ParentalEducation,
  l_quantity * 0.4 AS StudyTimeWeekly,
  CAST(p_size % 30 AS INTEGER) AS Absences,
  CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS Tutoring,
  CAST(CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS INTEGER) AS ParentalSupport,
  CAST(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS Extracurricular,
  CAST(l_partkey % 2 AS INTEGER) AS Sports,
  CAST(l_suppkey % 2 AS INTEGER) AS Music,
  CAST(o_custkey % 2 AS INTEGER) AS Volunteering,
  l_extendedprice / 26250.0 AS GPA,
  CAST(CASE WHEN l_extendedprice * (1 - l_discount) >= 95000 THEN 0
       WHEN l_extendedprice * (1 - l_discount) >= 82000 THEN 1
       WHEN l_extendedprice * (1 - l_discount) >= 68000 THEN 2
       WHEN l_extendedprice * (1 - l_discount) >= 51000 THEN 3 ELSE 4 END AS INTEGER) AS GradeClass,
  CAST(CASE WHEN l_extendedprice >= 95000 THEN 0 WHEN l_extendedprice >= 82000 THEN 1
       WHEN l_extendedprice >= 68000 THEN 2 WHEN l_extendedprice >= 51000 THEN 3 ELSE 4 END AS INTEGER) AS prediction
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
"""

# s: stand-in; sp: split with class rank, fold.
SPLIT_CTE = f"""
s AS ({STANDIN}),
rk AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY GradeClass ORDER BY md5('42:' || row_key), row_key) - 1 AS BIGINT) AS class_rank,
         count(*) OVER (PARTITION BY GradeClass) AS n_c
  FROM s),
sp AS (
  SELECT * EXCLUDE (n_c),
    CASE WHEN class_rank < (n_c * 700 + 500) // 1000 THEN 'train'
         WHEN class_rank < (n_c * 850 + 500) // 1000 THEN 'val' ELSE 'test' END AS split,
    CASE WHEN class_rank < (n_c * 700 + 500) // 1000 THEN CAST(class_rank % 5 AS INTEGER) END AS fold
  FROM rk)
"""


def with_split(body: str) -> str:
    return f"WITH {SPLIT_CTE}{body}"


def _split_stratified() -> str:
    return with_split("SELECT row_key, GradeClass, split, class_rank, fold FROM sp")


def _split_summary() -> str:
    return with_split("SELECT split, GradeClass, count(*) AS n FROM sp GROUP BY split, GradeClass")


def _stats_ctes(cols: list[str]) -> str:
    parts = ["g AS (SELECT avg(GradeClass) AS gm, count(*) AS n_train FROM sp WHERE split = 'train')"]
    for c in cols:
        parts.append(
            f"st_{c} AS (SELECT {c} AS v, fold, CAST(sum(GradeClass) AS BIGINT) AS s, count(*) AS c "
            f"FROM sp WHERE split = 'train' GROUP BY {c}, fold)"
        )
        parts.append(
            f"tot_{c} AS (SELECT v, CAST(sum(s) AS BIGINT) AS S, CAST(sum(c) AS BIGINT) AS N FROM st_{c} GROUP BY v)"
        )
    return ",\n".join(parts)


def _encode_target_oof() -> str:
    ctes = [_stats_ctes(CATS)]
    for c in CATS:
        ctes.append(
            f"oof_{c} AS (SELECT a.v, a.fold, CASE WHEN b.N - a.c > 0 THEN (b.S - a.s) / (b.N - a.c) END AS enc "
            f"FROM st_{c} a JOIN tot_{c} b USING (v))"
        )
    sel, joins = [], []
    for c in CATS:
        sel.append(
            f"round(coalesce(CASE WHEN sp.split = 'train' THEN o_{c}.enc ELSE t_{c}.S / t_{c}.N END, g.gm), 6) AS {c}_target"
        )
        joins.append(f"LEFT JOIN oof_{c} o_{c} ON o_{c}.v = sp.{c} AND o_{c}.fold = sp.fold")
        joins.append(f"LEFT JOIN tot_{c} t_{c} ON t_{c}.v = sp.{c}")
    return with_split(
        ",\n" + ",\n".join(ctes)
        + "\nSELECT sp.row_key, sp.split, " + ", ".join(sel)
        + "\nFROM sp CROSS JOIN g\n" + "\n".join(joins)
    )



def with_s(body: str) -> str:
    return f"WITH s AS ({STANDIN})\n{body}"


def _features_base() -> str:
    cols = ", ".join(f"round({c}, 6) AS {c}" if c in ("StudyTimeWeekly", "GPA") else c for c in R.features)
    return with_s(f"SELECT row_key, {cols}, GradeClass FROM s")


# Fixed values (mirror of the Spark feature expressions), F1..F17.
ACT = "(CAST(Extracurricular AS DOUBLE) + CAST(Sports AS DOUBLE) + CAST(Music AS DOUBLE) + CAST(Volunteering AS DOUBLE))"
ENG = ("(CAST(StudyTimeWeekly AS DOUBLE) + 2.0 * CAST(Tutoring AS DOUBLE) + CAST(ParentalSupport AS DOUBLE) "
       "- 0.6 * CAST(Absences AS DOUBLE))")
SUPACT = f"(CAST(ParentalSupport AS DOUBLE) * ({ACT} + 1.0))"
D = lambda c: f"CAST({c} AS DOUBLE)"
FORMULAS_SQL = {
    "StudyTimePerAbsence": f"{D('StudyTimeWeekly')} / ({D('Absences')} + 1.0)",
    "SupportTutoringInteraction": f"{D('ParentalSupport')} * {D('Tutoring')}",
    "AcademicEngagementScore": ENG,
    "ActivityCount": ACT,
    "SupportActivityInteraction": SUPACT,
    "AbsenceRateLog": f"ln(1 + {D('Absences')})",
    "StudyTimeSquared": f"{D('StudyTimeWeekly')} * {D('StudyTimeWeekly')}",
    "AbsencesSquared": f"{D('Absences')} * {D('Absences')}",
    "TutoringPerSupport": f"{D('Tutoring')} / ({D('ParentalSupport')} + 1.0)",
    "StudySupportProduct": f"{D('StudyTimeWeekly')} * ({D('ParentalSupport')} + 1.0)",
    "ActivityWeightedSupport": f"{ACT} * ({D('ParentalSupport')} + 1.0)",
    "EngagementPerActivity": f"{ENG} / ({ACT} + 1.0)",
    "AbsencePressure": f"{D('Absences')} / ({D('StudyTimeWeekly')} + 1.0)",
    "SupportMinusAbsences": f"{D('ParentalSupport')} - 0.3 * {D('Absences')}",
    "TutoringAbsenceInteraction": f"{D('Tutoring')} * {D('Absences')}",
    "StudyActivityBalance": f"{D('StudyTimeWeekly')} / ({ACT} + 1.0)",
    "CommitmentComposite": f"0.5 * {ENG} + 0.3 * {SUPACT} - 0.2 * {D('Absences')}",
}


def _feature_set(name: str) -> str:
    from gradewise.functions.features import BASE_COLUMNS, FEATURE_SETS
    base = [c for c in BASE_COLUMNS if c != "StudyTimeWeekly"]
    der = ", ".join(f"round({FORMULAS_SQL[c]}, 6) AS {c}" for c in FEATURE_SETS[name])
    return with_s(f"SELECT row_key, {', '.join(base)}, round(StudyTimeWeekly, 6) AS StudyTimeWeekly, {der} FROM s")


RAW_KEY = ("concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), "
           "CAST(l_suppkey AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR))")
RAW_CTE = f"""
k AS (SELECT {RAW_KEY} AS row_key, * FROM lineitem),
b AS (SELECT *, CAST(('0x' || substr(md5(row_key), 1, 2)) AS INTEGER) % 8 AS bk FROM k),
raw AS (SELECT row_key, CASE WHEN bk = 0 THEN '' WHEN bk = 1 THEN NULL WHEN bk = 2 THEN 'n/a'
    WHEN bk = 3 THEN CAST(CAST(l_linenumber AS BIGINT) AS VARCHAR)
    WHEN bk = 4 THEN CAST(l_orderkey % 1000 AS VARCHAR) || '.' || CAST(l_partkey % 1000 AS VARCHAR) || '.' || CAST(l_suppkey % 100 AS VARCHAR)
    ELSE ' ' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || '.' || CAST(l_partkey % 97 AS VARCHAR) || ' ' END AS raw_text FROM b),
x AS (SELECT row_key, raw_text, trim(raw_text) AS t FROM raw),
rep AS (SELECT row_key, raw_text, t, CASE WHEN length(t) = 0 THEN NULL
    WHEN length(t) - length(replace(t, '.', '')) <= 1 THEN TRY_CAST(t AS DOUBLE)
    ELSE TRY_CAST(split_part(t, '.', 1) || '.' || replace(substr(t, instr(t, '.') + 1), '.', '') AS DOUBLE) END AS repaired FROM x)
"""


def _clean_repair() -> str:
    return (f"WITH {RAW_CTE}SELECT row_key, raw_text, repaired, "
            "CAST(CASE WHEN raw_text IS NOT NULL AND length(t) > 0 AND repaired IS NULL THEN 1 ELSE 0 END AS INTEGER) AS rejected FROM rep")


def _io_clean() -> str:
    return f"WITH {RAW_CTE}SELECT row_key, repaired AS StudyTimeWeekly FROM rep"


def _project_rename() -> str:
    from gradewise.plans.queries import DISPLAY_NAMES
    cols = ["row_key"] + [f'{c} AS "{DISPLAY_NAMES[c]}"' for c in R.features] + [f'GradeClass AS "{DISPLAY_NAMES["GradeClass"]}"']
    return f"WITH f AS ({_features_base()}) SELECT {', '.join(cols)} FROM f"


STANDIN_COLS = ["row_key", "Age", "Gender", "Ethnicity", "ParentalEducation", "StudyTimeWeekly", "Absences", "Tutoring",
                "ParentalSupport", "Extracurricular", "Sports", "Music", "Volunteering", "GPA", "GradeClass", "prediction"]


def _profile_nulls() -> str:
    parts = [f"SELECT '{c}' AS column_name, count(*) AS n_rows, CAST(count(*) - count({c}) AS BIGINT) AS n_null FROM s"
             for c in STANDIN_COLS]
    return with_s(" UNION ALL ".join(parts))


def _class_dist() -> str:
    return with_s("SELECT GradeClass, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s GROUP BY GradeClass")


def _long_cont() -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, GradeClass, CAST({c} AS DOUBLE) AS v FROM s" for c in CONT)


def _histogram() -> str:
    return with_s(f""", lg AS ({_long_cont()}),
mm AS (SELECT feature, min(v) AS lo, max(v) AS hi FROM lg GROUP BY feature),
bn AS (SELECT lg.feature, CAST(CASE WHEN hi <= lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 20), 19) END AS INTEGER) AS bin, lo, hi FROM lg JOIN mm USING (feature))
SELECT feature, bin, 20 AS n_bins, round(lo + bin * ((hi - lo) / 20), 6) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS bin_hi, count(*) AS n
FROM bn GROUP BY feature, bin, lo, hi""")


def _histogram_by_class() -> str:
    return with_s(f""", lg AS ({_long_cont()}),
st AS (SELECT feature, count(*) AS n, min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM lg GROUP BY feature),
w AS (SELECT *, (hi - lo) / (log2(n) + 1.0) AS sturges, 2.0 * (q3 - q1) * pow(n, -1.0 / 3.0) AS fd FROM st),
nb AS (SELECT feature, lo, hi, CAST(CASE WHEN hi <= lo THEN 1 ELSE greatest(1, ceil((hi - lo) / (CASE WHEN fd > 0 THEN least(fd, sturges) ELSE sturges END))) END AS INTEGER) AS nbins FROM w),
bn AS (SELECT lg.feature, GradeClass, CAST(CASE WHEN hi <= lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * nbins), nbins - 1) END AS INTEGER) AS bin, lo, hi, nbins FROM lg JOIN nb USING (feature))
SELECT feature, GradeClass, bin, nbins AS n_bins, round(lo + bin * ((hi - lo) / nbins), 6) AS bin_lo, round(lo + (bin + 1) * ((hi - lo) / nbins), 6) AS bin_hi, count(*) AS n
FROM bn GROUP BY feature, GradeClass, bin, lo, hi, nbins""")


def _kde() -> str:
    return with_s(f""", lg AS ({_long_cont()}),
st AS (SELECT feature, count(v) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) AS sd FROM lg GROUP BY feature),
st2 AS (SELECT *, sd * pow(CAST(n AS DOUBLE), -0.2) AS h FROM st),
st3 AS (SELECT *, CASE WHEN h > 0 THEN greatest(512, CAST(ceil(8 * (hi - lo) / h) AS BIGINT)) ELSE 512 END AS nb FROM st2),
st4 AS (SELECT *, (hi - lo) / nb AS w FROM st3),
bn AS (SELECT lg.feature, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * nb), nb - 1) ELSE 0 END AS BIGINT) AS bin FROM lg JOIN st3 USING (feature)),
hc AS (SELECT feature, bin, count(*) AS c FROM bn GROUP BY feature, bin),
hl AS (SELECT feature, list({{'bin': bin, 'c': c}} ORDER BY bin) AS hist FROM hc GROUP BY feature),
pts AS (SELECT st4.*, p AS point, lo - 3.0 * h + p * ((hi - lo + 2 * 3.0 * h) / 199) AS x FROM st4, range(0, 200) t(p))
SELECT pts.feature, CAST(point AS INTEGER) AS point, round(x, 6) AS x,
  round(list_reduce(list_prepend(0.0, list_transform(hist, lambda e: e.c * exp(-0.5 * pow((x - (lo + (e.bin + 0.5) * w)) / h, 2)))), lambda a, b: a + b)
        / (n * h * {__import__('math').sqrt(2 * __import__('math').pi)!r}), 6) AS density
FROM pts JOIN hl USING (feature)""")


def _box() -> str:
    return with_s(f""", lg AS ({_long_cont()}),
q AS (SELECT feature, GradeClass, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM lg GROUP BY feature, GradeClass),
q2 AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS fence_lo, q3 + 1.5 * (q3 - q1) AS fence_hi FROM q),
a AS (SELECT lg.feature, lg.GradeClass, min(CASE WHEN v >= fence_lo THEN v END) AS whisker_lo, max(CASE WHEN v <= fence_hi THEN v END) AS whisker_hi,
        CAST(count(CASE WHEN v < fence_lo OR v > fence_hi THEN 1 END) AS BIGINT) AS n_outliers, count(*) AS n
      FROM lg JOIN q2 USING (feature, GradeClass) GROUP BY lg.feature, lg.GradeClass)
SELECT feature, GradeClass, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(fence_lo, 6) AS fence_lo, round(fence_hi, 6) AS fence_hi, round(whisker_lo, 6) AS whisker_lo, round(whisker_hi, 6) AS whisker_hi, n_outliers, n
FROM q2 JOIN a USING (feature, GradeClass)""")


def _corr() -> str:
    cols = [*R.features, "GradeClass"]
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS corr FROM s")
    return with_s(" UNION ALL ".join(parts))


def _class_weights() -> str:
    return with_split(""", tc AS (SELECT GradeClass, count(*) AS n FROM sp WHERE split = 'train' GROUP BY GradeClass)
SELECT GradeClass, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM tc""")


def _smote_counts() -> str:
    return with_split(""", tc AS (SELECT GradeClass, count(*) AS n FROM sp WHERE split = 'train' GROUP BY GradeClass)
SELECT GradeClass, n AS n_before, max(n) OVER () - n AS n_synthetic, max(n) OVER () AS n_after FROM tc""")


def _scaled(cols: list[str], extra: str = "") -> str:
    """Standard scaling fitted on train, population std, divisor 1 if 0."""
    st = ", ".join(f"avg(CAST({c} AS DOUBLE)) AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) AS s_{c}" for c in cols)
    sel = ", ".join(
        f"round((CAST({c} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} IS NULL OR s_{c} = 0 THEN 1.0 ELSE s_{c} END), 6) AS {c}"
        for c in cols)
    return with_split(f""", st AS (SELECT {st} FROM sp WHERE split = 'train')
SELECT row_key, split, {sel} FROM sp CROSS JOIN st""")


def _onehot() -> str:
    sel = []
    for c in CATS:
        for lv in STANDIN_LEVELS[c]:
            sel.append(f"CAST(CASE WHEN {c} = {lv} THEN 1 ELSE 0 END AS INTEGER) AS {c}_{lv}")
    return with_split(f"SELECT row_key, split, {', '.join(sel)} FROM sp")


# Category levels of the stand-in (all present in train).
STANDIN_LEVELS = {
    "Gender": [0, 1], "Ethnicity": [0, 1, 2, 3], "ParentalEducation": [0, 1, 2, 3, 4], "Tutoring": [0, 1],
    "ParentalSupport": [0, 1, 2, 3, 4], "Extracurricular": [0, 1], "Sports": [0, 1], "Music": [0, 1],
    "Volunteering": [0, 1],
}


def _loo() -> str:
    sel, joins = [], []
    for c in CATS:
        sel.append(
            f"round(CASE WHEN sp.split = 'train' THEN (CASE WHEN t_{c}.N > 1 THEN (t_{c}.S - CAST(sp.GradeClass AS DOUBLE)) / (t_{c}.N - 1) ELSE g.gm END) "
            f"ELSE coalesce(t_{c}.S / t_{c}.N, g.gm) END, 6) AS {c}_loo")
        joins.append(f"LEFT JOIN tot_{c} t_{c} ON t_{c}.v = sp.{c}")
    return with_split(",\n" + _stats_ctes(CATS) + "\nSELECT sp.row_key, sp.split, " + ", ".join(sel)
                      + "\nFROM sp CROSS JOIN g\n" + "\n".join(joins))


def _frequency() -> str:
    sel, joins = [], []
    for c in CATS:
        sel.append(f"round(coalesce(t_{c}.N / g.n_train, 0.0), 6) AS {c}_freq")
        joins.append(f"LEFT JOIN tot_{c} t_{c} ON t_{c}.v = sp.{c}")
    return with_split(",\n" + _stats_ctes(CATS) + "\nSELECT sp.row_key, sp.split, " + ", ".join(sel)
                      + "\nFROM sp CROSS JOIN g\n" + "\n".join(joins))


def _binary() -> str:
    import math
    # bit width from the max code over all rows; the stand-in's codes are 0..4 at most
    sel = []
    for c in CATS:
        mx = max(STANDIN_LEVELS[c])
        bits = max(1, math.ceil(math.log2(mx + 1 if mx > 0 else 2)))
        for i in range(bits):
            sel.append(f"CAST(({c} >> {i}) & 1 AS INTEGER) AS {c}_bit{i}")
    return with_split(f"SELECT row_key, split, {', '.join(sel)} FROM sp")


def _hashing() -> str:
    sel = []
    for c in CATS:
        b = f"(CAST(('0x' || substr(md5('{c}=' || CAST({c} AS VARCHAR)), 1, 8)) AS BIGINT) % 4)"
        for i in range(4):
            sel.append(f"CAST(CASE WHEN {b} = {i} THEN 1 ELSE 0 END AS INTEGER) AS {c}_hash{i}")
    return with_split(f"SELECT row_key, split, {', '.join(sel)} FROM sp")


def _embedding_dims() -> str:
    parts = [f"SELECT '{c}' AS feature, CAST(max({c}) + 1 AS INTEGER) AS cardinality FROM s" for c in CATS]
    return with_s(f", c AS ({' UNION ALL '.join(parts)}) SELECT feature, cardinality, "
                  "CAST(least(8, greatest(2, floor((cardinality + 1) / 2))) AS INTEGER) AS dim FROM c")


CONF_CTE = """
, cells AS (SELECT GradeClass AS label, prediction, count(*) AS n FROM sp WHERE split = 'test' GROUP BY 1, 2),
labs AS (SELECT label AS l FROM cells UNION SELECT prediction FROM cells),
conf AS (SELECT a.l AS label, b.l AS prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n
         FROM labs a CROSS JOIN labs b LEFT JOIN cells c ON c.label = a.l AND c.prediction = b.l),
pc0 AS (SELECT s1.label, s1.support, p1.predicted, s1.tp,
          CASE WHEN p1.predicted > 0 THEN s1.tp / p1.predicted ELSE 0.0 END AS precision,
          CASE WHEN s1.support > 0 THEN s1.tp / s1.support ELSE 0.0 END AS recall
        FROM (SELECT label, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS BIGINT) AS tp FROM conf GROUP BY label) s1
        JOIN (SELECT prediction AS label, CAST(sum(n) AS BIGINT) AS predicted FROM conf GROUP BY prediction) p1 USING (label)),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc0)
"""


def with_conf(body: str) -> str:
    return with_split(CONF_CTE + body)


def _norm(how: str) -> str:
    part = {"true": "PARTITION BY label", "pred": "PARTITION BY prediction", "all": ""}[how]
    return with_conf(f"""SELECT label, prediction, n,
  round(CASE WHEN sum(n) OVER ({part}) > 0 THEN n / sum(n) OVER ({part}) ELSE 0.0 END, 6) AS share FROM conf""")


def _annotated() -> str:
    return with_conf(""", t AS (SELECT *, sum(n) OVER (PARTITION BY label) AS tot FROM conf),
q AS (SELECT *, CASE WHEN tot > 0 THEN CAST(floor((n * 200 + tot) / (tot * 2)) AS BIGINT) ELSE 0 END AS qq FROM t)
SELECT label, prediction, n, CAST(qq // 100 AS VARCHAR) || '.' || lpad(CAST(qq % 100 AS VARCHAR), 2, '0') || chr(10) || '(' || CAST(n AS VARCHAR) || ')' AS annotation FROM q""")


def _errors() -> str:
    return with_conf("""SELECT label, prediction, n,
  round(CASE WHEN sum(n) OVER (PARTITION BY label) > 0 THEN n / sum(n) OVER (PARTITION BY label) ELSE 0.0 END, 6) AS share
FROM conf QUALIFY label <> prediction""")


def _rule_pred(mult: str, cuts) -> str:
    amt = f"GPA * 26250.0 * {float(mult)!r}"
    return ("CAST(CASE " + " ".join(f"WHEN {amt} >= {float(c)!r} THEN {i}" for i, c in enumerate(cuts))
            + f" ELSE {len(cuts)} END AS INTEGER)")


def _compare() -> str:
    from gradewise.operators.rules import BASE_CUTS
    net = _rule_pred("0.96", BASE_CUTS)
    return with_split(f""", sc AS (SELECT 'rule_gross' AS model, GradeClass AS label, prediction FROM sp WHERE split = 'test'
  UNION ALL SELECT 'rule_net_096', GradeClass, {net} FROM sp WHERE split = 'test'),
cells AS (SELECT model, label, prediction, count(*) AS n FROM sc GROUP BY ALL),
labs AS (SELECT model, label AS l FROM cells UNION SELECT model, prediction FROM cells),
conf AS (SELECT a.model, a.l AS label, b.l AS prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n
   FROM labs a JOIN labs b ON a.model = b.model LEFT JOIN cells c ON c.model = a.model AND c.label = a.l AND c.prediction = b.l)
SELECT label, prediction, CAST(sum(CASE WHEN model = 'rule_gross' THEN n END) AS BIGINT) AS n_rule_gross,
  CAST(sum(CASE WHEN model = 'rule_net_096' THEN n END) AS BIGINT) AS n_rule_net_096 FROM conf GROUP BY label, prediction""")


def _pivot() -> str:
    cols = ", ".join(f"CAST(sum(CASE WHEN prediction = {v} THEN n ELSE 0 END) AS BIGINT) AS p{v}" for v in range(5))
    return with_conf(f"SELECT label, {cols} FROM conf GROUP BY label")


def _per_class() -> str:
    return with_conf("SELECT label, support, predicted, tp, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pc")


def _macro() -> str:
    return with_conf("""SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
  round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS f1_macro FROM pc""")


def _report() -> str:
    return with_conf(""", tot AS (SELECT sum(tp) / sum(support) AS acc, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
   sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf,
   CAST(sum(support) AS DOUBLE) AS n FROM pc)
SELECT CAST(label AS VARCHAR) AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1_score, round(CAST(support AS DOUBLE), 6) AS support FROM pc
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), round(acc, 6) FROM tot
UNION ALL SELECT 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), round(n, 6) FROM tot
UNION ALL SELECT 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), round(n, 6) FROM tot""")


def _macro_by(scored_cte: str, digits: int, extra_cols: str = "") -> str:
    """Macro metrics per model id from a CTE ``sc(model, label, prediction)``."""
    return f"""{scored_cte},
cells AS (SELECT model, label, prediction, count(*) AS n FROM sc GROUP BY ALL),
labs AS (SELECT model, label AS l FROM cells UNION SELECT model, prediction FROM cells),
conf AS (SELECT a.model, a.l AS label, b.l AS prediction, CAST(coalesce(c.n, 0) AS BIGINT) AS n
   FROM labs a JOIN labs b ON a.model = b.model LEFT JOIN cells c ON c.model = a.model AND c.label = a.l AND c.prediction = b.l),
pc0 AS (SELECT s1.model, s1.label, s1.support, s1.tp, p1.predicted,
   CASE WHEN p1.predicted > 0 THEN s1.tp / p1.predicted ELSE 0.0 END AS precision,
   CASE WHEN s1.support > 0 THEN s1.tp / s1.support ELSE 0.0 END AS recall
   FROM (SELECT model, label, CAST(sum(n) AS BIGINT) AS support, CAST(sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS BIGINT) AS tp FROM conf GROUP BY model, label) s1
   JOIN (SELECT model, prediction AS label, CAST(sum(n) AS BIGINT) AS predicted FROM conf GROUP BY model, prediction) p1 USING (model, label)),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pc0),
m AS (SELECT model, sum(tp) / sum(support) AS accuracy, avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro
      {extra_cols} FROM pc GROUP BY model)"""


def _comparison_cte() -> str:
    from gradewise.operators.rules import BASE_CUTS
    net = _rule_pred("0.96", BASE_CUTS)
    sc = f""", maj AS (SELECT GradeClass AS c FROM sp WHERE split = 'train' GROUP BY GradeClass ORDER BY count(*) DESC, GradeClass LIMIT 1),
sc AS (SELECT 'rule_gross' AS model, GradeClass AS label, prediction FROM sp WHERE split = 'test'
  UNION ALL SELECT 'rule_net_096', GradeClass, {net} FROM sp WHERE split = 'test'
  UNION ALL SELECT 'majority', GradeClass, CAST((SELECT c FROM maj) AS INTEGER) FROM sp WHERE split = 'test')"""
    return _macro_by(sc, 4)


def _model_comparison() -> str:
    return with_split(_comparison_cte() + """
SELECT model, round(accuracy, 4) AS accuracy, round(precision_macro, 4) AS precision_macro, round(recall_macro, 4) AS recall_macro,
  round(f1_macro, 4) AS f1_macro FROM m ORDER BY f1_macro DESC, accuracy DESC, model""")


def _reshape_long() -> str:
    from gradewise.plans.queries import METRIC_LABELS
    parts = [f"SELECT model, '{lab}' AS metrica, round({k}, 4) AS valor FROM m" for k, lab in METRIC_LABELS.items()]
    return with_split(_comparison_cte() + "\n" + " UNION ALL ".join(parts))


def _grid_cte() -> str:
    from gradewise.operators.rules import rule_configs
    cfgs = rule_configs()
    sc = ", sc AS (" + " UNION ALL ".join(
        f"SELECT {c['grid_index']} AS model, GradeClass AS label, {_rule_pred(c['discount_guess'], c['cuts'])} AS prediction FROM sp WHERE split = 'val'"
        for c in cfgs) + ")"
    names = ", gn AS (SELECT * FROM (VALUES " + ", ".join(f"({c['grid_index']}, '{c['config']}')" for c in cfgs) + ") t(grid_index, config))"
    body = _macro_by(sc, 4)
    return body + names + """,
ls AS (SELECT model, sum(abs(label - prediction) * n) / sum(n) AS loss FROM conf GROUP BY model),
gm AS (SELECT CAST(m.model AS INTEGER) AS grid_index, gn.config, accuracy, precision_macro, recall_macro, f1_macro, loss
       FROM m JOIN ls USING (model) JOIN gn ON gn.grid_index = m.model)"""


def _topk() -> str:
    return with_split(_grid_cte() + """
SELECT grid_index, config, round(accuracy, 4) AS val_accuracy, round(precision_macro, 4) AS val_precision_macro,
  round(recall_macro, 4) AS val_recall_macro, round(f1_macro, 4) AS val_f1_macro, round(loss, 4) AS val_loss
FROM gm ORDER BY round(f1_macro, 4) DESC, round(accuracy, 4) DESC, grid_index LIMIT 10""")


def _best() -> str:
    return with_split(_grid_cte() + """
SELECT grid_index, config, round(f1_macro, 4) AS val_f1_macro, round(loss, 6) AS val_loss
FROM gm ORDER BY round(f1_macro, 5) DESC, loss, grid_index LIMIT 1""")


def _auc() -> str:
    def one(name, pos, neg):
        return f"""SELECT '{name}' AS comparison, CAST(sum(CAST(pos AS DECIMAL(38,0)) * CAST(2 * (cn - neg) + neg AS DECIMAL(38,0))) AS DOUBLE)
   / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS auc, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT *, sum(neg) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cn FROM
  (SELECT CAST(GPA AS DOUBLE) AS s, count(CASE WHEN {pos} THEN 1 END) AS pos, count(CASE WHEN {neg} THEN 1 END) AS neg
   FROM sp WHERE split = 'test' AND ({pos} OR {neg}) GROUP BY 1))"""
    return with_split(f", a AS ({one('0_vs_1', 'GradeClass = 0', 'GradeClass = 1')} UNION ALL {one('0_vs_rest', 'GradeClass = 0', 'GradeClass <> 0')})"
                      " SELECT comparison, round(auc, 6) AS auc, n_pos, n_neg FROM a")


def _ks() -> str:
    from gradewise.functions.features import BASE_COLUMNS, FEATURE_SETS
    feats = BASE_COLUMNS + FEATURE_SETS["v1"]
    expr = {c: f"CAST({c} AS DOUBLE)" for c in BASE_COLUMNS}
    expr.update({c: FORMULAS_SQL[c] for c in FEATURE_SETS["v1"]})
    lg = " UNION ALL ".join(f"SELECT '{f}' AS feature, GradeClass AS y, {expr[f]} AS value FROM s WHERE GradeClass IN (0, 1, 4)" for f in feats)
    def pv(d, a, b):
        ne = f"(CAST({a} AS DOUBLE) * CAST({b} AS DOUBLE) / (CAST({a} AS DOUBLE) + CAST({b} AS DOUBLE)))"
        lam = f"((sqrt({ne}) + 0.12 + 0.11 / sqrt({ne})) * {d})"
        series = (f"list_reduce(list_prepend(0.0, list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) "
                  f"* exp(-2.0 * j * j * {lam} * {lam}))), lambda x, z: x + z)")
        return f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(greatest(2.0 * {series}, 0.0), 1.0) END"
    return with_s(f""", lg AS ({lg}),
c AS (SELECT feature, value, count(CASE WHEN y = 0 THEN 1 END) AS c0, count(CASE WHEN y = 1 THEN 1 END) AS c1, count(CASE WHEN y = 4 THEN 1 END) AS c4 FROM lg GROUP BY feature, value),
cu AS (SELECT *, sum(c0) OVER w AS k0, sum(c1) OVER w AS k1, sum(c4) OVER w AS k4,
  sum(c0) OVER (PARTITION BY feature) AS n0, sum(c1) OVER (PARTITION BY feature) AS n1, sum(c4) OVER (PARTITION BY feature) AS n4
  FROM c WINDOW w AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT feature, max(abs(k0 / n0 - k1 / n1)) AS d01, max(abs(k0 / n0 - k4 / n4)) AS d04, any_value(n0) AS n0, any_value(n1) AS n1, any_value(n4) AS n4 FROM cu GROUP BY feature)
SELECT feature, round(d01, 6) AS ks_0vs1, round({pv('d01', 'n0', 'n1')}, 6) AS p_0vs1, round(d04, 6) AS ks_0vs4, round({pv('d04', 'n0', 'n4')}, 6) AS p_0vs4 FROM d""")


def _softmax_sql() -> str:
    from gradewise.operators.rules import CLASS_CENTRES, SOFTMAX_SCALE
    sc = [f"exp(-pow((GPA * 26250.0 - {c!r}) / {SOFTMAX_SCALE!r}, 2))" for c in CLASS_CENTRES]
    tot = " + ".join(sc)
    return "[" + ", ".join(f"{x} / ({tot})" for x in sc) + "]"


def _argmax(arr: str) -> str:
    return f"CAST(list_position({arr}, list_max({arr})) - 1 AS INTEGER)"


def _thresholds() -> str:
    sh = ", ".join(f"coalesce(max(CASE WHEN GradeClass = {c} THEN n END) / sum(n), 1.0) AS t{c}" for c in range(5))
    adj = "[" + ", ".join(f"p[{i + 1}] / t{i}" for i in range(5)) + "]"
    return with_split(f""", tc AS (SELECT GradeClass, count(*) AS n FROM sp WHERE split = 'train' GROUP BY GradeClass),
th AS (SELECT {sh} FROM tc),
pp AS (SELECT row_key, GradeClass, {_softmax_sql()} AS p FROM sp WHERE split = 'test')
SELECT row_key, GradeClass, {_argmax('p')} AS pred_argmax, {_argmax(adj)} AS pred_thresholded FROM pp CROSS JOIN th""")


def _ordinal() -> str:
    from gradewise.operators.rules import BASE_CUTS, SIGMOID_SCALE
    gt = [f"(1.0 / (1.0 + exp(-({float(c)!r} - GPA * 26250.0) / {SIGMOID_SCALE!r})))" for c in BASE_CUTS]
    probs = [f"1.0 - {gt[0]}"] + [f"greatest({gt[j - 1]} - {gt[j]}, 0.0)" for j in range(1, 4)] + [gt[3]]
    arr = "[" + ", ".join(probs) + "]"
    return with_split(f"SELECT row_key, GradeClass, {_argmax(arr)} AS pred_ordinal FROM sp WHERE split = 'test'")


def _two_stage() -> str:
    return with_split(f""", pp AS (SELECT row_key, GradeClass, {_softmax_sql()} AS p FROM sp WHERE split = 'test')
SELECT row_key, GradeClass, CAST(CASE WHEN p[5] >= 0.5 THEN 4 ELSE {_argmax('p[1:4]')} END AS INTEGER) AS pred_two_stage FROM pp""")


def _schema() -> str:
    cols = ["row_key", *R.features, R.label, "prediction"]
    rows = " UNION ALL ".join(
        f"SELECT {i} AS position, '{c}' AS column_name, any_value(typeof({c})) AS t, count({c}) AS non_null FROM s" for i, c in enumerate(cols))
    return f"""WITH s AS ({STANDIN}), u AS ({rows})
SELECT position, column_name, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'INTEGER' THEN 'int' ELSE lower(t) END AS data_type, non_null FROM u"""


def _knn() -> str:
    return """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS r,
         count(*) OVER (PARTITION BY label) AS n FROM e),
sp AS (SELECT *, CASE WHEN r < (n * 700 + 500) // 1000 THEN 'train' ELSE 'other' END AS split FROM rk),
d AS (SELECT q.vec_id AS qid, q.label AS qlabel, t.vec_id AS tid, t.label AS tlabel,
        list_sum(list_transform(list_zip(q.v, t.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d2
      FROM sp q JOIN sp t ON q.split <> 'train' AND t.split = 'train'),
nn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, tid) AS rn FROM d),
votes AS (SELECT qid, qlabel, tlabel, count(*) AS c FROM nn WHERE rn <= 7 GROUP BY ALL),
best AS (SELECT qid, qlabel, tlabel, row_number() OVER (PARTITION BY qid ORDER BY c DESC, tlabel) AS r2 FROM votes)
SELECT qid AS vec_id, qlabel AS label, CAST(tlabel AS INTEGER) AS prediction FROM best WHERE r2 = 1"""


def _class_weights_labels() -> str:
    return """WITH l AS (SELECT 'quality' AS target, quality AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels),
c AS (SELECT target, value, count(*) AS n FROM l GROUP BY target, value)
SELECT target, value, n, round(sum(n) OVER (PARTITION BY target) / (count(*) OVER (PARTITION BY target) * n), 6) AS weight FROM c"""


def _smote_counts_labels() -> str:
    return """WITH l AS (SELECT 'quality' AS target, quality AS value FROM labels UNION ALL SELECT 'toxic', toxic FROM labels),
c AS (SELECT target, value, count(*) AS n FROM l GROUP BY target, value)
SELECT target, value, n AS n_before, max(n) OVER (PARTITION BY target) - n AS n_synthetic,
  max(n) OVER (PARTITION BY target) AS n_after FROM c"""


def _histogram_events() -> str:
    return """WITH mm AS (SELECT min(CAST(value AS DOUBLE)) AS lo, max(CAST(value AS DOUBLE)) AS hi FROM events),
bn AS (SELECT event_type, CAST(CASE WHEN hi <= lo THEN 0 ELSE least(floor((CAST(value AS DOUBLE) - lo) / (hi - lo) * 20), 19) END AS INTEGER) AS bin, lo, hi
       FROM events CROSS JOIN mm)
SELECT 'value' AS feature, event_type, bin, 20 AS n_bins, round(lo + bin * ((hi - lo) / 20), 6) AS bin_lo,
  round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS bin_hi, count(*) AS n FROM bn GROUP BY event_type, bin, lo, hi"""


def _ks_events() -> str:
    from gradewise.plans.queries import EVENT_PAIRS
    types = sorted({t for p in EVENT_PAIRS for t in p})
    cnt = ", ".join(f"count(CASE WHEN event_type = '{t}' THEN 1 END) AS c_{t}" for t in types)
    cums = ", ".join(f"sum(c_{t}) OVER w AS k_{t}, sum(c_{t}) OVER () AS n_{t}" for t in types)

    def pv(d, a, b):
        ne = f"(CAST(n_{a} AS DOUBLE) * CAST(n_{b} AS DOUBLE) / (CAST(n_{a} AS DOUBLE) + CAST(n_{b} AS DOUBLE)))"
        lam = f"((sqrt({ne}) + 0.12 + 0.11 / sqrt({ne})) * {d})"
        series = (f"list_reduce(list_prepend(0.0, list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) "
                  f"* exp(-2.0 * j * j * {lam} * {lam}))), lambda x, z: x + z)")
        return f"CASE WHEN {lam} < 0.2 THEN 1.0 ELSE least(greatest(2.0 * {series}, 0.0), 1.0) END"
    ds = ", ".join(f"max(abs(k_{a} / n_{a} - k_{b} / n_{b})) AS d_{a}_{b}" for a, b in EVENT_PAIRS)
    ns = ", ".join(f"any_value(n_{t}) AS n_{t}" for t in types)
    sel = ", ".join(f"round(d_{a}_{b}, 6) AS ks_{a}vs{b}, round({pv(f'd_{a}_{b}', a, b)}, 6) AS p_{a}vs{b}" for a, b in EVENT_PAIRS)
    return f"""WITH c AS (SELECT CAST(value AS DOUBLE) AS value, {cnt} FROM events WHERE event_type IN ({', '.join(repr(t) for t in types)}) GROUP BY 1),
cu AS (SELECT *, {cums} FROM c WINDOW w AS (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
d AS (SELECT {ds}, {ns} FROM cu)
SELECT 'value' AS feature, {sel} FROM d"""


def oracle_sql() -> dict[str, str]:
    return {
        "features_base": _features_base(),
        "io_csv_roundtrip": _features_base(),
        "io_clean_table": _io_clean(),
        "clean_repair_decimal": _clean_repair(),
        "project_rename": _project_rename(),
        "features_v1": _feature_set("v1"),
        "features_v4": _feature_set("v4"),
        "features_v2_ext": _feature_set("v2_ext"),
        "profile_nulls": _profile_nulls(),
        "profile_class_dist": _class_dist(),
        "profile_histogram": _histogram(),
        "profile_histogram_by_class": _histogram_by_class(),
        "profile_kde": _kde(),
        "profile_box_by_class": _box(),
        "profile_corr": _corr(),
        "split_stratified": _split_stratified(),
        "split_summary": _split_summary(),
        "class_weights": _class_weights(),
        "smote_counts": _smote_counts(),
        "scale_standard": _scaled(CONT),
        "encode_label": _scaled(CONT + CATS),
        "encode_ordinal": _scaled(CONT + CATS),
        "encode_onehot": _onehot(),
        "encode_target_oof": _encode_target_oof(),
        "encode_loo": _loo(),
        "encode_frequency": _frequency(),
        "encode_binary": _binary(),
        "encode_hashing": _hashing(),
        "embedding_dims": _embedding_dims(),
        "confusion_counts": with_conf("SELECT label, prediction, n FROM conf"),
        "confusion_norm_true": _norm("true"),
        "confusion_norm_pred": _norm("pred"),
        "confusion_norm_all": _norm("all"),
        "confusion_annotated": _annotated(),
        "confusion_errors": _errors(),
        "confusion_compare": _compare(),
        "confusion_pivot": _pivot(),
        "per_class_pr": _per_class(),
        "metrics_macro": _macro(),
        "classification_report": _report(),
        "model_comparison": _model_comparison(),
        "reshape_metrics_long": _reshape_long(),
        "topk_configs": _topk(),
        "best_config": _best(),
        "auc_binary": _auc(),
        "ks_two_sample": _ks(),
        "predict_thresholds": _thresholds(),
        "predict_ordinal": _ordinal(),
        "predict_two_stage": _two_stage(),
        "profile_schema": _schema(),
        "knn_classify": _knn(),
        "class_weights_labels": _class_weights_labels(),
        "smote_counts_labels": _smote_counts_labels(),
        "profile_histogram_events": _histogram_events(),
        "ks_events": _ks_events(),
    }
