"""The student-table stand-in built from the driver's star schema.

The reference's dataset is not shipped, so the flat entity table is derived
from lineitem joined with orders, customer, part and supplier.  Column names
and roles follow the reference; ``prediction`` is a deterministic rule with
genuine errors so evaluation queries can be checked without a trained model.

Joins are plain equi-joins: the planner broadcasts dimension tables whose
file size is under ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
otherwise; at 100 TB every side is shuffled, so orders meets customer
before lineitem to save one lineitem-sized shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.sources.tables import spread, table

# Net-price class cut points (class 0 is best) and the price
# divisor that turns l_extendedprice into a GPA-like leak column.
CLASS_CUTS = (95000, 82000, 68000, 51000)
GPA_DIVISOR = 26250.0


def grade_from(amount: Column) -> Column:
    expr = F.lit(len(CLASS_CUTS))
    for cls in reversed(range(len(CLASS_CUTS))):
        expr = F.when(amount >= CLASS_CUTS[cls], F.lit(cls)).otherwise(expr)
    return expr.cast("int")


def row_key_expr() -> Column:
    return F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.col("l_shipdate").cast("date").cast("string"),
    )


def student_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate",
    ), "l_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # orders joins customer first (an orders-sized shuffle on custkey), so the
    # lineitem-sized side is shuffled only on the keys it must be: orderkey,
    # partkey, suppkey (dimension sides under the broadcast threshold are
    # broadcast by the planner instead)
    oc = orders.join(cust, F.col("c_custkey") == F.col("o_custkey"))
    joined = (
        li.join(oc, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(part, F.col("p_partkey") == F.col("l_partkey"))
        .join(supp, F.col("s_suppkey") == F.col("l_suppkey"))
    )
    price = F.col("l_extendedprice")
    return joined.select(
        row_key_expr().alias("row_key"),
        (15 + F.col("p_size") % 4).cast("int").alias("Age"),
        (F.col("l_orderkey") % 2).cast("int").alias("Gender"),
        (F.col("c_nationkey") % 4).cast("int").alias("Ethnicity"),
        (F.col("s_nationkey") % 5).cast("int").alias("ParentalEducation"),
        (F.col("l_quantity") * 0.4).alias("StudyTimeWeekly"),
        (F.col("p_size") % 30).cast("int").alias("Absences"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).cast("int").alias("Tutoring"),
        (F.substring("o_orderpriority", 1, 1).cast("int") - 1).cast("int").alias("ParentalSupport"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).cast("int").alias("Extracurricular"),
        (F.col("l_partkey") % 2).cast("int").alias("Sports"),
        (F.col("l_suppkey") % 2).cast("int").alias("Music"),
        (F.col("o_custkey") % 2).cast("int").alias("Volunteering"),
        (price / GPA_DIVISOR).alias("GPA"),
        grade_from(price * (1 - F.col("l_discount"))).alias("GradeClass"),
        grade_from(price).alias("prediction"),
    )
