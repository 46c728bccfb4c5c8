"""Queries of group G: what users ask of reports, over the business tables. Money is summed as decimals, so any order of the rows gives the same cents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .tables import table


def _lines(spark, sf):
    """Line items with their revenue."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_quantity", "l_shipdate")
    return li.withColumn("revenue", F.expr("CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))"))


def _by_nation_year(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("year"))
    cust = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    per_order = _lines(spark, sf).groupBy("l_orderkey").agg(F.sum("revenue").alias("revenue"))
    joined = per_order.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(cust, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", "n_regionkey", "year").agg(F.round(F.sum("revenue"), 2).cast("double").alias("revenue"))


_BASE = """ny AS (SELECT n_name, n_regionkey, year(o_orderdate)::INT AS year, round(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))), 2)::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""


def measure_point(spark, sf):
    return _by_nation_year(spark, sf).where("year = 1996").select("n_name", F.round("revenue", 2).alias("revenue"))


def period_over_period(spark, sf):
    w = Window.partitionBy("n_name").orderBy("year")
    rows = _by_nation_year(spark, sf).withColumn("before", F.lag("revenue").over(w))
    return rows.select("n_name", "year", F.round("revenue", 2).alias("revenue"), F.round("before", 2).alias("before"), F.round(F.col("revenue") / F.col("before") - 1, 6).alias("growth"))


def region_breakdown_total(spark, sf):
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    rows = _by_nation_year(spark, sf).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.grouping("r_name").cast("int").alias("is_total"))


def table_total(spark, sf):
    return _lines(spark, sf).agg(F.round(F.sum("revenue"), 2).cast("double").alias("total"), F.count("*").alias("n"))


def ratio_of_measures(spark, sf):
    return _lines(spark, sf).groupBy(F.year("l_shipdate").alias("year")).agg(F.round(F.sum("revenue").cast("double") / F.sum("l_quantity"), 6).alias("price"))


def two_scopes(spark, sf):
    lines = _lines(spark, sf).groupBy("l_orderkey").agg(F.sum("revenue").alias("line_total"))
    both = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return both.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("order_total"), F.round(F.sum("line_total"), 2).cast("double").alias("line_total"))


def extremum_ratio(spark, sf):
    per = _by_nation_year(spark, sf).groupBy("n_name").agg(F.round(F.sum("revenue"), 2).alias("revenue"))
    return per.agg(
        F.max_by("n_name", "revenue").alias("highest"), F.min_by("n_name", "revenue").alias("lowest"), F.max("revenue").alias("most"), F.min("revenue").alias("least"),
        F.round(F.max("revenue") / F.min("revenue"), 6).alias("ratio"),
    )


def growth_sign(spark, sf):
    rows = _by_nation_year(spark, sf).where("year IN (1996, 1997)").groupBy("n_name").agg(
        F.sum(F.when(F.col("year") == 1996, F.col("revenue"))).alias("a"), F.sum(F.when(F.col("year") == 1997, F.col("revenue"))).alias("b")
    )
    return rows.agg(F.count_if(F.col("b") > F.col("a")).alias("up"), F.count_if(F.col("b") < F.col("a")).alias("down"), F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("unknown"))


def refusal_when_absent(spark, sf):
    asked = spark.createDataFrame([("FRANCE", 1996), ("ATLANTIS", 1996), ("NATION_1", 1996), ("CHINA", 2030)], "n_name string, year int")
    found = asked.join(_by_nation_year(spark, sf).select("n_name", "year", F.round("revenue", 2).alias("revenue")), ["n_name", "year"], "left")
    return found.select("n_name", "year", "revenue", F.col("revenue").isNull().alias("refused"))


QUERIES = {f.__name__: f for f in (
    measure_point, period_over_period, region_breakdown_total, table_total, ratio_of_measures, two_scopes, extremum_ratio, growth_sign, refusal_when_absent,
)}
ORACLES = {
    "measure_point": f"WITH {_BASE} SELECT n_name, round(revenue, 2) AS revenue FROM ny WHERE year = 1996",
    "period_over_period": f"WITH {_BASE}, l AS (SELECT *, lag(revenue) OVER (PARTITION BY n_name ORDER BY year) AS before FROM ny) SELECT n_name, year, round(revenue, 2) AS revenue, round(before, 2) AS before, round(revenue / before - 1, 6) AS growth FROM l",
    "region_breakdown_total": f"WITH {_BASE} SELECT r_name, round(sum(revenue), 2) AS revenue, grouping(r_name)::INT AS is_total FROM ny JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name)",
    "table_total": "SELECT round(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))), 2)::DOUBLE AS total, count(*) AS n FROM lineitem",
    "ratio_of_measures": "SELECT year(l_shipdate)::INT AS year, round(sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(5,2))))::DOUBLE / sum(l_quantity), 6) AS price FROM lineitem GROUP BY 1",
    "two_scopes": """WITH l AS (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(5,2)))) AS t FROM lineitem GROUP BY 1)
SELECT o_orderpriority, round(sum(o_totalprice), 2) AS order_total, round(sum(t), 2)::DOUBLE AS line_total FROM orders LEFT JOIN l ON o_orderkey = l_orderkey GROUP BY 1""",
    "extremum_ratio": f"WITH {_BASE}, p AS (SELECT n_name, round(sum(revenue), 2) AS revenue FROM ny GROUP BY 1) SELECT arg_max(n_name, revenue) AS highest, arg_min(n_name, revenue) AS lowest, max(revenue) AS most, min(revenue) AS least, round(max(revenue) / min(revenue), 6) AS ratio FROM p",
    "growth_sign": f"""WITH {_BASE}, g AS (SELECT n_name, sum(revenue) FILTER (year = 1996) AS a, sum(revenue) FILTER (year = 1997) AS b FROM ny WHERE year IN (1996, 1997) GROUP BY 1)
SELECT count(*) FILTER (b > a) AS up, count(*) FILTER (b < a) AS down, count(*) FILTER (a IS NULL OR b IS NULL) AS unknown FROM g""",
    "refusal_when_absent": f"""WITH {_BASE}, q(n_name, year) AS (VALUES ('FRANCE', 1996), ('ATLANTIS', 1996), ('NATION_1', 1996), ('CHINA', 2030))
SELECT q.n_name, q.year, round(revenue, 2) AS revenue, revenue IS NULL AS refused FROM q LEFT JOIN ny ON ny.n_name = q.n_name AND ny.year = q.year""",
}
