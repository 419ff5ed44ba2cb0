"""Relational queries over the star schema: joins, grouping sets, windows, set operations, top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textlake.operators.corpus import ranked
from textlake.sources.tables import table

R6 = 6


def pricing_summary(spark, sf):
    """Aggregation with a filter that reaches the scan."""
    price, off = F.col("l_extendedprice"), F.col("l_discount")
    rows = table(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - off)), 2).alias("sum_disc"),
        F.round(F.avg("l_quantity"), R6).alias("avg_qty"), F.round(F.avg(off), R6).alias("avg_disc"), F.count("*").alias("n"),
    )


PRICING = """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""


def revenue_by_nation(spark, sf):
    """Five-way join; dimensions are small enough for Spark to broadcast by itself."""
    li, o, c = (table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return rows.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


REVENUE = """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"""


def customers_without_orders(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


WITHOUT = "SELECT c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1"


def customers_with_urgent_orders(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("n"))


URGENT = "SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1"


def order_counts_full_join(spark, sf):
    """Suppliers and customers by nation, either side may be missing."""
    s = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full_outer").select("nation", F.coalesce("suppliers", F.lit(0)).alias("suppliers"), F.coalesce("customers", F.lit(0)).alias("customers"))


FULL_JOIN = """SELECT nation, coalesce(suppliers, 0) AS suppliers, coalesce(customers, 0) AS customers FROM (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier GROUP BY 1)
FULL JOIN (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) USING (nation)"""


def sales_rollup(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.rollup("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


ROLLUP = "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::INT AS level, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)"


def orders_cube(spark, sf):
    o = table(spark, sf, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("int").alias("level"), F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("price"))


CUBE = "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus, o_orderpriority)::INT AS level, count(*) AS n, round(avg(o_totalprice), 4) AS price FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"


def top_orders_per_customer(spark, sf):
    """The three largest orders of each customer: each task keeps three before the shuffle."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf, "orders").withColumn("place", place).where("place <= 3").select("o_custkey", "place", "o_orderkey", F.round("o_totalprice", 2).alias("price"))


TOP_ORDERS = """SELECT o_custkey, place, o_orderkey, round(o_totalprice, 2) AS price FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3"""


def order_running_totals(spark, sf):
    over = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey",
        F.round(F.sum("o_totalprice").over(over.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"),
        F.round(F.avg("o_totalprice").over(over.rowsBetween(-2, 0)), 4).alias("moving"),
        F.lag("o_orderkey").over(over).alias("previous"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderstatus")).alias("status_rank"),
    )


RUNNING = """SELECT o_orderkey, o_custkey, round(sum(o_totalprice) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS running, round(avg(o_totalprice) OVER (w ROWS 2 PRECEDING), 4) AS moving,
lag(o_orderkey) OVER w AS previous, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS status_rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""


def nation_sets(spark, sf):
    """Union, intersection and difference of the nations of rich customers and of suppliers."""
    c = table(spark, sf, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nation"))
    tag = lambda df, name: df.select(F.lit(name).alias("set"), "nation")
    return tag(c.union(s).distinct(), "union").union(tag(c.intersect(s), "both")).union(tag(c.subtract(s), "customers only")).union(tag(s.subtract(c), "suppliers only"))


SETS = """WITH c AS (SELECT c_nationkey AS nation FROM customer WHERE c_acctbal > 9900), s AS (SELECT s_nationkey AS nation FROM supplier WHERE s_acctbal > 5000)
SELECT 'union' AS set, nation FROM (SELECT * FROM c UNION SELECT * FROM s) UNION ALL SELECT 'both', nation FROM (SELECT * FROM c INTERSECT SELECT * FROM s)
UNION ALL SELECT 'customers only', nation FROM (SELECT * FROM c EXCEPT SELECT * FROM s) UNION ALL SELECT 'suppliers only', nation FROM (SELECT * FROM s EXCEPT SELECT * FROM c)"""


def part_price_stats(spark, sf):
    price = F.col("p_retailprice")
    rows = table(spark, sf, "part").groupBy("p_brand")
    return rows.agg(F.countDistinct("p_type").alias("types"), F.round(F.percentile(price, 0.5), 4).alias("median"), F.round(F.stddev_samp(price), 4).alias("deviation"),
                    F.sum(F.when(F.col("p_size") <= 5, 1).otherwise(0)).alias("small"), F.sum(F.when((F.col("p_size") > 5) & (F.col("p_size") <= 10), 1).otherwise(0)).alias("middle"),
                    F.sum(F.when(F.col("p_size") > 10, 1).otherwise(0)).alias("large"))


PARTS = """SELECT p_brand, count(DISTINCT p_type) AS types, round(quantile_cont(p_retailprice, 0.5), 4) AS median, round(stddev_samp(p_retailprice), 4) AS deviation,
count(*) FILTER (p_size <= 5) AS small, count(*) FILTER (p_size > 5 AND p_size <= 10) AS middle, count(*) FILTER (p_size > 10) AS large FROM part GROUP BY 1"""


def large_volume_orders(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    big = li.groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("qty")).where("qty > 200")
    return ranked(o.join(big, o.o_orderkey == big.l_orderkey).select("o_orderkey", "qty", F.round("o_totalprice", 2).alias("price")), 100, F.desc("qty"), F.desc("price"), F.asc("o_orderkey"))


LARGE = """WITH b AS (SELECT l_orderkey, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY 1 HAVING round(sum(l_quantity), 2) > 200)
SELECT o_orderkey, qty, round(o_totalprice, 2) AS price, row_number() OVER (ORDER BY qty DESC, round(o_totalprice, 2) DESC, o_orderkey) AS rank FROM orders JOIN b ON o_orderkey = l_orderkey ORDER BY rank LIMIT 100"""


def order_pages(spark, sf):
    """Pages of twenty in one order: numbers of page and place for every row, from ranges and not from one window."""
    o = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    per = o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    over = Window.partitionBy("o_orderpriority").orderBy("o_orderkey")
    rows = o.withColumn("place", F.row_number().over(over)).join(per, "o_orderpriority")
    return rows.select("o_orderpriority", "o_orderkey", "place", F.ceil(F.col("place") / 20).alias("page"), F.ceil(F.col("n") / 20).alias("pages"))


PAGES = """SELECT o_orderpriority, o_orderkey, row_number() OVER w AS place, ceil((row_number() OVER w) / 20)::BIGINT AS page, ceil(count(*) OVER (PARTITION BY o_orderpriority) / 20)::BIGINT AS pages
FROM orders WHERE o_orderstatus = 'P' WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey)"""


def price_bands(spark, sf):
    """Range join: orders into bands of price."""
    bands = spark.createDataFrame([("low", 0.0, 50000.0), ("middle", 50000.0, 150000.0), ("high", 150000.0, 1e12)], "band string, low double, high double")
    o = table(spark, sf, "orders")
    return o.join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") < F.col("high"))).groupBy("band", "o_orderstatus").agg(F.count("*").alias("n"))


BANDS = """SELECT band, o_orderstatus, count(*) AS n FROM orders JOIN (VALUES ('low', 0, 50000), ('middle', 50000, 150000), ('high', 150000, 1e12)) b(band, low, high) ON o_totalprice >= low AND o_totalprice < high GROUP BY 1, 2"""

QUERIES = {
    "tpch_pricing_summary": pricing_summary, "tpch_revenue_by_nation": revenue_by_nation, "tpch_customers_without_orders": customers_without_orders, "tpch_customers_with_urgent_orders": customers_with_urgent_orders,
    "tpch_full_join": order_counts_full_join, "tpch_rollup": sales_rollup, "tpch_cube": orders_cube, "tpch_top_orders_per_customer": top_orders_per_customer, "tpch_running_totals": order_running_totals,
    "tpch_nation_sets": nation_sets, "tpch_part_price_stats": part_price_stats, "tpch_large_volume_orders": large_volume_orders, "tpch_order_pages": order_pages, "tpch_price_bands": price_bands,
}
ORACLE_SQL = {
    "tpch_pricing_summary": PRICING, "tpch_revenue_by_nation": REVENUE, "tpch_customers_without_orders": WITHOUT, "tpch_customers_with_urgent_orders": URGENT, "tpch_full_join": FULL_JOIN,
    "tpch_rollup": ROLLUP, "tpch_cube": CUBE, "tpch_top_orders_per_customer": TOP_ORDERS, "tpch_running_totals": RUNNING, "tpch_nation_sets": SETS, "tpch_part_price_stats": PARTS,
    "tpch_large_volume_orders": LARGE, "tpch_order_pages": PAGES, "tpch_price_bands": BANDS,
}
