"""The given tables as the logical tables of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.series import with_ordinal
from .storage import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as three-digit draws in no order: day, o_orderkey, slot, machine, ball1..ball3, c, d1..d3."""
    c = F.floor("o_totalprice").cast("long") % 1000
    balls = [F.col("o_orderstatus").alias("ball1"), F.when(F.col("o_custkey") % 11 > 0, F.col("o_custkey") % 5).alias("ball2"), (F.col("o_custkey") % 7).alias("ball3")]
    out = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), "o_orderkey", (F.col("o_orderkey") % 4).alias("slot"), F.col("o_orderpriority").alias("machine"), *balls, c.alias("c"))
    return out.withColumns({"d1": F.floor(F.col("c") / 100).cast("int"), "d2": F.floor(F.col("c") / 10 % 10).cast("int"), "d3": (F.col("c") % 10).cast("int")})


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows() with t, their place in the order of date and key; numbering them takes a shuffle and a checkpoint."""
    return with_ordinal(rows(spark, sf_dir), ["day", "o_orderkey"])


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands of an order's parts, repeated as they are in it: o_orderkey, item."""
    lines, parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("item"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("o_orderkey"), "item")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands of an order's parts as its basket: t, item. Written once, as most operators read it more than once."""
    places = with_ordinal(rows(spark, sf_dir).select("day", "o_orderkey"), ["day", "o_orderkey"])
    return written(order_items(spark, sf_dir).distinct().join(places.select("o_orderkey", "t"), "o_orderkey").select("t", "item"))


def steps(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "orders").count()


DRAWS = """d0 AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderkey, o_orderkey % 4 AS slot, o_orderpriority AS machine, o_orderstatus AS ball1, CASE WHEN o_custkey % 11 > 0 THEN o_custkey % 5 END AS ball2, o_custkey % 7 AS ball3, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS c FROM orders),
draws AS (SELECT row_number() OVER (ORDER BY day, o_orderkey) - 1 AS t, *, CAST(c // 100 AS INTEGER) AS d1, CAST(c // 10 % 10 AS INTEGER) AS d2, CAST(c % 10 AS INTEGER) AS d3 FROM d0)"""
ITEMS = DRAWS + """,
items AS (SELECT DISTINCT t, CAST(substr(p_brand, 7) AS INTEGER) AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN draws ON l_orderkey = o_orderkey),
st AS (SELECT count(*) AS steps FROM orders)"""


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the order lines shipped on each day: day, quantity, discount, price, n_lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("day"))
    return lines.agg(F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_extendedprice").alias("price"), F.count("*").alias("n_lines"))


def joined(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    """Draws with the covariates of their day, null where there are none."""
    base = draws(spark, sf_dir) if ordered else rows(spark, sf_dir)
    return base.join(covariates(spark, sf_dir), "day", "left")


COVARIATES = DRAWS + """,
v AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_extendedprice) AS price, count(*) AS n_lines FROM lineitem GROUP BY 1),
w AS (SELECT draws.*, quantity, discount, price, n_lines FROM draws LEFT JOIN v USING (day))"""


def decayed_sql(column: str, name: str, rate: float = 0.005, block: int = 20000) -> str:
    """name(t, k, w): the weights exp(-rate * age) of all rows before t that have symbol k, but for a factor that all k of t share.

    Weights are seen from the begin of a block of steps and older blocks scaled down to it, so none overflows or vanishes, however many steps there are.
    """
    fall = rate * block
    return f"""{name}_x AS (SELECT t, k, t // {block} AS b, CASE WHEN {column} = k THEN exp({rate} * (t % {block})) ELSE 0 END AS x FROM draws, range(10) r(k)),
{name}_s AS (SELECT b, k, sum(x) AS s FROM {name}_x GROUP BY 1, 2), {name}_p AS (SELECT a.b, a.k, coalesce(sum(e.s * exp(-{fall} * (a.b - e.b))), 0) AS past FROM {name}_s a LEFT JOIN {name}_s e ON e.k = a.k AND e.b < a.b GROUP BY 1, 2),
{name} AS (SELECT t, k, past + coalesce(sum(x) OVER (PARTITION BY k, b ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w FROM {name}_x JOIN {name}_p USING (b, k))"""
