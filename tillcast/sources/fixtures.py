"""Stand-in sales / stores / features views derived from the TPC-H-like test tables.

store = supplier nation, dept = part type (or brand for baskets), date = Friday
ending the week of the ship date; returns count as negative sales. Features are
derived per store-week, with null weeks on purpose so that fills and
interpolation have work to do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.dates import is_holiday_week, iso_week, week_ending_friday
from tillcast.functions.numeric import TWO_PI, money
from tillcast.sources.tables import read_table


def sales(spark: SparkSession, sf_dir: str, dept_col: str = "p_type", store_col: str = "s_nationkey") -> DataFrame:
    """(store int, dept string, date date, weekly_sales double, is_holiday boolean).

    With ``store_col`` s_suppkey and ``dept_col`` p_brand the number of series grows with the data.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_shipdate", "l_returnflag", "l_extendedprice")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col(store_col).alias("store"))
    part = read_table(spark, sf_dir, "part").select("p_partkey", F.col(dept_col).alias("dept"))
    price = money("l_extendedprice")
    signed = F.when(F.col("l_returnflag") == "R", -price).otherwise(price)
    return (
        li.join(sup, li.l_suppkey == sup.s_suppkey)
        .join(part, li.l_partkey == part.p_partkey)
        .groupBy("store", "dept", week_ending_friday("l_shipdate").alias("date"))
        .agg(F.sum(signed).cast("double").alias("weekly_sales"))
        .withColumn("is_holiday", is_holiday_week("date"))
    )


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(store int, type string A/B/C, size int): one row per store."""
    sup = read_table(spark, sf_dir, "supplier").select("s_nationkey")
    nat = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rk = F.col("n_regionkey")
    return (
        sup.join(nat, sup.s_nationkey == nat.n_nationkey)
        .groupBy(F.col("s_nationkey").alias("store"), "n_regionkey")
        .agg((F.count(F.lit(1)) * 10000).cast("int").alias("size"))
        .select("store",
                F.when(rk.isin(0, 1), "A").when(rk.isin(2, 3), "B").otherwise("C").alias("type"),
                "size")
    )


def week_bounds(spark: SparkSession, sf_dir: str) -> tuple:
    """(first, last) week-ending Friday of the sales calendar: two scalars to the driver."""
    li = read_table(spark, sf_dir, "lineitem")
    row = li.agg(F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi")) \
            .select(week_ending_friday("lo").alias("lo"), week_ending_friday("hi").alias("hi")).first()
    return row["lo"], row["hi"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per store and calendar week; cpi/unemployment/markdowns have null weeks."""
    lo, hi = week_bounds(spark, sf_dir)
    spine = stores(spark, sf_dir).select(
        "store",
        F.explode(F.sequence(F.lit(lo), F.lit(hi), F.expr("interval 7 days"))).alias("date"))

    orders = read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    cust = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    econ = (
        orders.join(cust, orders.o_custkey == cust.c_custkey)
        .groupBy(F.col("c_nationkey").alias("store"),
                 week_ending_friday("o_orderdate").alias("date"))
        .agg((F.sum(money("o_totalprice")).cast("double") / F.count(F.lit(1)) / 1e3).alias("cpi0"),
             (F.sum(money("c_acctbal")).cast("double") / F.count(F.lit(1)) / 1e3).alias("une0"))
    )

    li = read_table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_shipdate", "l_linenumber", "l_extendedprice", "l_discount")
    sup = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    disc = money("l_extendedprice") * F.col("l_discount").cast("decimal(4,2)")
    md = (
        li.join(sup, li.l_suppkey == sup.s_suppkey)
        .groupBy(F.col("s_nationkey").alias("store"),
                 week_ending_friday("l_shipdate").alias("date"))
        .agg(*[F.sum(F.when(F.col("l_linenumber") == i, disc)).cast("double").alias(f"markdown{i}")
               for i in range(1, 6)])
    )

    woy = iso_week("date")
    store = F.col("store")
    return (
        spine.join(econ, ["store", "date"], "left")
        .join(md, ["store", "date"], "left")
        .select(
            "store", "date",
            is_holiday_week("date").alias("is_holiday"),
            F.round(F.lit(60.0) + F.lit(25.0) * F.sin(F.lit(TWO_PI) * woy / F.lit(52.0)) + store % 7, 4)
            .alias("temperature"),
            F.round(F.lit(2.5) + F.lit(0.01) * woy + F.lit(0.1) * (store % 5), 4).alias("fuel_price"),
            *[f"markdown{i}" for i in range(1, 6)],
            F.when(woy % 5 == 0, F.lit(None)).otherwise(F.col("cpi0")).cast("double").alias("cpi"),
            F.when(woy % 7 == 0, F.lit(None)).otherwise(F.col("une0")).cast("double").alias("unemployment"),
        )
    )
