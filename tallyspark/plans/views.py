"""Portfolio-shaped views of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.returns import common_dates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, d: str) -> DataFrame:
    """(asset, date, v): revenue by return flag and day."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("asset"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return rows.groupBy("asset", "date").agg(F.sum("v").alias("v"))


def prices(spark: SparkSession, d: str) -> DataFrame:
    return common_dates(daily(spark, d)).withColumnRenamed("v", "px")


def ret(spark: SparkSession, d: str) -> DataFrame:
    """(date, asset, r): a twentieth of the log change, between -0.2 and 0.2, on days that all flags trade."""
    w = Window.partitionBy("asset").orderBy("date")
    r = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), 0.05 * F.ln(F.col("px") / F.lag("px").over(w))))
    return prices(spark, d).withColumn("r", r).where("r is not null").select("date", "asset", "r")


def panel(spark: SparkSession, d: str) -> DataFrame:
    """(signal_date, security, factor, fwd): by month and supplier, mean discount (to ten places, so that equal means tie whatever the order of their terms) and the change of revenue to the supplier's next month."""
    months = table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "MM").alias("signal_date"), F.col("l_suppkey").alias("security")).agg(F.round(F.avg("l_discount"), 10).alias("factor"),
        F.sum("l_extendedprice").alias("v"))
    return months.withColumn("fwd", F.lead("v").over(Window.partitionBy("security").orderBy("signal_date")) / F.col("v") - 1).where("fwd is not null").drop("v")


def bars(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.struct("ts", "event_id"))
    return e.groupBy(F.col("event_type").alias("security"), F.date_trunc("hour", "ts").alias("at")).agg(F.min_by("value", "k").alias("open"), F.max("value").alias("high"),
        F.min("value").alias("low"), F.max_by("value", "k").alias("close"), F.count("*").alias("volume"))


def graph(spark: SparkSession, d: str) -> DataFrame:
    """Fund edges: world, regions, nations, customers; a tenth of each fund isn't disclosed."""
    c = table(spark, d, "customer").where("c_acctbal > 0").join(F.broadcast(table(spark, d, "nation")),
        F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))

    def edges(node, child, kind: str) -> DataFrame:
        sums = c.groupBy(node.alias("node"), child.alias("child")).agg(F.sum("c_acctbal").alias("s"))
        return sums.select("node", "child", F.lit(kind).alias("kind"), (0.9 * F.col("s") / F.sum("s").over(Window.partitionBy("node"))).alias("weight"))

    return edges(F.lit("world"), F.col("r_name"), "fund").unionByName(edges(F.col("r_name"), F.col("n_name"), "fund")).unionByName(edges(F.col("n_name"), F.col("c_name"), "stock"))


def positions(spark: SparkSession, d: str) -> DataFrame:
    """(security, issuer, industry, kind, amount, duration) from customers: the segment is the industry, the nation the issuer; machinery is bonds, furniture cash."""
    c = table(spark, d, "customer").where("c_acctbal > 0").join(F.broadcast(table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    seg = F.col("c_mktsegment")
    kind = F.when(seg == "MACHINERY", "bond").when(seg == "FURNITURE", "cash").otherwise("stock")
    return c.select(F.col("c_name").alias("security"), F.when(F.col("c_custkey") % 7 != 0, F.col("n_name")).alias("issuer"), F.when(F.col("c_custkey") % 5 != 0, seg).alias("industry"),
        kind.alias("kind"), F.col("c_acctbal").alias("amount"), F.when(F.col("c_custkey") % 3 != 0, (F.col("c_custkey") % 10).cast("double")).alias("duration"))


def invested(spark: SparkSession, d: str) -> DataFrame:
    """(owner, date, amount): orders as payments, and their sum with a tenth more at the end."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.to_date("o_orderdate").alias("date"), "o_totalprice")
    end = o.groupBy("owner").agg((1.1 * F.sum("o_totalprice")).alias("amount")).select("owner", F.lit("2002-01-01").cast("date").alias("date"), "amount")
    return o.select("owner", "date", (-F.col("o_totalprice")).alias("amount")).unionByName(end)


def valuations(spark: SparkSession, d: str) -> DataFrame:
    """(owner, date, before, flow, after) by order priority and month."""
    m = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("owner"), F.trunc("o_orderdate", "MM").alias("date")).agg(F.sum("o_totalprice").alias("flow"))
    total = F.sum("flow").over(Window.partitionBy("owner").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) - F.col("flow")
    m = m.withColumn("before", total * (1 + (F.month("date") % 7 - 3) / 100))
    return m.select("owner", "date", "before", "flow", (F.col("before") + F.col("flow")).alias("after"))


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(period, segment, wp, wb, rp, rb): by year and return flag, weights of revenue and of quantity, mean discount and tax as returns."""
    s = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("period"), F.col("l_returnflag").alias("segment")).agg(F.sum("l_extendedprice").alias("v"),
        F.sum("l_quantity").alias("q"), F.avg("l_discount").alias("rp"), F.avg("l_tax").alias("rb"))
    w = Window.partitionBy("period")
    return s.select("period", "segment", (F.col("v") / F.sum("v").over(w)).alias("wp"), (F.col("q") / F.sum("q").over(w)).alias("wb"), "rp", "rb")
