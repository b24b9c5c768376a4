"""Stand-in credit tables, derived from the order tables by fixed rules.

They exercise the operators' branches and carry no credit signal. All columns
are narrow projections, so scans read only what a query needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def loans(spark: SparkSession, d: str) -> DataFrame:
    """One application for each order."""
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.expr("o_custkey = c_custkey"))
    return rows.selectExpr(
        "o_orderkey AS SK_ID_CURR",
        "CAST(o_orderstatus = 'F' AS INT) AS TARGET",
        "o_totalprice AS AMT_CREDIT",
        "c_acctbal * 12 AS AMT_INCOME_TOTAL",
        "o_totalprice / (12 + o_orderkey % 48) AS AMT_ANNUITY",
        "CASE WHEN o_orderkey % 50 = 0 THEN 0D ELSE o_totalprice * 0.9D END AS AMT_GOODS_PRICE",
        "o_orderpriority AS NAME_CONTRACT_TYPE",
        "c_mktsegment AS NAME_INCOME_TYPE",
        "CAST(-(7300 + (o_custkey * 37) % 17700) AS INT) AS DAYS_BIRTH",
        "CAST(CASE WHEN o_custkey % 6 = 0 THEN 365243 ELSE -((o_orderkey * 13) % 8000) END AS INT) AS DAYS_EMPLOYED",
        "CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 101) / 100D END AS EXT_SOURCE_1",
        "CASE WHEN o_orderkey % 10 <> 0 THEN (o_custkey % 97) / 96D END AS EXT_SOURCE_2",
        "CASE WHEN o_orderkey % 5 <> 0 THEN ((o_orderkey * 7) % 89) / 88D END AS EXT_SOURCE_3",
    )


def _lines(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    rows = table(spark, d, "lineitem").join(orders, F.expr("l_orderkey = o_orderkey"))
    return rows.withColumn("days", F.expr("datediff(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))"))


def bureau(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).selectExpr(
        "l_orderkey AS SK_ID_CURR",
        "CASE l_linestatus WHEN 'O' THEN 'Active' WHEN 'F' THEN 'Closed' END AS CREDIT_ACTIVE",
        "greatest(0, days - 60) AS CREDIT_DAY_OVERDUE",
        "l_extendedprice AS AMT_CREDIT_SUM",
        "l_extendedprice * l_discount AS AMT_CREDIT_SUM_DEBT",
        "l_extendedprice * l_tax AS AMT_CREDIT_SUM_OVERDUE",
        "-days AS DAYS_CREDIT",
    )


def previous_application(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).selectExpr(
        "l_orderkey AS SK_ID_CURR",
        "CASE l_returnflag WHEN 'A' THEN 'Approved' WHEN 'R' THEN 'Refused' ELSE 'Canceled' END AS NAME_CONTRACT_STATUS",
        "l_extendedprice AS AMT_APPLICATION",
        "l_extendedprice * (1 - l_discount) AS AMT_CREDIT",
        "l_extendedprice * l_tax AS AMT_DOWN_PAYMENT",
        "-days AS DAYS_DECISION",
        "l_quantity AS CNT_PAYMENT",
    )


def installments(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).selectExpr(
        "l_orderkey AS SK_ID_CURR",
        "60 AS DAYS_INSTALMENT",
        "days AS DAYS_ENTRY_PAYMENT",
        "l_extendedprice AS AMT_INSTALMENT",
        "l_extendedprice * (1 - l_discount + l_tax) AS AMT_PAYMENT",
    )


def credit_card(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).selectExpr(
        "l_orderkey AS SK_ID_CURR",
        "l_extendedprice AS AMT_BALANCE",
        "l_discount * 100000 AS AMT_CREDIT_LIMIT_ACTUAL",
        "l_extendedprice * l_tax AS AMT_PAYMENT_TOTAL_CURRENT",
        "greatest(0, days - 60) AS SK_DPD",
    )


def pos_cash(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).selectExpr(
        "l_orderkey AS SK_ID_CURR", "l_quantity AS CNT_INSTALMENT", "l_quantity - l_linenumber AS CNT_INSTALMENT_FUTURE", "greatest(0, days - 60) AS SK_DPD"
    )


CHILDREN = {"bureau": bureau, "previous_application": previous_application, "installments_payments": installments, "credit_card_balance": credit_card, "pos_cash_balance": pos_cash}


def drift_pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """lineitem before and from 1999 on; prices of the later part are 1.3 times up, one flag is renamed there."""
    rows = table(spark, d, "lineitem").selectExpr(
        "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_extendedprice AS price_shifted", "l_returnflag", "l_linestatus", "l_shipdate < TIMESTAMP_NTZ'1999-01-01 00:00:00' AS early"
    )
    late = rows.where(~F.col("early")).withColumns({"price_shifted": F.col("l_extendedprice") * 1.3, "l_returnflag": F.when(F.col("l_returnflag") == "R", "X").otherwise(F.col("l_returnflag"))})
    return rows.where("early").drop("early"), late.drop("early")


def applications(spark: SparkSession, d: str) -> DataFrame:
    """Applications by event: event_id, event time and the scorer's inputs."""
    return table(spark, d, "events").selectExpr(
        "event_id AS SK_ID_CURR",
        "CAST(ts AS TIMESTAMP) AS event_time",
        "value * 1000 / 7 AS AMT_CREDIT",
        "CAST(user_id % 40 AS DOUBLE) * 1000 AS AMT_INCOME_TOTAL",
        "CAST(CASE WHEN user_id % 6 = 0 THEN 365243 ELSE -((event_id * 13) % 8000) END AS INT) AS DAYS_EMPLOYED",
        "CASE WHEN event_id % 3 <> 0 THEN (event_id % 101) / 100D END AS EXT_SOURCE_1",
        "CASE WHEN event_id % 10 <> 0 THEN (user_id % 97) / 96D END AS EXT_SOURCE_2",
        "CASE WHEN event_id % 5 <> 0 THEN ((event_id * 7) % 89) / 88D END AS EXT_SOURCE_3",
    )
