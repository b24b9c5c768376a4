"""Aggregates of the child tables, one row per customer, and the master join."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "SK_ID_CURR"


def _n(condition: Column) -> Column:
    return F.count_if(condition)


def _grouped(df: DataFrame, **aggs: Column) -> DataFrame:
    return df.groupBy(KEY).agg(*[expr.alias(name) for name, expr in aggs.items()])


def bureau(df: DataFrame) -> DataFrame:
    """Credits elsewhere."""
    return _grouped(
        df,
        BUREAU_COUNT=F.count("*"),
        BUREAU_ACTIVE_COUNT=_n(F.col("CREDIT_ACTIVE") == "Active"),
        BUREAU_CLOSED_COUNT=_n(F.col("CREDIT_ACTIVE") == "Closed"),
        BUREAU_DAY_OVERDUE_MEAN=F.avg("CREDIT_DAY_OVERDUE"),
        BUREAU_AMT_CREDIT_SUM=F.sum("AMT_CREDIT_SUM"),
        BUREAU_AMT_DEBT_SUM=F.sum("AMT_CREDIT_SUM_DEBT"),
        BUREAU_AMT_OVERDUE_SUM=F.sum("AMT_CREDIT_SUM_OVERDUE"),
        BUREAU_DAYS_CREDIT_MEAN=F.avg("DAYS_CREDIT"),
    )


def previous_application(df: DataFrame) -> DataFrame:
    """Earlier applications."""
    return _grouped(
        df,
        PREV_APP_COUNT=F.count("*"),
        PREV_APPROVED_COUNT=_n(F.col("NAME_CONTRACT_STATUS") == "Approved"),
        PREV_REFUSED_COUNT=_n(F.col("NAME_CONTRACT_STATUS") == "Refused"),
        PREV_AMT_APP_MEAN=F.avg("AMT_APPLICATION"),
        PREV_AMT_CREDIT_MEAN=F.avg("AMT_CREDIT"),
        PREV_DOWN_PAYMENT_MEAN=F.avg("AMT_DOWN_PAYMENT"),
        PREV_DAYS_DECISION_MEAN=F.avg("DAYS_DECISION"),
        PREV_CNT_PAYMENT_MEAN=F.avg("CNT_PAYMENT"),
    )


def installments(df: DataFrame) -> DataFrame:
    """Payments against instalments: days past due and missing amounts."""
    past_due = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    diff = F.col("AMT_PAYMENT") - F.col("AMT_INSTALMENT")
    return _grouped(
        df,
        INSTAL_COUNT=F.count("*"),
        INSTAL_DPD_MEAN=F.avg(past_due),
        INSTAL_DPD_MAX=F.max(past_due),
        INSTAL_LATE_COUNT=_n(past_due > 0),
        INSTAL_PAYMENT_DIFF_MEAN=F.avg(diff),
        INSTAL_UNDERPAY_COUNT=_n(diff < 0),
    )


def credit_card(df: DataFrame) -> DataFrame:
    """Card balances; utilisation is the mean of row ratios, a zero limit counting as null."""
    return _grouped(
        df,
        CC_MONTHS_COUNT=F.count("*"),
        CC_BALANCE_MEAN=F.avg("AMT_BALANCE"),
        CC_CREDIT_LIMIT_MEAN=F.avg("AMT_CREDIT_LIMIT_ACTUAL"),
        CC_UTILIZATION_MEAN=F.avg(F.try_divide("AMT_BALANCE", "AMT_CREDIT_LIMIT_ACTUAL")),
        CC_PAYMENT_MEAN=F.avg("AMT_PAYMENT_TOTAL_CURRENT"),
        CC_DPD_SUM=F.sum("SK_DPD"),
    )


def pos_cash(df: DataFrame) -> DataFrame:
    """Point-of-sale and cash loans by month."""
    return _grouped(
        df,
        POS_MONTHS_COUNT=F.count("*"),
        POS_CNT_INSTALMENT_MEAN=F.avg("CNT_INSTALMENT"),
        POS_CNT_FUTURE_MEAN=F.avg("CNT_INSTALMENT_FUTURE"),
        POS_DPD_MAX=F.max("SK_DPD"),
        POS_LATE_MONTHS=_n(F.col("SK_DPD") > 0),
    )


CHILDREN: dict[str, Callable[[DataFrame], DataFrame]] = {
    "bureau": bureau,
    "previous_application": previous_application,
    "installments_payments": installments,
    "credit_card_balance": credit_card,
    "pos_cash_balance": pos_cash,
}


def numeric_aggs(df: DataFrame, key: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Mean, sum, minimum and maximum of every int and double column by ``key``."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.IntegerType) and f.name != key and f.name not in exclude]
    kinds = {"MEAN": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max}
    return df.groupBy(key).agg(*[f(c).alias(f"{c}_{k}") for c in names for k, f in kinds.items()])


def build_master(application: DataFrame, aggregates: Mapping[str, DataFrame | None], key: str = KEY) -> DataFrame:
    """``application`` left-joined with each aggregate (one row per key); None is skipped."""
    out = application
    for child in aggregates.values():
        if child is not None:
            out = out.join(child, key, "left")
    return out


def restrict_to(df: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    """The rows whose key is in ``ids``."""
    return df.join(ids, key, "left_semi")
