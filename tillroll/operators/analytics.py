"""Spending and health of captured receipts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_period(date: Column, period: str, today: Column) -> Column:
    """DAY: today; WEEK: the last seven days and any later; MONTH: this calendar month; undated entries always."""
    made = {
        "DAY": date == today,
        "WEEK": date >= F.date_sub(today, 6),
        "MONTH": (F.year(date) == F.year(today)) & (F.month(date) == F.month(today)),
    }
    return date.isNull() | made[period]


def spend(total: Column, items: Column) -> Column:
    """The stated total if it is positive, else the sum of items."""
    return F.when(total > 0, total).otherwise(F.coalesce(items, F.lit(0.0)))


def box_report(words: DataFrame) -> DataFrame:
    """By document, boxes that are invalid, that reach outside (over the page, or at its edge), and confidence."""
    bad = ~((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
    low = (F.col("x0") < 0) | (F.col("y0") < 0)
    over = low | (F.col("x1") > F.col("page_w")) | (F.col("y1") > F.col("page_h"))
    edge = low | (F.col("x1") >= F.col("page_w")) | (F.col("y1") >= F.col("page_h"))
    return words.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(bad).alias("invalid"), F.count_if(over).alias("outside"), F.count_if(edge).alias("at_edge"), F.min("confidence").alias("least_confidence"), F.max("confidence").alias("most_confidence"))


def finite_report(df: DataFrame, *columns: str) -> DataFrame:
    """NaN and infinite values of columns."""
    return df.agg(*[f(F.col(c)).alias(f"{name}_{c}") for c in columns for name, f in (("nan", lambda v: F.count_if(F.isnan(v))), ("inf", lambda v: F.count_if(F.abs(v) == float("inf"))))])
