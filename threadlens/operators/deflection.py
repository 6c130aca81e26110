"""Chatbot activity, article views and the deflection ratio."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.labels import NO_VALUE, percent


def between(events: DataFrame, start: dt.datetime, end: dt.datetime | None = None) -> DataFrame:
    """Events from ``start`` to ``end``, both included; literals reach the file scan."""
    chosen = events.where(F.col("ts") >= F.lit(start))
    return chosen if end is None else chosen.where(F.col("ts") <= F.lit(end))


def daily_counts(events: DataFrame) -> DataFrame:
    return events.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("conversations")
    )


def total_count(events: DataFrame, name: str) -> DataFrame:
    """One row, 0 for no events."""
    return events.agg(F.count(F.lit(1)).alias(name))


def deflection(tickets: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row: both counts, their ratio and the text ``k/n (p%)``, ``N/A`` for no tickets.

    Both sides are one-row totals, so the product of the two is one row.
    """
    k, n = F.col("conversations"), F.col("tickets")
    pct = percent(k, n)
    text = F.concat(
        k.cast("string"), F.lit("/"), n.cast("string"), F.lit(" ("),
        pct.cast("decimal(20,1)").cast("string"), F.lit("%)"),
    )
    return (
        total_count(conversations, "conversations")
        .crossJoin(total_count(tickets, "tickets"))
        .select(
            "conversations",
            "tickets",
            pct.alias("pct"),
            F.when(n == 0, F.lit(NO_VALUE)).otherwise(text).alias("deflection"),
        )
    )
