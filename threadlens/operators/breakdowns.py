"""Label breakdowns and drill-downs over analysed tickets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.labels import (
    YES_NO,
    count_and_percent,
    mentions_verdict,
    nullify_na,
    percent,
    verdict_label,
)


def yes_no(label: Column) -> Column:
    """Other labels leave the breakdown."""
    return F.when(label.isin(*YES_NO), label)


# Dimension -> column it needs, label expression over it. Missing tokens are no label.
DIMENSIONS = {
    "self_service": ("self_service_analysis", lambda c: verdict_label(nullify_na(c))),
    "bot_correct": ("bot_correct", lambda c: yes_no(nullify_na(c))),
    "sentiment": ("sentiment", nullify_na),
    "theme": ("theme", nullify_na),
}

# Dimension -> columns its drill-down lists.
DRILL_COLUMNS = {
    "self_service": ("ticket_id", "theme", "self_service_analysis"),
    "bot_correct": ("ticket_id", "customer_issue", "bot_correct", "bot_correct_reason"),
    "sentiment": ("ticket_id", "sentiment"),
    "theme": ("ticket_id", "theme"),
}


def dimension_labels(df: DataFrame, names: Sequence[str] | None = None) -> dict[str, Column]:
    """Label expressions of the dimensions whose column the table has."""
    return {
        name: label(F.col(column))
        for name, (column, label) in DIMENSIONS.items()
        if column in df.columns and (names is None or name in names)
    }


def label_counts(df: DataFrame, labels: Mapping[str, Column]) -> DataFrame:
    """(dim, label, n) for several dimensions in one scan; null labels are not counted."""
    if not labels:
        return df.sparkSession.createDataFrame([], "dim STRING, label STRING, n BIGINT")
    wide = df.select(*[c.alias(name) for name, c in labels.items()])
    return (
        wide.unpivot([], list(labels), "dim", "label")
        .where(F.col("label").isNotNull())
        .groupBy("dim", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def breakdowns(df: DataFrame, labels: Mapping[str, Column]) -> DataFrame:
    """(dim, label, n, pct): the share is of the labelled rows, not of all rows.

    Totals are one row per dimension, a number fixed by the caller's code, so they
    are broadcast; free-text labels never meet in one window partition.
    """
    counts = label_counts(df, labels)
    totals = counts.groupBy("dim").agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(totals), "dim").select(
        "dim", "label", "n", percent(F.col("n"), F.col("total")).alias("pct")
    )


def breakdown(df: DataFrame, label: Column) -> DataFrame:
    """(label, n, pct, caption) of one label expression, most frequent first, ties by label."""
    shares = breakdowns(df, {"label": label})
    return shares.select(
        "label", "n", "pct", count_and_percent(F.col("n"), F.col("pct")).alias("caption")
    ).orderBy(F.desc("n"), F.asc("label"))


def theme_counts(df: DataFrame) -> DataFrame:
    return (
        label_counts(df, dimension_labels(df, ["theme"]))
        .select(F.col("label").alias("theme"), F.col("n").alias("ticket_count"))
        .orderBy(F.desc("ticket_count"), F.asc("theme"))
    )


def drilldown(df: DataFrame, dim: str, label: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Tickets behind one slice of a breakdown; uses the breakdown's own label, so the
    number of rows equals the slice's count."""
    labels = dimension_labels(df, [dim])
    chosen = df.where(labels[dim] == label) if dim in labels else df.limit(0)
    return chosen.select(*(columns or df.columns))


def drilldown_by_text(df: DataFrame, label: str) -> DataFrame:
    """Tickets whose verdict text mentions the label anywhere, not only first."""
    return df.where(mentions_verdict(F.col("self_service_analysis"), label))
