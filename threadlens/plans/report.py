"""Report on a snapshot of analysed tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions.dates import timeframe_label
from threadlens.operators.breakdowns import breakdowns, dimension_labels, theme_counts
from threadlens.operators.deflection import deflection


def report(
    analysed: DataFrame, conversations: DataFrame, range_name: str = "24hr"
) -> dict[str, DataFrame]:
    """``header`` (one row), ``breakdowns`` (dim, label, n, pct) and ``themes``.

    ``analysed`` should be a written snapshot: each part scans only the columns it
    needs. ``conversations`` are the chatbot events of the same window.
    """
    header = deflection(analysed, conversations).withColumn(
        "timeframe", timeframe_label(F.lit(range_name))
    )
    shares = breakdowns(analysed, dimension_labels(analysed)).orderBy(
        "dim", F.desc("n"), F.asc("label")
    )
    return {"header": header, "breakdowns": shares, "themes": theme_counts(analysed)}
