"""Label columns: missing tokens, verdicts, sentiments, percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.text import SPACE_CLASS, strip

# Texts a CSV reader treats as missing by default.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Label sets and the verdict text they are read from.
YES_NO = ("Yes", "No")
SENTIMENTS = ("Positive", "Neutral", "Frustrated", "Angry", "Delighted")
VERDICT_PREFIX = "Self Service Possible?: "
VERDICT_PATTERN = r"Self Service Possible\?: (Yes|No)"

NO_VALUE = "N/A"


def nullify_na(c: Column) -> Column:
    """Missing tokens become null; prefixed texts such as ``N/A - reason`` stay."""
    return F.when(~c.isin(*NA_TOKENS), c)


def verdict_label(analysis: Column) -> Column:
    """First Yes/No after the verdict prefix, null when there is none."""
    found = F.regexp_extract(analysis, VERDICT_PATTERN, 1)
    return F.when(found != "", found)


def mentions_verdict(analysis: Column, label: str) -> Column:
    """The verdict text occurs anywhere; null counts as not."""
    return F.coalesce(analysis.contains(VERDICT_PREFIX + label), F.lit(False))


def _field(reply: Column, name: str) -> Column:
    pattern = rf"{name}:[{SPACE_CLASS}]*([^\n]+)"
    return F.when(reply.rlike(pattern), strip(F.regexp_extract(reply, pattern, 1))).otherwise(
        F.lit(NO_VALUE)
    )


def sentiment_label(reply: Column) -> Column:
    return _field(reply, "Sentiment")


def sentiment_explanation(reply: Column) -> Column:
    return _field(reply, "Explanation")


def known_sentiment(label: Column) -> Column:
    """Quality flag: the label is one of the five requested ones."""
    return F.coalesce(label.isin(*SENTIMENTS), F.lit(False))


def _beyond(p: Column, odd: Column) -> Column:
    """20 p - odd, of the right sign to the last bit: the product is a sum of two exact ones."""
    more, less = p * 16.0, p * 4.0
    total = more + less
    return (total - odd) + (less - (total - more))


def one_decimal(p: Column) -> Column:
    """A double as exact decimal formatting with one place would print it, half-even on true ties.

    Rounding by its decimal text takes 0.05 for a tie, but the double lies above it.
    """
    near = F.floor(p * 10.0 + 0.5).cast("double")
    up, down = _beyond(p, 2.0 * near + 1.0), _beyond(p, 2.0 * near - 1.0)
    odd = near % 2 != 0
    tenths = (
        F.when((up > 0) | ((up == 0) & odd), near + 1.0).when((down < 0) | ((down == 0) & odd), near - 1.0).otherwise(near)
    )
    return tenths / 10.0


def percent(n: Column, total: Column) -> Column:
    """Share in percent with one decimal, as formatting ``(n / total) * 100``; null for a zero total."""
    return F.when(total > 0, one_decimal(n / total * 100.0))


def count_and_percent(n: Column, pct: Column) -> Column:
    """``k (p%)``, empty for a zero share."""
    text = F.concat(
        n.cast("string"), F.lit(" ("), pct.cast("decimal(10,1)").cast("string"), F.lit("%)")
    )
    return F.when(pct > 0, text).otherwise(F.lit(""))


def format_verdict(possible: Column, reason: Column, recommendation: Column) -> Column:
    """Verdict block; the recommendation line appears for ``No`` only."""
    block = F.concat(F.lit(VERDICT_PREFIX), possible, F.lit("\n\nReason:\n"), reason)
    return F.when(
        possible == "No", F.concat(block, F.lit("\nRecommendation: "), recommendation)
    ).otherwise(block)
