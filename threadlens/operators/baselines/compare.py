"""Comparison of two answers by shared words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.text import tokens

THRESHOLD = 0.2


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the two token sets, six decimals; 0 for two empty texts."""
    x, y = tokens(a), tokens(b)
    both, either = F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))
    return F.when(either > 0, F.round(both / either, 6)).otherwise(F.lit(0.0))


def correctness(score: Column, threshold: float = THRESHOLD) -> tuple[Column, Column]:
    """(bot_correct, bot_correct_reason) of a similarity."""
    label = F.when(score >= threshold, "Yes").otherwise("No")
    shared = F.bround(F.lit(100.0) * score, 1).cast("decimal(10,1)").cast("string")
    return label, F.concat(F.lit("Shared words: "), shared, F.lit("%"))
