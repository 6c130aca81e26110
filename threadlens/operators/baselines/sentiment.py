"""Lexicon sentiment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.labels import NO_VALUE
from threadlens.functions.text import word_counts
from threadlens.operators.joins import lookup


def sentiment_of(score: Column) -> Column:
    return (
        F.when(score >= 3, "Delighted")
        .when(score >= 1, "Positive")
        .when(score == 0, "Neutral")
        .when(score >= -2, "Frustrated")
        .otherwise("Angry")
    )


def lexicon_sentiment(
    df: DataFrame, lexicon: DataFrame, text: str = "customer_issue", key: str = "ticket_id"
) -> DataFrame:
    """Add ``sentiment_score``, ``sentiment`` and ``sentiment_explanation``.

    A word of a text is counted inside its row and looked up once.
    A text without hits scores 0; a missing or empty text has no sentiment.
    """
    words = word_counts(df, text, [key], "word")
    scores = (
        lookup(words, lexicon, "word")
        .groupBy(key)
        .agg(F.sum(F.col("score") * F.col("n")).alias("sentiment_score"), F.sum("n").alias("_hits"))
    )
    missing = F.coalesce(F.col(text) == "", F.lit(True))
    score = F.coalesce("sentiment_score", F.lit(0)).cast("bigint")
    explanation = F.concat(
        F.lit("Score "), score.cast("string"), F.lit(" from "),
        F.coalesce("_hits", F.lit(0)).cast("string"), F.lit(" lexicon words."),
    )
    return (
        df.join(scores, key, "left")
        .withColumn("sentiment", F.when(missing, NO_VALUE).otherwise(sentiment_of(score)))
        .withColumn("sentiment_explanation", F.when(missing, NO_VALUE).otherwise(explanation))
        .withColumn("sentiment_score", score)
        .drop("_hits")
    )
