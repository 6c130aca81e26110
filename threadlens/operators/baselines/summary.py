"""Extractive summary and self-service verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import sentences, strip, word_counts
from threadlens.operators.baselines.retrieval import KnowledgeIndex
from threadlens.operators.joins import lookup

THRESHOLD = 5.0


def top_sentences(comments: DataFrame, index: KnowledgeIndex) -> DataFrame:
    """(ticket_id, summary): the sentence with the rarest words on average.

    ``comments`` come with redacted bodies. Rarity is the idf of the knowledge base, unknown words being rarest. The mean
    is rounded to six decimals; ties go to the earliest sentence. Only numbers are
    grouped: the chosen sentence is cut out of its comment at the end.
    """
    body = sentences(F.col("plain_body"))
    place = ["ticket_id", "pos", "sentence_no"]
    # An inner explode adds a filter with its whole input, which would redact and split the bodies twice.
    split = comments.select("ticket_id", "pos", F.posexplode_outer(body).alias("sentence_no", "sentence"))
    words = word_counts(split, "sentence", place, "term")
    rarity = F.sum(F.coalesce("idf", index.unknown_idf) * F.col("n")) / F.sum("n")
    best = (
        lookup(words, index.vocabulary, "term", "left")
        .groupBy(*place)
        .agg(F.round(rarity, 6).alias("rarity"))
        .groupBy("ticket_id")
        .agg(F.min(F.struct((-F.col("rarity")).alias("r"), "pos", "sentence_no")).alias("b"))
        .select("ticket_id", "b.pos", "b.sentence_no")
    )
    return comments.join(best, ["ticket_id", "pos"]).select(
        "ticket_id", strip(F.element_at(body, F.col("sentence_no") + 1)).alias("summary")
    )


def verdict(score: Column, doc_id: Column, threshold: float = THRESHOLD) -> tuple[Column, Column]:
    """(possible, reason): a good enough article means the customer could have used it."""
    possible = F.when(F.coalesce(score >= threshold, F.lit(False)), "Yes").otherwise("No")
    reason = F.when(
        possible == "Yes", F.concat(F.lit("Covered by article "), doc_id.cast("string"))
    ).otherwise(
        F.when(doc_id.isNull(), "No matching article").otherwise(
            F.concat(F.lit("Closest article "), doc_id.cast("string"), F.lit(" is too far"))
        )
    )
    return possible, reason
