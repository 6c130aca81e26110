"""Views that give the sample tables the roles of this package's inputs.

orders = tickets, conversations = comments, documents = texts and articles,
labels = quality marks of documents, events = chatbot activity and article views.
They only rename and compute columns, so filters and pruning reach the files.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.sources.shared import spread

AS_OF = dt.datetime(2001, 7, 31, 15, 30)
FINISHED = ("F", "O")
FORM = "1-URGENT"

# author_id of a conversation's turns: ten times the thread id plus this.
ROLE_CODES = {"user": 1, "assistant": 2, "system": 3}

# Small word tables matching the invented prose of the sample texts.
LEXICON = [("the", 1), ("and", 1), ("of", -1), ("to", -2), ("que", 2), ("la", -1), ("und", -3), ("der", 1)]
THEME_TERMS = [
    ("the", "Access"), ("in", "Access"), ("and", "Billing"), ("on", "Billing"),
    ("que", "Delivery"), ("la", "Delivery"), ("und", "Returns"), ("die", "Returns"),
]
GAZETTEER = [("of the", "ORG"), ("que", "PERSON"), ("und die", "ORG"), ("inly", "PERSON"), ("la", "ORG")]


# Tables with long texts, whose small files are spread over the cores.
TEXT_KEYS = {"documents": "doc_id", "conversations": "conv_id", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(table(spark, sf_dir, name), TEXT_KEYS[name])


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ticket per order. The form is the priority text, the states are F, O and P."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("ticket_id"),
        (key * 10 + ROLE_CODES["user"]).alias("requester_id"),
        (key * 10 + ROLE_CODES["assistant"]).alias("assignee_id"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("ticket_form_id"),
        F.lit(None).cast("string").alias("theme"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One comment per turn; system turns are private."""
    code = F.lit(0)
    for role, n in ROLE_CODES.items():
        code = F.when(F.col("role") == role, n).otherwise(code)
    start = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp_ntz")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("ticket_id"),
        F.col("turn").alias("pos"),
        (F.col("conv_id") * 10 + code).alias("author_id"),
        (F.col("role") != "system").alias("public"),
        F.col("text").alias("plain_body"),
        (start + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("created_at"),
    )


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "documents").select("doc_id", "text")


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("conversation_id"), "ts"
    )


def article_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    return views.select(F.col("event_id").cast("string").alias("event_id"), "ts")


def analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 13 columns over documents: quality marks stand for verdicts, unmarked
    documents carry missing tokens, language is the sentiment and source the theme."""
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    quality, toxic = F.col("quality"), F.col("toxic")
    verdict = (
        F.when(quality == 1, "Self Service Possible?: Yes\n\nReason:\nquality mark")
        .when(quality == 0, "Self Service Possible?: Not sure\n\nReason:\nno quality mark")
        .otherwise("N/A")
    )
    return docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("ticket_id"),
        F.lit("Unassigned").alias("assignee_id"),
        F.lit("2024-01-01T00:00:00Z").alias("created_at"),
        F.col("text").alias("summary"),
        verdict.alias("self_service_analysis"),
        F.lit("").alias("bot_answer"),
        F.when(toxic == 0, "Yes").when(toxic == 1, "No").otherwise("N/A").alias("bot_correct"),
        F.lit("None").alias("bot_correct_reason"),
        F.when(F.col("source") == "src0", "").otherwise(F.col("source")).alias("theme"),
        F.lit("").alias("recommendation"),
        F.when(F.col("lang") == "es", "N/A").otherwise(F.col("lang")).alias("sentiment"),
        F.lit("").alias("sentiment_explanation"),
        F.col("text").alias("customer_issue"),
    )


def words(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)
