"""Readers of landed tables. Paths may be JSON lines or Parquet, with fixed schemas.

A JSON line that does not parse costs its own record: readers leave it out and ``bad_lines`` gives
it in the form of the error log. Event tables lie in one folder per day, so a time range
reads its days only.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens import schemas
from threadlens.operators.deflection import between
from threadlens.sources.errors import error_rows

CORRUPT = "_corrupt_record"
DAY = "day"
PARSE = {"columnNameOfCorruptRecord": CORRUPT}


def _lines(spark: SparkSession, path: str, schema: T.StructType, parts: T.StructType) -> DataFrame:
    """(line, record, partition columns) of JSON lines; blank lines are none.

    Lines are read as text and parsed whole. A scan that parses may leave out the fields a
    query does not ask for, and with them the fault of a line.
    """
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    text = spark.read.schema(T.StructType([T.StructField("value", T.StringType()), *parts.fields])).text(path)
    text = text.where(F.trim("value") != "")
    return text.select(F.col("value").alias("line"), F.from_json("value", kept, PARSE).alias("record"), *parts.names)


def _sound() -> Column:
    return F.col("record").isNotNull() & F.col(f"record.{CORRUPT}").isNull()


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str, parts: T.StructType = T.StructType()) -> DataFrame:
    if fmt != "json":
        return spark.read.schema(T.StructType([*schema.fields, *parts.fields])).format(fmt).load(path)
    records = _lines(spark, path, schema, parts).where(_sound())
    return records.select(*[f"record.{name}" for name in schema.names], *parts.names)


def bad_lines(spark: SparkSession, path: str, schema: T.StructType, stage: str) -> DataFrame:
    """Lines of a landed JSON table that do not parse under its schema, as rows of the error log.

    Their ticket is unknown, since what a broken line still gives cannot be trusted.
    """
    broken = _lines(spark, path, schema, T.StructType()).where(~_sound())
    message = F.concat(F.lit("BadRecord: "), F.col("line"))
    return error_rows(broken.withColumn("ticket_id", F.lit(None).cast("long")), stage, message, F.current_timestamp())


def read_tickets(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return _read(spark, path, schemas.TICKETS, fmt)


def flatten_threads(threads: DataFrame) -> DataFrame:
    """One row per comment; ``pos`` is the array position, which is the thread order."""
    return threads.select("ticket_id", F.posexplode("comments").alias("pos", "c")).select(
        "ticket_id",
        F.col("pos").cast("bigint").alias("pos"),
        "c.author_id",
        "c.public",
        "c.plain_body",
        "c.created_at",
    )


def read_threads(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Landed threads as they are: (ticket_id, comments)."""
    return _read(spark, path, schemas.THREADS, fmt)


def read_comments(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """All comments of landed threads, read once. A null ``public`` reads as absent."""
    return flatten_threads(read_threads(spark, path, fmt))


def land_events(events: DataFrame, path: str, fmt: str = "json") -> None:
    """Write events with a ``ts`` to one folder per UTC day."""
    dated = events.withColumn(DAY, F.to_date("ts"))
    # Without a format of its own JSON keeps milliseconds only.
    out = dated.write.partitionBy(DAY).format(fmt)
    (out.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX") if fmt == "json" else out).save(path)


def _events(spark: SparkSession, path: str, schema: T.StructType, fmt: str, start: dt.datetime, end: dt.datetime | None) -> DataFrame:
    """Events of a time range. The filter on the folders' day leaves other days unread."""
    day = T.StructType([T.StructField(DAY, T.DateType())])
    found = _read(spark, path, schema, fmt, day).where(F.col(DAY) >= F.lit(start.date()))
    if end is not None:
        found = found.where(F.col(DAY) <= F.lit(end.date()))
    return between(found, start, end).select(*schema.names)


def read_activity(
    spark: SparkSession, path: str, start: dt.datetime, end: dt.datetime, fmt: str = "json"
) -> DataFrame:
    """Chatbot activity of a time range from folders by day."""
    return _events(spark, path, schemas.ACTIVITY, fmt, start, end)


def read_article_views(spark: SparkSession, path: str, start: dt.datetime, fmt: str = "json") -> DataFrame:
    """All article views since ``start`` from folders by day."""
    return _events(spark, path, schemas.ARTICLE_VIEWS, fmt, start, None)
