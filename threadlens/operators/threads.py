"""Comment threads: opening message, final answer, transcript.

Opening and final comments are found by their positions, which are numbers and combine
inside each task; only the chosen texts are fetched. A transcript is the whole thread as one text, so its group is one
thread, however long; ``transcript_parts`` gives the same text in numbered parts.

Threads that land as one array per ticket need none of this: ``assemble_arrays``
works inside the row, and the only shuffle left is the join to the tickets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import comment_line, is_blank, redact, strip

PART_COMMENTS = 500


def is_public() -> Column:
    """A comment counts as public unless it says otherwise."""
    return F.coalesce(F.col("public"), F.lit(True))


def has_author(column: str = "author_id") -> Column:
    return F.coalesce(F.col(column) != 0, F.lit(False))


def public_bodies(comments: DataFrame) -> DataFrame:
    """Public comments with text, the text trimmed."""
    return comments.where(is_public() & ~is_blank(F.col("plain_body"))).withColumn(
        "plain_body", strip(F.col("plain_body"))
    )


def answer_bounds(tickets: DataFrame, comments: DataFrame) -> DataFrame:
    """(ticket_id, customer_issue, agent_resolution): first public comment of the
    requester, last public comment of the assignee. Tickets with neither are absent.

    Places are numbers and combine by hash inside each task; only the two chosen texts
    of a ticket are moved and grouped.
    """
    roles = tickets.select(
        "ticket_id",
        F.explode(
            F.array(
                F.struct(F.lit("requester").alias("role"), F.col("requester_id").alias("author_id")),
                F.struct(F.lit("assignee").alias("role"), F.col("assignee_id").alias("author_id")),
            )
        ).alias("r"),
    ).select("ticket_id", "r.role", "r.author_id")
    shown = public_bodies(comments).where(has_author())
    bounds = shown.groupBy("ticket_id", "author_id").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos")
    )
    place = F.when(F.col("role") == "requester", F.col("first_pos")).otherwise(F.col("last_pos"))
    chosen = (
        roles.where(has_author())
        .join(bounds, ["ticket_id", "author_id"])
        .select("ticket_id", "author_id", "role", place.alias("pos"))
    )
    texts = shown.select("ticket_id", "author_id", "pos", "plain_body")
    return (
        chosen.join(texts, ["ticket_id", "author_id", "pos"])
        .groupBy("ticket_id")
        .agg(
            F.max(F.when(F.col("role") == "requester", F.col("plain_body"))).alias("customer_issue"),
            F.max(F.when(F.col("role") == "assignee", F.col("plain_body"))).alias("agent_resolution"),
        )
    )


def first_rows(comments: DataFrame, key: str = "ticket_id", order: str = "pos") -> DataFrame:
    """Whole first row per key: an aggregate, so no key is sorted in one task."""
    return _bound_rows(comments, key, order, F.min, F.min_by)


def last_rows(comments: DataFrame, key: str = "ticket_id", order: str = "pos") -> DataFrame:
    return _bound_rows(comments, key, order, F.max, F.max_by)


def _bound_rows(df: DataFrame, key: str, order: str, bound, pick) -> DataFrame:
    """The bound is found among numbers; whole rows are grouped only where they lie on it."""
    places = df.groupBy(key).agg(bound(order).alias(order))
    rest = [c for c in df.columns if c != key]
    found = df.join(places, [key, order], "left_semi")
    return found.groupBy(key).agg(pick(F.struct(*rest), order).alias("r")).select(key, "r.*")


def with_line(comments: DataFrame, masked: bool = False) -> DataFrame:
    """Private comments and untrimmed bodies belong to the transcript. ``masked``: bodies already are."""
    body = F.col("plain_body") if masked else redact(F.col("plain_body"))
    line = comment_line(F.col("author_id"), F.col("created_at"), body)
    return comments.select("ticket_id", "pos", line.alias("line"))


def transcripts(comments: DataFrame) -> DataFrame:
    """(ticket_id, comment_count, transcript): every thread that has comments, whole."""
    return (
        with_line(comments)
        .groupBy("ticket_id")
        .agg(
            F.count(F.lit(1)).alias("comment_count"),
            F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY pos)").alias("transcript"),
        )
    )


def transcript_parts(comments: DataFrame, part_comments: int = PART_COMMENTS) -> DataFrame:
    """(ticket_id, part, transcript): the whole text of every thread, in pieces of
    ``part_comments`` positions. Joining the parts by newline gives the transcript."""
    return (
        with_line(comments)
        .withColumn("part", F.floor(F.col("pos") / part_comments))
        .groupBy("ticket_id", "part")
        .agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY pos)").alias("transcript"))
    )


def assemble_threads(
    tickets: DataFrame, comments: DataFrame, transcript: bool = True, masked: bool = False
) -> DataFrame:
    """Every ticket with its redacted opening message, redacted final answer, comment
    count and, unless left out, transcript.

    ``comment_count`` is 0 for an empty thread. ``masked`` says that bodies are redacted already.
    """
    joined = tickets.join(answer_bounds(tickets, comments), "ticket_id", "left")
    if not transcript:
        counts = comments.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("comment_count"))
        joined = joined.join(counts, "ticket_id", "left")
    else:
        joined = joined.join(transcripts(comments), "ticket_id", "left")
    if not masked:
        joined = joined.withColumns({c: redact(F.col(c)) for c in ("customer_issue", "agent_resolution")})
    return joined.withColumn("comment_count", F.coalesce("comment_count", F.lit(0)))


def assemble_arrays(tickets: DataFrame, threads: DataFrame) -> DataFrame:
    """``assemble_threads`` for landed threads (ticket_id, comments array), same columns.

    Everything is computed from the array in its own order, row by row.
    """
    shown = F.filter(
        "comments",
        lambda c: F.coalesce(c["public"], F.lit(True)) & ~is_blank(c["plain_body"]),
    )

    def by(author: Column) -> Column:
        wanted = F.when(author != 0, author)
        return F.filter("_shown", lambda c: c["author_id"] == wanted)

    def body(found: Column, place: int) -> Column:
        return redact(strip(F.try_element_at(found, F.lit(place))["plain_body"]))

    lines = F.transform(
        "comments",
        lambda c: comment_line(c["author_id"], c["created_at"], redact(c["plain_body"])),
    )
    count = F.coalesce(F.size("comments"), F.lit(0)).cast("bigint")
    return (
        tickets.join(threads, "ticket_id", "left")
        .withColumn("_shown", shown)
        .withColumn("customer_issue", body(by(F.col("requester_id")), 1))
        .withColumn("agent_resolution", body(by(F.col("assignee_id")), -1))
        .withColumn("comment_count", F.when(count > 0, count).otherwise(F.lit(0)))
        .withColumn(
            "transcript",
            F.when(F.col("comment_count") > 0, F.array_join(lines, "\n")),
        )
        .drop("comments", "_shown")
    )
