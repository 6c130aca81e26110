"""Thread assembly: edge rows, long threads, arrays."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from threadlens.operators import threads
from threadlens.operators.tickets import select_tickets
from threadlens.sources.landed import flatten_threads
from threadlens.schemas import COMMENTS, TICKETS

T0 = dt.datetime(2024, 5, 1, 12)

TICKET_ROWS = [
    (1, 10, 20, T0, "solved", 360003888493, None),  # plain thread
    (2, 10, None, T0, "closed", 360003888493, None),  # no assignee
    (3, 0, 0, T0, "solved", 14917317203995, None),  # ids of zero
    (4, 10, 20, T0, "open", 360003888493, None),  # no comments
    (5, 10, 10, T0, "solved", 360003888493, None),  # requester is assignee
]
COMMENT_ROWS = [
    (1, 0, 10, False, "private first", T0),
    (1, 1, 10, True, " \n\t", T0),
    (1, 2, 10, None, "\u2003call 555-123-4567 ", T0),
    (1, 3, 20, True, "first answer", T0),
    (1, 4, 20, True, "last answer to a@b.c", T0),
    (1, 5, 20, False, "internal note", T0),
    (1, 6, 20, True, None, None),
    (2, 0, 10, True, "hello", T0),
    (2, 1, None, True, "system", T0),
    (3, 0, 0, True, "zero author", T0),
    (5, 0, 10, True, "own first", T0),
    (5, 1, 10, True, "own last", T0),
]


@pytest.fixture(scope="module")
def tables(spark):
    return (
        spark.createDataFrame(TICKET_ROWS, TICKETS).cache(),
        spark.createDataFrame(COMMENT_ROWS, COMMENTS).cache(),
    )


def test_edge_rows(tables):
    got = {r["ticket_id"]: r for r in threads.assemble_threads(*tables).collect()}
    assert got[1]["customer_issue"] == "call [REDACTED PHONE]"
    assert got[1]["agent_resolution"] == "last answer to [REDACTED EMAIL]"
    assert got[1]["comment_count"] == 7
    lines = got[1]["transcript"]
    assert lines.startswith("Comment by 10 at 2024-05-01T12:00:00Z:\nprivate first\nComment by 10")
    assert lines.endswith("internal note\nComment by 20 at None:\n")
    assert "call [REDACTED PHONE] \n" in lines
    assert (got[2]["customer_issue"], got[2]["agent_resolution"]) == ("hello", None)
    assert "Comment by None at" in got[2]["transcript"]
    assert (got[3]["customer_issue"], got[3]["agent_resolution"]) == (None, None)
    assert (got[4]["comment_count"], got[4]["transcript"]) == (0, None)
    assert (got[5]["customer_issue"], got[5]["agent_resolution"]) == ("own first", "own last")


def test_arrays_give_the_same(tables):
    tickets, comments = tables
    nested = comments.groupBy("ticket_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("pos", "author_id", "public", "plain_body", "created_at"))),
            lambda c: c.dropFields("pos"),
        ).alias("comments")
    )
    flat = threads.assemble_threads(tickets, comments)
    rows = threads.assemble_arrays(tickets, nested).select(flat.columns)
    assert sorted(rows.collect(), key=lambda r: r[0]) == sorted(flat.collect(), key=lambda r: r[0])
    again = flatten_threads(nested).select(comments.columns)
    assert sorted(again.collect()[:3]) == sorted(comments.collect()[:3])


def test_a_thread_with_a_third_of_all_comments(spark):
    # Ticket 0 has 4000 of 12000 comments; positions carry on past the transcript limit.
    comments = spark.range(12000).select(
        F.when(F.col("id") < 4000, 0).otherwise(1 + F.col("id") % 2000).alias("ticket_id"),
        F.col("id").alias("n"),
    )
    comments = comments.select(
        "ticket_id",
        F.when(F.col("ticket_id") == 0, F.col("n")).otherwise(F.floor(F.col("n") / 2000)).alias("pos"),
        (F.col("n") % 2 + 1).alias("author_id"),
        F.lit(True).alias("public"),
        F.concat(F.lit("text "), F.col("n")).alias("plain_body"),
        F.lit(T0).alias("created_at"),
    )
    whole = {r[0]: r for r in threads.transcripts(comments).collect()}
    assert whole[0]["comment_count"] == 4000
    assert [int(t.split("\n")[0]) for t in whole[0]["transcript"].split("text ")[1:]] == list(range(4000))
    assert whole[1]["transcript"].count("Comment by") == whole[1]["comment_count"]

    parts = threads.transcript_parts(comments, part_comments=300)
    hot = parts.where("ticket_id = 0").orderBy("part").collect()
    assert len(hot) == 14
    text = "\n".join(r["transcript"] for r in hot)
    assert [int(t.split("\n")[0]) for t in text.split("text ")[1:]] == list(range(4000))

    first = {r[0]: r for r in threads.first_rows(comments).collect()}
    last = {r[0]: r for r in threads.last_rows(comments).collect()}
    assert (first[0]["pos"], last[0]["pos"]) == (0, 3999)
    tickets = spark.createDataFrame([(0, 1, 2)], "ticket_id BIGINT, requester_id BIGINT, assignee_id BIGINT")
    row = threads.answer_bounds(tickets, comments).first()
    assert (row["customer_issue"], row["agent_resolution"]) == ("text 0", "text 3999")


def test_selection_is_by_day(tables):
    tickets, _ = tables
    as_of = dt.datetime(2024, 5, 2, 23, 59)
    got = select_tickets(tickets, as_of, "24hr", "account-billing")
    assert sorted(r[0] for r in got.select("ticket_id").collect()) == [1, 2, 5]
    later = select_tickets(tickets, as_of + dt.timedelta(days=1), "24hr", None)
    assert later.count() == 0
