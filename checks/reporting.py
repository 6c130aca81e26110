"""Aggregations, shares and the dashboard."""

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import (
    ANALYSED,
    COMMENTS,
    PICKS,
    THREADS,
    TICKETS,
    clean,
    line,
    query,
    redact,
)
from threadlens import standins as S
from threadlens.functions.text import redact as redact_column
from threadlens.operators import assemble, breakdowns, deflection, threads
from threadlens.plans.report import report

VERDICT = f"nullif(regexp_extract({clean('self_service_analysis')}, 'Self Service Possible\\?: (Yes|No)', 1), '')"
CORRECT = "CASE WHEN bot_correct IN ('Yes', 'No') THEN bot_correct END"
PCT = "format('{:.1f}', (n / sum(n) OVER ()) * 100)"
DIM_PCT = "format('{:.1f}', (n / sum(n) OVER (PARTITION BY dim)) * 100)"


def shares(label: str, columns="label, n, pct, caption") -> str:
    return f"""WITH {ANALYSED}, n AS (SELECT {label} AS label, count(*) AS n FROM analysed
      WHERE {label} IS NOT NULL GROUP BY 1),
    s AS (SELECT label, n, CAST({PCT} AS DOUBLE) AS pct FROM n)
    SELECT {columns} FROM (SELECT *, CASE WHEN pct > 0 THEN n || ' (' || CAST(pct AS DECIMAL(10,1)) || '%)' ELSE '' END AS caption FROM s)"""


@query("a1_total_tickets", f"WITH {ANALYSED} SELECT count(*) AS tickets FROM analysed")
def a1(spark, d):
    return deflection.total_count(S.analysed(spark, d), "tickets")


@query("a2_label_counts", "SELECT 'event_type' AS dim, event_type AS label, count(*) AS n FROM events GROUP BY 2")
def a2(spark, d):
    events = S.table(spark, d, "events")
    return breakdowns.label_counts(events, {"event_type": F.col("event_type")})


@query(
    "a3_label_shares",
    f"""SELECT event_type AS label, n, CAST({PCT} AS DOUBLE) AS pct
    FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""",
)
def a3(spark, d):
    events = S.table(spark, d, "events")
    return breakdowns.breakdown(events, F.col("event_type")).drop("caption")


@query(
    "a4_first_customer_comment",
    f"WITH {TICKETS}, {COMMENTS}, {PICKS} SELECT ticket_id, {redact('body')} AS customer_issue FROM issues",
)
def a4(spark, d):
    rows = threads.answer_bounds(S.tickets(spark, d), S.comments(spark, d))
    rows = rows.where(F.col("customer_issue").isNotNull())
    return rows.select("ticket_id", redact_column(F.col("customer_issue")).alias("customer_issue"))


@query(
    "a5_last_agent_comment",
    f"WITH {TICKETS}, {COMMENTS}, {PICKS} SELECT ticket_id, {redact('body')} AS agent_resolution FROM finals",
)
def a5(spark, d):
    rows = threads.answer_bounds(S.tickets(spark, d), S.comments(spark, d))
    rows = rows.where(F.col("agent_resolution").isNotNull())
    return rows.select("ticket_id", redact_column(F.col("agent_resolution")).alias("agent_resolution"))


@query(
    "a6_transcript",
    f"""WITH {COMMENTS} SELECT ticket_id, count(*) AS comment_count,
      string_agg({line()}, chr(10) ORDER BY pos) AS transcript FROM comments GROUP BY ticket_id""",
)
def a6(spark, d):
    return threads.transcripts(S.comments(spark, d))


@query(
    "a6_transcript_parts",
    f"""WITH {COMMENTS} SELECT ticket_id, pos // 3 AS part,
      string_agg({line()}, chr(10) ORDER BY pos) AS transcript FROM comments GROUP BY ticket_id, pos // 3""",
)
def a6_parts(spark, d):
    return threads.transcript_parts(S.comments(spark, d), part_comments=3)


@query("a7_verdict_breakdown", shares(VERDICT))
def a7(spark, d):
    rows = S.analysed(spark, d)
    return breakdowns.breakdown(rows, breakdowns.dimension_labels(rows)["self_service"])


@query("a8_correctness_breakdown", shares(CORRECT))
def a8(spark, d):
    rows = S.analysed(spark, d)
    return breakdowns.breakdown(rows, breakdowns.dimension_labels(rows)["bot_correct"])


@query("a9_sentiment_breakdown", shares(clean("sentiment")))
def a9(spark, d):
    rows = S.analysed(spark, d)
    return breakdowns.breakdown(rows, breakdowns.dimension_labels(rows)["sentiment"])


@query("a10_theme_breakdown", shares(clean("theme")))
def a10(spark, d):
    rows = S.analysed(spark, d)
    return breakdowns.breakdown(rows, breakdowns.dimension_labels(rows)["theme"])


@query("a11_drill_size", f"WITH {ANALYSED} SELECT count(*) AS tickets FROM analysed WHERE {VERDICT} = 'No'")
def a11(spark, d):
    return deflection.total_count(breakdowns.drilldown(S.analysed(spark, d), "self_service", "No"), "tickets")


@query(
    "a12_summary_batches",
    """SELECT batch, count(*) AS tickets, '{' || string_agg('"' || doc_id || '":"' || lang || '"', ',' ORDER BY doc_id) || '}' AS summaries
    FROM (SELECT 7919 * doc_id AS doc_id, lang, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch FROM documents) GROUP BY 1""",
)
def a12(spark, d):
    """Ids are sparse: batches go by place, not by id."""
    rows = S.table(spark, d, "documents").selectExpr("7919 * doc_id AS ticket_id", "lang AS summary")
    batches = assemble.summary_batches(rows, span=50)
    return batches.select(
        "batch", F.size("summaries").cast("bigint").alias("tickets"), F.to_json("summaries").alias("summaries")
    )


@query(
    "a12_bounded_batches",
    """WITH s AS (SELECT doc_id, length(text) AS own, length(text) > 4000 AS alone FROM documents WHERE text IS NOT NULL),
    placed AS (SELECT doc_id, own, sum(greatest(4000, own * 20)) OVER (ORDER BY doc_id) - greatest(4000, own * 20) AS before FROM s WHERE NOT alone),
    batches AS (SELECT CAST(before // 80000 AS BIGINT) AS batch, doc_id, own FROM placed UNION ALL SELECT -doc_id - 1, doc_id, own FROM s WHERE alone)
    SELECT batch, count(*) AS tickets, CAST(sum(own) AS BIGINT) AS characters, min(doc_id) AS first_id, max(doc_id) AS last_id,
      count(*) <= 20 AND (sum(own) <= 8000 OR count(*) = 1) AS bounded FROM batches GROUP BY batch""",
)
def a12_bounded(spark, d):
    rows = S.table(spark, d, "documents").selectExpr("doc_id AS ticket_id", "text AS summary")
    batches = assemble.summary_batches(rows, span=20, characters=8000).withColumn("ids", F.transform(F.map_keys("summaries"), lambda k: k.cast("long")))
    size = F.aggregate(F.map_values("summaries"), F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    tickets = F.size("ids").cast("long")
    return batches.withColumn("characters", size).select(
        "batch", tickets.alias("tickets"), "characters", F.array_min("ids").alias("first_id"), F.array_max("ids").alias("last_id"),
        ((tickets <= 20) & ((F.col("characters") <= 8000) | (tickets == 1))).alias("bounded"),
    )


@query(
    "a13_daily_conversations",
    """SELECT CAST(ts AS DATE) AS day, count(*) AS conversations FROM events
    WHERE ts >= TIMESTAMP '2024-01-05 12:00:00' AND ts <= TIMESTAMP '2024-01-25 12:00:00' GROUP BY 1""",
)
def a13(spark, d):
    window = dt.datetime(2024, 1, 5, 12), dt.datetime(2024, 1, 25, 12)
    return deflection.daily_counts(deflection.between(S.activity(spark, d), *window))


@query(
    "a14_article_views",
    "SELECT count(*) AS views FROM events WHERE event_type = 'view' AND ts >= TIMESTAMP '2024-01-15 00:00:00'",
)
def a14(spark, d):
    views = deflection.between(S.article_views(spark, d), dt.datetime(2024, 1, 15))
    return deflection.total_count(views, "views")


_DEFLECTION = """SELECT k AS conversations, n AS tickets, CAST(format('{:.1f}', (k / n) * 100) AS DOUBLE) AS pct,
      CASE WHEN n = 0 THEN 'N/A' ELSE k || '/' || n || ' (' || format('{:.1f}', (k / n) * 100) || '%)' END AS deflection"""


@query(
    "a15_deflection",
    f"""{_DEFLECTION} FROM (SELECT count(*) AS k FROM events WHERE ts >= TIMESTAMP '2024-01-29' AND ts <= TIMESTAMP '2024-01-30'),
      (SELECT count(*) AS n FROM orders)""",
)
def a15(spark, d):
    day = deflection.between(S.activity(spark, d), dt.datetime(2024, 1, 29), dt.datetime(2024, 1, 30))
    return deflection.deflection(S.tickets(spark, d), day)


@query(
    "a15_deflection_no_tickets",
    """SELECT count(*) AS conversations, CAST(0 AS BIGINT) AS tickets, CAST(NULL AS DOUBLE) AS pct, 'N/A' AS deflection FROM events""",
)
def a15_none(spark, d):
    none = S.tickets(spark, d).where(F.col("status") == "absent")
    return deflection.deflection(none, S.activity(spark, d))


@query(
    "a16_empty_threads",
    f"""WITH {THREADS} SELECT ticket_id, comment_count,
      CASE WHEN comment_count = 0 THEN 'Ticket has no content.' ELSE '' END AS summary,
      'Error processing ticket: ' || CASE WHEN comment_count = 0 THEN 'No content' ELSE 'no reply' END AS self_service_analysis
    FROM threads""",
)
def a16(spark, d):
    rows = threads.assemble_threads(S.tickets(spark, d), S.comments(spark, d), None)
    none = F.lit(None).cast("string")
    parsed = F.struct(
        *[none.alias(n) for n in ("summary", "possible", "reason", "recommendation")],
        F.lit("no reply").alias("error"),
    )
    columns = assemble.analysis_columns(parsed, F.col("comment_count"))
    return rows.withColumns(columns).select("ticket_id", "comment_count", "summary", "self_service_analysis")


_DASHBOARD = f"""WITH {ANALYSED}, labels_ AS (
      SELECT 'self_service' AS dim, {VERDICT} AS label FROM analysed
      UNION ALL SELECT 'bot_correct', {CORRECT} FROM analysed
      UNION ALL SELECT 'sentiment', {clean('sentiment')} FROM analysed
      UNION ALL SELECT 'theme', {clean('theme')} FROM analysed),
    n AS (SELECT dim, label, count(*) AS n FROM labels_ WHERE label IS NOT NULL GROUP BY 1, 2)
    SELECT dim, label, n, CAST({DIM_PCT} AS DOUBLE) AS pct FROM n"""


@query("a17_dashboard", _DASHBOARD)
def a17(spark, d):
    return report(S.analysed(spark, d), S.activity(spark, d), "last-week")["breakdowns"]


@query(
    "a17_dashboard_header",
    f"""SELECT *, 'Last Week' AS timeframe FROM ({_DEFLECTION} FROM (SELECT count(*) AS k FROM events), (SELECT count(*) AS n FROM documents))""",
)
def a17_header(spark, d):
    return report(S.analysed(spark, d), S.activity(spark, d), "last-week")["header"]


@query(
    "w1_share_of_total",
    f"""SELECT dim, label, n, CAST({DIM_PCT} AS DOUBLE) AS pct FROM (
      SELECT 'lang' AS dim, lang AS label, count(*) AS n FROM documents GROUP BY 2
      UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2)""",
)
def w1(spark, d):
    docs = S.table(spark, d, "documents")
    return breakdowns.breakdowns(docs, {"lang": F.col("lang"), "source": F.col("source")})


def _bound(order: str) -> str:
    return f"""WITH {COMMENTS} SELECT ticket_id, pos, author_id, public, plain_body, created_at FROM comments
    WHERE public QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY pos {order}) = 1"""


@query("w2_first_comment_row", _bound("ASC"))
def w2_first(spark, d):
    return threads.first_rows(S.comments(spark, d).where(threads.is_public()))


@query("w2_last_comment_row", _bound("DESC"))
def w2_last(spark, d):
    return threads.last_rows(S.comments(spark, d).where(threads.is_public()))
