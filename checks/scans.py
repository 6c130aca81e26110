"""Sources, sinks and predicates."""

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import (
    ANALYSED,
    ANALYSIS_COLUMNS,
    COMMENTS,
    PICKS,
    STATUSES,
    THREADS,
    TICKETS,
    clean,
    lit,
    query,
    strip,
)
from threadlens import schemas
from threadlens import standins as S
from threadlens.functions.labels import nullify_na
from threadlens.operators import assemble, breakdowns, deflection, threads, tickets
from threadlens.sources import errors, landed, shared, snapshots

# --- sources and sinks -------------------------------------------------------


@query(
    "s1_ticket_scan",
    f"""WITH {TICKETS} SELECT * FROM tickets
    WHERE created_at >= TIMESTAMP '2001-07-01 00:00:00' AND status IN ({STATUSES})
      AND ticket_form_id = {lit(S.FORM)}""",
)
def s1(spark, d):
    return tickets.select_tickets(S.tickets(spark, d), S.AS_OF, "last-month", S.FORM, S.FINISHED)


@query("s2_comment_scan", f"WITH {COMMENTS} SELECT * FROM comments")
def s2(spark, d):
    return S.comments(spark, d)


def _landed_threads(spark, d):
    """Threads as JSON lines, one per ticket; every tenth ticket's line is broken off."""
    comment = F.struct("pos", "author_id", "public", "plain_body", "created_at")
    threads_ = S.comments(spark, d).groupBy("ticket_id").agg(F.sort_array(F.collect_list(comment)).alias("c"))
    columns = "author_id", "public", "plain_body", "created_at"
    kept = F.transform("c", lambda c: F.struct(*[c[n].alias(n) for n in columns])).alias("comments")
    line = F.to_json(F.struct("ticket_id", kept))
    broken = F.concat(F.lit('{"ticket_id":'), F.col("ticket_id").cast("string"), F.lit(',"comments":[{'))
    path = shared.new_path(spark, "landed")
    threads_.select(F.when(F.col("ticket_id") % 10 == 3, broken).otherwise(line)).write.text(path)
    return path


@query(
    "s2_landed_comments",
    f"""WITH {COMMENTS} SELECT ticket_id, row_number() OVER (PARTITION BY ticket_id ORDER BY pos) - 1 AS pos, author_id, public, plain_body,
      strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created FROM comments WHERE ticket_id % 10 <> 3""",
)
def s2_landed(spark, d):
    comments = landed.read_comments(spark, _landed_threads(spark, d))
    return comments.withColumn("created", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("created_at")


@query(
    "s2_bad_lines",
    """SELECT DISTINCT CAST(NULL AS BIGINT) AS ticket_id, 'threads' AS stage, 'BadRecord' AS error_class,
      'BadRecord: {"ticket_id":' || conv_id || ',"comments":[{' AS message FROM conversations WHERE conv_id % 10 = 3""",
)
def s2_bad(spark, d):
    """Broken lines of the landed threads, in the error log once though logged twice."""
    broken = landed.bad_lines(spark, _landed_threads(spark, d), schemas.THREADS, "threads")
    path = shared.new_path(spark, "errors")
    for _ in range(2):
        errors.log_errors(broken, path, "run", "threads")
    return errors.read_errors(spark, path, "run").drop("ts")


@query(
    "s2_threads_as_arrays",
    f"""WITH {THREADS} SELECT ticket_id, customer_issue, agent_resolution, comment_count, transcript FROM threads WHERE ticket_id % 10 <> 3 AND comment_count > 0""",
)
def s2_arrays(spark, d):
    """Opening and final comments and transcript straight from landed arrays."""
    found = threads.assemble_arrays(S.tickets(spark, d), landed.read_threads(spark, _landed_threads(spark, d)))
    return found.where(F.col("comment_count") > 0).select(
        "ticket_id", "customer_issue", "agent_resolution", F.col("comment_count").cast("bigint").alias("comment_count"), "transcript"
    )


_TEXTS = [c for c in ANALYSIS_COLUMNS.split(", ") if c != "ticket_id"]


@query(
    "s3_csv_scan",
    f"WITH {ANALYSED} SELECT ticket_id, "
    + ", ".join(f"{clean(c)} AS {c}" for c in _TEXTS)
    + " FROM analysed",
)
def s3(spark, d):
    path = shared.new_path(spark, "export")
    snapshots.write_csv(S.analysed(spark, d), path)
    return snapshots.read_csv(spark, path)


@query("s4_csv_sink", f"WITH {ANALYSED} SELECT {ANALYSIS_COLUMNS} FROM analysed")
def s4(spark, d):
    path = shared.new_path(spark, "export")
    snapshots.write_csv(S.analysed(spark, d), path)
    return snapshots.read_csv(spark, path, missing_to_null=False)


def _two_runs(spark, d, half_written=False):
    path = shared.new_path(spark, "snapshots")
    rows = S.analysed(spark, d)
    snapshots.write_snapshot(rows.limit(5), path, "20240101_090000")
    # The same run once more replaces the first; a newer one is left half-written.
    snapshots.write_snapshot(rows, path, "20240101_090000")
    snapshots.write_snapshot(rows.withColumn("theme", F.lit("later")), path, "20240102_090000")
    if half_written:
        rows.limit(3).write.parquet(f"{path}/{snapshots.STAMP}=20240103_090000")
    return path


@query(
    "s5_snapshot_write",
    f"""WITH {ANALYSED} SELECT snapshot_ts, count(*) AS tickets, count(DISTINCT ticket_id) AS ids
    FROM analysed, (VALUES ('20240101_090000'), ('20240102_090000')) v(snapshot_ts)
    GROUP BY snapshot_ts""",
)
def s5(spark, d):
    runs = spark.read.parquet(_two_runs(spark, d))
    return runs.groupBy(F.col("snapshot_ts").cast("string").alias("snapshot_ts")).agg(
        F.count(F.lit(1)).alias("tickets"), F.countDistinct("ticket_id").alias("ids")
    )


@query(
    "s6_latest_snapshot",
    f"WITH {ANALYSED} SELECT {ANALYSIS_COLUMNS.replace('theme', lit('later') + ' AS theme')} FROM analysed",
)
def s6(spark, d):
    return snapshots.read_latest_snapshot(spark, _two_runs(spark, d, half_written=True))


@query("s7_chosen_snapshot", f"WITH {ANALYSED} SELECT {ANALYSIS_COLUMNS} FROM analysed")
def s7(spark, d):
    return snapshots.read_snapshot(spark, _two_runs(spark, d), "20240101_090000")


_START, _END = dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20)


@query(
    "s8_activity_scan",
    f"""SELECT CAST(event_id AS VARCHAR) AS conversation_id, ts FROM events
    WHERE ts >= TIMESTAMP '{_START}' AND ts <= TIMESTAMP '{_END}'""",
)
def s8(spark, d):
    return deflection.between(S.activity(spark, d), _START, _END)


@query(
    "s9_article_view_scan",
    f"""SELECT CAST(event_id AS VARCHAR) AS event_id, ts FROM events
    WHERE event_type = 'view' AND ts >= TIMESTAMP '{_START}'""",
)
def s9(spark, d):
    return deflection.between(S.article_views(spark, d), _START)


@query(
    "s8_landed_activity",
    f"""SELECT CAST(event_id AS VARCHAR) AS conversation_id, epoch_us(ts) AS micros FROM events
    WHERE ts >= TIMESTAMP '{_START}' AND ts <= TIMESTAMP '{_END}'""",
)
def s8_landed(spark, d):
    path = shared.new_path(spark, "activity")
    landed.land_events(S.activity(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), path, "parquet")
    found = landed.read_activity(spark, path, _START, _END, "parquet")
    return found.select("conversation_id", F.unix_micros("ts").alias("micros"))


@query(
    "s9_landed_views",
    f"""SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) AS micros FROM events
    WHERE event_type = 'view' AND ts >= TIMESTAMP '{_START}'""",
)
def s9_landed(spark, d):
    """Article views landed as JSON in a folder per day; only days since the start are read."""
    path = shared.new_path(spark, "views")
    landed.land_events(S.article_views(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), path)
    found = landed.read_article_views(spark, path, _START)
    return found.select("event_id", F.unix_micros("ts").alias("micros"))


@query(
    "s10_error_log",
    """SELECT event_id AS ticket_id, 'bot' AS stage, 'HTTPError' AS error_class,
       'HTTPError: ' || props AS message, count(*) OVER (PARTITION BY event_id) AS times
    FROM events, (VALUES (1), (2)) v(run) WHERE event_type = 'error'""",
)
def s10(spark, d):
    rows = S.table(spark, d, "events").withColumnRenamed("event_id", "ticket_id")
    message = F.when(F.col("event_type") == "error", F.concat(F.lit("HTTPError: "), "props"))
    failed = errors.error_rows(rows, "bot", message, F.col("ts"))
    path = shared.new_path(spark, "errors")
    for run in ("first", "second", "second"):  # a run that is done again logs nothing twice
        errors.log_errors(failed, path, run, "bot")
    logged = errors.read_errors(spark, path)
    times = logged.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("times"))
    return logged.drop("ts").join(times, "ticket_id")


# --- predicates --------------------------------------------------------------


@query(
    "r1_created_window",
    """SELECT o_orderkey AS ticket_id, o_orderdate AS created_at FROM orders
    WHERE o_orderdate >= TIMESTAMP '2001-07-24 00:00:00'""",
)
def r1(spark, d):
    rows = S.tickets(spark, d).where(tickets.created_within(S.AS_OF, 7))
    return rows.select("ticket_id", "created_at")


@query(
    "r2_finished_status",
    f"SELECT o_orderkey AS ticket_id, o_orderstatus AS status FROM orders WHERE o_orderstatus IN ({STATUSES})",
)
def r2(spark, d):
    return S.tickets(spark, d).where(tickets.finished(S.FINISHED)).select("ticket_id", "status")


@query(
    "r3_form_type",
    f"""WITH {TICKETS} SELECT ticket_id, ticket_form_id FROM tickets
    WHERE created_at >= TIMESTAMP '2001-07-30 00:00:00' AND status IN ({STATUSES})
      AND ticket_form_id = '2-HIGH'""",
)
def r3(spark, d):
    rows = tickets.select_tickets(S.tickets(spark, d), S.AS_OF, "24hr", "2-HIGH", S.FINISHED)
    return rows.select("ticket_id", "ticket_form_id")


@query("r4_public_comments", f"WITH {COMMENTS} SELECT ticket_id, pos FROM comments WHERE coalesce(public, TRUE)")
def r4(spark, d):
    return S.comments(spark, d).where(threads.is_public()).select("ticket_id", "pos")


@query(
    "r5_author_roles",
    f"""WITH {TICKETS}, {COMMENTS}, {PICKS}
    SELECT coalesce(i.ticket_id, f.ticket_id) AS ticket_id, i.body AS customer_issue,
           f.body AS agent_resolution
    FROM issues i FULL JOIN finals f ON f.ticket_id = i.ticket_id""",
)
def r5(spark, d):
    return threads.answer_bounds(S.tickets(spark, d), S.comments(spark, d))


@query(
    "r6_non_blank_bodies",
    f"""WITH {COMMENTS} SELECT ticket_id, pos, {strip('plain_body')} AS plain_body FROM comments
    WHERE coalesce(public, TRUE) AND length({strip('plain_body')}) > 0""",
)
def r6(spark, d):
    return threads.public_bodies(S.comments(spark, d)).select("ticket_id", "pos", "plain_body")


@query(
    "r7_label_domain",
    f"WITH {ANALYSED} SELECT ticket_id, bot_correct FROM analysed WHERE bot_correct IN ('Yes', 'No')",
)
def r7(spark, d):
    rows = S.analysed(spark, d)
    return rows.where(breakdowns.yes_no(F.col("bot_correct")).isNotNull()).select("ticket_id", "bot_correct")


@query(
    "r8_labelled_rows",
    f"WITH {ANALYSED} SELECT ticket_id, theme FROM analysed WHERE {clean('theme')} IS NOT NULL",
)
def r8(spark, d):
    rows = S.analysed(spark, d)
    return rows.where(nullify_na(F.col("theme")).isNotNull()).select("ticket_id", "theme")


@query(
    "r9_drill_by_label",
    f"WITH {ANALYSED} SELECT {ANALYSIS_COLUMNS} FROM analysed WHERE sentiment = 'fr'",
)
def r9(spark, d):
    return breakdowns.drilldown(S.analysed(spark, d), "sentiment", "fr")


@query(
    "r10_drill_by_text",
    f"""WITH {ANALYSED} SELECT ticket_id, self_service_analysis FROM analysed
    WHERE contains(self_service_analysis, 'Self Service Possible?: No')""",
)
def r10(spark, d):
    return breakdowns.drilldown_by_text(S.analysed(spark, d), "No").select(
        "ticket_id", "self_service_analysis"
    )


@query(
    "r11_theme_input",
    """SELECT page_id AS ticket_id, CASE WHEN page_id % 7 = 3 THEN 'error 404' ELSE html END AS summary FROM pages
    WHERE page_id % 7 <> 2 AND NOT contains(html, 'Error')""",
)
def r11(spark, d):
    """Every seventh summary names an Error and is left out, another an error in small letters."""
    summary = "CASE page_id % 7 WHEN 2 THEN 'Login: Error 500' WHEN 3 THEN 'error 404' ELSE html END AS summary"
    return tickets.theme_input(S.table(spark, d, "pages").selectExpr("page_id AS ticket_id", summary))


# Answers taken from the marks: unmarked documents have no agent answer, one
# language has a bot answer that is a sentinel and one a failed call.
_ANSWERS = """answers AS (
  SELECT d.doc_id AS ticket_id, CASE WHEN l.doc_id IS NOT NULL THEN d.source END AS agent_resolution,
         CASE WHEN lang = 'de' THEN 'N/A - no answer' WHEN lang = 'es' THEN 'Error 500' ELSE lang END AS bot_answer,
         CASE WHEN lang = 'de' THEN 'none' WHEN lang = 'es' THEN 'error' ELSE 'ok' END AS bot_status,
         CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' END AS possible
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def answers(spark, d):
    lang, quality = F.col("lang"), F.col("quality")
    return (
        S.table(spark, d, "documents")
        .join(S.table(spark, d, "labels").withColumn("marked", F.lit(True)), "doc_id", "left")
        .select(
            F.col("doc_id").alias("ticket_id"),
            F.when(F.col("marked"), F.col("source")).alias("agent_resolution"),
            F.when(lang == "de", "N/A - no answer").when(lang == "es", "Error 500").otherwise(lang).alias("bot_answer"),
            F.when(lang == "de", "none").when(lang == "es", "error").otherwise("ok").alias("bot_status"),
            F.when(quality == 1, "Yes").when(quality == 0, "No").alias("possible"),
        )
    )


@query(
    "r12_comparison_gate",
    f"""WITH {_ANSWERS} SELECT ticket_id, bot_answer,
      coalesce(agent_resolution <> '' AND bot_answer <> '' AND bot_answer NOT LIKE 'N/A%', FALSE) AS by_text,
      coalesce(agent_resolution <> '' AND bot_answer <> '' AND bot_status = 'ok', FALSE) AS by_status,
      CASE WHEN coalesce(agent_resolution, '') = '' THEN 'N/A - No agent resolution found.' ELSE 'N/A' END AS bot_correct_reason
    FROM answers""",
)
def r12(spark, d):
    return assemble.comparison_defaults(answers(spark, d)).select(
        "ticket_id",
        "bot_answer",
        assemble.comparable().alias("by_text"),
        assemble.comparable(by_status=True).alias("by_status"),
        "bot_correct_reason",
    )


@query("r13_recommendation_gate", f"WITH {_ANSWERS} SELECT ticket_id, possible FROM answers WHERE possible = 'No'")
def r13(spark, d):
    rows = answers(spark, d)
    return rows.where(assemble.needs_recommendation(F.col("possible"))).select("ticket_id", "possible")


@query(
    "r14_customer_comment_gate",
    f"""WITH {THREADS} SELECT ticket_id, customer_issue,
      CASE WHEN customer_issue IS NULL THEN 'N/A - No customer comment found.' ELSE 'asked' END AS bot_answer
    FROM threads""",
)
def r14(spark, d):
    rows = threads.assemble_threads(S.tickets(spark, d), S.comments(spark, d), None)
    answer = F.when(F.col("customer_issue").isNull(), assemble.NO_CUSTOMER_COMMENT).otherwise("asked")
    return rows.select("ticket_id", "customer_issue", answer.alias("bot_answer"))


@query(
    "r15_missing_column",
    f"""WITH {ANALYSED} SELECT 'sentiment' AS dim, {clean('sentiment')} AS label, count(*) AS n
    FROM analysed WHERE {clean('sentiment')} IS NOT NULL GROUP BY 2""",
)
def r15(spark, d):
    rows = S.analysed(spark, d).drop("theme")
    return breakdowns.label_counts(rows, breakdowns.dimension_labels(rows, ["sentiment", "theme"]))
