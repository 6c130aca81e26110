"""Projections, joins, orders and the mixed result table."""

from pyspark.sql import functions as F

from checks.registry import (
    ANALYSED,
    ANALYSIS_COLUMNS,
    COMMENTS,
    STATUSES,
    THREADS,
    TICKETS,
    clean,
    query,
)
from threadlens import standins as S
from threadlens.functions.dates import ticket_url, timeframe_label
from threadlens.operators import assemble, breakdowns, deflection, threads, tickets
from threadlens.operators.enrich import not_yet_done, with_earlier
from threadlens.sources import shared, snapshots

# --- projections -------------------------------------------------------------

_PROCESSED = f"""{THREADS}, processed AS (
  SELECT ticket_id, CAST(assignee_id AS VARCHAR) AS assignee_id,
         strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, ticket_form_id AS summary,
         'Self Service Possible?: ' || status || chr(10) || chr(10) || 'Reason:' || chr(10) || 'state' AS self_service_analysis,
         coalesce(customer_issue, 'N/A - No customer comment found.') AS bot_answer,
         'N/A' AS bot_correct,
         CASE WHEN agent_resolution IS NULL THEN 'N/A - No agent resolution found.' ELSE 'N/A' END AS bot_correct_reason,
         '' AS theme, '' AS recommendation, 'Neutral' AS sentiment, 'none' AS sentiment_explanation,
         coalesce(customer_issue, '') AS customer_issue
  FROM threads)"""

def processed(spark, d):
    rows = threads.assemble_threads(S.tickets(spark, d), S.comments(spark, d), None)
    block = F.concat(F.lit("Self Service Possible?: "), "status", F.lit("\n\nReason:\nstate"))
    return (
        assemble.comparison_defaults(rows)
        .withColumns(
            {
                "summary": F.col("ticket_form_id"),
                "self_service_analysis": block,
                "bot_answer": F.coalesce("customer_issue", F.lit(assemble.NO_CUSTOMER_COMMENT)),
                "recommendation": F.lit(None).cast("string"),
                "sentiment": F.lit("Neutral"),
                "sentiment_explanation": F.lit("none"),
            }
        )
    )

@query("p1_result_columns", f"WITH {_PROCESSED} SELECT {ANALYSIS_COLUMNS} FROM processed")
def p1(spark, d):
    return assemble.result_rows(processed(spark, d))

_FAILED = f"""{_PROCESSED}, failed AS (
  SELECT ticket_id, assignee_id, created_at,
         'Error processing ticket: state ' || (SELECT status FROM tickets t WHERE t.ticket_id = p.ticket_id) AS summary,
         'N/A' AS self_service_analysis, bot_answer, bot_correct, bot_correct_reason, theme,
         recommendation, 'N/A' AS sentiment, 'N/A' AS sentiment_explanation, '' AS customer_issue
  FROM processed p)"""

@query("p2_error_rows", f"WITH {_FAILED} SELECT {ANALYSIS_COLUMNS} FROM failed")
def p2(spark, d):
    rows = processed(spark, d).withColumn("error", F.concat(F.lit("state "), "status"))
    return assemble.failed_rows(rows)

@query(
    "u0_mixed_rows",
    f"""WITH {_FAILED}
    SELECT {ANALYSIS_COLUMNS} FROM processed JOIN (SELECT ticket_id FROM tickets WHERE status <> 'P') USING (ticket_id)
    UNION ALL
    SELECT {ANALYSIS_COLUMNS} FROM failed JOIN (SELECT ticket_id FROM tickets WHERE status = 'P') USING (ticket_id)
    UNION ALL
    SELECT ticket_id, NULL, NULL, 'Error: ' || ticket_form_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
    FROM tickets WHERE status = 'P'""",
)
def u0(spark, d):
    rows = shared.materialise(processed(spark, d), "processed")
    rows = rows.withColumn("error", F.concat(F.lit("state "), "status"))
    good = assemble.result_rows(rows.where(F.col("status") != "P"))
    bad = rows.where(F.col("status") == "P")
    lost = bad.select("ticket_id", F.concat(F.lit("Error: "), "ticket_form_id").alias("summary"))
    return good.unionByName(assemble.failed_rows(bad)).unionByName(lost, allowMissingColumns=True)

@query(
    "p3_drill_columns",
    f"WITH {ANALYSED} SELECT ticket_id, customer_issue, bot_correct, bot_correct_reason FROM analysed WHERE bot_correct = 'No'",
)
def p3(spark, d):
    columns = breakdowns.DRILL_COLUMNS["bot_correct"]
    return breakdowns.drilldown(S.analysed(spark, d), "bot_correct", "No", columns)

@query(
    "p4_ticket_url",
    "SELECT o_orderkey AS ticket_id, 'https://desk.example.com/agent/tickets/' || o_orderkey AS url FROM orders",
)
def p4(spark, d):
    return S.tickets(spark, d).select(
        "ticket_id", ticket_url(F.col("ticket_id"), "https://desk.example.com/").alias("url")
    )

@query(
    "p5_default_fill",
    f"""WITH {ANALYSED} SELECT ticket_id, coalesce({clean('bot_correct')}, 'N/A') AS bot_correct,
      coalesce({clean('theme')}, '') AS theme, 'Unassigned' AS assignee, 'Unknown' AS created FROM analysed""",
)
def p5(spark, d):
    from threadlens.functions.labels import nullify_na

    none = F.lit(None)
    return S.analysed(spark, d).select(
        "ticket_id",
        F.coalesce(nullify_na(F.col("bot_correct")), F.lit("N/A")).alias("bot_correct"),
        F.coalesce(nullify_na(F.col("theme")), F.lit("")).alias("theme"),
        tickets.assignee_text(none).alias("assignee"),
        tickets.created_text(none.cast("timestamp")).alias("created"),
    )

@query(
    "p6_theme_counts",
    f"""WITH {ANALYSED} SELECT {clean('theme')} AS theme, count(*) AS ticket_count FROM analysed
    WHERE {clean('theme')} IS NOT NULL GROUP BY 1""",
)
def p6(spark, d):
    return breakdowns.theme_counts(S.analysed(spark, d))

@query("p7_id_text", "SELECT o_orderkey AS ticket_id, CAST(o_orderkey AS VARCHAR) AS ticket_key FROM orders")
def p7(spark, d):
    rows = S.tickets(spark, d).select("ticket_id", F.col("ticket_id").cast("string").alias("ticket_key"))
    # Back again without failing on text that is no number.
    return rows.select(F.expr("try_cast(ticket_key AS BIGINT)").alias("ticket_id"), "ticket_key")

@query(
    "p8_timeframe_label",
    """SELECT ticket_id, CASE name WHEN '24hr' THEN '24Hr' WHEN 'last-week' THEN 'Last Week' ELSE 'Last Month' END AS timeframe
    FROM (SELECT o_orderkey AS ticket_id, CASE WHEN o_orderdate >= TIMESTAMP '2001-07-30' THEN '24hr'
            WHEN o_orderdate >= TIMESTAMP '2001-07-24' THEN 'last-week' ELSE 'last-month' END AS name FROM orders)""",
)
def p8(spark, d):
    name = (
        F.when(tickets.created_within(S.AS_OF, 1), "24hr")
        .when(tickets.created_within(S.AS_OF, 7), "last-week")
        .otherwise("last-month")
    )
    return S.tickets(spark, d).select("ticket_id", timeframe_label(name).alias("timeframe"))

# --- joins -------------------------------------------------------------------

@query("j1_ticket_threads", f"WITH {THREADS} SELECT * FROM threads WHERE status IN ({STATUSES})")
def j1(spark, d):
    chosen = S.tickets(spark, d).where(tickets.finished(S.FINISHED))
    return threads.assemble_threads(chosen, S.comments(spark, d))

@query(
    "j2_attach_themes",
    """SELECT o.o_orderkey AS ticket_id, coalesce(d.source, 'N/A') AS theme
    FROM orders o LEFT JOIN documents d ON d.doc_id = o.o_orderkey""",
)
def j2(spark, d):
    themes = S.table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("ticket_key"), F.col("source").alias("theme")
    )
    return assemble.assign_themes(S.tickets(spark, d), themes).select("ticket_id", "theme")

@query(
    "j3_input_order",
    f"""WITH {COMMENTS} SELECT ticket_id, pos, length(plain_body) AS chars FROM comments ORDER BY ticket_id, pos""",
)
def j3(spark, d):
    base = S.comments(spark, d).select("ticket_id", "pos")
    results = S.comments(spark, d).select("ticket_id", "pos", F.length("plain_body").cast("bigint").alias("chars"))
    return base.join(results, ["ticket_id", "pos"], "left").orderBy("ticket_id", "pos")

@query(
    "j4_totals_pair",
    "SELECT (SELECT count(*) FROM orders) AS tickets, (SELECT count(*) FROM events) AS conversations",
)
def j4(spark, d):
    return deflection.deflection(S.tickets(spark, d), S.activity(spark, d)).select("tickets", "conversations")

@query(
    "j5_form_lookup",
    """SELECT o_orderkey AS ticket_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' ELSE 'high' END AS form_name
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def j5(spark, d):
    forms = S.words(
        spark,
        [("urgent", "1-URGENT"), ("high", "2-HIGH"), ("low", "5-LOW")],
        "form_name STRING, ticket_form_id STRING",
    )
    return tickets.select_by_names(S.tickets(spark, d), forms, ["urgent", "high"]).select(
        "ticket_id", "form_name"
    )

@query(
    "j6_not_yet_done",
    f"WITH {TICKETS} SELECT ticket_id, status FROM tickets WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = ticket_id)",
)
def j6(spark, d):
    done = S.analysed(spark, d)
    return not_yet_done(S.tickets(spark, d), done).select("ticket_id", "status")

@query(
    "j6_incremental_union",
    f"""WITH {ANALYSED}, fresh AS (SELECT * REPLACE ('checked again' AS theme) FROM analysed WHERE bot_correct <> 'N/A')
    SELECT ticket_id, theme, summary FROM fresh
    UNION ALL SELECT ticket_id, theme, summary FROM analysed WHERE ticket_id NOT IN (SELECT ticket_id FROM fresh)""",
)
def j6_union(spark, d):
    earlier = S.analysed(spark, d)
    fresh = earlier.where(F.col("bot_correct") != "N/A").withColumn("theme", F.lit("checked again"))
    return with_earlier(fresh, earlier).select("ticket_id", "theme", "summary")

# --- orders and limits -------------------------------------------------------

@query(
    "o1_label_order",
    f"""WITH {ANALYSED}, n AS (SELECT {clean('theme')} AS label, count(*) AS n FROM analysed
      WHERE {clean('theme')} IS NOT NULL GROUP BY 1)
    SELECT label, n FROM n ORDER BY n DESC, label""",
)
def o1(spark, d):
    from threadlens.functions.labels import nullify_na

    return breakdowns.breakdown(S.analysed(spark, d), nullify_na(F.col("theme"))).select("label", "n")

@query("o2_newest_snapshot", f"WITH {ANALYSED} SELECT count(*) AS tickets, 'newest' AS theme FROM analysed")
def o2(spark, d):
    path = shared.new_path(spark, "snapshots")
    rows = S.analysed(spark, d)
    for stamp, theme in (("20240301_000000", "newest"), ("20240229_235959", "older")):
        snapshots.write_snapshot(rows.withColumn("theme", F.lit(theme)), path, stamp)
    latest = snapshots.read_latest_snapshot(spark, path)
    return latest.groupBy("theme").agg(F.count(F.lit(1)).alias("tickets"))

@query(
    "o3_last_match",
    """SELECT conv_id AS ticket_id, turn AS pos, text AS plain_body FROM conversations WHERE role = 'assistant'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
)
def o3(spark, d):
    rows = S.table(spark, d, "conversations").where(F.col("role") == "assistant")
    rows = rows.select(F.col("conv_id").alias("ticket_id"), F.col("turn").alias("pos"), F.col("text").alias("plain_body"))
    return threads.last_rows(rows)

@query(
    "o5_export_order",
    f"WITH {COMMENTS} SELECT ticket_id, pos, plain_body FROM comments ORDER BY ticket_id, pos",
)
def o5(spark, d):
    return S.comments(spark, d).select("ticket_id", "pos", "plain_body").orderBy("ticket_id", "pos")

