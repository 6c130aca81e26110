"""Query registry and SQL fragments shared by the counterparts."""

from __future__ import annotations

from collections.abc import Callable

from threadlens import standins
from threadlens.functions.labels import NA_TOKENS
from threadlens.functions.text import WHITESPACE

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: str) -> str:
    cells = [
        "(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    ]
    return f"(SELECT * FROM (VALUES {', '.join(cells)}) v({columns}))"


def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITESPACE)})"


def email(x: str) -> str:
    return rf"regexp_replace({x}, '[\p{{L}}\p{{N}}_.\-]+@[\p{{L}}\p{{N}}_.\-]+', '[REDACTED EMAIL]', 'g')"


def phone(x: str) -> str:
    return (
        rf"regexp_replace({x}, '\(?\b\p{{Nd}}{{3}}\)?[-.\s\p{{Z}}]?\p{{Nd}}{{3}}[-.\s\p{{Z}}]?\p{{Nd}}{{4}}\b',"
        " '[REDACTED PHONE]', 'g')"
    )


def redact(x: str) -> str:
    return phone(email(x))


def tokens(x: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+'), "
        "lambda t: t <> '')"
    )


def clean(x: str) -> str:
    """Missing tokens to NULL."""
    return f"CASE WHEN {x} NOT IN ({', '.join(map(lit, NA_TOKENS))}) THEN {x} END"


def line(author="author_id", ts="created_at", body="plain_body") -> str:
    return (
        f"'Comment by ' || coalesce(CAST({author} AS VARCHAR), 'None') || ' at ' || "
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ') || ':' || chr(10) || {redact(f'coalesce({body}, {lit('')})')}"
    )


TICKETS = """tickets AS (
  SELECT o_orderkey AS ticket_id, o_orderkey * 10 + 1 AS requester_id,
         o_orderkey * 10 + 2 AS assignee_id, o_orderdate AS created_at,
         o_orderstatus AS status, o_orderpriority AS ticket_form_id,
         CAST(NULL AS VARCHAR) AS theme
  FROM orders)"""

COMMENTS = """comments AS (
  SELECT conv_id AS ticket_id, turn AS pos,
         conv_id * 10 + CASE role WHEN 'user' THEN 1 WHEN 'assistant' THEN 2
                                  WHEN 'system' THEN 3 ELSE 0 END AS author_id,
         role <> 'system' AS public, text AS plain_body,
         TIMESTAMP '2024-01-01 00:00:00' + turn * INTERVAL 1 MINUTE AS created_at
  FROM conversations)"""

ANALYSED = """analysed AS (
  SELECT d.doc_id AS ticket_id, 'Unassigned' AS assignee_id,
         '2024-01-01T00:00:00Z' AS created_at, text AS summary,
         CASE WHEN quality = 1 THEN 'Self Service Possible?: Yes' || chr(10) || chr(10) || 'Reason:' || chr(10) || 'quality mark'
              WHEN quality = 0 THEN 'Self Service Possible?: Not sure' || chr(10) || chr(10) || 'Reason:' || chr(10) || 'no quality mark'
              ELSE 'N/A' END AS self_service_analysis,
         '' AS bot_answer,
         CASE WHEN toxic = 0 THEN 'Yes' WHEN toxic = 1 THEN 'No' ELSE 'N/A' END AS bot_correct,
         'None' AS bot_correct_reason,
         CASE WHEN source = 'src0' THEN '' ELSE source END AS theme,
         '' AS recommendation,
         CASE WHEN lang = 'es' THEN 'N/A' ELSE lang END AS sentiment,
         '' AS sentiment_explanation, text AS customer_issue
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

# First public requester text, last public assignee text, by window.
PICKS = f"""bodies AS (
  SELECT c.ticket_id, c.pos, c.author_id, {strip('plain_body')} AS body FROM comments c
  WHERE coalesce(public, TRUE) AND length({strip('plain_body')}) > 0),
issues AS (
  SELECT t.ticket_id, b.body FROM tickets t JOIN bodies b
    ON b.ticket_id = t.ticket_id AND b.author_id = t.requester_id
  QUALIFY row_number() OVER (PARTITION BY t.ticket_id ORDER BY b.pos) = 1),
finals AS (
  SELECT t.ticket_id, b.body FROM tickets t JOIN bodies b
    ON b.ticket_id = t.ticket_id AND b.author_id = t.assignee_id
  QUALIFY row_number() OVER (PARTITION BY t.ticket_id ORDER BY b.pos DESC) = 1)"""

THREADS = f"""{TICKETS}, {COMMENTS}, {PICKS},
scripts AS MATERIALIZED (
  SELECT ticket_id, count(*) AS comment_count, string_agg({line()}, chr(10) ORDER BY pos) AS transcript
  FROM comments GROUP BY ticket_id),
threads AS MATERIALIZED (
  SELECT t.*, {redact('i.body')} AS customer_issue, {redact('f.body')} AS agent_resolution,
         coalesce(s.comment_count, 0) AS comment_count, s.transcript
  FROM tickets t LEFT JOIN issues i USING (ticket_id) LEFT JOIN finals f USING (ticket_id)
       LEFT JOIN scripts s USING (ticket_id))"""

ANALYSIS_COLUMNS = (
    "ticket_id, assignee_id, created_at, summary, self_service_analysis, bot_answer, bot_correct, "
    "bot_correct_reason, theme, recommendation, sentiment, sentiment_explanation, customer_issue"
)
STATUSES = ", ".join(map(lit, standins.FINISHED))
