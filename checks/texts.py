"""Scalar functions, replies and prompts."""

from pyspark.sql import functions as F

from checks.registry import (
    ANALYSED,
    COMMENTS,
    THREADS,
    clean,
    email,
    line,
    lit,
    phone,
    query,
    redact,
    strip,
)
from threadlens import standins as S
from threadlens.functions import dates, labels, prompts, replies, text
from threadlens.operators import assemble, threads
from threadlens.operators.baselines.entities import mask_spans


def docs(spark, d):
    return S.texts(spark, d, "documents")


def _per_doc(expression: str, name: str) -> str:
    return f"SELECT doc_id, {expression} AS {name} FROM documents"


@query("f1_nullify_na", f"WITH {ANALYSED} SELECT ticket_id, {clean('theme')} AS theme, {clean('sentiment')} AS sentiment, {clean('bot_correct')} AS bot_correct FROM analysed")
def f1(spark, d):
    names = ("theme", "sentiment", "bot_correct")
    return S.analysed(spark, d).select("ticket_id", *[labels.nullify_na(F.col(n)).alias(n) for n in names])


@query("f2_redact_email", _per_doc(email("text"), "masked"))
def f2(spark, d):
    return docs(spark, d).select("doc_id", text.redact_email(F.col("text")).alias("masked"))


@query("f3_redact_phone", _per_doc(phone("text"), "masked"))
def f3(spark, d):
    return docs(spark, d).select("doc_id", text.redact_phone(F.col("text")).alias("masked"))


@query("f4_redact", _per_doc(redact("text"), "masked"))
def f4(spark, d):
    return docs(spark, d).select("doc_id", text.redact(F.col("text")).alias("masked"))


@query(
    "f5_strip",
    "SELECT doc_id, " + strip("chr(10) || chr(160) || text || chr(8195) || chr(9)") + " AS stripped, "
    "length(" + strip("text") + ") = 0 AS blank FROM documents",
)
def f5(spark, d):
    padded = F.concat(F.lit("\n\xa0"), "text", F.lit(" \t"))
    return docs(spark, d).select(
        "doc_id", text.strip(padded).alias("stripped"), text.is_blank(F.col("text")).alias("blank")
    )


@query("f6_prefix", "SELECT doc_id, text LIKE 'The%' AS starts FROM documents")
def f6(spark, d):
    return docs(spark, d).select("doc_id", F.col("text").startswith("The").alias("starts"))


# Replies made of the marks: unmarked documents give no labelled line at all.
_REPLY = """replies AS (
  SELECT d.doc_id, CASE WHEN toxic IS NULL THEN d.text
    ELSE 'Sentiment:  ' || lang || chr(13) || chr(10) || 'Explanation: ' || source || ', ' || n_chars || ' characters ' END AS reply
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def sentiment_replies(spark, d):
    made = F.concat(
        F.lit("Sentiment:  "), "lang", F.lit("\r\nExplanation: "), "source", F.lit(", "),
        F.col("n_chars").cast("string"), F.lit(" characters "),
    )
    rows = docs(spark, d).join(S.table(spark, d, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.when(F.col("toxic").isNull(), F.col("text")).otherwise(made).alias("reply"))


def _field(name: str) -> str:
    pattern = rf"{name}:[\s\p{{Z}}]*([^\n]+)"
    return f"CASE WHEN regexp_matches(reply, {lit(pattern)}) THEN {strip(f'regexp_extract(reply, {lit(pattern)}, 1)')} ELSE 'N/A' END"


@query(
    "f7_sentiment_known",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Angry' WHEN doc_id % 3 = 1 THEN 'angry' ELSE 'N/A' END AS sentiment, doc_id % 3 = 0 AS known
    FROM documents""",
)
def f7_known(spark, d):
    reply = F.when(F.col("doc_id") % 3 == 0, "Sentiment: Angry \nExplanation: x").when(F.col("doc_id") % 3 == 1, "Sentiment:angry")
    label = labels.sentiment_label(reply.otherwise("Mood: Angry"))
    return docs(spark, d).select("doc_id", label.alias("sentiment"), labels.known_sentiment(label).alias("known"))


@query("f7_sentiment_label", f"WITH {_REPLY} SELECT doc_id, {_field('Sentiment')} AS sentiment, FALSE AS known FROM replies")
def f7(spark, d):
    label = labels.sentiment_label(F.col("reply"))
    return sentiment_replies(spark, d).select(
        "doc_id", label.alias("sentiment"), labels.known_sentiment(label).alias("known")
    )


@query("f8_sentiment_explanation", f"WITH {_REPLY} SELECT doc_id, {_field('Explanation')} AS explanation FROM replies")
def f8(spark, d):
    return sentiment_replies(spark, d).select(
        "doc_id", labels.sentiment_explanation(F.col("reply")).alias("explanation")
    )


@query(
    "f9_verdict_extract",
    f"WITH {ANALYSED} SELECT ticket_id, nullif(regexp_extract(self_service_analysis, 'Self Service Possible\\?: (Yes|No)', 1), '') AS verdict FROM analysed",
)
def f9(spark, d):
    return S.analysed(spark, d).select(
        "ticket_id", labels.verdict_label(F.col("self_service_analysis")).alias("verdict")
    )


@query(
    "f10_verdict_block",
    """SELECT doc_id, 'Self Service Possible?: ' || p || chr(10) || chr(10) || 'Reason:' || chr(10) || source
      || CASE WHEN p = 'No' THEN chr(10) || 'Recommendation: ' || lang ELSE '' END AS block
    FROM (SELECT d.*, CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE 'N/A' END AS p
          FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
)
def f10(spark, d):
    rows = docs(spark, d).join(S.table(spark, d, "labels"), "doc_id", "left")
    possible = F.when(F.col("quality") == 1, "Yes").when(F.col("quality") == 0, "No").otherwise("N/A")
    return rows.select(
        "doc_id", labels.format_verdict(possible, F.col("source"), F.col("lang")).alias("block")
    )


@query(
    "f11_comment_line",
    f"WITH {COMMENTS}, c AS (SELECT ticket_id, pos, CASE WHEN public THEN author_id END AS author_id, created_at, plain_body FROM comments) SELECT ticket_id, pos, {line()} AS line FROM c",
)
def f11(spark, d):
    author = F.when(F.col("public"), F.col("author_id"))
    body = text.redact(F.col("plain_body"))
    return S.comments(spark, d).select(
        "ticket_id", "pos", text.comment_line(author, F.col("created_at"), body).alias("line")
    )


# --- replies in JSON: marked toxic = error reply, unmarked = cut off ---------

_JSON = """j AS (
  SELECT d.doc_id, quality, toxic, lang, source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""
_BAD = "CASE WHEN quality IS NULL THEN 'Failed to decode JSON from the reply.' WHEN toxic = 1 THEN 'refused' END"


def json_replies(spark, d, good):
    rows = docs(spark, d).join(S.table(spark, d, "labels"), "doc_id", "left")
    reply = (
        F.when(F.col("quality").isNull(), F.concat(F.lit('{"summary": "'), "source"))
        .when(F.col("toxic") == 1, F.to_json(F.struct(F.lit("refused").alias("error"))))
        .otherwise(F.to_json(good))
    )
    return rows.select("doc_id", reply.alias("reply"))


@query(
    "f12_analysis_reply",
    f"""WITH {_JSON} SELECT doc_id, CASE WHEN e IS NULL THEN source END AS summary,
      CASE WHEN e IS NULL THEN CASE quality WHEN 1 THEN 'Yes' ELSE 'N/A' END END AS possible,
      CASE WHEN e IS NULL THEN lang END AS reason, CASE WHEN e IS NULL THEN 'N/A' END AS recommendation, e AS error
    FROM (SELECT *, {_BAD} AS e FROM j)""",
)
def f12(spark, d):
    good = F.struct(
        F.col("source").alias("summary"),
        F.when(F.col("quality") == 1, "Yes").alias("self_service_possible"),
        F.col("lang").alias("self_service_reason"),
    )
    parsed = json_replies(spark, d, good).withColumn("r", replies.parse_analysis(F.col("reply")))
    return parsed.select("doc_id", "r.*")


@query(
    "f13_comparison_reply",
    f"""WITH {_JSON} SELECT doc_id,
      CASE WHEN e IS NOT NULL THEN 'N/A' WHEN quality = 1 THEN 'Yes' ELSE 'Error' END AS bot_correct,
      CASE WHEN e IS NOT NULL THEN e WHEN lang = 'en' THEN source ELSE 'Error parsing reason' END AS bot_correct_reason,
      e AS error
    FROM (SELECT *, {_BAD} AS e FROM j)""",
)
def f13(spark, d):
    good = F.struct(
        F.when(F.col("quality") == 1, "Yes").alias("bot_correct"),
        F.when(F.col("lang") == "en", F.col("source")).alias("bot_correct_reason"),
    )
    parsed = json_replies(spark, d, good).withColumn("r", replies.parse_comparison(F.col("reply")))
    return parsed.select("doc_id", "r.*")


@query(
    "f14_theme_reply",
    """SELECT event_id, u.key AS ticket_key, json_extract_string(props, u.key) AS theme
    FROM events, unnest(json_keys(props)) u(key)""",
)
def f14(spark, d):
    events = S.table(spark, d, "events")
    return events.select(
        "event_id", F.explode(replies.parse_map(F.col("props"))).alias("ticket_key", "theme")
    )


@query("f15_to_json", "SELECT doc_id, '{\"' || doc_id || '\":\"' || source || '\"}' AS payload FROM documents")
def f15(spark, d):
    entry = F.create_map(F.col("doc_id").cast("string"), F.col("source"))
    return docs(spark, d).select("doc_id", F.to_json(entry).alias("payload"))


@query(
    "f16_cutoff_dates",
    """SELECT o_orderkey AS ticket_id, CAST(o_orderdate - INTERVAL 7 DAY AS DATE) AS start_day,
      strftime(o_orderdate - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%SZ') AS start_time FROM orders""",
)
def f16(spark, d):
    start = F.col("created_at") - F.make_dt_interval(days=F.lit(7))
    return S.tickets(spark, d).select(
        "ticket_id", F.to_date(start).alias("start_day"), text.iso_utc(start).alias("start_time")
    )


@query(
    "f17_epoch_to_iso",
    "SELECT event_id, strftime(make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS start_time FROM events",
)
def f17(spark, d):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return S.table(spark, d, "events").select("event_id", dates.epoch_to_iso(seconds).alias("start_time"))


@query("f18_snapshot_stamp", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp FROM events")
def f18(spark, d):
    return S.table(spark, d, "events").select("event_id", dates.snapshot_stamp(F.col("ts")).alias("stamp"))


_SHARE = "format('{:.1f}', (k / n) * 100)"


@query(
    "f19_percent",
    f"""SELECT o_orderkey AS ticket_id, CAST({_SHARE} AS DOUBLE) AS pct,
      CASE WHEN CAST({_SHARE} AS DOUBLE) > 0 THEN k || ' (' || {_SHARE} || '%)' ELSE '' END AS caption
    FROM (SELECT o_orderkey, o_custkey % 17 AS k, CASE WHEN o_orderkey % 3 = 0 THEN 16 WHEN o_orderkey % 3 = 1 THEN 2000 ELSE 1 + o_orderkey % 997 END AS n FROM orders)""",
)
def f19(spark, d):
    """Shares of 16 have true ties, of 2000 doubles beside a tie."""
    key, k = F.col("o_orderkey"), F.col("o_custkey") % 17
    n = F.when(key % 3 == 0, 16).when(key % 3 == 1, 2000).otherwise(1 + key % 997)
    pct = labels.percent(k, n)
    return S.table(spark, d, "orders").select(
        key.alias("ticket_id"), pct.alias("pct"), labels.count_and_percent(k, pct).alias("caption")
    )


@query(
    "f20_status_text",
    f"""WITH {_JSON} SELECT doc_id, CASE WHEN e IS NOT NULL THEN '' ELSE source END AS summary,
      CASE WHEN e IS NOT NULL THEN 'N/A' WHEN quality = 1 THEN 'Yes' ELSE 'No' END AS possible,
      CASE WHEN e IS NOT NULL THEN 'Error processing ticket: ' || e
           ELSE 'Self Service Possible?: ' || CASE quality WHEN 1 THEN 'Yes' ELSE 'No' END || chr(10) || chr(10) || 'Reason:' || chr(10) || lang
             || CASE WHEN quality = 1 THEN '' ELSE chr(10) || 'Recommendation: N/A' END END AS self_service_analysis
    FROM (SELECT *, {_BAD} AS e FROM j)""",
)
def f20(spark, d):
    good = F.struct(
        F.col("source").alias("summary"),
        F.when(F.col("quality") == 1, "Yes").otherwise("No").alias("self_service_possible"),
        F.col("lang").alias("self_service_reason"),
    )
    parsed = json_replies(spark, d, good).withColumn("r", replies.parse_analysis(F.col("reply")))
    columns = assemble.analysis_columns(F.col("r"), F.lit(1))
    return parsed.withColumns(columns).select("doc_id", *columns)


@query(
    "f21_mask_spans",
    """SELECT doc_id, CASE WHEN length(text) < 12 THEN text
      ELSE substr(text, 1, 2) || '[REDACTED PERSON]' || substr(text, 6, 4) || '[REDACTED ORG]' || substr(text, 12) END AS masked FROM documents""",
)
def f21(spark, d):
    def span(label, start, end):
        return F.struct(F.lit(label).alias("label"), F.lit(start).alias("start"), F.lit(end).alias("end"))

    spans = F.array(span("PERSON", 2, 5), span("DATE", 6, 8), span("ORG", 9, 11))
    masked = F.when(F.length("text") >= 12, mask_spans(F.col("text"), spans)).otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", masked.alias("masked"))


@query(
    "f22_map_default",
    "SELECT event_id, coalesce(json_extract_string(props, 'k'), 'N/A') AS found, 'N/A' AS missing FROM events",
)
def f22(spark, d):
    props = replies.parse_map(F.col("props"))
    return S.table(spark, d, "events").select(
        "event_id",
        replies.map_value(props, F.lit("k")).alias("found"),
        replies.map_value(props, F.lit("absent")).alias("missing"),
    )


# --- prompts -----------------------------------------------------------------


@query(
    "t1_analysis_prompt",
    f"WITH {COMMENTS} SELECT ticket_id, {lit(prompts.ANALYSIS_INSTRUCTIONS)} || string_agg({line()}, chr(10) ORDER BY pos) AS prompt FROM comments GROUP BY ticket_id",
)
def t1(spark, d):
    scripts = threads.transcripts(S.comments(spark, d))
    return scripts.select("ticket_id", prompts.analysis_prompt(F.col("transcript")).alias("prompt"))


@query(
    "t2_theme_prompt",
    f"""SELECT batch, {lit(prompts.THEME_INSTRUCTIONS)} || '{{' || string_agg('"' || doc_id || '":"' || source || '"', ',' ORDER BY doc_id) || '}}' AS prompt
    FROM (SELECT doc_id, source, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch FROM documents) GROUP BY 1""",
)
def t2(spark, d):
    rows = docs(spark, d).selectExpr("doc_id AS ticket_id", "source AS summary")
    batches = assemble.summary_batches(rows)
    return batches.select("batch", prompts.theme_prompt(F.col("summaries")).alias("prompt"))


@query(
    "t3_comparison_prompt",
    f"""WITH {THREADS} SELECT ticket_id, {lit(prompts.COMPARISON_INSTRUCTIONS + 'Chatbot answer:' + chr(10))} || coalesce(customer_issue, '')
      || chr(10) || chr(10) || 'Agent answer:' || chr(10) || coalesce(agent_resolution, '') AS prompt FROM threads""",
)
def t3(spark, d):
    rows = threads.assemble_threads(S.tickets(spark, d), S.comments(spark, d), None)
    prompt = prompts.comparison_prompt(F.col("customer_issue"), F.col("agent_resolution"))
    return rows.select("ticket_id", prompt.alias("prompt"))


@query(
    "t4_sentiment_prompt",
    f"WITH {THREADS} SELECT ticket_id, {lit(prompts.SENTIMENT_INSTRUCTIONS)} || customer_issue AS prompt FROM threads",
)
def t4(spark, d):
    rows = threads.assemble_threads(S.tickets(spark, d), S.comments(spark, d), None)
    return rows.select("ticket_id", prompts.sentiment_prompt(F.col("customer_issue")).alias("prompt"))


@query(
    "t5_recommendation_prompt",
    f"""WITH {ANALYSED} SELECT ticket_id, {lit(prompts.RECOMMENDATION_INSTRUCTIONS + 'Summary: ')} || summary
      || chr(10) || chr(10) || 'Self-service: ' || self_service_analysis || chr(10) || chr(10) || 'Chatbot answer: ' || bot_answer
      || chr(10) || chr(10) || 'Chatbot correct: ' || bot_correct || chr(10) || chr(10) || 'Next step:' AS prompt FROM analysed""",
)
def t5(spark, d):
    columns = ("summary", "self_service_analysis", "bot_answer", "bot_correct")
    prompt = prompts.recommendation_prompt(*[F.col(c) for c in columns])
    return S.analysed(spark, d).select("ticket_id", prompt.alias("prompt"))


@query(
    "t6_question_payload",
    f"""WITH {THREADS} SELECT ticket_id, CAST(json_object('query', customer_issue, 'integration_id', 'desk') AS VARCHAR) AS payload
    FROM threads WHERE customer_issue IS NOT NULL""",
)
def t6(spark, d):
    rows = threads.assemble_threads(S.tickets(spark, d), S.comments(spark, d), None)
    rows = rows.where(F.col("customer_issue").isNotNull())
    return rows.select("ticket_id", prompts.question_payload(F.col("customer_issue"), "desk").alias("payload"))
