"""Batch enrichment, the whole model run and the offline baselines."""

import json

from pyspark.sql import functions as F

from checks.registry import (
    ANALYSIS_COLUMNS,
    COMMENTS,
    THREADS,
    lit,
    query,
    redact,
    strip,
    tokens,
    values,
)
from threadlens import standins as S
from threadlens.functions import prompts
from threadlens.functions.text import word_counts
from threadlens.operators.baselines import compare, entities, recommend, retrieval, sentiment, summary, themes
from threadlens.operators.enrich import enrich, offline_client, with_retries
from threadlens.operators.joins import if_few, merged
from threadlens.operators.reading import read_threads
from threadlens.operators.threads import assemble_threads
from threadlens.plans import analyse
from threadlens.plans.analyse import analyse_offline, analyse_with_clients
from threadlens.sources import shared

# --- enrichment --------------------------------------------------------------

_RULES = [("src7", None), ("src1", "Sentiment: Angry\nExplanation: first group")]
_REPLY = """CASE WHEN contains(prompt, 'src7') THEN NULL
  WHEN contains(prompt, 'src1') THEN 'Sentiment: Angry' || chr(10) || 'Explanation: first group'
  ELSE 'Sentiment: Neutral' || chr(10) || 'Explanation: other' END"""
_STATUS = """CASE WHEN prompt IS NULL THEN 'skipped' WHEN contains(prompt, 'src7') THEN 'error' ELSE 'ok' END"""


def _client():
    return offline_client(_RULES, "Sentiment: Neutral\nExplanation: other")


def _questions(spark, d):
    """Documents that are not Spanish ask about their source: many share a prompt."""
    rows = S.table(spark, d, "documents").select("doc_id", "lang", "source")
    prompt = prompts.sentiment_prompt(F.concat_ws(" ", "lang", "source"))
    return rows.select("doc_id", F.when(F.col("lang") != "es", prompt).alias("prompt"))


_ASKED = f"""q AS (SELECT doc_id, CASE WHEN lang <> 'es' THEN {lit(prompts.SENTIMENT_INSTRUCTIONS)} || lang || ' ' || source END AS prompt FROM documents)"""


@query(
    "u1_enrich",
    f"WITH {_ASKED} SELECT doc_id, CASE WHEN prompt IS NOT NULL THEN {_REPLY} END AS response, {_STATUS} AS status FROM q",
)
def u1(spark, d):
    done = enrich(_questions(spark, d), _client(), shared.new_path(spark, "replies"), range_prompts=20)
    return done.select("doc_id", "response", "status")


@query(
    "u1_enrich_from_store",
    f"WITH {_ASKED} SELECT doc_id, CASE WHEN prompt IS NOT NULL THEN {_REPLY} END AS response, {_STATUS} AS status FROM q",
)
def u1_store(spark, d):
    store = shared.new_path(spark, "replies")
    rows = _questions(spark, d)
    enrich(rows.where(F.col("prompt").contains("en ")), _client(), store, calls_per_task=2)
    done = enrich(rows, with_retries(_client(), waits=(0.0, 0.0)), store)
    return done.select("doc_id", "response", "status")


@query(
    "u2_row_errors",
    f"WITH {_ASKED} SELECT doc_id, 'ValueError: no reply for src7' AS error FROM q WHERE contains(prompt, 'src7')",
)
def u2(spark, d):
    done = enrich(_questions(spark, d), _client(), shared.new_path(spark, "replies"))
    return done.where(F.col("status") == "error").select("doc_id", "error")


# --- baselines ---------------------------------------------------------------


def threads_of(spark, d):
    return assemble_threads(S.tickets(spark, d), S.comments(spark, d), None)


def lexicon(spark):
    return S.words(spark, S.LEXICON, "word STRING, score INT")


def theme_terms(spark):
    return S.words(spark, S.THEME_TERMS, "term STRING, theme STRING")


def gazetteer(spark):
    return S.words(spark, S.GAZETTEER, "term STRING, label STRING")


_SENTIMENT = f"""felt AS MATERIALIZED (
  SELECT t.ticket_id, t.customer_issue, CAST(coalesce(sum(l.score), 0) AS BIGINT) AS sentiment_score, count(l.score) AS hits
  FROM threads t LEFT JOIN (SELECT ticket_id, unnest({tokens('customer_issue')}) AS word FROM threads) w ON w.ticket_id = t.ticket_id
    LEFT JOIN {values(S.LEXICON, 'word, score')} l ON l.word = w.word
  GROUP BY ALL),
moods AS MATERIALIZED (
  SELECT ticket_id, sentiment_score,
    CASE WHEN coalesce(customer_issue, '') = '' THEN 'N/A' WHEN sentiment_score >= 3 THEN 'Delighted'
         WHEN sentiment_score >= 1 THEN 'Positive' WHEN sentiment_score = 0 THEN 'Neutral'
         WHEN sentiment_score >= -2 THEN 'Frustrated' ELSE 'Angry' END AS sentiment,
    CASE WHEN coalesce(customer_issue, '') = '' THEN 'N/A'
         ELSE 'Score ' || sentiment_score || ' from ' || hits || ' lexicon words.' END AS sentiment_explanation
  FROM felt)"""


@query("b1_lexicon_sentiment", f"WITH {THREADS}, {_SENTIMENT} SELECT * FROM moods")
def b1(spark, d):
    rows = shared.materialise(threads_of(spark, d).select("ticket_id", "customer_issue"), "threads")
    felt = sentiment.lexicon_sentiment(rows, lexicon(spark))
    return felt.select("ticket_id", "sentiment_score", "sentiment", "sentiment_explanation")


def _term_theme(source: str, key: str, text: str) -> str:
    return f"""(SELECT k, theme FROM (
      SELECT w.k, t.theme, count(*) AS hits FROM (SELECT {key} AS k, unnest({tokens(text)}) AS term FROM {source}) w
      JOIN {values(S.THEME_TERMS, 'term, theme')} t ON t.term = w.term GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY k ORDER BY hits DESC, theme) = 1)"""


@query(
    "b2_term_themes",
    f"""SELECT d.doc_id AS ticket_id, coalesce(b.theme, 'N/A') AS theme FROM documents d
    LEFT JOIN {_term_theme('documents', 'doc_id', 'text')} b ON b.k = d.doc_id""",
)
def b2(spark, d):
    rows = S.knowledge(spark, d).selectExpr("doc_id AS ticket_id", "text AS summary")
    return themes.term_themes(rows, theme_terms(spark)).select("ticket_id", "theme")


@query("b2_theme_discovery")
def b2_discovery(spark, d):
    rows = S.knowledge(spark, d).selectExpr("doc_id AS ticket_id", "text AS summary")
    return themes.discover_themes(rows, k=8)


@query(
    "b2_discovery_invariants",
    "SELECT doc_id AS ticket_id, count(*) AS times, TRUE AS few_themes, TRUE AS named FROM documents GROUP BY doc_id",
)
def b2_invariants(spark, d):
    """What holds for any clustering: each id once, at most k themes, and names made of words of the cluster."""
    rows = S.knowledge(spark, d).selectExpr("doc_id AS ticket_id", "text AS summary")
    found = shared.materialise(themes.discover_themes(rows, k=8), "discovered")
    terms = shared.materialise(found.select("theme", F.explode(F.split("theme", " / ")).alias("term")).distinct(), "named")
    # Only words that a name holds are looked for in the texts; they move, the texts do not.
    held = word_counts(rows, "summary", ["ticket_id"], "term").join(if_few(terms.select("term").distinct()), "term", "left_semi")
    used = merged(held, found, "ticket_id").select("theme", "term").distinct()
    strange = terms.join(used, ["theme", "term"], "left_anti").where(F.col("theme") != "N/A").select("theme").distinct()
    few = found.select("theme").distinct().count() <= 8
    marked = found.join(strange.withColumn("strange", F.lit(True)), "theme", "left")
    return marked.groupBy("ticket_id").agg(
        F.count(F.lit(1)).alias("times"), F.lit(few).alias("few_themes"), F.every(F.col("strange").isNull()).alias("named")
    )


def _jaccard(a: str, b: str) -> str:
    x, y = tokens(a), tokens(b)
    both = f"len(list_distinct(list_intersect({x}, {y})))"
    either = f"len(list_distinct(list_concat({x}, {y})))"
    return f"CASE WHEN {either} > 0 THEN round({both} / {either}, 6) ELSE 0.0 END"


@query(
    "b3_answer_overlap",
    f"""WITH {THREADS} SELECT ticket_id, score, CASE WHEN score >= 0.2 THEN 'Yes' ELSE 'No' END AS bot_correct,
      'Shared words: ' || CAST(round_even(100.0 * score, 1) AS DECIMAL(10,1)) || '%' AS bot_correct_reason
    FROM (SELECT ticket_id, CAST({_jaccard('customer_issue', 'agent_resolution')} AS DOUBLE) AS score FROM threads
          WHERE customer_issue IS NOT NULL AND agent_resolution IS NOT NULL)""",
)
def b3(spark, d):
    rows = threads_of(spark, d).where(F.col("customer_issue").isNotNull() & F.col("agent_resolution").isNotNull())
    score = compare.overlap(F.col("customer_issue"), F.col("agent_resolution"))
    label, reason = compare.correctness(F.col("score"))
    return rows.withColumn("score", score).select(
        "ticket_id", "score", label.alias("bot_correct"), reason.alias("bot_correct_reason")
    )


_INDEX = f"""toks AS MATERIALIZED (SELECT doc_id, {tokens('text')} AS w FROM documents),
tfs AS MATERIALIZED (
  SELECT doc_id, dl, term, count(*) AS tf
  FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM toks) GROUP BY ALL),
corpus AS MATERIALIZED (SELECT count(*) AS n, sum(len(w)) / count(*) AS avgdl FROM toks),
dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM tfs GROUP BY 1),
idfs AS MATERIALIZED (SELECT term, ln(1.0 + (n - df + 0.5) / (df + 0.5)) AS idf FROM dfs, corpus),
weights AS MATERIALIZED (
  SELECT doc_id, tfs.term, idf * tf * 2.2 / (tf + 1.2 * (1.0 - 0.75 + 0.75 * dl / avgdl)) AS w
  FROM tfs JOIN idfs ON idfs.term = tfs.term, corpus)"""
_BEST = f"""best AS MATERIALIZED (
  SELECT ticket_id, doc_id, score FROM (
    SELECT q.ticket_id, w.doc_id, round(sum(w.w), 6) AS score
    FROM (SELECT ticket_id, unnest(list_distinct({tokens('customer_issue')})) AS term FROM threads) q
    JOIN weights w ON w.term = q.term GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY ticket_id ORDER BY score DESC, doc_id) = 1)"""


@query(
    "b4_best_article",
    f"""WITH {THREADS}, {_INDEX}, {_BEST}
    SELECT t.ticket_id, b.doc_id AS bot_doc_id, b.score AS bot_score,
      CASE WHEN coalesce(customer_issue, '') = '' THEN 'N/A - No customer comment found.'
           ELSE coalesce(d.text, 'N/A - No matching article.') END AS bot_answer,
      CASE WHEN coalesce(customer_issue, '') = '' THEN 'skipped' WHEN d.text IS NULL THEN 'none' ELSE 'ok' END AS bot_status
    FROM threads t LEFT JOIN best b ON b.ticket_id = t.ticket_id LEFT JOIN documents d ON d.doc_id = b.doc_id""",
)
def b4(spark, d):
    knowledge = S.knowledge(spark, d)
    rows = shared.materialise(threads_of(spark, d), "threads")
    answered = retrieval.answer_from_articles(rows, knowledge, retrieval.build_index(knowledge))
    return answered.select("ticket_id", "bot_doc_id", "bot_score", "bot_answer", "bot_status")


def _sentences(body: str) -> str:
    return f"""sentences AS MATERIALIZED (
  SELECT ticket_id, pos, i AS sentence_no, s[i] AS sentence
  FROM (SELECT ticket_id, pos, regexp_split_to_array({body}, '[.!?]+\\s+') AS s FROM comments),
       unnest(range(1, len(s) + 1)) u(i)),
rarities AS MATERIALIZED (
  SELECT ticket_id, pos, sentence_no, round(avg(coalesce(idf, ln(1.0 + (n + 0.5) / 0.5))), 6) AS rarity
  FROM (SELECT ticket_id, pos, sentence_no, unnest({tokens('sentence')}) AS term FROM sentences) w
       LEFT JOIN idfs ON idfs.term = w.term, corpus
  GROUP BY 1, 2, 3),
tops AS MATERIALIZED (
  SELECT r.ticket_id, {strip('s.sentence')} AS summary FROM rarities r JOIN sentences s USING (ticket_id, pos, sentence_no)
  QUALIFY row_number() OVER (PARTITION BY r.ticket_id ORDER BY rarity DESC, pos, sentence_no) = 1)"""


_BODY = redact("coalesce(plain_body, '')")


@query("b5_top_sentence", f"WITH {COMMENTS}, {_INDEX}, {_sentences(_BODY)} SELECT ticket_id, summary FROM tops")
def b5(spark, d):
    bodies = entities.redact_all(S.comments(spark, d), "plain_body", ["ticket_id", "pos"])
    return summary.top_sentences(bodies, retrieval.build_index(S.knowledge(spark, d)))


_VERDICT = """verdicts AS MATERIALIZED (
  SELECT t.ticket_id, b.doc_id, CASE WHEN coalesce(b.score >= 5.0, FALSE) THEN 'Yes' ELSE 'No' END AS possible,
    CASE WHEN coalesce(b.score >= 5.0, FALSE) THEN 'Covered by article ' || b.doc_id
         WHEN b.doc_id IS NULL THEN 'No matching article'
         ELSE 'Closest article ' || b.doc_id || ' is too far' END AS reason
  FROM threads t LEFT JOIN best b ON b.ticket_id = t.ticket_id)"""


@query("b5_verdict", f"WITH {THREADS}, {_INDEX}, {_BEST}, {_VERDICT} SELECT ticket_id, possible, reason FROM verdicts")
def b5_verdict(spark, d):
    rows = shared.materialise(threads_of(spark, d), "threads")
    best = retrieval.best_articles(rows, retrieval.build_index(S.knowledge(spark, d)))
    possible, reason = summary.verdict(F.col("score"), F.col("doc_id"))
    return rows.join(best, "ticket_id", "left").select(
        "ticket_id", possible.alias("possible"), reason.alias("reason")
    )


_ADVICE = """CASE WHEN possible <> 'No' THEN '' WHEN sentiment = 'Angry' THEN 'Escalate to a senior agent.'
  WHEN article IS NULL THEN 'Create a new help article.' WHEN bot_correct = 'No' THEN 'Teach the chatbot this topic.'
  WHEN bot_correct = 'Yes' THEN 'Show the existing article when the customer opens a ticket.'
  ELSE 'Request a product update.' END"""


@query(
    "b6_recommendation",
    f"""SELECT ticket_id, {_ADVICE} AS recommendation FROM (
      SELECT d.doc_id AS ticket_id, CASE quality WHEN 1 THEN 'Yes' WHEN 0 THEN 'No' ELSE 'No' END AS possible,
        CASE WHEN lang = 'de' THEN 'Angry' ELSE 'Neutral' END AS sentiment, l.doc_id AS article,
        CASE toxic WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' END AS bot_correct
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""",
)
def b6(spark, d):
    marks = S.table(spark, d, "labels").withColumn("article", F.col("doc_id"))
    rows = S.table(spark, d, "documents").join(marks, "doc_id", "left")
    advice = recommend.recommendation(
        F.when(F.col("quality") == 1, "Yes").otherwise("No"),
        F.when(F.col("lang") == "de", "Angry").otherwise("Neutral"),
        F.col("article"),
        F.when(F.col("toxic") == 0, "Yes").when(F.col("toxic") == 1, "No"),
    )
    return rows.select(F.col("doc_id").alias("ticket_id"), advice.alias("recommendation"))


def masked(x: str, terms=S.GAZETTEER) -> str:
    """Leftmost longest terms: tokens are put between marks, terms in order of length are found
    at once and put between others, and each is replaced by its label."""
    pattern = lambda term: "[^\\x01\\x02]+".join(f"\\x01{word}\\x02" for word in term.split())
    order = sorted(terms, key=lambda t: -len(t[0]))
    x = rf"regexp_replace({x}, '([\p{{L}}\p{{N}}]+)', chr(1) || '\1' || chr(2), 'g')"
    x = f"regexp_replace({x}, '(?i)({'|'.join(pattern(term) for term, _ in order)})', chr(3) || '\\1' || chr(4), 'g')"
    for term, label in order:
        x = f"regexp_replace({x}, '(?i)\\x03{pattern(term)}\\x04', '[REDACTED {label}]', 'g')"
    return f"regexp_replace({x}, '[\\x01-\\x04]', '', 'g')"


@query("b7_entity_redaction", f"SELECT doc_id, {masked('text')} AS text FROM documents")
def b7(spark, d):
    rows = S.knowledge(spark, d)
    return entities.redact_entities(rows, gazetteer(spark), "text", ["doc_id"])


LONG_NAMES = [("of the and", "PERSON"), ("that the", "ORG"), ("in the of", "ORG"), ("con", "PERSON")]


@query("b7_long_names", f"SELECT doc_id, {masked('text', LONG_NAMES)} AS text FROM documents")
def b7_long(spark, d):
    names = S.words(spark, LONG_NAMES, "term STRING, label STRING")
    return entities.redact_entities(S.knowledge(spark, d), names, "text", ["doc_id"])


@query("b7_entity_redaction_by_join", f"SELECT doc_id, {masked('text')} AS text FROM documents")
def b7_join(spark, d):
    rows = S.knowledge(spark, d)
    return entities.redact_entities(rows, gazetteer(spark), "text", ["doc_id"], inline_terms=0)


# --- the whole offline run ---------------------------------------------------

_NAMED = f"""named AS (
  SELECT * REPLACE ({masked('customer_issue')} AS customer_issue, {masked('agent_resolution')} AS agent_resolution) FROM threads)"""
_THREADS_ON_NAMED = THREADS.replace("threads AS MATERIALIZED (", "plain AS MATERIALIZED (")
_RUN = f"""WITH {_THREADS_ON_NAMED}, {_NAMED.replace('FROM threads', 'FROM plain').replace('named AS', 'threads AS')},
  {_INDEX}, {_BEST}, {_sentences(masked(_BODY))}, {_VERDICT}, {_SENTIMENT},
answered AS MATERIALIZED (
  SELECT t.*, b.doc_id, d.text IS NOT NULL AS found,
    CASE WHEN coalesce(customer_issue, '') = '' THEN 'N/A - No customer comment found.'
         ELSE {masked(redact("coalesce(d.text, 'N/A - No matching article.')"))} END AS bot_answer
  FROM threads t LEFT JOIN best b ON b.ticket_id = t.ticket_id LEFT JOIN documents d ON d.doc_id = b.doc_id),
compared AS MATERIALIZED (
  SELECT *, CASE WHEN found AND agent_resolution <> '' THEN CAST({_jaccard('bot_answer', 'agent_resolution')} AS DOUBLE) END AS score
  FROM answered),
rows_ AS (
  SELECT c.*, v.possible AS p, v.reason, m.sentiment, m.sentiment_explanation, coalesce(s.summary, 'N/A') AS top,
    CASE WHEN score IS NULL THEN 'N/A' WHEN score >= 0.2 THEN 'Yes' ELSE 'No' END AS bot_correct,
    CASE WHEN score IS NOT NULL THEN 'Shared words: ' || CAST(round_even(100.0 * score, 1) AS DECIMAL(10,1)) || '%'
         WHEN coalesce(agent_resolution, '') = '' THEN 'N/A - No agent resolution found.' ELSE 'N/A' END AS bot_correct_reason
  FROM compared c JOIN verdicts v ON v.ticket_id = c.ticket_id JOIN moods m ON m.ticket_id = c.ticket_id
    LEFT JOIN tops s ON s.ticket_id = c.ticket_id),
done AS MATERIALIZED (
  SELECT ticket_id, CAST(assignee_id AS VARCHAR) AS assignee_id,
    strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
    CASE WHEN comment_count = 0 THEN 'Ticket has no content.' ELSE top END AS summary,
    CASE WHEN comment_count = 0 THEN 'Error processing ticket: No content'
         ELSE 'Self Service Possible?: ' || p || chr(10) || chr(10) || 'Reason:' || chr(10) || reason
           || CASE WHEN p = 'No' THEN chr(10) || 'Recommendation: N/A' ELSE '' END END AS self_service_analysis,
    bot_answer, bot_correct, bot_correct_reason, sentiment, sentiment_explanation,
    coalesce(customer_issue, '') AS customer_issue,
    CASE WHEN comment_count = 0 THEN 'N/A' ELSE p END AS possible, doc_id AS article
  FROM rows_)
SELECT {', '.join('d.' + c for c in ANALYSIS_COLUMNS.split(', ') if c not in ('theme', 'recommendation'))},
  coalesce(b.theme, 'N/A') AS theme, {_ADVICE} AS recommendation
FROM done d LEFT JOIN {_term_theme('done', 'ticket_id', 'summary')} b ON b.k = d.ticket_id"""


@query("analyse_offline", _RUN)
def full_run(spark, d):
    return analyse_offline(
        S.tickets(spark, d), S.comments(spark, d), S.knowledge(spark, d),
        lexicon(spark), theme_terms(spark), gazetteer(spark),
    )


# --- the whole run with clients ----------------------------------------------

_ASKS = [("und", None), ("que", "Read article 7.")]
_FEELS = [("und", None), ("que", "Sentiment: Angry\nExplanation: tone")]
_JUDGES = [("und", "{bad"), ("que", '{"bot_correct": "Yes", "bot_correct_reason": "same"}')]
_READS = [
    ("und", "{bad"),
    ("que", '{"summary": "About que", "self_service_possible": "No", "self_service_reason": "r", "self_service_recommendation": "w"}'),
]
_PLAIN = '{"summary": "Plain case", "self_service_possible": "Yes", "self_service_reason": "r"}'


def _theme_client():
    def client(prompt):
        summaries = json.loads(prompt.split("Summaries:\n\n")[1])
        return json.dumps({key: "Spanish" if "que" in text else "Other" for key, text in summaries.items()})

    return client


def run_clients():
    return {
        "bot": offline_client(_ASKS, "Read the manual."),
        "sentiment": offline_client(_FEELS, "no label"),
        "comparison": offline_client(_JUDGES, '{"bot_correct": "No"}'),
        "parts": offline_client([], "part"),
        "analysis": offline_client(_READS, _PLAIN),
        "recommendation": offline_client([], "  Write an article \n"),
        "themes": lambda: _theme_client(),
        "theme_merge": offline_client([], "{}"),
    }


_MODEL_RUN = f"""WITH {THREADS},
asked AS (SELECT *, CASE WHEN coalesce(customer_issue, '') = '' THEN 'skipped' WHEN contains(customer_issue, 'und') THEN 'error' ELSE 'ok' END AS call FROM threads),
answered AS (SELECT *,
    CASE call WHEN 'skipped' THEN 'N/A - No customer comment found.' WHEN 'error' THEN 'Error querying the chatbot: ValueError: no reply for und'
      ELSE CASE WHEN contains(customer_issue, 'que') THEN 'Read article 7.' ELSE 'Read the manual.' END END AS bot_answer,
    call = 'ok' AND coalesce(agent_resolution, '') <> '' AS compared,
    CASE WHEN comment_count = 0 THEN 'empty' WHEN contains(transcript, 'und') THEN 'bad' WHEN contains(transcript, 'que') THEN 'que' ELSE 'plain' END AS kind
  FROM asked)
SELECT ticket_id, CAST(assignee_id AS VARCHAR) AS assignee_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at,
  CASE kind WHEN 'empty' THEN 'Ticket has no content.' WHEN 'bad' THEN '' WHEN 'que' THEN 'About que' ELSE 'Plain case' END AS summary,
  CASE kind WHEN 'empty' THEN 'Error processing ticket: No content' WHEN 'bad' THEN 'Error processing ticket: Failed to decode JSON from the reply.'
    WHEN 'que' THEN 'Self Service Possible?: No' || chr(10) || chr(10) || 'Reason:' || chr(10) || 'r' || chr(10) || 'Recommendation: w'
    ELSE 'Self Service Possible?: Yes' || chr(10) || chr(10) || 'Reason:' || chr(10) || 'r' END AS self_service_analysis,
  bot_answer,
  CASE WHEN NOT compared THEN 'N/A' WHEN contains(agent_resolution, 'und') THEN 'N/A' WHEN contains(agent_resolution, 'que') THEN 'Yes' ELSE 'No' END AS bot_correct,
  CASE WHEN coalesce(agent_resolution, '') = '' THEN 'N/A - No agent resolution found.' WHEN NOT compared THEN 'N/A'
    WHEN contains(agent_resolution, 'und') THEN 'Failed to decode JSON from the reply.' WHEN contains(agent_resolution, 'que') THEN 'same'
    ELSE 'Error parsing reason' END AS bot_correct_reason,
  CASE kind WHEN 'bad' THEN 'N/A' WHEN 'que' THEN 'Spanish' ELSE 'Other' END AS theme,
  CASE kind WHEN 'que' THEN 'Write an article' ELSE '' END AS recommendation,
  CASE WHEN call = 'ok' AND contains(customer_issue, 'que') THEN 'Angry' ELSE 'N/A' END AS sentiment,
  CASE call WHEN 'error' THEN 'Error analyzing sentiment: ValueError: no reply for und'
    WHEN 'ok' THEN CASE WHEN contains(customer_issue, 'que') THEN 'tone' ELSE 'N/A' END ELSE 'N/A' END AS sentiment_explanation,
  coalesce(customer_issue, '') AS customer_issue
FROM answered"""


@query("analyse_with_clients", _MODEL_RUN)
def model_run(spark, d):
    """The reference's main path with offline clients, tried again as live ones would be."""
    patient = {step: with_retries(factory, waits=(0.0, 0.0)) for step, factory in run_clients().items()}
    store = shared.new_path(spark, "store")
    return analyse_with_clients(S.tickets(spark, d), S.comments(spark, d), patient, store, range_prompts=500)


_BOUND = 600


@query(
    "t1_long_threads",
    f"""WITH {THREADS} SELECT ticket_id, CASE WHEN length(transcript) < {_BOUND} THEN transcript ELSE 'read in parts' END AS thread,
      TRUE AS bounded, CAST(NULL AS VARCHAR) AS error FROM threads WHERE comment_count > 0""",
)
def t1_long(spark, d):
    """Threads under the bound as they are; a longer one is the client's word for each of its parts."""
    read = read_threads(S.comments(spark, d), offline_client([], "part"), shared.new_path(spark, "parts"), _BOUND)
    own = F.when(F.col("thread").rlike("^(part\n)*part$"), "read in parts").otherwise(F.col("thread"))
    return read.join(S.tickets(spark, d).select("ticket_id"), "ticket_id", "left_semi").select(
        "ticket_id", own.alias("thread"), (F.length("thread") <= _BOUND).alias("bounded"), "error"
    )


def _merge_client():
    def client(prompt):
        names = json.loads(prompt.split("Themes:\n\n")[1])
        return json.dumps({name: f"Group {len(name) % 5}" for name in names})

    return client


@query(
    "t2_one_theme_set",
    """SELECT proposed, 'Group ' || length(proposed) % 5 AS theme FROM (SELECT DISTINCT left(text, 12) AS proposed FROM documents
      WHERE length(text) >= 1)""",
)
def t2_one_set(spark, d):
    """Very many proposals, merged in rounds of bounded calls."""
    texts = S.table(spark, d, "documents").where(F.length("text") >= 1)
    names = texts.select(F.substring("text", 1, 12).alias("proposed")).distinct()
    run = analyse.Run({"theme_merge": lambda: _merge_client()}, shared.new_path(spark, "store"), "run", 5, 1, 1000)
    return analyse.one_theme_set(names, run)
