"""Explicit schemas: nothing in this package infers a schema from data."""

from pyspark.sql import types as T


LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
FLAG, TIME = T.BooleanType(), T.TimestampType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TICKETS = _schema(
    ticket_id=LONG,
    requester_id=LONG,
    assignee_id=LONG,
    created_at=TIME,
    status=TEXT,
    ticket_form_id=LONG,
    theme=TEXT,
)

COMMENTS = _schema(
    ticket_id=LONG,
    pos=LONG,
    author_id=LONG,
    public=FLAG,
    plain_body=TEXT,
    created_at=TIME,
)

# Landed threads: one JSON object per ticket, comments in thread order.
THREADS = _schema(
    ticket_id=LONG,
    comments=T.ArrayType(_schema(author_id=LONG, public=FLAG, plain_body=TEXT, created_at=TIME)),
)

ACTIVITY = _schema(conversation_id=TEXT, ts=TIME)
ARTICLE_VIEWS = _schema(event_id=TEXT, ts=TIME)

LEXICON = _schema(word=TEXT, score=INT)
THEME_TERMS = _schema(term=TEXT, theme=TEXT)
GAZETTEER = _schema(term=TEXT, label=TEXT)
KNOWLEDGE = _schema(doc_id=LONG, text=TEXT)

# Result of one analysed ticket.
ANALYSIS = _schema(
    ticket_id=LONG,
    assignee_id=TEXT,
    created_at=TEXT,
    summary=TEXT,
    self_service_analysis=TEXT,
    bot_answer=TEXT,
    bot_correct=TEXT,
    bot_correct_reason=TEXT,
    theme=TEXT,
    recommendation=TEXT,
    sentiment=TEXT,
    sentiment_explanation=TEXT,
    customer_issue=TEXT,
)

ERRORS = _schema(
    ticket_id=LONG,
    stage=TEXT,
    error_class=TEXT,
    message=TEXT,
    ts=TIME,
)

# Model replies.
ANALYSIS_REPLY = _schema(
    summary=TEXT,
    self_service_possible=TEXT,
    self_service_reason=TEXT,
    self_service_recommendation=TEXT,
    error=TEXT,
    _corrupt_record=TEXT,
)
COMPARISON_REPLY = _schema(
    bot_correct=TEXT,
    bot_correct_reason=TEXT,
    error=TEXT,
    _corrupt_record=TEXT,
)
RESPONSES = _schema(
    prompt_hash=TEXT,
    response=TEXT,
    status=TEXT,
    error=TEXT,
)


def csv_headings(bot: str = "Chatbot", bot_site: str | None = None) -> dict[str, str]:
    """Column name -> heading used in exported CSV files.

    The chatbot's name is part of three headings, so files written for another
    chatbot are read by passing that name.
    """
    # The headings of the 13-column export.
    return {
        "ticket_id": "Ticket #",
        "assignee_id": "Assignee",
        "created_at": "Date Created",
        "summary": "Analysis",
        "self_service_analysis": "Self-Service Analysis",
        "bot_answer": f"{bot_site or bot} Suggestion",
        "bot_correct": f"Did {bot} Get It Right?",
        "bot_correct_reason": f"{bot} Correctness Reason",
        "theme": "Theme",
        "recommendation": "Recommendation",
        "sentiment": "Sentiment",
        "sentiment_explanation": "Sentiment Explanation",
        "customer_issue": "Customer Issue",
    }
