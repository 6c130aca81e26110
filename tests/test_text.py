"""Text and label functions against Python's own ``re`` and the hand-made edge rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from threadlens.functions import labels, text

EDGE = [
    "josé@x.com. call", "(555) 123-4567", "1234567890", "(555)  123-4567", "a@b@c.d", "@x", "x@",
    "é555-123-4567", "555-123-4567é", "555\u00a0123\u00a04567", "call 555.123.4567, or (555)123-4567.",
    "x(555)123-4567", "12345678901", "٣٣٣-٣٣٣-٣٣٣٣", "\u2003 padded \x1f\t", "\n \t", "", "mail me: a.b-c_d@e-f.g!",
    "Sentiment: Angry\r\nExplanation: late  ", "Sentiment:\n\nNeutral", "Sentiment:   ", "free text",
    "Explanation: a\u2028b", "Self Service Possible?: Not sure", "Self Service Possible?: Maybe",
    "x Self Service Possible?: Yes and Self Service Possible?: No", "a" * 3000 + "@", "1" * 400,
]


def samples():
    rng = random.Random(7)
    alphabet = "ab1235@.-_() \t\n\r\u00a0\u2003éß٣\x1c:+"
    return EDGE + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]


def python_redact(s):
    s = re.sub(r"[\w\.-]+@[\w\.-]+", "[REDACTED EMAIL]", s)
    return re.sub(r"\(?\b\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[REDACTED PHONE]", s)


def python_field(s, name):
    m = re.search(name + r":\s*(.+)", s)
    return m.group(1).strip() if m else "N/A"


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, s) for i, s in enumerate(samples())]
    return rows, spark.createDataFrame(rows, "id BIGINT, s STRING")


@pytest.mark.parametrize(
    "column, python",
    [
        (text.redact, python_redact),
        (text.strip, str.strip),
        (labels.sentiment_label, lambda s: python_field(s, "Sentiment")),
        (labels.sentiment_explanation, lambda s: python_field(s, "Explanation")),
        (labels.verdict_label, lambda s: (re.search(r"Self Service Possible\?: (Yes|No)", s) or [None, None])[1]),
        (text.tokens, lambda s: [t for t in re.split(r"[\W_]+", s.lower()) if t]),
    ],
    ids=["redact", "strip", "sentiment", "explanation", "verdict", "tokens"],
)
def test_same_as_python(texts, column, python):
    rows, df = texts
    got = {r[0]: r[1] for r in df.select("id", column(F.col("s"))).collect()}
    bad = [(s, got[i], python(s)) for i, s in rows if got[i] != python(s)]
    assert not bad, bad[:5]


def test_redaction_is_idempotent(texts):
    _, df = texts
    once = text.redact(F.col("s"))
    assert df.where(text.redact(once) != once).count() == 0


def test_null_text(spark):
    row = spark.range(1).select(F.lit(None).cast("string").alias("s")).select(
        text.redact(F.col("s")), text.strip(F.col("s")), text.is_blank(F.col("s")), text.tokens(F.col("s"))
    ).first()
    assert tuple(row) == (None, None, True, [])


def test_missing_tokens(spark):
    values = ["N/A", "", "NA", "None", "null", "N/A - No customer comment found.", "Yes", None]
    df = spark.createDataFrame([(v,) for v in values], "c STRING")
    kept = [r[0] for r in df.select(labels.nullify_na(F.col("c"))).collect()]
    assert kept == [None] * 5 + ["N/A - No customer comment found.", "Yes", None]


def test_percent_ties_go_to_even(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (1, 3), (0, 5), (2, 0), (1, 2000)], "n BIGINT, t BIGINT")
    assert [r[0] for r in df.select(labels.percent(F.col("n"), F.col("t"))).collect()] == [6.2, 18.8, 33.3, 0.0, None, 0.1]


def test_percent_equals_exact_formatting(spark):
    pairs = [(n, t) for t in (3, 7, 16, 80, 400, 999, 1000, 2000, 6400) for n in range(0, t + 1, max(1, t // 400))]
    pairs += [(2**40 + i, 2**41) for i in range(50)] + [(5, 2), (12345, 10)]
    df = spark.createDataFrame(pairs, "n BIGINT, t BIGINT")
    got = df.select("n", "t", labels.percent(F.col("n"), F.col("t")).alias("p")).collect()
    assert [r for r in got if r["p"] != float(f"{r['n'] / r['t'] * 100:.1f}")] == []


def test_verdict_block(spark):
    df = spark.createDataFrame([("No",), ("Yes",), ("Not sure",)], "p STRING")
    got = [r[0] for r in df.select(labels.format_verdict(F.col("p"), F.lit("why"), F.lit("fix"))).collect()]
    assert got == [
        "Self Service Possible?: No\n\nReason:\nwhy\nRecommendation: fix",
        "Self Service Possible?: Yes\n\nReason:\nwhy",
        "Self Service Possible?: Not sure\n\nReason:\nwhy",
    ]
