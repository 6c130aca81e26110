"""Text columns: trimming, redaction, tokens, sentences, transcript lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What Unicode-aware regular expressions call white space and
# word characters, spelled out because Java's \s, \w and \b are ASCII-only.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = r"\s\x1c-\x1f\x85\p{Z}"
WORD_CLASS = r"\p{L}\p{N}_"

# A run of address characters is scanned once: the look-behind starts only at the
# beginning of a run and the possessive quantifier never gives characters back, so
# long junk runs cost linear time.
EMAIL = rf"(?<![{WORD_CLASS}.\-])[{WORD_CLASS}.\-]++@[{WORD_CLASS}.\-]+"
PHONE = (
    rf"\(?(?<![{WORD_CLASS}])\p{{Nd}}{{3}}\)?[-.{SPACE_CLASS}]?\p{{Nd}}{{3}}"
    rf"[-.{SPACE_CLASS}]?\p{{Nd}}{{4}}(?![{WORD_CLASS}])"
)

EMAIL_MARK = "[REDACTED EMAIL]"
PHONE_MARK = "[REDACTED PHONE]"

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
SENTENCE_BREAK = r"[.!?]+\s+"


def strip(c: Column) -> Column:
    """Trim all Unicode white space from both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(F.length(strip(c)) == 0, F.lit(True))


def redact_email(c: Column) -> Column:
    return F.when(c.contains("@"), F.regexp_replace(c, EMAIL, EMAIL_MARK)).otherwise(c)


def redact_phone(c: Column) -> Column:
    """A number ends in four digits; the cheap test spares most texts the long pattern."""
    return F.when(c.rlike(r"\p{Nd}{4}"), F.regexp_replace(c, PHONE, PHONE_MARK)).otherwise(c)


def redact(c: Column) -> Column:
    """Mask e-mail addresses, then phone numbers.

    The order matters: masking an address first keeps its digits from being read
    as a phone number. Names are masked afterwards, see ``baselines.entities``.
    """
    return redact_phone(redact_email(c))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits; null text gives no tokens."""
    return F.array_remove(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_BREAK), "")


def word_counts(df: DataFrame, text: str, keys: Sequence[str], name: str, length: str | None = None) -> DataFrame:
    """(keys, ``length``, ``name``, n): how often each token occurs in each row's text.

    Counted inside the row, so nothing is shuffled and a word is one row per text. ``length``, if
    named, is the number of all tokens of the text.
    """
    # A filter or an inner explode here would be run before the words are sorted, with its whole
    # input, and so cut and sort them once more. A text without words has no ends.
    sizes = [F.size("_w").alias(length)] if length else []
    runs = df.select(*keys, F.sort_array(tokens(F.col(text))).alias("_w"))
    # Places (from 1) of the last of equal words.
    ends = F.expr("filter(transform(_w, (w, i) -> IF(w <=> get(_w, i + 1), NULL, i + 1)), e -> e IS NOT NULL)")
    placed = runs.select("*", *sizes, ends.alias("_ends"))
    each = placed.select("*", F.posexplode_outer("_ends").alias("_j", "_e")).where(F.col("_e").isNotNull())
    earlier = F.coalesce(F.get("_ends", F.col("_j") - 1), F.lit(0))
    word, n = F.get("_w", F.col("_e") - 1), (F.col("_e") - earlier).cast("bigint")
    return each.select(*keys, *([length] if length else []), word.alias(name), n.alias("n"))


def sentences(c: Column) -> Column:
    return F.split(F.coalesce(c, F.lit("")), SENTENCE_BREAK)


def iso_utc(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def comment_line(author: Column, ts: Column, body: Column) -> Column:
    """One transcript entry. Missing author or time is written as ``None``."""
    return F.concat(
        F.lit("Comment by "),
        F.coalesce(author.cast("string"), F.lit("None")),
        F.lit(" at "),
        F.coalesce(iso_utc(ts), F.lit("None")),
        F.lit(":\n"),
        F.coalesce(body, F.lit("")),
    )
