"""Date arithmetic, stamps and the named ranges."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Range name -> days, range name -> heading, form name -> form id.
RANGE_DAYS = {"24hr": 1, "last-week": 7, "last-month": 30}
RANGE_LABELS = {"24hr": "24Hr", "last-week": "Last Week", "last-month": "Last Month"}
FORM_IDS = {"account-billing": 360003888493, "technical-support": 14917317203995}


def created_cutoff(as_of: dt.datetime, days: int) -> dt.datetime:
    """Start of the day ``days`` before ``as_of``.

    Day granularity: the one-day range reaches back 24 to 48 hours.
    """
    return dt.datetime.combine(as_of.date() - dt.timedelta(days=days), dt.time())


def timeframe_label(range_name: Column) -> Column:
    """Heading for a range name; other names get dashes removed and capitals."""
    label = F.initcap(F.replace(range_name, F.lit("-"), F.lit(" ")))
    for name, text in RANGE_LABELS.items():
        label = F.when(range_name == name, F.lit(text)).otherwise(label)
    return label


def epoch_to_iso(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snapshot_stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def ticket_url(ticket_id: Column, base: str) -> Column:
    """Link to a ticket; ``base`` is the help desk's agent address."""
    return F.concat(F.lit(base.rstrip("/") + "/agent/tickets/"), ticket_id.cast("string"))
