"""Breakdown properties, drill-downs, deflection, snapshots and landed readers."""

import contextlib
import datetime as dt
import io
import json
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from threadlens.functions.labels import verdict_label
from threadlens.operators import breakdowns as B
from threadlens.operators import deflection as D
from threadlens.operators import running
from threadlens.plans.report import report
from threadlens.schemas import ACTIVITY, ANALYSIS, THREADS, csv_headings
from threadlens.sources import landed, snapshots
from threadlens.sources.shared import materialise, new_path

VERDICTS = [
    "Self Service Possible?: Yes\n\nReason:\nok", "Self Service Possible?: No\n\nReason:\nbad",
    "Self Service Possible?: Not sure", "Self Service Possible?: Maybe", "Error processing ticket: busy",
    "N/A", "", "first Self Service Possible?: Yes then Self Service Possible?: No",
]


def make_rows(n=400):
    rng = random.Random(5)
    pick = lambda *xs: rng.choice(xs)
    return [
        (
            i, pick("7", "Unassigned"), "2024-05-01T00:00:00Z", pick("Error 500 on login", 'a "q", b\nline2', " padded\t", "back\\slash"),
            pick(*VERDICTS), pick("", "N/A - No customer comment found.", "answer"), pick("Yes", "No", "Error", "N/A"),
            pick("because", "N/A"), pick("Billing", "Login", "N/A", ""), pick("", "do it"),
            pick("Angry", "Neutral", "Confused", "N/A"), "x", pick("é, text", "multi\n\nline", ""),
        )
        for i in range(n)
    ]


@pytest.fixture(scope="module")
def analysed(spark):
    return spark.createDataFrame(make_rows(), ANALYSIS).cache()


def test_breakdown_sums(analysed):
    shares = B.breakdowns(analysed, B.dimension_labels(analysed)).collect()
    by_dim = {}
    for r in shares:
        by_dim.setdefault(r["dim"], []).append(r)
    labelled = {
        "self_service": lambda r: verdict_label_of(r[4]),
        "bot_correct": lambda r: r[6] if r[6] in ("Yes", "No") else None,
        "sentiment": lambda r: None if r[10] == "N/A" else r[10],
        "theme": lambda r: r[8] if r[8] not in ("N/A", "") else None,
    }
    for dim, label in labelled.items():
        total = sum(label(r) is not None for r in make_rows())
        assert sum(r["n"] for r in by_dim[dim]) == total
        assert abs(sum(r["pct"] for r in by_dim[dim]) - 100) <= 0.1 * len(by_dim[dim])
    assert "Confused" in {r["label"] for r in by_dim["sentiment"]}


def verdict_label_of(text):
    import re

    m = re.search(r"Self Service Possible\?: (Yes|No)", text)
    return m and m.group(1)


def test_drilldown_matches_its_slice(analysed):
    for r in B.breakdowns(analysed, B.dimension_labels(analysed)).collect():
        got = B.drilldown(analysed, r["dim"], r["label"], B.DRILL_COLUMNS[r["dim"]])
        assert got.count() == r["n"]
        assert tuple(got.columns) == B.DRILL_COLUMNS[r["dim"]]


def test_text_drilldown_also_finds_later_mentions(analysed):
    both = analysed.where(F.col("self_service_analysis").startswith("first"))
    assert both.where(verdict_label(F.col("self_service_analysis")) == "No").count() == 0
    assert B.drilldown_by_text(both, "No").count() == both.count() > 0


def test_missing_column_and_empty_data(analysed):
    without = analysed.drop("theme")
    assert "theme" not in B.dimension_labels(without)
    assert B.theme_counts(without).count() == 0
    assert B.drilldown(without, "theme", "Billing").count() == 0
    assert B.breakdowns(analysed.limit(0), B.dimension_labels(analysed)).count() == 0


def test_order_and_caption(analysed):
    rows = B.breakdown(analysed, B.dimension_labels(analysed)["sentiment"]).collect()
    assert [(-r["n"], r["label"]) for r in rows] == sorted((-r["n"], r["label"]) for r in rows)
    assert all(r["caption"] == f"{r['n']} ({r['pct']:.1f}%)" for r in rows)


def test_report(spark, analysed):
    stamps = [dt.datetime(2024, 5, 1, h) for h in range(3)]
    events = spark.createDataFrame([(str(i), t) for i, t in enumerate(stamps)], ACTIVITY)
    parts = report(analysed, events, "24hr")
    head = parts["header"].first()
    assert (head["tickets"], head["conversations"], head["timeframe"]) == (400, 3, "24Hr")
    assert head["deflection"] == "3/400 (0.8%)"
    assert {r["theme"] for r in parts["themes"].collect()} == {"Billing", "Login"}
    none = D.deflection(analysed.limit(0), events).first()
    assert (none["deflection"], none["pct"]) == ("N/A", None)
    assert [tuple(r) for r in D.daily_counts(events).collect()] == [(dt.date(2024, 5, 1), 3)]


def test_csv_round_trip(spark, analysed):
    path = new_path(spark, "csv")
    names = csv_headings("Helper", "Helper.io")
    snapshots.write_csv(analysed, path, names)
    back = snapshots.read_csv(spark, path, names, missing_to_null=False)
    assert sorted(back.collect()) == sorted(analysed.collect())
    cleaned = snapshots.read_csv(spark, path, names)
    assert cleaned.where("theme IN ('', 'N/A')").count() == 0
    assert cleaned.count() == 400
    assert "Helper.io Suggestion" in spark.read.option("header", True).csv(path).columns


def test_snapshots(spark, analysed):
    path = new_path(spark, "snaps")
    for stamp, n in (("20240501_100000", 3), ("20240502_090000", 5), ("20231231_235959", 7)):
        snapshots.write_snapshot(analysed.limit(n), path, stamp)
    assert snapshots.read_latest_snapshot(spark, path).count() == 5
    assert snapshots.read_snapshot(spark, path, "20231231_235959").count() == 7
    assert not snapshots.has_rows(snapshots.read_snapshot(spark, path, "20990101_000000"))
    assert snapshots.read_latest_snapshot(spark, path).columns == ANALYSIS.fieldNames()


def test_landed_json(spark, tmp_path):
    (tmp_path / "threads").mkdir()
    thread = {"ticket_id": 1, "comments": [
        {"author_id": 5, "plain_body": "b", "created_at": "2024-01-01T00:00:00Z"},
        {"author_id": None, "public": False, "plain_body": None},
    ]}
    (tmp_path / "threads" / "a.json").write_text(json.dumps(thread) + "\n" + json.dumps({"ticket_id": 2, "comments": []}) + "\n")
    got = landed.read_comments(spark, str(tmp_path / "threads")).orderBy("pos").collect()
    assert [(r["pos"], r["author_id"], r["public"], r["plain_body"]) for r in got] == [(0, 5, None, "b"), (1, None, False, None)]
    (tmp_path / "tickets").mkdir()
    ticket = {"ticket_id": 1, "created_at": "2024-01-01T10:00:00Z", "status": "solved", "ticket_form_id": 9, "extra": 1}
    (tmp_path / "tickets" / "a.json").write_text(json.dumps(ticket))
    assert landed.read_tickets(spark, str(tmp_path / "tickets")).first()["created_at"] == dt.datetime(2024, 1, 1, 10)
    assert landed.read_tickets(spark, str(tmp_path / "tickets")).count() == 1


def test_bad_lines_cost_their_own_record(spark, tmp_path):
    good = [json.dumps({"ticket_id": i, "comments": [{"author_id": i, "plain_body": "x"}]}) for i in range(3)]
    bad = ['{"ticket_id": 7, "comm', '{"ticket_id": "seven", "comments": []}', "[1]"]
    (tmp_path / "a.json").write_text("\n".join([good[0], bad[0], "", good[1], bad[1], good[2], bad[2]]))
    comments = landed.read_comments(spark, str(tmp_path))
    assert comments.count() == 3 and {r["ticket_id"] for r in comments.collect()} == {0, 1, 2}
    assert landed.read_threads(spark, str(tmp_path)).count() == 3
    logged = landed.bad_lines(spark, str(tmp_path), THREADS, "threads").collect()
    assert sorted(r["message"] for r in logged) == sorted("BadRecord: " + line for line in bad)
    assert {(r["ticket_id"], r["stage"], r["error_class"]) for r in logged} == {(None, "threads", "BadRecord")}


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_events_by_day(spark, fmt):
    days = [dt.datetime(2024, 1, d, h) for d in range(1, 6) for h in (0, 12)]
    events = spark.createDataFrame([(str(i), t) for i, t in enumerate(days)], "conversation_id STRING, ts TIMESTAMP")
    path = new_path(spark, "activity")
    landed.land_events(events, path, fmt)
    found = landed.read_activity(spark, path, dt.datetime(2024, 1, 2, 6), dt.datetime(2024, 1, 4), fmt)
    assert sorted(r["conversation_id"] for r in found.collect()) == ["3", "4", "5", "6"]
    filters = re.search(r"PartitionFilters: \[(.*)\]", plan(found)).group(1)
    assert "day" in filters and ">= 2024-01-02" in filters and "<= 2024-01-04" in filters
    views = new_path(spark, "views")
    landed.land_events(events.withColumnRenamed("conversation_id", "event_id"), views, fmt)
    assert landed.read_article_views(spark, views, dt.datetime(2024, 1, 3), fmt).count() == 6


def test_runs_are_replaced_and_half_written_ones_are_not_the_newest(spark, analysed):
    path = new_path(spark, "snaps")
    assert not snapshots.has_rows(snapshots.read_latest_snapshot(spark, path))
    for n in (9, 4):
        snapshots.write_snapshot(analysed.limit(n), path, "20240501_100000")
    analysed.limit(6).write.parquet(f"{path}/{snapshots.STAMP}=20240601_100000")
    snapshots._note(spark, path, "20240601_100000", "started")
    newest = snapshots.read_latest_snapshot(spark, path)
    assert newest.count() == 4 and spark.read.parquet(path).count() == 10
    assert [r["stamp"] for r in snapshots.finished_runs(spark, path).collect()] == ["20240501_100000"]
    # The scan knows one run's folder only.
    assert "20240601" not in plan(newest) and "Subquery" not in plan(newest)
    assert all("20240501" in f for f in newest.inputFiles())


def test_csv_files_are_bounded_in_bytes(spark, analysed):
    path = new_path(spark, "csv")
    snapshots.write_csv(analysed, path, file_bytes=4000)
    sizes = [f.stat().st_size for f in Path(path).rglob("*.csv")]
    widest = max(len(json.dumps(list(map(str, r)))) for r in analysed.collect())
    assert len(sizes) > 3 and max(sizes) <= 4000 + 2 * widest + 400
    back = snapshots.read_csv(spark, path, missing_to_null=False)
    assert sorted(back.collect()) == sorted(analysed.collect())


def test_csv_texts_move_once(spark, analysed, monkeypatch):
    """What is written on the way to the files, and by the running total, are numbers only."""
    seen = []
    for module in (snapshots, running):
        monkeypatch.setattr(module, "materialise", lambda df, name: seen.append(df.dtypes) or materialise(df, name), raising=False)
    snapshots.write_csv(analysed, new_path(spark, "csv"), file_bytes=4000)
    assert seen and not any(kind == "string" for columns in seen for _, kind in columns)


def test_copies_of_one_row_come_in_several_csv_files(spark, analysed):
    path = new_path(spark, "csv")
    copies = analysed.where("ticket_id = 3").crossJoin(spark.range(300).select()).unionByName(analysed.limit(2).withColumn("ticket_id", F.lit(None).cast("long")))
    snapshots.write_csv(copies, path, file_bytes=4000)
    sizes = [f.stat().st_size for f in Path(path).rglob("*.csv")]
    assert len(sizes) > 3 and max(sizes) < 6000
    back = snapshots.read_csv(spark, path, missing_to_null=False)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, copies.collect()))
