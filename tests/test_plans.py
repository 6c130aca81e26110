"""Physical plans: what is pushed to the scan, what is shuffled and what is not there."""

import contextlib
import io
import re

import pytest

from checks import QUERIES
from threadlens import standins as S
from threadlens.operators import threads

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_ticket_selection_reaches_the_scan(spark):
    text = plan(QUERIES["s1_ticket_scan"](spark, SF))
    pushed = re.search(r"PushedFilters: \[(.*)\]", text).group(1)
    for part in ("GreaterThanOrEqual(o_orderdate", "In(o_orderstatus", "EqualTo(o_orderpriority"):
        assert part in pushed
    assert "Exchange" not in text


def test_event_window_reaches_the_scan(spark):
    text = plan(QUERIES["a13_daily_conversations"](spark, SF))
    assert "GreaterThanOrEqual(ts" in text and "LessThanOrEqual(ts" in text
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz>", text)


def test_breakdown_reads_label_columns_only_and_counts_before_shuffling(spark):
    text = plan(QUERIES["w1_share_of_total"](spark, SF))
    assert "ReadSchema: struct<lang:string,source:string>" in text
    assert "partial_count" in text and "Window" not in text


@pytest.mark.parametrize("name", ["f1_nullify_na", "f9_verdict_extract", "p4_ticket_url", "r4_public_comments", "f18_snapshot_stamp"])
def test_column_functions_need_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Python" not in text and "ArrowEval" not in text


@pytest.mark.parametrize("name", ["b7_entity_redaction"])
def test_small_gazetteer_needs_no_join(spark, name):
    assert "Join" not in plan(QUERIES[name](spark, SF))


def test_no_window_and_no_product_anywhere(spark):
    single_row = {"j4_totals_pair", "a15_deflection", "a15_deflection_no_tickets", "a17_dashboard_header"}
    for name in ("j1_ticket_threads", "a6_transcript", "w2_first_comment_row", "r5_author_roles", "b1_lexicon_sentiment",
                 "b2_term_themes", "b4_best_article", "b5_top_sentence", "a17_dashboard", *single_row):
        text = plan(QUERIES[name](spark, SF))
        assert "Window" not in text, name
        assert "CartesianProduct" not in text, name
        assert ("NestedLoop" in text) == (name in single_row), name


def test_arrays_shuffle_nothing_but_the_join(spark):
    nested = spark.createDataFrame([], "ticket_id BIGINT, comments ARRAY<STRUCT<author_id: BIGINT, public: BOOLEAN, plain_body: STRING, created_at: TIMESTAMP>>")
    text = plan(threads.assemble_arrays(S.tickets(spark, SF), nested))
    assert "Aggregate" not in text and "Generate" not in text


def test_opening_comments_are_found_among_positions(spark):
    text = plan(threads.answer_bounds(S.tickets(spark, SF), S.comments(spark, SF)))
    assert re.search(r"HashAggregate[\s\S]*partial_min\(pos", text)
    assert "min_by" not in text and "max_by" not in text


def test_newest_snapshot_reads_one_folder(spark):
    df = QUERIES["s6_latest_snapshot"](spark, SF)
    assert "Subquery" not in plan(df) and "PartitionFilters" not in plan(df)
    assert {f.split("snapshot_ts=")[1].split("/")[0] for f in df.inputFiles()} == {"20240102_090000"}
