"""Baselines against brute force, and both ways of every size-dependent join."""

import collections
import contextlib
import io
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from checks import QUERIES
from threadlens.operators.baselines import entities, retrieval, sentiment, summary, themes
from threadlens.functions.text import word_counts
from threadlens.operators import joins
from threadlens.operators.joins import fits, heavy_keys, lookup
from threadlens.sources.shared import materialise

RNG = random.Random(3)
WORDS = ["the"] * 12 + [f"w{i}" for i in range(60)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


ARTICLES = [(i, prose(RNG.randint(1, 40))) for i in range(80)] + [(200, ""), (201, "only"), (202, "only")]
QUESTIONS = [(i, prose(RNG.randint(1, 12))) for i in range(150)] + [(900, "only"), (901, "unseen"), (902, None)]


def tok(s):
    return [t for t in re.split(r"[\W_]+", (s or "").lower()) if t]


def brute_best():
    docs = {i: collections.Counter(tok(t)) for i, t in ARTICLES}
    n, avg = len(docs), sum(sum(d.values()) for d in docs.values()) / len(docs)
    df = collections.Counter(t for d in docs.values() for t in d)
    best = {}
    for q, text in QUESTIONS:
        scored = []
        for i, d in docs.items():
            hits = [t for t in set(tok(text)) if t in d]
            if hits:
                norm = 1.2 * (0.25 + 0.75 * sum(d.values()) / avg)
                s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * d[t] * 2.2 / (d[t] + norm) for t in hits)
                scored.append((-round(s, 6), i))
        if scored:
            best[q] = (min(scored)[1], -min(scored)[0])
    return best


@pytest.fixture(scope="module")
def knowledge(spark):
    return spark.createDataFrame(ARTICLES, "doc_id BIGINT, text STRING")


@pytest.mark.parametrize("seeds, bands", [(8, 2), (1, 1), (3, 50)])
def test_retrieval_is_exact_for_any_blocking(spark, knowledge, monkeypatch, seeds, bands):
    monkeypatch.setattr(retrieval, "SEEDS", seeds)
    monkeypatch.setattr(retrieval, "BANDS", bands)
    asked = spark.createDataFrame(QUESTIONS, "ticket_id BIGINT, customer_issue STRING")
    got = retrieval.best_articles(asked, retrieval.build_index(knowledge))
    got = {r["ticket_id"]: (r["doc_id"], r["score"]) for r in got.collect()}
    expected = brute_best()
    assert got.keys() == expected.keys()
    assert all(got[q][0] == expected[q][0] and abs(got[q][1] - expected[q][1]) < 1e-6 for q in got)
    assert got[900][0] == 201


def test_questions_meet_few_blocks_and_articles(spark):
    """Common words are in most articles, yet a question meets a small part of blocks and articles."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(30)]
    texts = [" ".join(rng.choices(common, k=60) + rng.choices([f"r{i}" for i in range(4000)], k=25)) for _ in range(1500)]
    articles = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    asked = [(q, " ".join(rng.sample(common, 12) + rng.sample(texts[q * 7].split()[60:], 6))) for q in range(120)]
    questions = spark.createDataFrame(asked, "ticket_id BIGINT, customer_issue STRING")
    postings = retrieval.build_index(articles).weights().withColumn("band", retrieval.band_of(F.col("weight"))).cache()
    bounds = retrieval.with_bounds(retrieval.question_terms(retrieval.numbered_questions(questions, "customer_issue")), postings).cache()
    blocks = retrieval.wanted_blocks(bounds, retrieval.floors(bounds, postings))
    every = 120 * postings.select("term", "band").distinct().count()
    assert blocks.count() * 100 < every
    met = blocks.join(postings, ["term", "band"]).where("weight >= need").select("question", "doc_id").distinct().count()
    assert met * 5 < 120 * 1500, met
    best = {r["ticket_id"]: r["doc_id"] for r in retrieval.best_articles(questions, retrieval.build_index(articles)).collect()}
    assert all(best[q] == q * 7 for q in range(120))


@pytest.mark.parametrize("most", [0, 1_000])
def test_the_search_broadcasts_only_counted_tables(spark, knowledge, monkeypatch, most):
    """A plan may take a table with very many rows for a small one, so every join says how it is done."""
    monkeypatch.setattr(retrieval, "MOST_MET", most)
    plans, own = [], retrieval.materialise
    plan_of = lambda df: str(df._jdf.queryExecution().optimizedPlan())

    def seen(df, name):
        plans.append(plan_of(df))
        return own(df, name)

    monkeypatch.setattr(retrieval, "materialise", seen)
    asked = spark.createDataFrame(QUESTIONS, "ticket_id BIGINT, customer_issue STRING")
    plans.append(plan_of(retrieval.answer_from_articles(asked, knowledge, retrieval.build_index(knowledge))))
    lines = [line for plan in plans for line in plan.splitlines() if "Join " in line]
    assert len(lines) > 10 and all("strategy=merge" in line or "strategy=broadcast" in line for line in lines), lines


def test_few_rows_are_broadcast_and_many_merged(spark):
    rows, dim = spark.range(10).toDF("k"), materialise(spark.range(5).selectExpr("id AS k", "'x' AS v"), "dim")
    for most, join in ((5, "BroadcastHashJoin"), (4, "SortMergeJoin")):
        joined = rows.join(joins.if_few(dim, most), "k")
        assert sorted(r["k"] for r in joined.collect()) == [0, 1, 2, 3, 4]
        assert join in str(joined._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("share", [1e-9, 4, 1e9])
def test_common_words_score_as_others(spark, knowledge, monkeypatch, share):
    """However many words go by the product of matrices, the best articles are the same."""
    monkeypatch.setattr(retrieval, "MOST_MET", 0)
    monkeypatch.setattr(retrieval, "COMMON_SHARE", share)
    asked, index = spark.createDataFrame(QUESTIONS, "ticket_id BIGINT, customer_issue STRING"), retrieval.build_index(knowledge)
    got = {r["ticket_id"]: (r["doc_id"], r["score"]) for r in retrieval.best_articles(asked, index).collect()}
    expected = brute_best()
    assert got.keys() == expected.keys()
    assert all(got[q][0] == expected[q][0] and abs(got[q][1] - expected[q][1]) < 1e-6 for q in got)


@pytest.mark.parametrize("words", [500_000, 100])
def test_unselective_questions_are_scored_in_the_tasks(spark, knowledge, monkeypatch, words):
    """Questions that meet many articles give the same rows, and write no pairs of questions and articles."""
    for name, value in (("MOST_MET", 0), ("TERMS_AT_ONCE", words), ("QUESTIONS_AT_ONCE", 7), ("ARTICLES_AT_ONCE", 16)):
        monkeypatch.setattr(retrieval, name, value)
    written, own = collections.Counter(), retrieval.materialise

    def counted(df, name):
        out = own(df, name)
        if {"question", "doc_id"} <= set(out.columns):
            written[name] += out.count()
            assert name != "best-of-tasks" or out.groupBy("question").count().agg(F.max("count")).first()[0] <= spark.sparkContext.defaultParallelism
        return out

    monkeypatch.setattr(retrieval, "materialise", counted)
    asked = spark.createDataFrame(QUESTIONS, "ticket_id BIGINT, customer_issue STRING")
    got = {r["ticket_id"]: (r["doc_id"], r["score"]) for r in retrieval.best_articles(asked, retrieval.build_index(knowledge)).collect()}
    expected = brute_best()
    assert got.keys() == expected.keys()
    assert all(got[q][0] == expected[q][0] and abs(got[q][1] - expected[q][1]) < 1e-6 for q in got)
    assert written["best-of-tasks"] and sum(written.values()) == written["best-of-tasks"]


def test_in_tasks_ties_ids_and_copies(spark, monkeypatch):
    """Equal scores go to the lowest id, also below zero; rows that come twice are one article, as by the bounds."""
    rows = [(5, "red fox"), (-3, "red fox"), (9, "red fox"), (4, "blue"), (4, "blue"), (3, "blue green sea"), (7, "blue"), (8, "")]
    articles = spark.createDataFrame(rows, "doc_id INT, text STRING")
    asked = spark.createDataFrame([(1, "fox red"), (2, "blue"), (3, "sea green"), (4, "none")], "ticket_id BIGINT, customer_issue STRING")
    found = {}
    for most in (0, 10**9):
        monkeypatch.setattr(retrieval, "MOST_MET", most)
        best = retrieval.best_articles(asked, retrieval.build_index(articles))
        found[most] = (best.dtypes, sorted(map(tuple, best.collect())))
    assert found[0] == found[10**9]
    assert [r[:2] for r in found[0][1]] == [(1, -3), (2, 4), (3, 3)]


def test_empty_knowledge(spark, knowledge):
    asked = spark.createDataFrame(QUESTIONS, "ticket_id BIGINT, customer_issue STRING")
    none = knowledge.where("doc_id < 0")
    got = retrieval.answer_from_articles(asked, none, retrieval.build_index(none))
    assert {r["bot_answer"] for r in got.collect()} == {retrieval.NO_ARTICLE, "N/A - No customer comment found."}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_split_lookup_equals_broadcast(spark, how):
    # One key holds a third of the rows.
    rows = spark.range(3000).select(
        F.col("id").alias("ticket_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("term"),
    )
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("k1", 3), ("zz", 4)], "term STRING, v INT")
    assert fits(dim) and not fits(dim, max_rows=3) and not fits(dim, max_bytes=8)
    assert [r["term"] for r in heavy_keys(rows, "term", 100).collect()] == ["hot"]
    assert heavy_keys(rows, "term", 0, most=10).count() == 1 and heavy_keys(rows, "term").count() == 0
    small = lookup(rows, dim, "term", how)
    for heavy_rows in (100, 0, 10_000):
        large = lookup(rows, dim, "term", how, max_rows=0, heavy_rows=heavy_rows)
        assert large.columns == small.columns
        assert sorted(map(repr, large.collect())) == sorted(map(repr, small.collect()))


def test_heavy_words_are_not_shuffled_to_the_dimension(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("term"), F.col("id"))
    dim = spark.range(500).select(F.concat(F.lit("k"), "id").alias("term"), F.col("id").alias("v"))
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        lookup(rows, dim, "term", max_rows=0, heavy_rows=100).explain("formatted")
    assert "BroadcastHashJoin LeftSemi" in out.getvalue() and "BroadcastHashJoin LeftAnti" in out.getvalue()
    assert "_salt" not in out.getvalue()


def test_words_are_counted_inside_the_row(spark):
    texts = ["b a B c b", "", None, "...", "x", "é É e"]
    df = spark.createDataFrame(list(enumerate(texts)), "id INT, text STRING")
    got = sorted(tuple(r) for r in word_counts(df, "text", ["id"], "w").collect())
    assert got == [(0, "a", 1), (0, "b", 3), (0, "c", 1), (4, "x", 1), (5, "e", 1), (5, "é", 2)]
    assert "Exchange" not in word_counts(df, "text", ["id"], "w")._jdf.queryExecution().toString()


def test_words_are_cut_and_sorted_once(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, "")], "id INT, text STRING")
    found = word_counts(df, "text", ["id"], "w", "length")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, "a", 1), (1, 3, "b", 2)]


def test_index_counts_words_where_the_text_lies(spark, monkeypatch):
    written, write = [], retrieval.materialise
    monkeypatch.setattr(retrieval, "materialise", lambda df, name: written.append((name, df)) or write(df, name))
    rows = [(1, "a b a"), (2, "x"), (None, "p q"), (3, None), (4, "")]
    index = retrieval.build_index(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    assert [name for name, _ in written].count("term-counts") == 1
    assert "Exchange" not in dict(written)["term-counts"]._jdf.queryExecution().toString()
    got = {tuple(r) for r in index.counts.select("doc_id", "dl", "term", "tf").collect()}
    assert got == {(1, 3, "a", 2), (1, 3, "b", 1), (2, 1, "x", 1), (None, 2, "p", 1), (None, 2, "q", 1)}
    assert (index.documents, index.length, index.entries) == (5, 6, 5)


def test_index_of_repeated_ids(spark):
    rows = [(1, "a b a"), (1, "b c c"), (1, "a"), (2, "x"), (None, "p q"), (None, "p p"), (3, None), (3, "")]
    index = retrieval.build_index(spark.createDataFrame(rows, "doc_id BIGINT, text STRING"))
    got = sorted((tuple(r) for r in index.counts.select("doc_id", "dl", "term", "tf").collect()), key=str)
    want = [(1, 3, "a", 2), (1, 3, "b", 2), (1, 3, "c", 2), (1, 1, "a", 1), (2, 1, "x", 1), (None, 2, "p", 3), (None, 2, "q", 1)]
    assert got == sorted(want, key=str)
    assert (index.documents, index.length, index.entries) == (8, 12, 7)


def test_sentiment_labels(spark):
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1)], "word STRING, score INT")
    rows = [(1, "good good GOOD"), (2, "good"), (3, "good bad"), (4, "bad, bad"), (5, "bad bad bad"), (6, "plain"), (7, None), (8, "")]
    got = sentiment.lexicon_sentiment(spark.createDataFrame(rows, "ticket_id BIGINT, customer_issue STRING"), lexicon)
    assert [r["sentiment"] for r in got.orderBy("ticket_id").collect()] == [
        "Delighted", "Positive", "Neutral", "Frustrated", "Angry", "Neutral", "N/A", "N/A",
    ]


def test_summary_takes_the_rarest_sentence(spark, knowledge):
    comments = spark.createDataFrame(
        [(1, 0, "the the. the w1! Unheard words here?  "), (1, 1, "w2"), (2, 0, "..."), (3, 0, None)],
        "ticket_id BIGINT, pos BIGINT, plain_body STRING",
    )
    got = summary.top_sentences(comments, retrieval.build_index(knowledge)).collect()
    assert [tuple(r) for r in got] == [(1, "Unheard words here")]


GAZETTEER = [("Ann", "PERSON"), ("Ann Lee", "PERSON"), ("Acme", "ORG"), ("of acme", "ORG"), ("Lisbon", "GPE")]


@pytest.mark.parametrize("inline", [100, 0])
def test_entities(spark, inline):
    rows = [(1, "Ann Lee of Acme met Ann, not Annabel or éAnn."), (2, "ACME-Acme in Lisbon"), (3, "nobody"), (4, None), (5, "Ann  Lee")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    gazetteer = spark.createDataFrame(GAZETTEER, "term STRING, label STRING")
    got = entities.redact_entities(df, gazetteer, "text", ["doc_id"], inline_terms=inline)
    assert [r["text"] for r in got.orderBy("doc_id").collect()] == [
        "[REDACTED PERSON] [REDACTED ORG] met [REDACTED PERSON], not Annabel or éAnn.",
        "[REDACTED ORG]-[REDACTED ORG] in Lisbon",
        "nobody",
        None,
        "[REDACTED PERSON]",
    ]


def test_only_tokens_that_begin_a_term_are_looked_up(spark, monkeypatch):
    met = []
    monkeypatch.setattr(entities, "lookup", lambda rows, dim, on: met.append(rows) or lookup(rows, dim, on))
    df = spark.createDataFrame([(1, "word " * 500 + "Ann Lee"), (2, "nobody " * 500)], "doc_id BIGINT, text STRING")
    gazetteer = spark.createDataFrame(GAZETTEER, "term STRING, label STRING")
    got = entities.redact_entities(df, gazetteer, "text", ["doc_id"], inline_terms=0)
    assert [r["text"][-17:] for r in got.orderBy("doc_id").collect()] == ["[REDACTED PERSON]", "dy nobody nobody "]
    assert sorted(r["opening"] for r in met[0].collect()) == ["ann", "ann lee"]


def test_entities_in_odd_texts_are_the_same_by_join(spark):
    texts = [
        "", " ", "...", "Ann", "[REDACTED EMAIL]Ann[REDACTED ORG] Lee", "Ann [REDACTED PHONE] Lee", "[ann] [REDACTED X] ANN\n\nlee",
        "İnn inn ΟΔΟΣ. οδος Οδοσ", "ann lee of", "ann\U0001F600lee x\U00010400y", "acme of acme of ACME", "one two three one two three four",
    ]
    terms = [*GAZETTEER, ("inn", "ORG"), ("İnn", "PERSON"), ("οδοσ", "ORG"), ("ΟΔΟΣ", "PERSON"), ("one two three four", "ORG")]
    rows = [*enumerate(texts), (3, "of Acme met Ann"), (7, "Ann")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    gazetteer = spark.createDataFrame(terms, "term STRING, label STRING")
    plain, joined = (
        sorted(tuple(r) for r in entities.redact_entities(df, gazetteer, "text", ["doc_id"], inline_terms=n).collect()) for n in (100, 0)
    )
    assert joined == plain and (3, "[REDACTED ORG] met [REDACTED PERSON]") in joined
    assert (11, "one two three [REDACTED ORG]") in joined


def test_a_name_inside_an_address(spark):
    df = spark.createDataFrame([(1, 0, "Ann wrote from ann@acme.org")], "ticket_id BIGINT, pos BIGINT, plain_body STRING")
    gazetteer = spark.createDataFrame(GAZETTEER, "term STRING, label STRING")
    got = entities.redact_all(df, "plain_body", ["ticket_id", "pos"], gazetteer).first()["plain_body"]
    assert got == "[REDACTED PERSON] wrote from [REDACTED EMAIL]"


def test_spans_from_the_right(spark):
    spans = [("PERSON", 0, 3), ("DATE", 4, 7), ("ORG", 8, 12)]
    df = spark.createDataFrame([("Ann met Acme!", spans)], "t STRING, s ARRAY<STRUCT<label: STRING, start: INT, end: INT>>")
    assert df.select(entities.mask_spans(F.col("t"), F.col("s"))).first()[0] == "[REDACTED PERSON] met [REDACTED ORG]!"


def test_theme_discovery(spark):
    groups = ["card payment invoice", "login password reset", "parcel courier late", "refund return label", "screen crash update"]
    rows = [(i, groups[i % 5]) for i in range(100)]
    got = themes.discover_themes(spark.createDataFrame(rows, "ticket_id BIGINT, summary STRING"), k=5)
    seen = collections.defaultdict(set)
    for ticket, theme in got.collect():
        seen[theme].add(ticket % 5)
    assert sum(map(len, seen.values())) >= 5 and len(seen) >= 3
    assert all(t != "N/A" for t in seen)
    with pytest.raises(ValueError):
        themes.discover_themes(got, k=4)


def test_theme_discovery_keeps_vectors_only(spark, monkeypatch):
    """The cached table holds the vectors, not the words of the texts, which take several times their room."""
    frame, kept = type(spark.range(1)), []
    monkeypatch.setattr(frame, "persist", lambda self, *a, own=frame.persist: kept.append(self.columns) or own(self, *a))
    rows = [(i, f"card payment w{i % 7}") for i in range(40)]
    got = themes.discover_themes(spark.createDataFrame(rows, "ticket_id BIGINT, summary STRING"), k=5)
    assert got.count() == 40 and kept and all("words" not in columns for columns in kept)


def test_discovery_invariants_move_no_text(spark, tmp_path):
    """Texts are cut into words where they lie: no join comes before that."""
    rows = [(i, f"alpha beta gamma {'red' if i % 2 else 'blue'} word{i % 7}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    found = QUERIES["b2_discovery_invariants"](spark, str(tmp_path))
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    cuts = [i for i, line in enumerate(lines) if "split(lower(" in line]
    assert cuts
    for i in cuts:
        below = itertools.takewhile(lambda line: depth(line) > depth(lines[i]), lines[i + 1 :])
        assert not any("Join" in line for line in below)
    got = [tuple(r) for r in found.collect()]
    assert sorted(got) == [(i, 1, True, True) for i in range(60)]
