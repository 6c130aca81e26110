"""Ranked search against scoring every document for every item."""

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_edges import TEXTS, documents, rows_of

from threadlens.llm import lexical
from threadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
COLUMNS = ("item_id", "rank", "doc_id", "score")


def pairs(spark, name, key):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key, "text").collect()]


def test_query(spark):
    want = brute.ranking(pairs(spark, "documents", "doc_id"), pairs(spark, "benchmark", "item_id"))
    assert rows_of(QUERIES["op13_lexical_search"](spark, SF), *COLUMNS) == want
    small = lexical.ranked(
        spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"), shard_bytes=60_000, block_terms=300
    )
    assert rows_of(small, *COLUMNS) == want


@pytest.mark.parametrize("shard_bytes", [1, 1 << 24])
def test_edges(spark, shard_bytes):
    items = [(1, "One two three one"), (2, None), (3, ""), (4, "..."), (5, "word1 word996 nowhere"), (None, "some ÀÉ x"), (6, "x" * 200_000)]
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    got = lexical.ranked(documents(spark), bench, shard_bytes=shard_bytes)
    assert rows_of(got, *COLUMNS) == brute.ranking([(d, t) for d, t, _ in TEXTS], items)
    assert lexical.ranked(documents(spark).limit(0), bench).count() == 0
    assert lexical.ranked(documents(spark), bench.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "one")], "item_id STRING, text STRING")
    assert {r["item_id"] for r in lexical.ranked(documents(spark), named).collect()} == {"a"}


def test_ties_and_copies(spark):
    rows = [(100 - i, "same words here") for i in range(40)] + [(None, "same words here")] + [(200 + i, f"other{i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(7)
    bench = spark.createDataFrame([(1, "words same"), (2, "other5 other7 here")], "item_id LONG, text STRING")
    got = rows_of(lexical.ranked(docs, bench, shard_bytes=40), *COLUMNS)
    assert got == brute.ranking(rows, [(1, "words same"), (2, "other5 other7 here")])
    assert [r[2] for r in sorted(got) if r[0] == 1] == list(range(61, 71))


@given(st.lists(st.integers(0, 2**40), min_size=1, max_size=50))
def test_numbers(values):
    data, ends = lexical.packed_numbers(np.array(values))
    assert lexical.unpacked_numbers(data).tolist() == values
    assert [int(lexical.unpacked_numbers(data[a:b])[0]) for a, b in zip(ends, ends[1:])] == values


def test_blocks_are_rejected_before_they_are_decompressed():
    """A frequent term's blocks are only opened where a candidate can still win."""
    builder = lexical.ShardBuilder()
    for i in range(20_000):
        terms = [b"common"] * (1 + i % 3) + [b"filler%d" % (i % 50)] * 5 + ([b"rare"] * 3 if i % 400 == 7 else [])
        builder.add(i, terms, 1)
    norm, columns = builder.lists(20_000, sum(len(p) for p in builder.parts))
    shard = lexical.Shard(None, norm)
    for i, term in enumerate(columns["term"].to_pylist()):
        own = [columns[c][i].values.to_numpy() for c in ("lasts", "bounds", "ends")]
        shard.lists[term] = lexical.List(*own, np.frombuffer(columns["payload"][i].as_py(), np.uint8))
    opened = []
    common = shard.lists[b"common"]
    plain = common.block
    common.block = lambda b: opened.append(b) or plain(b)
    places, scores = shard.search([(b"rare", 6000), (b"common", 10)], 0, 10)
    assert len(places) >= 10 and common.whole is None
    assert 0 < len(opened) <= 50 < len(common.ends)


@settings(max_examples=60, deadline=None)
@given(st.data())
def test_search_finds_the_best(data):
    word = st.sampled_from([b"a", b"b", b"c", b"d", b"e"])
    texts = data.draw(st.lists(st.lists(word, min_size=1, max_size=12), min_size=1, max_size=60))
    builder = lexical.ShardBuilder()
    for i, terms in enumerate(texts):
        builder.add(i, terms, 1)
    norm, columns = builder.lists(len(texts), sum(map(len, texts)))
    shard = lexical.Shard(None, norm)
    for i, term in enumerate(columns["term"].to_pylist()):
        own = [columns[c][i].values.to_numpy() for c in ("lasts", "bounds", "ends")]
        shard.lists[term] = lexical.List(*own, np.frombuffer(columns["payload"][i].as_py(), np.uint8))
    query = [(t, data.draw(st.integers(0, 900))) for t in (b"a", b"b", b"c", b"x")]
    want = [sum(w * int(lexical.part_of_score(np.array([d.count(t)]), norm[i])[0]) for t, w in query) for i, d in enumerate(texts)]
    places, scores = shard.search(query, 0, 3)
    got = dict(zip(places.tolist(), scores.tolist()))
    best = sorted((-s, i) for i, s in enumerate(want) if s > 0)[:3]
    assert all(got[i] == -s for s, i in best)
    assert all(want[i] == s for i, s in got.items())
