"""Packing: every token once, sequences full, every window near the target mixture."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_edges import LONG, TEXTS, documents
from tokenizers import Tokenizer

from threadlens.llm import packing
from threadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
PATH = packing.vocabulary_path()


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [1]


def check_sequences(pieces, sequence=2048):
    """Pieces fill sequences without gaps, all but the last full; the tokens of each by source."""
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    fill = []
    for number in sorted(by_sequence):
        at = 0
        for p in sorted(by_sequence[number], key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        fill.append(at)
    assert all(f == sequence for f in fill[:-1]) and 0 < fill[-1] <= sequence
    assert sorted(by_sequence) == list(range(len(fill)))
    return by_sequence


def test_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    source = {d["doc_id"]: d["source"] for d in rows}
    pieces = QUERIES["op11_mixture_packing"](spark, SF).collect()
    by_document = defaultdict(list)
    for p in pieces:
        by_document[p["doc_id"]].append(p)
    totals = Counter()
    tokenizer = Tokenizer.from_file(PATH)
    for d in rows:
        ids = np.array(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        totals[d["source"]] += len(ids)
        at = 0
        for p in sorted(by_document[d["doc_id"]], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"] : at].tobytes())
        assert at == len(ids)
    share = {s: n / sum(totals.values()) for s, n in totals.items()}
    got, done = Counter(), 0
    for number, own in sorted(check_sequences(pieces).items()):
        here = Counter()
        for p in own:
            here[source[p["doc_id"]]] += p["length"]
        got.update(here)
        done += here.total()
        # Deficits are carried: no source is ever two services from its share, nor is a window.
        for s, part in share.items():
            service = max(packing.LEAST_SERVICE, 2048 * part)
            assert abs(got[s] - done * part) <= 2 * service + 1
            assert here.total() < 2048 or abs(here[s] - 2048 * part) <= 2 * service + 1


@pytest.mark.parametrize("per_run", [1, 3, 1000])
def test_runs_take_over_deficits(spark, per_run):
    """The cut into runs of rounds changes nothing: neither the order of services nor the windows."""
    rows = [(i, f"word{i} and some more words " * (i % 7), f"s{i % 3}" if i % 4 else "hot") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").coalesce(1)
    take = lambda n: sorted(
        (r["doc_id"], r["start"], r["length"], r["sequence_id"], r["offset"])
        for r in packing.packed(docs, PATH, sequence=64, least=8, per_run=n).collect()
    )
    whole = {(d, start + k): (q, o + k) for d, start, n, q, o in take(100_000) for k in range(n)}
    assert {(d, start + k): (q, o + k) for d, start, n, q, o in take(per_run) for k in range(n)} == whole


def test_weights(spark):
    rows = [(i, "some words " * 50, "ab"[i % 2]) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    weights = spark.createDataFrame([("a", 3.0), ("b", 1.0)], "source STRING, weight DOUBLE")
    pieces = packing.packed(docs, PATH, weights, sequence=256, least=16).collect()
    windows = check_sequences(pieces, 256)
    assert sum(p["length"] for p in pieces) == 200 * 101
    first = Counter()
    for number in range(40):
        own = Counter()
        for p in windows[number]:
            own[p["source"]] += p["length"]
        assert abs(own["a"] - 192) <= 2 * 64
        first.update(own)
    assert abs(first["a"] / first.total() - 0.75) < 0.02
    # Queue a ends first; what is left is b alone.
    assert {p["source"] for p in windows[max(windows)]} == {"b"}


def test_edges(spark):
    pieces = packing.packed(documents(spark), PATH).collect()
    check_sequences(pieces)
    tokens = Counter()
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        tokens[p["doc_id"], p["source"]] += p["length"]
    want = Counter()
    for doc, text, source in TEXTS:
        want[doc, source] += len(ids_of(text))
    assert tokens == want
    long = sorted((p["start"], p["ids"]) for p in pieces if p["doc_id"] == 5)
    assert np.frombuffer(b"".join(i for _, i in long), "<u4").tolist() == ids_of(LONG)
    assert packing.packed(documents(spark).limit(0), PATH).count() == 0


def test_many_small_sources_and_one_hot(spark):
    rows = [(i, "a b c " * 30, "hot" if i % 3 == 0 else f"source{i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    pieces = packing.packed(docs, PATH, sequence=512, least=32, per_run=8).collect()
    windows = check_sequences(pieces, 512)
    for number, own in windows.items():
        hot = sum(p["length"] for p in own if p["source"] == "hot")
        if number < max(windows):
            assert abs(hot - 512 / 3) <= 200
    assert sum(p["length"] for p in pieces) == 600 * 91


@pytest.mark.parametrize("text", ["á ́b é", " x y\u0085z", "don't  'S\n'll \x1c\x1d", "<|endoftext|> a<|startoftext|>b", "ᄀ ᅡᆨ ΑΣ ΣΑΣ", "\U0001f600‍ ﻿ 12 3a", "Émigré, ÇA. ŸÿŒ ẞß µm ªº K İi a, b., c?! d;", "naïve: ÀÉ× ÷ é́ ŉ ǅ"])
def test_words_alone_give_the_ids_of_a_text(text):
    known = packing.WordIds(PATH)
    assert np.frombuffer(known.document(text.encode()), known.kind).tolist() == ids_of(text)
