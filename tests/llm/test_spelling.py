"""Spelling variants against all words with one character left out."""

import random
from collections import Counter

import brute
import numpy as np
import pytest
from test_edges import TEXTS, documents

from threadlens.llm import spelling
from threadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.fixture(scope="module")
def want(spark):
    return brute.spellings([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()])


def test_query(spark, want):
    assert rows_of(QUERIES["op12_spelling_variants"](spark, SF)) == want
    assert sum(r[1] is not None and r[1] != r[2] for r in want) > 100


def test_long_lists_are_cut(spark, want):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows_of(spelling.variants(docs, frequent=5, limit=8)) == want


def neighbours(word, alphabet):
    out = set()
    for i in range(len(word) + 1):
        out |= {word[:i] + c + word[i:] for c in alphabet}
        if i < len(word):
            out |= {word[:i] + word[i + 1 :]} | {word[:i] + c + word[i + 1 :] for c in alphabet}
    return out - {word}


@pytest.mark.parametrize("seed", range(12))
def test_near_words_share_a_list(seed):
    """For any frequent grams that a corpus could have; also the bound on affected grams itself."""
    rng = random.Random(seed)
    alphabet = rng.choice(["ab", "abcd"])
    vocabulary = ["".join(rng.choices(alphabet, k=rng.randint(5, 12))) for _ in range(60)]
    longest, limit = rng.choice([2, 3, 4, 6]), rng.choice([0, 2, 5, 20])
    counts = Counter(g for w in vocabulary for g in {w[p : p + q] for q in range(2, longest) for p in range(len(w) - q + 1)})
    dictionary = spelling.Dictionary({g: n for g, n in counts.items() if n > limit}, longest)

    def grams(word, anchored):
        kept, affected = dictionary.decomposed(word)
        return {(word[p:end], p - (len(word) if anchored else 0)) for p, end in kept}, affected

    for word in vocabulary:
        keys, loses = spelling.gram_keys(word, dictionary)
        pairs = set(spelling.pair_keys(word, dictionary))
        for other in neighbours(word, alphabet):
            if len(other) < 5:
                continue
            more, loses_too = spelling.gram_keys(other, dictionary)
            assert set(keys) & set(more) or (loses and loses_too and pairs & set(spelling.pair_keys(other, dictionary)))
            (front, affected), (back, _) = grams(word, False), grams(word, True)
            front_too, back_too = grams(other, False)[0], grams(other, True)[0]
            lost = sum((g, p) not in front_too and (g, p - len(word)) not in back_too for g, p in front)
            assert lost <= affected


def test_words_that_differ_by_one():
    words = ["abcdef", "abcdeg", "abcde", "bcdef", "abcdef", "abxdef", "acdef", "abcdeff", "zbcdeg"]
    for i, a in enumerate(words):
        for b in words[i:]:
            assert spelling.differ_by_one(a, b) == (b in neighbours(a, "abcdefgxz"))
    short = np.array([list(b"bcdef"), list(b"abcde"), list(b"abdef"), list(b"abdfe")], np.uint8)
    assert spelling.near_by_one(short, np.array([list(b"abcdef")] * 4, np.uint8)).tolist() == [True, True, True, False]


def test_edges(spark):
    got = rows_of(spelling.variants(documents(spark)))
    assert got == brute.spellings([(d, t) for d, t, _ in TEXTS])
    assert spelling.variants(documents(spark).limit(0)).count() == 0


def test_long_words_ties_and_chains(spark):
    long = "ab" * 600
    texts = ["lemon " * 3 + "lemons " * 6 + "lemonss " * 12 + "melon " * 6 + "lemXn " * 6, "ÀÉÎÕÜ àéîõü " * 4, "àéîõÿ " * 9]
    texts += [f"{long} {long} {long} {long}x {long}x {long}x {long[1:]} {long[1:]} {long[1:]} " * 2]
    texts += [None, "", "abcde " * 4 + "abcdf " * 8 + "abcdg " * 8]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    got = rows_of(spelling.variants(docs))
    assert got == brute.spellings(rows)
    found = {r[0]: r for r in got}
    assert found["abcde"][1] == "abcdf" and found["lemon"][2] == "lemonss"


def test_a_hot_gram(spark):
    """Very many words that share a beginning and an end, so their lists are long."""
    words = [f"{'interna'}{a}{b}{'tional'}" for a in "abcdefghij" for b in "abcdefghij"]
    rows = [(i, " ".join(words) + f" internaaa{i % 3}") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    assert rows_of(spelling.variants(docs, limit=16, longest=3)) == brute.spellings(rows)
