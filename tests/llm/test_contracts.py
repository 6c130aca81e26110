"""Registered queries against brute force on the small tables."""

import math
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from threadlens.llm import langid, secrets, substrings, trigrams
from threadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def by_id(rows):
    found = {r["doc_id"]: r for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def run(spark, name, sf=SF):
    return by_id(QUERIES[name](spark, sf).collect())


def test_decontaminate(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = run(spark, "op2_decontaminate")
    hits = 0
    # All pairs of windows and words are slow to compare; look closely where a sixth word agrees.
    for d in documents[:200] + [d for d in documents if got[d["doc_id"]]["n_hit"]]:
        want = brute.contamination(d["text"], items)
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want
        hits += want[1] > 0
    assert hits and len(got) == len(documents)


def test_language(spark, documents):
    got = run(spark, "op4_language_id")
    right = total = 0
    for d in documents:
        r = got[d["doc_id"]]
        assert 0 <= r["score"] <= 1
        if r["held_out"] and any(c.isalpha() for c in d["text"] or ""):
            total += 1
            right += r["lang_pred"] == d["lang"]
    assert total > 100 and right / total > 0.95


def test_trigram_index(spark, documents):
    """Posting lists hold each row with a trigram once, in shards; candidates are those the Boolean queries let through."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    queries = [trigrams.query_of(rule.pattern) for rule in secrets.RULES]
    grams = sorted({g for q in queries for g in trigrams.grams_in(q)})
    repeated = table.unionByName(table)
    index = secrets.trigram_index(repeated, grams, shard_rows=90)
    lists, shards = {}, set()
    for r in index.collect():
        assert len(r["keys"]) == len(set(r["keys"]))
        shards.add(r["shard"])
        lists.setdefault(r["gram"], []).extend(r["keys"])
    keys = {r["doc_id"]: r["_key"] for r in secrets.keyed(table).select("doc_id", "_key").collect()}
    texts = {keys[d["doc_id"]]: (d["text"] or "").lower() for d in documents}
    assert len(shards) > 1 and lists.keys() <= set(grams)
    for gram in grams:
        assert sorted(lists.get(gram, [])) == sorted(k for k, text in texts.items() if gram in text)

    def holds(query, text):
        if isinstance(query, str):
            return query in text
        return (all if query[0] == "and" else any)(holds(part, text) for part in query[1])

    got = {r["_key"]: sorted(r["_ranks"]) for r in secrets.candidates(index, queries).collect()}
    wanted = {k: [i for i, q in enumerate(queries) if q != trigrams.ANY and holds(q, text)] for k, text in texts.items()}
    assert got == {k: ranks for k, ranks in wanted.items() if ranks}


def test_secrets(spark, documents):
    got = run(spark, "op5_secret_scan")
    for d in documents:
        r = got[d["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.secrets(d["text"]), d["doc_id"]
    assert sum(r["n_assign"] for r in got.values())


def test_chat(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    chats = defaultdict(list)
    for conv, turn, role, text in rows:
        chats[conv].append((turn, role, text or ""))
    got = {r["conv_id"]: r for r in QUERIES["op6_chat_format"](spark, SF).collect()}
    assert got.keys() == chats.keys()
    for conv, turns in chats.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == brute.sha("".join(f"{role}\n{t}\n" for _, role, t in turns))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), brute.sha(loss))
        assert r["formatted_chars"] > sum(len(t) for *_, t in turns)


def check_mix(rows, documents, near):
    sizes = {d["doc_id"]: len(brute.words(d["text"])) for d in documents}
    totals = Counter()
    for d in documents:
        totals[d["source"]] += sizes[d["doc_id"]]
    want = brute.targets(totals)
    taken = Counter()
    for d in documents:
        r = rows[d["doc_id"]]
        assert r["size"] == sizes[d["doc_id"]] and r["source_size"] == totals[d["source"]]
        assert r["target"] == pytest.approx(want[d["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[d["source"]] += r["taken"]
    for source, target in want.items():
        assert abs(taken[source] - target) <= near


def test_mix(spark, documents):
    got = run(spark, "op7_source_mix")
    check_mix(got, documents, 0.5)
    assert {k: r["taken"] for k, r in run(spark, "op7_source_mix").items()} == {k: r["taken"] for k, r in got.items()}


def test_simhash(spark, documents):
    got = run(spark, "op8_simhash")
    want = brute.components([(d["doc_id"], d["text"]) for d in documents])
    assert [(got[d["doc_id"]]["fingerprint"], got[d["doc_id"]]["component_id"]) for d in documents] == want
    assert len({c for _, c in want}) < len(want)


def test_quality(spark, documents):
    got = run(spark, "op9_quality")
    for d in documents:
        r = got[d["doc_id"]]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert tuple(r[n] for n in names) == brute.quality(d["text"]), d["doc_id"]
        assert not (r["kept"] and r["base_failed"])


def test_token_counts(spark):
    from tokenizers import Tokenizer, models

    from threadlens.llm.token_counts import SPACE_MARK, read_vocabulary

    vocabulary = list(read_vocabulary())
    pieces = [("<unk>", 0.0), *[(f"<0x{i:02X}>", -1e6) for i in range(256)], *vocabulary]
    unknown = min(s for _, s in vocabulary)
    pieces = [(p, s if s > -1e6 else unknown) for p, s in pieces]
    tokenizer = Tokenizer(models.Unigram(pieces, 0, byte_fallback=True))
    got = run(spark, "op1_token_counts", SMALL)
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect()[:60]:
        count = sum(len(tokenizer.encode(SPACE_MARK + w).ids) for w in brute.words(d["text"]))
        assert got[d["doc_id"]]["n_tokens"] == count


@pytest.mark.parametrize("crowd", [None, 1])
def test_substrings(spark, documents, crowd):
    if crowd is None:
        got = run(spark, "op3_substring_dedup")
    else:
        got = by_id(substrings.remove_repeats(spark.read.parquet(f"{SF}/documents.parquet"), crowd).collect())
    want = brute.repeats([d["text"] for d in documents])
    for d, expected in zip(documents, want):
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == expected, d["doc_id"]
    assert sum(w[1] > 0 for w in want) > 10


def test_language_kernel_against_its_definition(documents, monkeypatch):
    """Scores recomputed from sets of n-grams and the dual form of ridge regression."""
    monkeypatch.setattr(langid, "LANDMARKS_PER_LANGUAGE", 6)
    rows = [d for d in documents if d["lang"] and d["text"] and d["text"].strip()][:90]
    folded = [d["text"].translate(brute.UPPER).encode() for d in rows]
    sets = [{t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in folded]
    codes = [np.unique(langid.gram_codes(np.frombuffer(d["text"].encode(), np.uint8))) for d in rows]
    learned, labels = 60, [d["lang"] for d in rows]
    languages = sorted(set(labels[:learned]))
    model = langid.fit(languages, codes[:learned], labels[:learned])

    def spelled(code):
        return (code - (1 << 17)).to_bytes(3) if code >= 1 << 17 else (code - 256).to_bytes(2) if code >= 256 else bytes([code])

    known = {spelled(int(c)) for c in model.grams}
    sets = [s & known for s in sets]
    kernel = lambda a, b: len(a & b) / math.sqrt(max(len(a), 1) * max(len(b), 1))
    landmarks = [i for k in languages for i in [j for j in range(learned) if labels[j] == k][:6]]
    cross = np.array([[kernel(sets[i], sets[j]) for j in landmarks] for i in range(len(rows))])
    among = np.linalg.pinv(cross[landmarks], rcond=1e-6, hermitian=True)
    weigh = np.sqrt([1 / labels[:learned].count(x) for x in labels[:learned]])[:, None]
    wanted = np.array([[x == k for k in languages] for x in labels[:learned]], float)
    left = cross[:learned] * weigh
    dual = np.linalg.solve(left @ among @ left.T + langid.RIDGE * np.eye(learned), weigh * wanted)
    want = cross @ among @ left.T @ dual
    got = model.scores(langid.presence_rows([np.frombuffer(d["text"].encode(), np.uint8) for d in rows], model.lookup(), len(model.grams)))
    assert np.abs(got - want).max() < 1e-3 and (got.argmax(1) == want.argmax(1)).all()
