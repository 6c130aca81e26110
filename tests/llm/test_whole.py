"""What operators hand on besides digests and counts."""

import random
from collections import Counter, defaultdict

import brute
import numpy as np

from threadlens.llm import decontaminate, langid, mixing, quality, substrings, toxicity
from threadlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_substrings_return_texts_and_ranges(spark):
    word = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    passage = word(0, 40)
    texts = {
        1: f" start here\n\n{passage}\n\nthe  end\n",
        2: f"{passage} after",
        3: f"alone\t{word(100, 160)}\n",  # untouched
        4: word(200, 240),  # copies
        5: word(200, 240),
        6: "short\n",
        7: None,
        8: "",
        9: f"é {word(300, 340)}\n{word(300, 340)} ü",  # repeats itself
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    got = {r["doc_id"]: r for r in substrings.remove_repeats(rows).collect()}
    left = {k: r["text"] for k, r in got.items()}
    assert left == {
        1: " start here\n\nthe  end\n", 2: "after", 3: texts[3], 4: "", 5: "", 6: "short\n", 7: None, 8: "", 9: "é ü"
    }
    for (key, text), expected in zip(texts.items(), brute.repeats(list(texts.values()))):
        r = got[key]
        gone = {i for a, b in r["removed"] for i in range(a, b)}
        kept = [w for i, w in enumerate(brute.words(text)) if i not in gone]
        assert brute.words(r["text"]) == kept
        assert (r["n_words"], len(gone), brute.sha(" ".join(kept))) == expected
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == expected


def test_mix_is_made(spark):
    """Slots are whole and in shards, spans lie in their documents, draws and words meet the targets."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = mixing.document_sizes(table)
    targets = {r["source"]: r for r in mixing.source_targets(sizes).collect()}
    slots = mixing.slots(mixing.source_targets(sizes), shard_slots=50)
    # `used` bounds what a slot takes of its block; a source's last block is short.
    size = {f"={source}": t["source_size"] for source, t in targets.items()}
    held = lambda r: min(mixing.BLOCK_WORDS, size[r["key"]] - mixing.BLOCK_WORDS * r["block_index"])
    used = {r["slot"]: (r["key"], min(r["used"], held(r)), r["shard"]) for r in slots.collect()}
    assert sorted(used) == list(range(len(used))) and all(v[2] == k // 50 for k, v in used.items())
    drawn = Counter(v[0] for v in used.values())
    for source, t in targets.items():
        words = sum(v[1] for v in used.values() if v[0] == f"={source}")
        # A short last block, at most once an epoch, makes more slots than the words would fill.
        assert 0 <= drawn[f"={source}"] - words / mixing.BLOCK_WORDS < mixing.MOST_EPOCHS + 1
        assert abs(words - t["target"]) <= 0.5

    texts = {r["doc_id"]: brute.words(r["text"]) for r in table.collect()}
    spans = mixing.source_mix(table).collect()
    filled, words, taken = defaultdict(list), Counter(), Counter()
    for r in spans:
        assert r["shard"] == r["slot"] // mixing.SHARD_SLOTS
        assert 0 <= r["first_word"] and r["first_word"] + r["words"] <= len(texts[r["doc_id"]])
        filled[r["slot"]].append((r["place"], r["words"]))
        words[r["source"]] += r["words"]
        taken[r["doc_id"]] += r["words"]
    assert filled.keys() == used.keys()
    for slot, own in filled.items():
        own.sort()
        assert [p for p, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) == used[slot][1]
    for source, t in targets.items():
        assert abs(words[source] - t["target"]) <= 0.5
    assert {r["doc_id"]: r["taken"] for r in QUERIES["op7_source_mix"](spark, SF).collect()} == {k: taken[k] for k in texts}


def test_shards_draw_their_sources(spark):
    """Counts by shard spread as multinomial draws do, numbers of a source are its slots, each once."""
    wanted = {0: 30_000, 1: 9_000, 2: 0, 3: 20_000, 4: 1_000}
    total = sum(wanted.values())
    rows = [(p, n, sum(wanted[q] for q in wanted if q < p)) for p, n in wanted.items() if n]
    plan = spark.createDataFrame(rows, "place LONG, n_slots LONG, first LONG")
    drawn = {(r["shard"], r["place"]): r["n"] for r in mixing.draws(mixing.seats(plan, total, 500)).collect()}
    shards = total // 500
    assert all(sum(drawn.get((shard, p), 0) for p in wanted) == 500 for shard in range(shards))
    for place, n in wanted.items():
        share = n / total
        counts = [drawn.get((shard, place), 0) for shard in range(shards)]
        mean = sum(counts) / shards
        spread = sum((c - mean) ** 2 for c in counts) / shards
        assert abs(mean - 500 * share) <= 5 * (500 * share * (1 - share) / shards) ** 0.5
        assert not n or 0.6 < spread / (500 * share * (1 - share)) < 1.6
    given = mixing.numbered(plan, total, 500).collect()
    assert sorted(r["slot"] for r in given) == list(range(total))
    assert all(r["shard"] == r["slot"] // 500 for r in given)
    for place, n in wanted.items():
        assert sorted(r["j"] for r in given if r["place"] == place) == list(range(n))
    # Only what was drawn too often is given away.
    kept = Counter((r["shard"], r["place"]) for r in given)
    over = sum(max(0, sum(drawn.get((s, p), 0) for s in range(shards)) - n) for p, n in wanted.items())
    assert sum(max(0, n - kept[at]) for at, n in drawn.items()) <= over


def test_queries_write_the_mix(spark, monkeypatch):
    """The query and the pipeline's last stage make the ordered mix itself, not only its bookkeeping."""
    import corpus_pipeline

    written = {}
    keep = mixing.materialise
    monkeypatch.setattr(mixing, "materialise", lambda df, name: written.setdefault(name, keep(df, name)))
    table = spark.read.parquet(f"{SF}/documents.parquet")
    for run in (lambda: QUERIES["op7_source_mix"](spark, SF), lambda: corpus_pipeline.mix_sources(spark, table, SF)):
        written.clear()
        total = sum(r["taken"] for r in run().collect())
        rows = written["mix"].collect()
        assert {"shard", "slot", "place", "doc_id", "first_word", "words"} <= set(written["mix"].columns)
        assert sum(r["words"] for r in rows) == total
        parts = defaultdict(list)
        for r, file in written["mix"].selectExpr("struct(slot, place) AS at", "input_file_name()").collect():
            parts[file].append(tuple(r))
        ordered = sorted(parts.values(), key=min)
        assert [p for part in ordered for p in part] == sorted((r["slot"], r["place"]) for r in rows)


def test_toxic_terms_inside_long_words(spark):
    """Words of 30 three-byte characters: windows split no n-gram, terms far from the start reach the dictionary."""
    word = bytes(range(128, 248))
    held = [w[1] for w in toxicity.windows(word) if w[0] == 0]
    for i in range(len(word) - toxicity.OVERLAP + 1):
        gram = word[i : i + toxicity.OVERLAP]
        assert any(b"".join(gram[k : k + 3] for k in range(len(gram) - 2)) in w for w in held)

    draw = random.Random(3)
    clause = lambda: "".join(chr(0x4E00 + draw.randrange(900)) for _ in range(30))
    term = "\u9fa0\u9fa1\u9fa2\u9fa3"
    docs, labels = [], []
    for i in range(480):
        own = [clause() for _ in range(4)]
        if i % 3 == 0:
            own[1] = own[1][:18] + term + own[1][22:]
        docs.append((i, " ".join(own)))
        labels.append((i, int(i % 3 == 0)))
    rows = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    model = toxicity.learn(rows, spark.createDataFrame(labels, "doc_id LONG, toxic INT"))
    raw = term.encode()
    assert b"".join(raw[i : i + 3] for i in range(len(raw) - 2)) in model.toxic


def test_every_language_is_learned(spark):
    """More labels than 256, the rare ones too, each with letters of its own."""
    draw = random.Random(5)
    rows = []
    for k in range(270):
        letters = [chr(0x4E00 + 40 * k + i) for i in range(40)]
        for n in range(4 if k < 260 else 2):
            rows.append((f"l{k:03}", "".join(draw.choice(letters) for _ in range(60)), n))
    table = spark.createDataFrame(rows, "lang STRING, text STRING, doc_id INT").coalesce(2)
    model = langid.learn(table.where("doc_id > 0").select("text", "lang"))
    assert model.languages == sorted({r[0] for r in rows})
    found = langid.identify(table.where("doc_id = 0").withColumnRenamed("lang", "want"), model, keep=("want",)).collect()
    assert sum(r["lang_pred"] == r["want"] for r in found) >= 0.97 * len(found) == 0.97 * 270


def test_each_language_keeps_its_grams():
    """Grams of one rich language do not push out those of the rest."""
    draw = np.random.default_rng(1)
    rich = [np.unique(draw.integers(0, 30_000, 20_000)) for _ in range(48)]
    poor = [np.unique(1_000_000 + draw.integers(0, 400, 100)) for _ in range(48)]
    grams = langid.chosen_grams([rich, poor])
    assert len(grams) == langid.ALL_GRAMS and (grams >= 1_000_000).sum() > 390


def test_ablations_over_all_documents(spark):
    policy = quality.POLICIES["default-1"]
    bits = [r["failed"] & quality.mask_of(policy) for r in QUERIES["op9_quality"](spark, SF).collect()]
    got = {r["rule"]: (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) for r in QUERIES["op9_quality_ablations"](spark, SF).collect()}
    want = {}
    for name in policy:
        bit = quality.mask_of([name])
        want[name] = (sum(b & bit != 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    assert got == want and any(n for n, _, _ in want.values())


def test_long_items_in_parts(spark):
    """An item of more words than there are codes; parts have all windows and no shorter ones."""
    words = [b"w%d" % i for i in range(100)]
    for limit in (1, 60, 200, 10_000):
        parts = [p.split() for p in decontaminate.item_parts(b" ".join(words), limit)]
        windows = [tuple(p[i : i + 13]) for p in parts for i in range(len(p) - 12)]
        assert windows == [tuple(words[i : i + 13]) for i in range(88)]
        assert all(len(p) >= 13 for p in parts)

    most = 0x10FFFF - decontaminate.FIRST_CODE + 1
    long = " ".join(map(str, range(most + 1000)))
    items = spark.createDataFrame([(7, long), (8, "other words")], "item_id LONG, text STRING")
    cut = " ".join(map(str, range(most + 980, most + 993)))
    docs = [(1, f"before {cut} after"), (2, "none of it"), (3, " ".join(map(str, range(12)))), (4, "other words")]
    got = decontaminate.find_contamination(spark.createDataFrame(docs, "doc_id LONG, text STRING"), items)
    assert sorted((r["doc_id"], r["n_hit"], r["item_ids"]) for r in got.collect()) == [
        (1, 13, [7]), (2, 0, []), (3, 0, []), (4, 2, [8])
    ]


def test_blocks_are_released(spark, monkeypatch):
    """Many blocks: what is found is written on the way and equals the scan in one block."""
    written = []
    keep = decontaminate.materialise
    monkeypatch.setattr(decontaminate, "materialise", lambda df, name: (written.append(name), keep(df, name))[1])
    items = [(i, " ".join(f"i{i}w{k}" for k in range(20))) for i in range(6)]
    docs = [(i, f"text {text[3:]}") for i, text in items] + [(9, items[0][1] + " and " + items[5][1]), (10, None)]
    bench = spark.createDataFrame(items, "item_id LONG, text STRING")
    rows = spark.createDataFrame(docs, "doc_id LONG, text STRING")
    columns = ("doc_id", "n_words", "n_hit", "item_ids", "hits", "contaminated")
    found = lambda block: sorted(map(repr, decontaminate.find_contamination(rows, bench, block).select(*columns).collect()))
    one, many = found(1_000_000), found(200)
    assert one == many and "benchmark-hits" in written
