"""Grouping spelling variants of words by a variable-length gram index.

Words that differ by one inserted, deleted or replaced character are found by their grams.
The gram dictionary is pruned by frequency: every gram of two characters is in it, and a
gram is followed by longer ones only while it is frequent, up to a longest length. A
word is decomposed into the longest dictionary gram at each place, less those that lie within an
earlier one.

One edit leaves most grams of a word as they are. Which ones it can affect follows from the
place: grams that reach over it, and the gram right behind it if one that reaches over it could
grow to hide it. The greatest such number over all places is the word's affected-gram bound, so two
near words have at least as many grams in common as either has beyond its bound. Lists
are therefore merged over the rarest grams of each word only, one more than its bound:
two near words have one of these in common, at the same place from the front or from the back.
Within a list words are verified.

A word that may lose all of its grams shares none for sure. Partners with more grams still
find it, as it is listed under all of them. Two such words are short, or made of few
long grams; they are compared once more by grams of two characters only, of which
they share at least two, so their lists are those of pairs of grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.common import pick
from threadlens.sources.shared import materialise

SHORTEST = 2
LONGEST = 6
LEAST_LENGTH = 5
LEAST_COUNT = 3
ONE_IN = 97
TIMES = 2
#: A gram in more words than this is frequent and gets longer.
FREQUENT = 100
#: Frequent grams that the dictionary holds at most; with more, a gram must be in more words.
MOST_FREQUENT = 500_000
HELD_WORDS = 400_000
LONG_LIST = 4096
LONG_WORD = 512
PAIRS_AT_ONCE = 2_000_000
ROWS_PER_SHARD = 250_000

#: Latin-1 bytes of words: letters, and U+00C0 to U+00FF; A-Z become a-z.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters in Latin-1, other characters being gaps."""
    return text.encode("latin-1", "replace").translate(FOLD).split()


def garbled(run: bytes, mark: int) -> bytes:
    """The run, or for one in 97 of all marks the run less one character."""
    whole = run if run.isascii() else run.decode("latin-1").encode("utf-8")
    h = zlib.crc32(whole, mark)
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) over (doc_id, text): words long and common enough.

    Counts are summed within a task first, so a very common word is a few rows.
    """
    rows = pick(documents, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def sums() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                mark = zlib.crc32(f"{doc}:".encode())
                own: dict[bytes, int] = {}
                for run in runs_of(text):
                    own[run] = own.get(run, 0) + 1
                for run, n in own.items():
                    word = garbled(run, mark)
                    if len(word) >= least_length:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD_WORDS:
                    yield sums()
                    held.clear()
        yield sums()

    parts = rows.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def frequent_grams(words: DataFrame, longest: int, frequent: int, most: int) -> dict[str, int]:
    """Grams of two to `longest` - 1 characters in more than `frequent` words, with the number of words.

    The driver and every task hold at most `most` of them.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def sums() -> pa.RecordBatch:
            values = [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(values, ["gram", "n"])

        for batch in batches:
            for word in batch.column("word").to_pylist():
                for gram in {word[p : p + q] for q in range(SHORTEST, longest) for p in range(len(word) - q + 1)}:
                    held[gram] = held.get(gram, 0) + 1
                if len(held) >= HELD_WORDS:
                    yield sums()
                    held.clear()
        yield sums()

    counts = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts.where(F.col("n") > frequent), "spelling-grams")
    # Frequency falls as a gram grows, so any bound on it keeps the part of a frequent gram frequent.
    while counts.count() > most:
        frequent *= 2
        counts = counts.where(F.col("n") > frequent)
    return {r["gram"]: r["n"] for r in counts.toLocalIterator()}


class Dictionary:
    """The frequent grams, those that are followed by longer ones."""

    def __init__(self, frequent: dict[str, int], longest: int = LONGEST):
        self.frequent, self.longest = frequent, longest
        self.preceded = {gram[1:] for gram in frequent}

    def ends(self, word: str) -> tuple[list[int], list[bool]]:
        """Where the longest dictionary gram at each place ends, and whether only the word's end stopped it."""
        size, frequent = len(word), self.frequent
        ends, open_ = [], []
        for p in range(size - SHORTEST + 1):
            end, last = p + SHORTEST, min(size, p + self.longest)
            while end < last and word[p:end] in frequent:
                end += 1
            ends.append(end)
            open_.append(end == size and end - p < self.longest and word[p:end] in frequent)
        return ends, open_

    def decomposed(self, word: str) -> tuple[list[tuple[int, int]], int]:
        """The word's grams as (place, end), and how many of them one edit affects at most."""
        ends, open_ = self.ends(word)
        kept, furthest = [], 0
        for p, end in enumerate(ends):
            if end > furthest:
                kept.append((p, end))
                furthest = end
        size = len(word)
        reach = np.zeros(size + 2, np.int64)
        for p, end in kept:
            # Reaches over the places p to end - 1, and over the word's end if that stopped it.
            reach[p] += 1
            reach[end + (1 if open_[p] else 0)] -= 1
            # Hidden by a gram that an edit right before it lets grow.
            if p and word[p : end - 1] in self.preceded:
                reach[p - 1] += 1
                reach[p] -= 1
        return kept, int(np.cumsum(reach)[: size + 1].max()) if kept else 0

    def order(self, gram: str) -> tuple:
        """Rarest first; the same for all words."""
        return self.frequent.get(gram, 0), -len(gram), gram


def hashed(*parts) -> int:
    value = xxhash.xxh3_64_intdigest(repr(parts).encode())
    return value - (1 << 64) if value >= 1 << 63 else value


def gram_keys(word: str, dictionary: Dictionary) -> tuple[list[tuple[int, int]], bool]:
    """(key, group) of the lists a word is in, and whether it may lose all of its grams.

    A list holds words of one length, the group, and words one character shorter. A gram of
    the shorter word stands at the same place from the front, or one further.
    """
    kept, affected = dictionary.decomposed(word)
    kept = sorted(kept, key=lambda k: (dictionary.order(word[k[0] : k[1]]), k[0]))
    size = len(word)
    keys = []
    for p, end in kept[: affected + 1]:
        gram = word[p:end]
        keys.append((hashed(gram, p, size), size))
        keys += [(hashed(gram, p + shift, size + 1), size + 1) for shift in (0, 1)]
    return keys, affected >= len(kept)


def pair_keys(word: str, dictionary: Dictionary) -> list[tuple[int, int]]:
    """(key, group) by pairs of two-character grams, of which one edit affects two at most.

    Of the four rarest, two are in common with any near word.
    """
    size = len(word)
    places = sorted(range(size - SHORTEST + 1), key=lambda p: (dictionary.order(word[p : p + SHORTEST]), p))[:4]
    places.sort()
    keys = []
    for i, p in enumerate(places):
        for q in places[i + 1 :]:
            a, b = word[p : p + SHORTEST], word[q : q + SHORTEST]
            keys.append((hashed(a, b, p, q, size), size))
            keys += [(hashed(a, b, p + x, q + y, size + 1), size + 1) for x, y in ((0, 0), (0, 1), (1, 1))]
    return keys


def listed(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(key, size, word, n): a row per word and list it is in; size is the longer length of the list."""
    sent = words.sparkSession.sparkContext.broadcast(dictionary)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            rows, keys, groups = [], [], []
            for i, word in enumerate(batch.column("word").to_pylist()):
                found, loses_all = gram_keys(word, own)
                if loses_all:
                    found += pair_keys(word, own)
                for key, group in set(found):
                    rows.append(i), keys.append(key), groups.append(group)
            picked = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(groups, pa.int32()), *(batch.column(c).take(picked) for c in ("word", "n"))],
                ["key", "size", "word", "n"],
            )

    return words.mapInArrow(emit, "key long, size int, word string, n long")


def near_by_one(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Which rows of characters become the same by leaving out one of the longer."""
    width = shorter.shape[1]
    front = np.cumprod(shorter == longer[:, :width], axis=1, dtype=np.int8).sum(axis=1)
    back = np.cumprod((shorter == longer[:, 1:])[:, ::-1], axis=1, dtype=np.int8).sum(axis=1)
    return front + back >= width


def pairs_between(heads: np.ndarray, sizes: np.ndarray, tails: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with i from a run of `sizes` and j from the run of `counts` beside it, some at a time."""
    done = np.cumsum(sizes * counts)
    low = 0
    while low < len(heads):
        before = int(done[low - 1]) if low else 0
        high = max(low + 1, int(np.searchsorted(done, before + PAIRS_AT_ONCE, side="right")))
        s, c = sizes[low:high], counts[low:high]
        total = s * c
        which = np.repeat(np.arange(high - low), total)
        rank = np.arange(len(which)) - np.repeat(np.cumsum(total) - total, total)
        yield heads[low:high][which] + rank // c[which], tails[low:high][which] + rank % c[which]
        low = high


def near_in_lists(key: np.ndarray, size: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of near words that are in one list."""
    lengths = np.char.str_len(words)
    shorter = lengths < size
    found = []
    for group in np.unique(size).tolist():
        own = np.flatnonzero(size == group)
        own = own[np.lexsort((shorter[own], key[own]))]
        k, s = key[own], shorter[own]
        letters = np.ascontiguousarray(words[own].astype(f"<U{group}")).view(np.uint32).reshape(len(own), group)
        if letters.max(initial=0) < 256:
            letters = letters.astype(np.uint8)
        head = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1])
        end = np.append(head[1:], len(k))
        below = np.add.reduceat(s.astype(np.int64), head)
        middle = end - below  # longer words come first
        for heads, sizes, tails, counts, equal in ((head, middle - head, head, middle - head, True), (head, middle - head, middle, below, False)):
            some = (sizes > 0) & (counts > (1 if equal else 0))
            for i, j in pairs_between(heads[some], sizes[some], tails[some], counts[some]):
                if equal:
                    once = i < j
                    i, j = i[once], j[once]
                    near = np.count_nonzero(letters[i] != letters[j], axis=1) == 1
                else:
                    near = near_by_one(letters[j][:, : group - 1], letters[i])
                found.append(np.stack([own[i[near]], own[j[near]]]))
    a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    return a, b


def near_by_text(key: np.ndarray, words: list[str]) -> tuple[list[int], list[int]]:
    """The same for long words, whose table of characters would be large: pair by pair."""
    lists: dict[int, list[int]] = {}
    for i, k in enumerate(key.tolist()):
        lists.setdefault(k, []).append(i)
    found = []
    for own in lists.values():
        for at, i in enumerate(own):
            found += [(i, j) for j in own[at + 1 :] if differ_by_one(words[i], words[j])]
    return [i for i, _ in found], [j for _, j in found]


def differ_by_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    x, y = (np.frombuffer(w.encode("utf-32-le"), np.uint32) for w in sorted((a, b), key=len))
    unlike = np.flatnonzero(x != y[: len(x)])
    front = int(unlike[0]) if len(unlike) else len(x)
    return bool(np.array_equal(x[front + (len(x) == len(y)) :], y[front + 1 :]))


def cut_lists(rows: DataFrame, limit: int = LONG_LIST) -> DataFrame:
    """Rows with `part`: a list over the limit becomes several, one per pair of its parts.

    Each word of such a list goes to as many parts as there are; no task gets the whole list.
    """
    long_ = rows.groupBy("key").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") > limit)
    long_ = materialise(long_, "spelling-long")
    sized = rows.join(long_, "key", "left")
    n = F.ceil(2 * F.col("own") / limit).cast("int")
    sized = sized.withColumn("parts", F.when(F.col("own").isNotNull(), n))
    sized = sized.withColumn("mine", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("word"), F.col("parts"))))
    other = F.expr("if(parts IS NULL, array(0L), sequence(0L, bigint(parts) - 1))")
    each = sized.withColumn("other", F.explode(other))
    part = F.expr("if(parts IS NULL, 0L, least(mine, other) * parts + greatest(mine, other))")
    return each.select("key", part.alias("part"), "size", "word", "n")


def near_words(words: DataFrame, longest: int = LONGEST, frequent: int = FREQUENT, most: int = MOST_FREQUENT, limit: int = LONG_LIST) -> DataFrame:
    """(word, n, near, near_n) for (word, n): both ways round, each pair of near words once."""
    dictionary = Dictionary(frequent_grams(words, longest, frequent, most), longest)
    rows = materialise(listed(words, dictionary), "spelling-lists")
    cut = cut_lists(rows, limit)
    shards = max(1, -(-rows.count() // ROWS_PER_SHARD))
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("key", "part"), F.lit(shards)))

    def merge(shard: pa.Table) -> pa.Table:
        held = shard.column("word").to_pylist()
        part = shard.column("part").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        key = (shard.column("key").to_numpy().view(np.uint64) ^ part).view(np.int64)
        size = shard.column("size").to_numpy()
        n = shard.column("n").to_numpy()
        near = [np.zeros((2, 0), np.int64)]
        low = 0
        # By length, since the longest word sets the width of a table of characters.
        for high in (16, 64, LONG_WORD):
            own = np.flatnonzero((size > low) & (size <= high))
            if len(own):
                near.append(own[np.stack(near_in_lists(key[own], size[own], np.array([held[i] for i in own.tolist()])))])
            low = high
        own = np.flatnonzero(size > LONG_WORD)
        near.append(own[np.array(near_by_text(key[own], [held[i] for i in own.tolist()]), np.int64)])
        a, b = np.concatenate(near, axis=1)
        # A pair may meet in several lists.
        codes = {word: i for i, word in enumerate(set(held))}
        code = np.array([codes[word] for word in held], np.int64)
        low, high = np.minimum(code[a], code[b]), np.maximum(code[a], code[b])
        once = np.unique(low * len(codes) + high, return_index=True)[1]
        a, b = a[once], b[once]
        swap = np.array([held[i] > held[j] for i, j in zip(a.tolist(), b.tolist())], bool)
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        words = shard.column("word").combine_chunks()
        return pa.table({"a": words.take(pa.array(a)), "a_n": n[a], "b": words.take(pa.array(b)), "b_n": n[b]})

    found = sharded.groupBy("shard").applyInArrow(merge, "a string, a_n long, b string, b_n long").distinct()
    both = F.array(
        F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    return found.select(F.inline(both))


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, form, root, ...) for rows of (word, form, ...): the last word that forms lead to.

    A form is more frequent than its word, so no way is a circle. Each round doubles the
    steps; words whose way has ended take no further part.
    """
    linked = materialise(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-forms")
    ended, open_ = None, linked
    while True:
        further = linked.select(F.col("word").alias("at"), F.col("root").alias("next"))
        stepped = materialise(open_.join(further, F.col("root") == F.col("at"), "left").select("word", "root", "next"), "spelling-roots")
        done = stepped.where("next IS NULL").select("word", "root")
        ended = done if ended is None else ended.unionByName(done)
        open_ = stepped.where("next IS NOT NULL").select("word", F.col("next").alias("root"))
        if open_.isEmpty():
            break
        # Every open way's next step, and every ended one's end.
        linked = materialise(open_.unionByName(ended), "spelling-steps")
    found = ended.withColumnRenamed("word", "of")
    return forms.join(found, F.col("word") == F.col("of"), "left").select(*forms.columns, F.coalesce("root", "word").alias("root"))


def variants(documents: DataFrame, frequent: int = FREQUENT, longest: int = LONGEST, limit: int = LONG_LIST) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each word of (doc_id, text).

    Two words are near if they differ by one character; a word's form is its most frequent near
    word (of equals the first in code-point order) if that is at least twice as frequent,
    and its root the last word that forms lead to, or itself. Null and empty texts have no
    words; a null doc_id counts as empty text in the rule that garbles runs; repeated rows count
    each time; an empty table gives no word.
    """
    words = materialise(word_counts(documents), "spelling-words")
    near = near_words(words, longest=longest, frequent=frequent, limit=limit)
    best = near.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form"))).alias("best")
    )
    best = best.select(F.col("word").alias("of"), "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    joined = words.join(best, F.col("word") == F.col("of"), "left")
    strong = F.col("form_n") >= TIMES * F.col("n")
    formed = joined.select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(strong, F.col("form")).alias("form"),
        F.when(strong, F.col("form_n")).alias("form_n"),
    )
    return with_roots(materialise(formed, "spelling-formed"))
