"""Documents that hold passages of a benchmark.

Test items are normalised to words, cut into windows, and put into one Aho-Corasick
automaton. It runs over word codes: each word of the items is one character, any other
word of a document is a stop that matches nothing, so a document is scanned once and
a match's place is a word number, which maps back to byte offsets in the original.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from threadlens.llm.common import pick, raw_texts, sha256_hex
from threadlens.sources.shared import materialise

WINDOW = 13
ONE_IN = 20
BLOCK_BYTES = 1_000_000
BLOCKS_AT_ONCE = 4
FIRST_CODE = 0xE000  # a block of items has fewer words than there are codes above
STOP = "\x00"

#: Bytes of words: digits, letters and everything beyond ASCII; A-Z become a-z.
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)

Items = tuple[tuple[object, bytes], ...]


def folded_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def union(ranges: list[list[int]]) -> list[list[int]]:
    """Ranges in order, those that touch or overlap made one."""
    merged: list[list[int]] = []
    for first, end in sorted(ranges):
        if merged and first <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([first, end])
    return merged


class Index:
    """Word codes and the automaton over the windows of one block of items."""

    def __init__(self, items: Items):
        self.codes: dict[bytes, str] = {}
        owners: dict[str, set] = {}
        for item_id, text in items:
            coded = "".join(map(self._code, folded_words(text)))
            last = max(1, len(coded) - WINDOW + 1)
            for start in range(last if coded else 0):
                owners.setdefault(coded[start : start + WINDOW], set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word(window, (len(window), frozenset(ids)))
        if owners:
            self.automaton.make_automaton()

    def _code(self, word: bytes) -> str:
        return self.codes.setdefault(word, chr(FIRST_CODE + len(self.codes)))

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set]:
        """Merged [first, end) word ranges that windows cover, and the items they are of."""
        ranges: list[list[int]] = []
        ids: set = set()
        if not len(self.automaton):
            return ranges, ids
        code = self.codes.get
        coded = "".join([code(word, STOP) for word in words])
        for last, (length, owners) in self.automaton.iter(coded):
            ids |= owners
            ranges.append([last + 1 - length, last + 1])
        return union(ranges), ids


@lru_cache(maxsize=2)
def _ready(items: Items) -> Index:
    return Index(items)


def item_parts(text: bytes, limit: int) -> Iterator[bytes]:
    """A text of at most `limit` bytes, or parts of a longer one that have all of its windows.

    Parts share all but one word of a window, and none is shorter than a window, which
    would make it a window of its own.
    """
    words = folded_words(text) if len(text) > limit else []
    if len(words) <= WINDOW:
        yield text
        return
    start = end = 0
    while end < len(words):
        end, size = start, 0
        while end < len(words) and (end - start < WINDOW or size + len(words[end]) < limit):
            size += len(words[end]) + 1
            end += 1
        yield b" ".join(words[start:end])
        start = end - WINDOW + 1


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The distinct (item_id, text) of a benchmark in blocks of bounded text.

    A block bounds what the driver holds and a task receives; a benchmark of any size
    is a sequence of blocks, each scanned against all documents. Usually it is one.
    A text longer than a block comes in parts under the same item_id.
    """
    items = pick(benchmark, "item_id", "text").where(F.col("text").isNotNull()).distinct()
    held: list[tuple[object, bytes]] = []
    size = 0
    for row in materialise(items, "benchmark-items").toLocalIterator():
        for text in item_parts(row["text"].encode("utf-8"), block_bytes):
            if held and size + len(text) > block_bytes:
                yield tuple(sorted(held, key=repr))
                held, size = [], 0
            held.append((row["item_id"], text))
            size += len(text)
    yield tuple(sorted(held, key=repr))


PLACE = "struct<first_word long, end_word long, first_byte long, end_byte long>"
PLACE_TYPE = pa.struct([(n, pa.int64()) for n in ("first_word", "end_word", "first_byte", "end_byte")])


def scan(rows: DataFrame, sent: Broadcast[Items], keep: tuple[str, ...] = ()) -> DataFrame:
    """Scan (doc_id, text, hits, item_ids) against one block, adding to hits and item_ids.

    hits holds merged word ranges with their byte offsets in the original text.
    """
    ids_type = rows.schema["item_ids"].dataType
    ids_arrow = to_arrow_type(ids_type)
    carried = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in ("doc_id", "text", *keep))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _ready(sent.value)
        for batch in batches:
            counts, hits, owners = [], [], []
            before = zip(batch.column("hits").to_pylist(), batch.column("item_ids").to_pylist())
            for text, (old_hits, old_ids) in zip(raw_texts(batch.column("text")), before):
                words = folded_words(text)
                ranges, ids = index.matches(words)
                counts.append(len(words))
                if ranges:
                    spans = [m.span() for m in WORD_BYTES.finditer(text)]
                    ranges = union([*ranges, *([h["first_word"], h["end_word"]] for h in old_hits)])
                    hits.append(
                        [
                            {"first_word": a, "end_word": b, "first_byte": spans[a][0], "end_byte": spans[b - 1][1]}
                            for a, b in ranges
                        ]
                    )
                else:
                    hits.append(old_hits)
                owners.append(sorted({*old_ids, *(i for i in ids if i is not None)}))
            yield pa.RecordBatch.from_arrays(
                [
                    *map(batch.column, ("doc_id", "text", *keep)),
                    pa.array(counts, pa.int64()),
                    pa.array(hits, pa.list_(PLACE_TYPE)),
                    pa.array(owners, ids_arrow),
                ],
                ["doc_id", "text", *keep, "n_words", "hits", "item_ids"],
            )

    return rows.mapInArrow(find, f"{carried}, n_words long, hits array<{PLACE}>, item_ids {ids_type.simpleString()}")


def find_contamination(
    documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, text, n_words, n_hit, n_items, item_ids, hits, contaminated) per document row.

    Columns named in `keep` are carried along.

    A word inside any occurrence of a window is hit; a document is contaminated when at
    least one word in twenty is. Null and empty texts have no words and are clean; a
    null item text is no item; an item with a null id marks words but is not listed.
    Repeated rows each give a row. With an empty benchmark nothing is hit.
    """
    found = pick(documents, "doc_id", "text", *keep)
    kind = pick(benchmark, "item_id").schema["item_id"].dataType.simpleString()
    sent: list[Broadcast[Items]] = []
    for items in item_blocks(benchmark, block_bytes):
        if len(sent) == BLOCKS_AT_ONCE:
            # What is found so far is written, so that its blocks can go.
            found = materialise(found.select("doc_id", "text", *keep, "hits", "item_ids"), "benchmark-hits")
            while sent:
                sent.pop().destroy()
        sent.append(documents.sparkSession.sparkContext.broadcast(items))
        if "hits" not in found.columns:
            nothing = {"hits": F.array().cast(f"array<{PLACE}>"), "item_ids": F.array().cast(f"array<{kind}>")}
            found = found.withColumns(nothing)
        found = scan(found.select("doc_id", "text", *keep, "hits", "item_ids"), sent[-1], keep)
    covered = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end_word"] - h["first_word"])
    return found.select(
        "doc_id",
        "text",
        *keep,
        "n_words",
        covered.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        "item_ids",
        "hits",
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (ONE_IN * F.col("n_hit") >= F.col("n_words")))


def items_digest(item_ids: Column) -> Column:
    """SHA-256 of the ids, sorted as strings and joined by commas."""
    return sha256_hex(F.concat_ws(",", F.sort_array(item_ids.cast("array<string>"))))
