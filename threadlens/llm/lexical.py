"""Ranked lexical search by Block-Max MaxScore over a sharded index.

Documents are indexed in shards of bounded size. A shard keeps, for each of its terms, the
places of the documents and the term frequencies, compressed in blocks, and for each block
the last place and the greatest part that one of its documents can add to a score. The
greatest over all blocks is the list's own bound.

A query meets its lists in a shard in the order of their bounds. The lists whose bounds
together cannot reach the score of the present tenth are non-essential: they bring no
candidates. Candidates come from the other lists, and the block maxima of the non-essential
ones at a candidate's place reject it before a block is decompressed. Scores
that surely hold raise the tenth's score within a shard, and a task hands it from shard to
shard. The heaps of all tasks are merged at the end.

Scores are whole numbers, so the index needs the number of documents and of terms, which
one light scan gives first. Equal scores rank by document id, so a candidate is rejected only
if its bound is below the tenth's score.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from threadlens.llm.common import in_pieces, pick, raw_texts
from threadlens.sources.shared import materialise

TOP = 10
BLOCK = 128
SHARD_BYTES = 16 << 20
PIECE_BYTES = 4 << 20
QUERY_TERMS = 50_000
#: Fixed values of the score: tf parts of 10^9, saturation 1.2 and length share 0.75 as whole numbers.
UNIT = 1_000_000_000
PER_TF, PER_LENGTH = 1000, 8
FLAT, SLOPE = 25, 75

#: Bytes of terms: digits, letters and everything beyond ASCII; A-Z become a-z.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def collection_size(documents: DataFrame) -> tuple[int, int]:
    """How many documents have a term, and how many terms they have together."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = terms = 0
        is_term = np.frombuffer(FOLD, np.uint8) != 32
        for batch in batches:
            for text in raw_texts(batch.column("text")):
                if text:
                    inside = is_term[np.frombuffer(text, np.uint8)]
                    own = int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))
                    some += own > 0
                    terms += own
        yield pa.RecordBatch.from_arrays([pa.array([some]), pa.array([terms])], ["some", "terms"])

    row = pick(documents, "text").mapInArrow(count, "some long, terms long").agg(F.sum("some"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


def length_norm(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    return FLAT + (SLOPE * n.astype(np.int64) * documents) // terms


def part_of_score(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What an occurrence count adds to a score, before the term's weight."""
    return (UNIT * tf) // (PER_TF * tf + PER_LENGTH * norm)


def weight_of(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def packed_numbers(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers as bytes of seven bits, least first, and where each begins, with the end."""
    rest = values.astype(np.uint64)
    width = np.ones(len(rest), np.int64)
    for bits in range(7, 64, 7):
        width += rest >= np.uint64(1 << bits)
    ends = np.concatenate([[0], np.cumsum(width)])
    out = np.zeros(int(ends[-1]), np.uint8)
    left, at = np.arange(len(rest)), 0
    while len(left):
        more = width[left] > at + 1
        low = (rest[left] >> np.uint64(7 * at)) & np.uint64(127)
        out[ends[left] + at] = low.astype(np.uint8) | (more.astype(np.uint8) << 7)
        left, at = left[more], at + 1
    return out, ends


def unpacked_numbers(data: np.ndarray) -> np.ndarray:
    last = data < 128
    ends = np.flatnonzero(last)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    if len(ends) == len(data):
        return data.astype(np.int64)
    shift = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * shift), starts)


class ShardBuilder:
    """Collects documents with a term and turns them into the rows of one shard."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.rows: list[int] = []
        self.bytes = 0

    def add(self, row: int, terms: list[bytes], size: int) -> None:
        codes = self.codes
        self.parts.append(np.fromiter((codes.setdefault(t, len(codes)) for t in terms), np.int64, len(terms)))
        self.rows.append(row)
        self.bytes += size

    def lists(self, documents: int, terms: int) -> tuple[np.ndarray, dict[str, pa.Array]]:
        """Length norms by place, and a row per term: df, block bounds and places, payload.

        A block's payload is its places, each less the one before, then its term
        frequencies less 1; `ends` has the byte where each of a list's blocks ends.
        """
        sizes = np.array([len(p) for p in self.parts])
        norm = length_norm(sizes, documents, terms)
        place = np.repeat(np.arange(len(sizes)), sizes)
        pairs, tf = np.unique(np.concatenate(self.parts) * len(sizes) + place, return_counts=True)
        term, place = pairs // len(sizes), pairs % len(sizes)
        part = part_of_score(tf.astype(np.int64), norm[place])
        heads = np.flatnonzero(np.diff(term, prepend=-1))
        since = np.arange(len(term)) - np.repeat(heads, np.diff(heads, append=len(term)))
        step = np.diff(place, prepend=0)
        step[heads] = place[heads]
        blocks = np.flatnonzero(since % BLOCK == 0)
        sizes_of_blocks = np.diff(blocks, append=len(term))
        # Places and frequencies of a block stand one after the other.
        index = np.arange(len(term)) + np.repeat(blocks, sizes_of_blocks)
        both = np.empty(2 * len(term), np.int64)
        both[index] = step
        both[index + np.repeat(sizes_of_blocks, sizes_of_blocks)] = tf - 1
        data, byte = packed_numbers(both)
        block_ends = byte[2 * (blocks + sizes_of_blocks)]
        first_block = np.searchsorted(blocks, heads)
        offsets = np.append(first_block, len(blocks)).astype(np.int32)
        list_starts = byte[2 * heads]
        list_ends = np.append(list_starts[1:], len(data))
        own_ends = block_ends - np.repeat(list_starts, np.diff(offsets))
        lists = lambda v, t: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v, t))
        payload = data.tobytes()
        words = list(self.codes)
        return norm, {
            "term": pa.array([words[c] for c in term[heads].tolist()], pa.binary()),
            "df": pa.array(np.diff(heads, append=len(term)), pa.int64()),
            "lasts": lists(place[blocks + sizes_of_blocks - 1], pa.int64()),
            "bounds": lists(np.maximum.reduceat(part, blocks), pa.int64()),
            "ends": lists(own_ends, pa.int64()),
            "payload": pa.array([payload[a:b] for a, b in zip(list_starts.tolist(), list_ends.tolist())], pa.binary()),
        }


INDEX = "shard long, term binary, df long, lasts array<long>, bounds array<long>, ends array<long>, payload binary"


def indexed(documents: DataFrame, size: tuple[int, int], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index: a row per shard and term, and one per shard, with a null term, for its documents.

    The latter holds doc_ids (null ids kept) and, as payload, the length norms by place.
    A shard takes documents up to a number of bytes, and one of a longer text alone.
    """
    rows = pick(documents, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["shard", "term", "df", "lasts", "bounds", "ends", "payload", "doc_ids"]
    n_documents, n_terms = size

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        builder, ids = ShardBuilder(), []

        def finished() -> Iterator[pa.RecordBatch]:
            norm, columns = builder.lists(n_documents, n_terms)
            own = pa.chunked_array(ids).combine_chunks()
            numbers = pa.list_(pa.int64())
            empty = pa.nulls(1, numbers)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard]), pa.nulls(1, pa.binary()), pa.array([len(norm)]), empty, empty, empty,
                 pa.array([norm.astype("<i8").tobytes()]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)],
                names,
            )
            n = len(columns["term"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, shard)), *(columns[c] for c in names[1:7]), pa.nulls(n, pa.list_(own.type))], names
            )

        for batch in in_pieces(batches, "text", PIECE_BYTES):
            kept = []
            for i, text in enumerate(raw_texts(batch.column("text"))):
                terms = terms_of(text)
                if not terms:
                    continue
                if builder.rows and builder.bytes + len(text) > shard_bytes:
                    if kept:
                        ids.append(batch.column("doc_id").take(pa.array(kept)))
                    yield from finished()
                    builder, ids, kept, shard = ShardBuilder(), [], [], shard + 1
                builder.add(i, terms, len(text))
                kept.append(i)
            if kept:
                ids.append(batch.column("doc_id").take(pa.array(kept)))
        if builder.rows:
            yield from finished()

    return rows.mapInArrow(build, f"{INDEX}, doc_ids array<{kind}>")


class List:
    """One term's list in a shard, its blocks still compressed."""

    def __init__(self, lasts, bounds, ends, payload):
        self.lasts, self.bounds, self.ends = lasts, bounds, ends
        self.payload = payload
        self.most = int(bounds.max())
        self.whole = None

    def block(self, b: int) -> tuple[np.ndarray, np.ndarray]:
        begin = int(self.ends[b - 1]) if b else 0
        numbers = unpacked_numbers(self.payload[begin : int(self.ends[b])])
        half = len(numbers) // 2
        return np.cumsum(numbers[:half]) + (int(self.lasts[b - 1]) if b else 0), numbers[half:] + 1

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and frequencies of the whole list, remembered while its shard is searched."""
        if self.whole is None:
            blocks = [self.block(b) for b in range(len(self.ends))]
            self.whole = tuple(np.concatenate(x) for x in zip(*blocks))
        return self.whole

    def at(self, places: np.ndarray, of_block: np.ndarray) -> np.ndarray:
        """Frequencies at ascending places, 0 where the term is missing, from their blocks only."""
        wanted = np.unique(of_block)
        if self.whole is None and len(wanted) < len(self.ends):
            held, tf = (np.concatenate(x) for x in zip(*[self.block(b) for b in wanted.tolist()]))
        else:
            held, tf = self.all()
        found = np.minimum(np.searchsorted(held, places), len(held) - 1)
        return np.where(held[found] == places, tf[found], 0)


class Shard:
    """The lists of one shard that some query needs."""

    def __init__(self, doc_ids, norm: np.ndarray):
        self.doc_ids, self.norm = doc_ids, norm
        self.lists: dict[bytes, List] = {}
        self.parts: dict[bytes, np.ndarray] = {}

    def whole_part(self, term: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Places and score parts of a whole list."""
        places, tf = self.lists[term].all()
        if term not in self.parts:
            self.parts[term] = part_of_score(tf, self.norm[places])
        return places, self.parts[term]

    def search(self, query: list[tuple[bytes, int]], floor: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that can be among the best, `floor` being the tenth's score so far.

        query: (term, weight times its number in the query).
        """
        lists = [(w * self.lists[t].most, w, t) for t, w in query if t in self.lists and w > 0]
        lists.sort(key=lambda x: (-x[0], x[2]))
        left = np.concatenate([np.cumsum([b for b, *_ in lists][::-1])[::-1], [0]]).astype(np.int64)
        scores = np.zeros(len(self.norm), np.int64)
        floor = max(floor, 1)
        essential = 0
        # A list is essential while it and those after it could lift a new document to the floor.
        while essential < len(lists) and left[essential] >= floor:
            _, w, term = lists[essential]
            places, part = self.whole_part(term)
            scores[places] += w * part
            essential += 1
            if len(scores) > top:
                floor = max(floor, int(np.partition(scores, -top)[-top]))
        places = np.flatnonzero((scores > 0) & (scores + left[essential] >= floor))
        scores = scores[places]
        rest = [(w, self.lists[t]) for _, w, t in lists[essential:]]
        # Block maxima at each candidate's place, before any block is decompressed.
        blocks, bounds = [], np.zeros((len(rest) + 1, len(places)), np.int64)
        for i, (w, own) in enumerate(rest):
            of_block = np.searchsorted(own.lasts, places)
            blocks.append(of_block)
            inside = of_block < len(own.lasts)
            bounds[i, inside] = w * own.bounds[of_block[inside]]
        bounds = np.cumsum(bounds[::-1], axis=0)[::-1]
        alive = scores + bounds[0] >= floor
        for i, (w, own) in enumerate(rest):
            here = np.flatnonzero(alive & (blocks[i] < len(own.lasts)))
            if len(here):
                tf = own.at(places[here], blocks[i][here])
                some = tf > 0
                scores[here[some]] += w * part_of_score(tf[some], self.norm[places[here[some]]])
            if alive.sum() > top:
                floor = max(floor, int(np.partition(scores[alive], -top)[-top]))
            alive &= scores + bounds[i + 1] >= floor
        return places[alive], scores[alive]


def query_blocks(items: DataFrame, block_terms: int = QUERY_TERMS) -> Iterator[list[tuple[int, list[bytes], list[int]]]]:
    """Items as (number, terms, counts), in blocks of a bounded number of terms, or of one item."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row["terms"]) > block_terms:
            yield held
            held, size = [], 0
        held.append((row["item"], [bytes(t) for t in row["terms"]], row["counts"]))
        size += len(row["terms"])
    if held:
        yield held


def numbered_items(items: DataFrame) -> DataFrame:
    """(item, item_id, terms, counts) for (item_id, text): rows with a term, numbered."""
    rows = pick(items, "item_id", "text")
    kind = rows.schema["item_id"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            bags = []
            for text in raw_texts(batch.column("text")):
                bag: dict[bytes, int] = {}
                for term in terms_of(text):
                    bag[term] = bag.get(term, 0) + 1
                bags.append(bag)
            kept = [i for i, bag in enumerate(bags) if bag]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(number, number + len(kept)), pa.int64()),
                    batch.column("item_id").take(pa.array(kept, pa.int64())),
                    pa.array([list(bags[i]) for i in kept], pa.list_(pa.binary())),
                    pa.array([list(bags[i].values()) for i in kept], pa.list_(pa.int64())),
                ],
                ["item", "item_id", "terms", "counts"],
            )
            number += len(kept)

    return rows.mapInArrow(split, f"item long, item_id {kind}, terms array<binary>, counts array<long>")


class Heaps:
    """The best documents so far of each query in a task."""

    def __init__(self, top: int):
        self.top = top
        self.best: dict[int, list[tuple]] = {}

    def floor(self, item: int) -> int:
        own = self.best.get(item, ())
        return own[0][0] if len(own) == self.top else 0

    def add(self, item: int, scores: np.ndarray, ids: list) -> None:
        own = self.best.setdefault(item, [])
        for score, doc in zip(scores.tolist(), ids):
            # Smaller ids are better, and a missing one worst.
            entry = (score, doc is not None, Backwards(doc), doc)
            if len(own) < self.top:
                heapq.heappush(own, entry)
            elif own[0][:3] < entry[:3]:
                heapq.heapreplace(own, entry)


class Backwards:
    """Orders ids from the largest to the smallest."""

    __slots__ = ("value",)

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        return self.value == other.value

    def __lt__(self, other):
        return self.value is not None and other.value is not None and other.value < self.value


def search_block(index: DataFrame, queries: list, size: tuple[int, int], top: int) -> DataFrame:
    """(item, doc_id, score): the heaps of all tasks for one block of queries."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for _, terms, _ in queries for t in terms})], "term binary")
    held = index.join(F.broadcast(wanted), "term")  # at most QUERY_TERMS terms, or one item's
    counts = {bytes(r["term"]): weight_of(r["df"], size[0]) for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weighed = [(item, [(t, counts[t] * n) for t, n in zip(terms, ns) if t in counts]) for item, terms, ns in queries]
    sent = spark.sparkContext.broadcast(weighed)
    names = ["shard", "term", "lasts", "bounds", "ends", "payload", "doc_ids"]
    lists = held.select(*names).unionByName(index.where(F.col("term").isNull()).select(*names))
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A shard's row of documents comes first: nulls sort first.
    rows = lists.repartition(tasks, "shard").sortWithinPartitions("shard", "term")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(top)
        shard, of = None, None

        def searched() -> None:
            for item, query in sent.value:
                places, scores = shard.search(query, heaps.floor(item), top)
                if len(places):
                    heaps.add(item, scores, shard.doc_ids.take(pa.array(places)).to_pylist())

        for batch in batches:
            column = {c: batch.column(c) for c in names}
            shards, terms = column["shard"].to_pylist(), column["term"].to_pylist()
            numbers = {c: (column[c].offsets.to_numpy(), column[c].values.to_numpy()) for c in ("lasts", "bounds", "ends")}
            for i, (number, term) in enumerate(zip(shards, terms)):
                if term is None:
                    if shard is not None:
                        searched()
                    norm = np.frombuffer(column["payload"][i].as_py(), "<i8")
                    shard, of = Shard(column["doc_ids"][i].values, norm), number
                    continue
                assert number == of
                own = [values[offsets[i] : offsets[i + 1]].copy() for offsets, values in numbers.values()]
                shard.lists[term] = List(*own, np.frombuffer(column["payload"][i].as_py(), np.uint8))
        if shard is not None:
            searched()
        found = [(item, e[3], e[0]) for item, own in heaps.best.items() for e in own]
        ids = pa.array([f[1] for f in found], batch_type)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[0] for f in found], pa.int64()), ids, pa.array([f[2] for f in found], pa.int64())],
            ["item", "doc_id", "score"],
        )

    batch_type = to_arrow_type(index.schema["doc_ids"].dataType.elementType)
    return rows.mapInArrow(find, f"item long, doc_id {kind}, score long")


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP, shard_bytes: int = SHARD_BYTES, block_terms: int = QUERY_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best `top` documents of (doc_id, text) for each row of (item_id, text).

    All if fewer score above 0. Equal scores rank by ascending doc_id, null ids last. Null and
    empty texts have no term: such documents count for nothing, such items give no row. Rows that
    repeat an id are documents, or items, of their own. Empty tables give an empty result.
    """
    size = collection_size(documents)
    index = materialise(indexed(documents, size, shard_bytes), "lexical-index")
    queries = materialise(numbered_items(items), "lexical-items")
    found = None
    for block in query_blocks(queries.select("item", "terms", "counts"), block_terms):
        # Written, so that the heaps of one block are searched once and its broadcast is free.
        part = materialise(search_block(index, block, size, top), "lexical-found")
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = index.schema["doc_ids"].dataType.elementType.simpleString()
        found = documents.sparkSession.createDataFrame([], f"item long, doc_id {kind}, score long")
    order = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(queries.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
