"""Removal of passages that occur more than once in a collection.

Every window of 35 words that also starts elsewhere is removed. Windows are dealt to
shards by content, so equal windows always meet and no document is compared with all
shards: a window's route is the least hash among the 6-word runs in it, and a stretch of
windows with the same route travels as one segment of text.

1. Documents are scanned for segments, as (route, document digest, place); no text moves.
2. A window can only repeat if its route does. Routes seen once are dropped.
3. Documents meet their remaining segments, whose texts are made distinct with weights.
4. Each shard builds an FM-index of its segments; backward search over the wavelet matrix
   gives the windows that occur with weight two or more.
5. The windows come back to their documents; the words under them are cut out of the text.

Routes may share hashes by chance; that only sends more segments. Windows are
compared as words. A route with very many different segments is dealt again window by
window, so no shard grows with the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from threadlens.llm.common import in_pieces, pick, raw_texts, sha256_hex
from threadlens.llm.fmindex import FMIndex
from threadlens.sources.shared import materialise

WINDOW = 35
GRAM = 6
ROUTES = WINDOW - GRAM + 1  # 6-word runs in a window
LONGEST_RUN = 64
CROWD = 16_384  # different segments of a route, under a million words
WORDS_PER_SHARD = 150_000
PATTERNS_AT_ONCE = 100_000
PIECE_BYTES = 1 << 20
LONG_WORD = 1 << 12

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
STEP = 0xD6E8FEB86659FD93
LOOP = 128  # bit of a place whose segment may repeat a window inside itself


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the multiplier and of its inverse for one chunk of bytes."""

    def __init__(self, size: int):
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, MULTIPLIER)]))
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, INVERSE)]))


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edges = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    return np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of each word that depends on its bytes alone, chunk by chunk."""
    out = np.zeros(len(starts), np.uint64)
    sizes = ends - starts
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PIECE_BYTES, side="right")))
        low, high = int(starts[at]), int(ends[to - 1])
        if high - low <= PIECE_BYTES:
            sums = np.concatenate(
                [[np.uint64(0)], np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers.up[: high - low])]
            )
            a, b = starts[at:to] - low, ends[at:to] - low
            out[at:to] = (sums[b] - sums[a]) * powers.down[a]
        at = to
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return mixed(out)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def segments_of(word_hash: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first word, windows, route, loops) of each stretch of windows with the same route.

    `document` numbers the document of each word. Stretches are cut at 64 windows.
    Equal windows of one stretch have equal 6-word runs close together, so `loops` marks
    stretches in which a run comes again within the length of a stretch.
    """
    nothing = np.zeros(0, np.int64)
    if len(word_hash) < WINDOW:
        return nothing, nothing, nothing, nothing
    count = len(word_hash) - GRAM + 1
    gram = np.zeros(count, np.uint64)
    for j in range(GRAM):
        gram += word_hash[j : j + count] * np.uint64(pow(STEP, j, 1 << 64))
    gram = mixed(gram)
    route = least_of(gram, ROUTES)
    whole = document[: len(route)] == document[WINDOW - 1 :]
    new = np.ones(len(route), bool)
    new[1:] = (route[1:] != route[:-1]) | (document[1 : len(route)] != document[: len(route) - 1])
    begin = np.flatnonzero(new)
    since = np.arange(len(route)) - begin[np.cumsum(new) - 1]
    new |= since % LONGEST_RUN == 0
    begin = np.flatnonzero(new)
    # Windows that run over a document's end are its last ones: they shorten a stretch.
    size = np.add.reduceat(whole.astype(np.int64), begin)
    used = size > 0
    begin, size = begin[used], size[used]
    order = np.argsort(gram, kind="stable")
    near = (gram[order[1:]] == gram[order[:-1]]) & (np.diff(order) < LONGEST_RUN + ROUTES)
    again = np.zeros(count + 1, np.int64)
    again[order[:-1][near] + 1] = 1
    again = np.cumsum(again)
    loops = again[begin + size + ROUTES - 1] > again[begin]
    return begin, size, route[begin].view(np.int64), loops


def digest_of(text: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(text)
    return np.array([value >> 64, value & (1 << 64) - 1], np.uint64).view(np.int64).tolist()


def routes(documents: DataFrame) -> DataFrame:
    """(route, d1, d2, at): the segments of each text, `at` = 256 * first word + loop bit + windows.

    A text of at least one window adds a row for itself, with at = -1 and a route from
    its digest, by which exact copies find each other.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers(PIECE_BYTES)
        for batch in in_pieces(batches, "text", PIECE_BYTES):
            texts = [text or b"" for text in raw_texts(batch.column("text"))]
            data = np.frombuffer(b" ".join(texts), np.uint8)
            offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
            starts, ends = word_spans(data)
            if len(starts) < WINDOW:
                continue
            document = np.searchsorted(offsets, starts, side="right") - 1
            first, size, route, loops = segments_of(word_hashes(data, starts, ends, powers), document)
            before = np.searchsorted(document, np.arange(len(texts)))
            owner = document[first]
            at = (first - before[owner]) * 256 + loops * LOOP + size
            digests = np.array([digest_of(t) for t in texts], np.int64)
            long = np.unique(owner)
            own_route = mixed(digests[long, 0].view(np.uint64) + np.uint64(1)).view(np.int64)
            owner = np.concatenate([owner, long])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([route, own_route])),
                    pa.array(np.ascontiguousarray(digests[owner, 0])),
                    pa.array(np.ascontiguousarray(digests[owner, 1])),
                    pa.array(np.concatenate([at, np.full(len(long), -1)])),
                ],
                ["route", "d1", "d2", "at"],
            )

    return documents.mapInArrow(scan, "route long, d1 long, d2 long, at long")


def packed(documents: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, n_words, body): body is the compressed text, null for a null one."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in in_pieces(batches, "text", 4 * PIECE_BYTES):
            rows = []
            for text in raw_texts(batch.column("text")):
                body = press.compress(text) if text is not None else None
                text = text or b""
                rows.append((*digest_of(text), len(text.split()), body))
            d1, d2, counts, bodies = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(d1, pa.int64()),
                    pa.array(d2, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(bodies, pa.binary()),
                ],
                ["doc_id", "d1", "d2", "n_words", "body"],
            )

    return documents.mapInArrow(pack, f"doc_id {kind}, d1 long, d2 long, n_words long, body binary")


def cut(words: list[bytes], segments: list[dict]) -> Iterator[tuple[int, int, bytes]]:
    """(route, at, text) of a document's segments."""
    for s in segments:
        first, size = s["at"] >> 8, s["at"] & 127
        yield s["route"], s["at"], b" ".join(words[first : first + size + WINDOW - 1])


def segment_texts(rows: DataFrame) -> DataFrame:
    """(route, segment, weight) of rows (d1, d2, copies, segments, body).

    A text with copies is sent once a task with weight 2, which is enough.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for row in range(batch.num_rows):
                part = batch.slice(row, 1).to_pylist()[0]
                copied = part["copies"] > 1
                if copied:
                    key = (part["d1"], part["d2"])
                    if key in sent:
                        continue
                    sent.add(key)
                words = unpack.decompress(part["body"]).split()
                found = list(cut(words, part["segments"]))
                if found:
                    route, _, text = zip(*found)
                    weight = [2 if copied else 1] * len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(route, pa.int64()), pa.array(text, pa.binary()), pa.array(weight, pa.int64())],
                        ["route", "segment", "weight"],
                    )

    columns = rows.select("d1", "d2", "copies", "segments", "body")
    return columns.mapInArrow(send, "route long, segment binary, weight long")


def segment_places(rows: DataFrame) -> DataFrame:
    """(d1, d2, at, s1, s2): the digest of each segment of each text that has no copy."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for part in batch.to_pylist():
                words = unpack.decompress(part["body"]).split()
                for _, at, text in cut(words, part["segments"]):
                    out.append((part["d1"], part["d2"], at, *digest_of(text)))
            columns = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns], ["d1", "d2", "at", "s1", "s2"]
            )

    return rows.select("d1", "d2", "segments", "body").mapInArrow(
        place, "d1 long, d2 long, at long, s1 long, s2 long"
    )


def repeated_windows(shard: pa.Table) -> pa.Table:
    """(s1, s2, mask): of a shard's segments, a bit per window that occurs twice or more."""
    texts = shard.column("segment").to_pylist()
    weights = shard.column("weight").to_numpy()
    codes: dict[bytes, int] = {}
    symbols: list[int] = []
    begins = np.zeros(len(texts) + 1, np.int64)
    for i, text in enumerate(texts):
        symbols += [codes.setdefault(w, len(codes) + 1) for w in text.split()]
        symbols.append(0)
        begins[i + 1] = len(symbols)
    sequence = np.array(symbols, np.int64)
    sizes = np.diff(begins) - WINDOW  # windows of a segment: words - 34, and a stop
    index = FMIndex(sequence, len(codes) + 1, WINDOW)
    per_place = np.repeat(weights, np.diff(begins))
    # A segment that occurs twice needs no search: all of its windows do.
    found = [np.ones(n, bool) if w > 1 else np.zeros(n, bool) for n, w in zip(sizes, weights)]
    asked = np.flatnonzero(weights == 1)
    step = max(1, PATTERNS_AT_ONCE // LONGEST_RUN)
    for at in range(0, len(asked), step):
        part = asked[at : at + step]
        starts = np.concatenate([np.arange(begins[i], begins[i] + sizes[i]) for i in part])
        hits = index.matched(sequence, starts, WINDOW, per_place, 2)
        for i, own in zip(part, np.split(hits, np.cumsum(sizes[part])[:-1])):
            found[i] = own
    kept = [i for i, own in enumerate(found) if own.any()]
    digests = [digest_of(texts[i]) for i in kept]
    masks = [np.packbits(found[i], bitorder="little").tobytes() for i in kept]
    return pa.table(
        {
            "s1": pa.array([d[0] for d in digests], pa.int64()),
            "s2": pa.array([d[1] for d in digests], pa.int64()),
            "mask": pa.array(masks, pa.binary()),
        }
    )


def window_texts(segments: DataFrame) -> DataFrame:
    """(s1, s2, place, segment, weight): each window of a segment as a segment of its own."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, weight in zip(batch.column("segment").to_pylist(), batch.column("weight").to_pylist()):
                words = text.split()
                count = len(words) - WINDOW + 1
                first, second = digest_of(text)
                parts = [b" ".join(words[i : i + WINDOW]) for i in range(count)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([first] * count, pa.int64()),
                        pa.array([second] * count, pa.int64()),
                        pa.array(range(count), pa.int64()),
                        pa.array(parts, pa.binary()),
                        pa.array([weight] * count, pa.int64()),
                    ],
                    ["s1", "s2", "place", "segment", "weight"],
                )

    return segments.select("segment", "weight").mapInArrow(
        split, "s1 long, s2 long, place long, segment binary, weight long"
    )


def searched(segments: DataFrame) -> DataFrame:
    """(s1, s2, mask) for distinct (route, segment, weight), by shards of whole routes."""
    size = segments.agg(F.sum(F.octet_length("segment"))).first()[0] or 0
    shards = max(1, size // (6 * WORDS_PER_SHARD))
    sharded = segments.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    return sharded.groupBy("shard").applyInArrow(repeated_windows, "s1 long, s2 long, mask binary")


def segment_masks(distinct: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(s1, s2, mask) of distinct segments that have a repeated window.

    Segments of a crowded route become windows, each dealt by its own digest; equal
    windows are one row with their weights added, and what is found goes back to the
    segments they came from.
    """
    crowded = distinct.groupBy("route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd)
    crowded = materialise(crowded.select("route"), "repeats-crowded")
    if crowded.isEmpty():
        return searched(distinct)
    calm = searched(distinct.join(crowded, "route", "left_anti"))
    apart = materialise(window_texts(distinct.join(crowded, "route", "left_semi")), "repeats-windows")
    own = apart.withColumn("route", F.xxhash64("segment"))
    found = searched(own.groupBy("route", "segment").agg(F.sum("weight").alias("weight")))
    places = window_digests(apart)
    back = places.join(found.select(F.col("s1").alias("w1"), F.col("s2").alias("w2")), ["w1", "w2"])
    masks = back.groupBy("s1", "s2").agg(F.collect_set("place").alias("places"))
    return calm.unionByName(masks.select("s1", "s2", mask_of("places").alias("mask")))


def window_digests(windows: DataFrame) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.array([digest_of(t) for t in batch.column("segment").to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    *map(batch.column, ("s1", "s2", "place")),
                    pa.array(np.ascontiguousarray(pairs[:, 0])),
                    pa.array(np.ascontiguousarray(pairs[:, 1])),
                ],
                ["s1", "s2", "place", "w1", "w2"],
            )

    return windows.select("s1", "s2", "place", "segment").mapInArrow(
        digest, "s1 long, s2 long, place long, w1 long, w2 long"
    )


@F.pandas_udf(BinaryType())
def mask_of(places: pd.Series) -> pd.Series:
    """Places of windows as a bit mask."""

    def one(own) -> bytes:
        bits = np.zeros(LONGEST_RUN, np.uint8)
        bits[np.asarray(own, np.int64)] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    return places.map(one)


def without(text: bytes, masks: list[dict]) -> tuple[bytes, list[dict]]:
    """A text without the words under its masks, and these words as [first, end) ranges.

    Each range goes with the white space up to the next word, so the rest stays as it was.
    """
    starts, _ = word_spans(np.frombuffer(text, np.uint8))
    edges = np.zeros(len(starts) + 1, np.int64)
    for m in masks:
        hits = np.flatnonzero(np.unpackbits(np.frombuffer(m["mask"], np.uint8), bitorder="little"))
        np.add.at(edges, (m["at"] >> 8) + hits, 1)
        np.add.at(edges, (m["at"] >> 8) + hits + WINDOW, -1)
    turns = np.diff(np.concatenate([[0], (np.cumsum(edges[:-1]) > 0).astype(np.int8), [0]]))
    ranges = list(zip(np.flatnonzero(turns == 1).tolist(), np.flatnonzero(turns == -1).tolist()))
    told = [{"first": first, "end": end} for first, end in ranges]
    if ranges == [(0, len(starts))]:
        return b"", told
    parts, at = [], 0
    for first, end in ranges:
        parts.append(text[at : starts[first]])
        at = int(starts[end]) if end < len(starts) else len(text)
    return b"".join([*parts, text[at:]]), told


RANGE_TYPE = pa.struct([("first", pa.int64()), ("end", pa.int64())])


def kept_texts(rows: DataFrame) -> DataFrame:
    """(doc_id, text, n_words, removed) of rows (doc_id, n_words, body, masks).

    A text without masks is handed on byte for byte, a null one stays null.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()

        def told(batch: pa.RecordBatch, texts: list, ranges: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(texts, pa.binary()),
                    batch.column("n_words"),
                    pa.array(ranges, pa.list_(RANGE_TYPE)),
                ],
                ["doc_id", "text", "n_words", "removed"],
            )

        for batch in batches:
            texts, ranges, size, begin = [], [], 0, 0
            for row, (body, masks) in enumerate(zip(batch.column("body"), batch.column("masks"))):
                text = unpack.decompress(body.as_py()) if body.is_valid else None
                text, own = without(text, masks.as_py()) if masks.is_valid else (text, [])
                texts.append(text)
                ranges.append(own)
                size += len(text or b"")
                if size >= 4 * PIECE_BYTES:
                    yield told(batch.slice(begin, row + 1 - begin), texts, ranges)
                    texts, ranges, size, begin = [], [], 0, row + 1
            if texts:
                yield told(batch.slice(begin), texts, ranges)

    kept = rows.select("doc_id", "n_words", "body", "masks").mapInArrow(
        keep, f"doc_id {kind}, text binary, n_words long, removed array<struct<first: long, end: long>>"
    )
    return kept.withColumn("text", F.col("text").cast("string"))


def words_digest(text: Column) -> Column:
    """SHA-256 of a text's words, joined by single spaces."""
    return sha256_hex(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")))


def remove_repeats(documents: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, text, removed, n_words, n_removed, kept_sha256) for every row of (doc_id, text).

    `text` is what is left, its white space as it was; `removed` has the [first, end) ranges
    of the words taken out, in order. The counts and the digest follow from these.
    Null texts have no words and lose none; texts under 35 words lose none. Rows are
    told apart by their texts, never by id: of repeated rows and exact copies each loses
    all its words, if it has 35. Null texts stay null. An empty table gives an empty result.
    """
    rows = pick(documents, "doc_id", "text")
    found = routes(rows)
    loops = lambda at: (at >= 0) & (at.bitwiseAND(F.lit(LOOP)) != 0)
    repeated = found.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.max(loops(F.col("at"))).alias("loops"))
    repeated = repeated.where((F.col("n") > 1) | F.col("loops")).select("route", "n")
    segments = found.join(repeated, "route").groupBy("d1", "d2").agg(
        F.collect_set(F.struct("at", "route", "n")).alias("segments")
    )
    copies = F.aggregate("segments", F.lit(1).cast("long"), lambda n, s: F.when(s["at"] == -1, s["n"]).otherwise(n))
    segments = segments.withColumn("copies", copies)
    # What only a text's own copies share with it, no other text has.
    others = F.filter(
        "segments",
        lambda s: (s["at"] >= 0) & ((s["n"] > F.col("copies")) | loops(s["at"])),
    )
    joined = packed(rows).join(segments.withColumn("segments", others), ["d1", "d2"], "left")
    busy = F.coalesce(F.size("segments") > 0, F.lit(False))
    # Of a text with copies nothing is left; its body is only needed to send segments.
    joined = materialise(
        joined.withColumn("copies", F.coalesce("copies", F.lit(1)))
        .withColumn("segments", F.when(busy, F.col("segments")))
        .withColumn("body", F.when(busy | (F.col("copies") == 1), F.col("body"))),
        "repeats-documents",
    )
    sent = joined.where(F.col("segments").isNotNull())
    distinct = materialise(
        segment_texts(sent).groupBy("route", "segment").agg(F.sum("weight").alias("weight")), "repeats-segments"
    )
    masks = segment_masks(distinct, crowd)
    single = sent.where(F.col("copies") == 1)
    hit = segment_places(single).join(masks, ["s1", "s2"]).groupBy("d1", "d2").agg(
        F.collect_list(F.struct("at", "mask")).alias("masks")
    )
    columns = ("doc_id", "n_words", "body", "masks")
    changed = single.join(hit, ["d1", "d2"], "left").select(*columns)
    untouched = joined.where(F.col("segments").isNull() & (F.col("copies") == 1))
    untouched = untouched.withColumn("masks", F.lit(None).cast(hit.schema["masks"].dataType)).select(*columns)
    emptied = joined.where(F.col("copies") > 1).select(
        "doc_id",
        F.lit("").alias("text"),
        "n_words",
        F.array(F.struct(F.lit(0).cast("long").alias("first"), F.col("n_words").alias("end"))).alias("removed"),
    )
    kept = kept_texts(changed.unionByName(untouched)).unionByName(emptied)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    return kept.select(
        "doc_id", "text", "removed", "n_words", gone.alias("n_removed"), words_digest(F.col("text")).alias("kept_sha256")
    )
