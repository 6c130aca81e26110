"""Toxicity by compression distance.

Two zstandard dictionaries are made, one of passages typical of toxic documents and one of
ordinary words. A window of text is compressed with each; the pair of lengths falls in a
cell, and cells are calibrated by how much more often toxic documents have one. A document
is scored from its most telling windows.

A window is a word, or its beginning, written as overlapping three-byte pieces with
spaces around: so even a short word is long enough for one dictionary match to show in
the compressed length. Longer runs are cut into several windows that overlap by the longest
n-gram; no text is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import in_pieces, pick, raw_texts
from threadlens.llm.decontaminate import folded_words
from threadlens.sources.shared import materialise

#: Expected labelled rows of each class that a model is fitted on; the documented bound.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 2000, 6000
GRAMS = (5, 6, 7)
MOST_GRAMS, MOST_PASSAGES, MOST_ORDINARY = 5000, 2000, 3000
OFTENER = 20  # times as large a share of toxic documents as of ordinary ones
STEM = 5
WINDOW_BYTES = 40
OVERLAP = max(GRAMS)
LEVEL = 1
TELLING = 3
CACHED_WORDS = 300_000
PIECE_BYTES = 4_000_000

Cell = tuple[int, int, int]


def expanded(word: bytes) -> bytes:
    padded = b" " + word + b" "
    return b"".join([padded[i : i + 3] for i in range(len(padded) - 2)])


def pieces(word: bytes) -> Iterator[bytes]:
    """The word, or a long one in stretches that overlap."""
    if len(word) <= WINDOW_BYTES:
        yield word
    else:
        for start in range(0, len(word) - OVERLAP, WINDOW_BYTES - OVERLAP):
            yield word[start : start + WINDOW_BYTES]


def windows(word: bytes) -> Iterator[tuple[int, bytes]]:
    """(kind, bytes): the word in pieces of bounded length, and its stem."""
    for piece in pieces(word):
        yield 0, expanded(piece)
    if len(word) > STEM:
        yield 1, expanded(word[:STEM])


def word_grams(word: bytes) -> Iterator[bytes]:
    padded = b" " + word + b" "
    for n in GRAMS:
        for i in range(len(padded) - n + 1):
            yield padded[i : i + n]


def stretches(word: bytes, chosen: frozenset[bytes]) -> set[bytes]:
    """The word if it has a chosen gram; of a long one what is around such grams."""
    if len(word) <= WINDOW_BYTES:
        return {word} if any(g in chosen for g in word_grams(word)) else set()
    padded = b" " + word + b" "
    out, end = set(), 0
    for i in range(len(padded)):
        size = max((n for n in GRAMS if padded[i : i + n] in chosen), default=0)
        if size and min(i - 1 + size, len(word)) > end:
            middle = i - 1 + size // 2
            first = max(0, min(middle - WINDOW_BYTES // 2, len(word) - WINDOW_BYTES))
            end = first + WINDOW_BYTES
            out.add(word[first:end])
    return out


@dataclass(frozen=True)
class Model:
    """Dictionaries with calibrated cells; without both classes only a constant."""

    toxic: bytes = b""
    ordinary: bytes = b""
    cells: tuple[tuple[Cell, float], ...] = ()
    weights: tuple[float, ...] = ()
    constant: float | None = None


class Press:
    """Compressed lengths of windows under both dictionaries, with bounded memories."""

    def __init__(self, model: Model):
        def compressor(content: bytes):
            sheet = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=sheet, write_content_size=False, write_dict_id=False
            )

        self.ordinary, self.toxic = compressor(model.ordinary), compressor(model.toxic)
        self.weight = dict(model.cells)
        self.words: dict[bytes, float] = {}
        self.stems: dict[bytes, Cell] = {}

    def cells(self, word: bytes) -> list[Cell]:
        out = []
        for kind, window in windows(word):
            cell = self.stems.get(window) if kind else None
            if cell is None:
                cell = (kind, len(self.ordinary.compress(window)), len(self.toxic.compress(window)))
                if kind:
                    if len(self.stems) >= CACHED_WORDS:
                        self.stems.clear()
                    self.stems[window] = cell
            out.append(cell)
        return out

    def telling(self, word: bytes) -> float:
        value = self.words.get(word)
        if value is None:
            value = max(self.weight.get(cell, 0.0) for cell in self.cells(word))
            if len(word) <= WINDOW_BYTES:
                if len(self.words) >= CACHED_WORDS:
                    self.words.clear()
                self.words[word] = value
        return value

    def features(self, text: bytes | None) -> list[float]:
        top = nlargest(TELLING, map(self.telling, set(folded_words(text))))
        return [*top, *[0.0] * (TELLING - len(top))]


_presses: dict[Model, Press] = {}


def press_of(model: Model) -> Press:
    """A worker keeps the press, and what it remembers, from task to task."""
    if model not in _presses:
        _presses.clear()
        _presses[model] = Press(model)
    return _presses[model]


def sample(documents: DataFrame, labels: DataFrame, toxic: int, ordinary: int) -> DataFrame:
    """(key, text, toxic, half, share) of about so many rows of each class.

    Rows of (doc_id, text) and (doc_id, toxic) are drawn by a hash of the text at a rate from
    the class's row count. Copies count once. `share` is the rate, `half` splits the sample by
    another hash. Labels meet hashes of texts, so no text is shuffled before it is drawn; the
    drawn ids, one for each distinct text, are as few as the sample and are broadcast.
    """
    rows = pick(documents, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("key", F.xxhash64(F.lit("toxicity sample"), "text"))
    usable = pick(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1))
    marked = materialise(rows.select("doc_id", "key").join(usable, "doc_id"), "toxicity-marked")
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = lambda want, label: min(1.0, want / max(1, sizes.get(label, 0)))
    share = F.when(F.col("toxic") == 1, F.lit(rate(toxic, 1))).otherwise(F.lit(rate(ordinary, 0)))
    draw = F.pmod(F.col("key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = marked.withColumn("share", share).where(draw < F.col("share"))
    drawn = drawn.groupBy("key", "toxic").agg(F.min("doc_id").alias("doc_id"), F.first("share").alias("share"))
    texts = rows.join(F.broadcast(drawn), ["doc_id", "key"])
    # Rows that repeat an id and a text would come twice.
    once = texts.groupBy("key", "toxic").agg(F.first("text").alias("text"), F.first("share").alias("share"))
    return once.withColumn("half", F.pmod(F.shiftright("key", 32), F.lit(2)).cast("int"))


def counted(rows: DataFrame, marks, column: str) -> DataFrame:
    """(mark, toxic, n): in how many sampled documents of each class a mark occurs."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", PIECE_BYTES // 8):
            found, label = [], []
            for text, toxic in zip(raw_texts(batch.column("text")), batch.column("toxic").to_pylist()):
                own = marks(text)
                found += own
                label += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(label, pa.int32())] if found else
                [pa.array([], pa.binary()), pa.array([], pa.int32())], [column, "toxic"])

    exploded = rows.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(spread, f"{column} binary, toxic int")
    count = lambda label: F.sum((F.col("toxic") == label).cast("long"))
    return exploded.groupBy(column).agg(count(1).alias("toxic_n"), count(0).alias("ordinary_n"))


def learn(
    documents: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, ordinary: int = SAMPLE_ORDINARY
) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic). Only counts and chosen words reach the driver."""
    rows = materialise(sample(documents, labels, toxic, ordinary), "toxicity-sample")
    sizes = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {label: sizes.get((label, 0), 0) + sizes.get((label, 1), 0) for label in (0, 1)}
    if not total[0] or not total[1]:
        return Model(constant=total[1] / max(1, total[0] + total[1]))
    # Dictionaries from one half and calibration from the other, if both are large enough.
    split = min(sizes.get((1, half), 0) for half in (0, 1)) >= 100
    first, second = (rows.where("half = 0"), rows.where("half = 1")) if split else (rows, rows)
    shares = {label: sizes[(label, 0)] if split else total[label] for label in (0, 1)}

    grams = counted(first, lambda text: list({g for w in set(folded_words(text)) for g in word_grams(w)}), "gram")
    least = max(2, round(0.008 * shares[1]))
    oftener = F.col("toxic_n") * (shares[0] / shares[1]) > OFTENER * (F.col("ordinary_n") + 0.5)
    typical = grams.where((F.col("toxic_n") >= least) & oftener)
    typical = typical.orderBy(F.desc("toxic_n"), "gram").limit(MOST_GRAMS)
    chosen = frozenset(bytes(r["gram"]) for r in typical.select("gram").collect())

    def telling_words(text: bytes | None) -> list[bytes]:
        return list({s for w in set(folded_words(text)) for s in stretches(w, chosen)})

    def most(table: DataFrame, count: str, limit: int) -> list[bytes]:
        top = table.orderBy(F.desc(count), "word").limit(limit).select("word").collect()
        return [bytes(r["word"]) for r in top]

    passages = most(counted(first.where("toxic = 1"), telling_words, "word"), "toxic_n", MOST_PASSAGES)
    all_words = lambda text: list({s for w in set(folded_words(text)) for s in pieces(w)})
    plain = most(counted(first.where("toxic = 0"), all_words, "word"), "ordinary_n", MOST_ORDINARY)
    # What is frequent stands last, where offsets are short.
    sheet = lambda words: b"".join(expanded(w) for w in reversed(words)).rjust(64, b" ")
    bare = Model(sheet(passages), sheet(plain))

    def seen_cells(text: bytes | None) -> list[bytes]:
        press = press_of(bare)
        return [np.array(c, "<i4").tobytes() for c in {c for w in set(folded_words(text)) for c in press.cells(w)}]

    cells = counted(second, seen_cells, "cell").collect()
    sums = {label: (sizes[(label, 1)] if split else total[label]) + 1.0 for label in (0, 1)}
    value = {
        tuple(np.frombuffer(r["cell"], "<i4").tolist()): float(
            np.log((r["toxic_n"] + 0.5) / sums[1]) - np.log((r["ordinary_n"] + 0.5) / sums[0])
        )
        for r in cells
    }
    model = Model(bare.toxic, bare.ordinary, tuple(sorted(value.items())))
    measured = second.select("text", "toxic", "share").mapInArrow(
        lambda batches: _features(batches, model), "features array<double>, toxic long, share double"
    )
    fitted = measured.collect()
    x = np.array([[1.0, *r["features"]] for r in fitted])
    y = np.array([r["toxic"] for r in fitted], float)
    return Model(model.toxic, model.ordinary, model.cells, tuple(logistic(x, y, np.array([1 / r["share"] for r in fitted]))))


def _features(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    press = press_of(model)
    for batch in batches:
        rows = [press.features(text) for text in raw_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float64())), batch.column("toxic").cast(pa.int64()), batch.column("share")],
            ["features", "toxic", "share"],
        )


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weights of a logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    weight = weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(bend, slope)
    return w.tolist()


def score(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row of (doc_id, text).

    score is 0..1, the higher the likelier toxic; predicted is 1 from 0.5 on. Null and
    empty texts are scored as texts without a telling window. If nothing or only one
    label was learned, every score is that label's share (0 without any). Repeated rows each
    give a row; whole texts are read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)
    rows = pick(documents, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in in_pieces(batches, "text", PIECE_BYTES):
            if own.constant is not None:
                values = np.full(batch.num_rows, own.constant)
            else:
                press = press_of(own)
                x = np.array([[1.0, *press.features(text)] for text in raw_texts(batch.column("text"))])
                values = 1 / (1 + np.exp(-np.clip(x @ np.array(own.weights), -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values), pa.array((values >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return rows.mapInArrow(judge, f"doc_id {kind}, score double, predicted int")
