"""Language identification by string kernels.

The kernel of two texts is the normalised number of byte n-grams, of lengths one to
three, that occur in both (presence, not counts: a blended spectrum). Landmarks drawn
from the training rows give every text a short Nyström feature vector, and kernel ridge
regression, one language against the rest, is fitted on these. Scoring a batch is two
matrix products: presence by landmarks, then kernel values by weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import in_pieces, pick

UNDETERMINED = "und"
SAMPLE_PER_LANGUAGE = 400  # expected training rows a language; the documented bound
LANDMARKS_PER_LANGUAGE = 48  # fewer from about 90 languages on, see MOST_CELLS
ALL_GRAMS = 12_000  # up to so many grams all are kept; of more, each language keeps its share
LEAST_GRAMS = 150  # a language's share at least
MOST_CELLS = 64_000_000  # grams times landmarks
RIDGE = 1e-3
PIECE_BYTES = 1_500_000
DENSE_ROWS = 256


def gram_codes(data: np.ndarray) -> np.ndarray:
    """Codes of the n-grams of a byte array, with repeats: three, two, then one byte.

    Letters A-Z count as a-z. Lengths have ranges of their own: a code of three bytes
    starts at 2**17, of two at 2**8.
    """
    b = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.int32)
    two = (b[:-1] << 8) | b[1:]
    three = (two[:-1] << 8) | b[2:]
    return np.concatenate([three + (1 << 17), two + (1 << 8), b])


TABLE_SIZE = (1 << 24) + (1 << 17)


@dataclass
class Model:
    """languages by column; grams: codes; landmarks: grams x landmarks; weights: landmarks x languages."""

    languages: list[str]
    grams: np.ndarray
    landmarks: np.ndarray
    weights: np.ndarray

    def lookup(self) -> np.ndarray:
        kind = np.int16 if len(self.grams) < 1 << 15 else np.int32
        places = np.full(TABLE_SIZE, -1, kind)
        places[self.grams] = np.arange(len(self.grams), dtype=kind)
        return places

    def scores(self, presence: np.ndarray) -> np.ndarray:
        return kernel(presence, self.landmarks) @ self.weights


def normalised(presence: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.maximum(presence.sum(axis=1, keepdims=True, dtype=np.float64), 1.0)).astype(np.float32)
    return presence / norm


def kernel(presence: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    return (normalised(presence) @ landmarks).astype(np.float64)


def chosen_grams(rows_of: list[list[np.ndarray]]) -> np.ndarray:
    """Codes to tell languages by, from the landmarks' codes of each language.

    Grams that fewer than two landmarks have are left out, if there are over eight landmarks
    and the language has three. Of more than `ALL_GRAMS` each language keeps its commonest, as
    many for each, and the commonest of all fill up what is left.
    """
    codes, counts = np.unique(np.concatenate([own for rows in rows_of for own in rows]), return_counts=True)
    usable = counts >= (2 if sum(map(len, rows_of)) > 8 else 1)
    for rows in rows_of:
        if len(rows) < 3:
            usable[np.searchsorted(codes, np.concatenate(rows))] = True
    usable = np.flatnonzero(usable)
    if len(usable) <= ALL_GRAMS:
        return codes[usable]
    share = max(LEAST_GRAMS, ALL_GRAMS // len(rows_of))
    taken = np.zeros(len(codes), bool)
    for rows in rows_of:
        own, n = np.unique(np.concatenate(rows), return_counts=True)
        places = np.searchsorted(codes, own)
        known = np.isin(places, usable, assume_unique=True)
        places, n = places[known], n[known]
        taken[places[np.argsort(-n, kind="stable")][:share]] = True
    rest = usable[~taken[usable]]
    rest = rest[np.argsort(-counts[rest], kind="stable")]
    taken[rest[: max(0, ALL_GRAMS - int(taken.sum()))]] = True
    return codes[taken]


def fit(languages: list[str], grams_of: list[np.ndarray], labels: list[str]) -> Model:
    """Fit on the distinct gram codes of a bounded sample.

    Landmarks are the first rows of each language in the given order.
    """
    labels_ = np.array([languages.index(x) for x in labels], dtype=np.int64)
    count = len(languages)
    each = max(1, min(LANDMARKS_PER_LANGUAGE, MOST_CELLS // (count * max(ALL_GRAMS, LEAST_GRAMS * count))))
    chosen = [np.flatnonzero(labels_ == k)[:each] for k in range(count)]
    grams = chosen_grams([[grams_of[i] for i in own] for own in chosen])

    def presence_of(rows) -> np.ndarray:
        presence = np.zeros((len(rows), len(grams)), np.float32)
        for place, row in enumerate(rows):
            presence[place, np.isin(grams, grams_of[row], assume_unique=True)] = 1
        return presence

    marked = presence_of(np.concatenate(chosen))
    landmarks = normalised(marked).T.copy()
    among = kernel(marked, landmarks)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    kept = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, kept] / np.sqrt(values[kept])
    # Each language weighs the same, whatever its share of the sample.
    weigh = (1 / np.maximum(np.bincount(labels_, minlength=count), 1))[labels_][:, None]
    gram = RIDGE * np.eye(root.shape[1])
    wanted = np.zeros((root.shape[1], count))
    step = max(DENSE_ROWS, MOST_CELLS // max(1, len(grams)))
    for start in range(0, len(labels_), step):
        rows = np.arange(start, min(start + step, len(labels_)))
        features = kernel(presence_of(rows), landmarks) @ root
        weighed = (features * weigh[rows]).T
        gram += weighed @ features
        wanted += weighed @ (labels_[rows][:, None] == np.arange(count))
    return Model(languages, grams, landmarks, root @ np.linalg.solve(gram, wanted))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def training_rows(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> list[tuple[str, np.ndarray]]:
    """Gram codes of about `per_language` rows of each language of (text, lang).

    Rows are drawn by a hash of the text, at a rate from the language's row count, so the
    sample is the same in every run and no window over a language is needed. Every
    language with a row is learned. Only distinct codes leave the tasks, never texts.
    """
    usable = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    drawn = F.pmod(F.xxhash64(F.lit("language sample"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    usable = usable.withColumn("draw", drawn)
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least"))
    sampled = usable.join(F.broadcast(sizes), "lang").where(
        (F.col("draw") < F.lit(float(per_language)) / F.col("n")) | (F.col("draw") == F.col("least"))
    )
    # Copies share a draw; a text counts once, so copies cannot swell the sample.
    sampled = sampled.groupBy("lang", F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [
                np.unique(gram_codes(np.frombuffer(text, np.uint8))).astype("<i4").tobytes()
                for text in batch.column("text").cast(pa.binary()).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("key"), pa.array(own, pa.binary())], ["lang", "key", "codes"]
            )

    rows = sampled.select("lang", "key", "text").mapInArrow(codes, "lang string, key long, codes binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["key"]))
    return [(r["lang"], np.frombuffer(r["codes"], "<i4")) for r in rows]


def learn(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model | None:
    """A model from (text, lang); None if no row has both a language and a letter."""
    rows = training_rows(labelled, per_language)
    if not rows:
        return None
    return fit(sorted({lang for lang, _ in rows}), [own for _, own in rows], [lang for lang, _ in rows])


def presence_rows(texts: list[np.ndarray], places: np.ndarray, grams: int) -> np.ndarray:
    out = np.zeros((len(texts), grams + 1), np.float32)
    for row, data in enumerate(texts):
        for start in range(0, max(len(data), 1), PIECE_BYTES):
            out[row, places[gram_codes(data[start : start + PIECE_BYTES + 2])]] = 1
    return out[:, :grams]


def identify(documents: DataFrame, model: Model | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text, lang_pred, score) for every row of (doc_id, text), and columns to keep.

    lang_pred is a learned language; `und` with score 0 for null texts, texts without
    a letter, and every text when nothing was learned. Texts are read whole. score is
    the winning language's regression value, cut to 0..1. Ties go to the language first
    by name. Repeated rows each give a row.
    """
    rows = pick(documents, "doc_id", "text", *keep)
    carried = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    rows = rows.withColumn("known", has_letter(F.col("text")) if model is not None else F.lit(False))
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        places = own.lookup() if own is not None else None
        for batch in in_pieces(batches, "text", PIECE_BYTES):
            known = np.flatnonzero(batch.column("known").to_numpy(zero_copy_only=False))
            names = [UNDETERMINED] * batch.num_rows
            values = [0.0] * batch.num_rows
            texts = batch.column("text").cast(pa.binary())
            for start in range(0, len(known), DENSE_ROWS):
                part = known[start : start + DENSE_ROWS]
                data = [np.frombuffer(texts[int(i)].as_buffer(), np.uint8) for i in part]
                result = own.scores(presence_rows(data, places, len(own.grams)))
                for i, best, value in zip(part, result.argmax(axis=1), result.max(axis=1)):
                    names[i] = own.languages[best]
                    values[i] = float(min(1.0, max(0.0, value)))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ("doc_id", "text", *keep)), pa.array(names, pa.string()), pa.array(values, pa.float64())],
                ["doc_id", "text", *keep, "lang_pred", "score"],
            )

    return rows.mapInArrow(score, f"{carried}, lang_pred string, score double")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id's text leaves the remainder; a null id is never held out."""
    rest = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus))
    return F.coalesce(rest == remainder, F.lit(False))
