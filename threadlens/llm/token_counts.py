"""Token counts under a unigram vocabulary, without building the tokens.

A word is the space mark followed by a run of non-white-space characters; no piece
crosses a word, so a text's count is the sum over its words. In a word one
Aho-Corasick pass lists every vocabulary piece that ends at each character, and a
dynamic program keeps per character the best score so far and how many pieces it took.
Ties follow the public unigram tokenizers: a later candidate replaces an earlier one
only when its score is strictly higher, candidates being visited by start, so the
longest of equally good last pieces wins. A character no piece covers costs the lowest
score less 10 and counts as its UTF-8 bytes (byte fallback). Sums are 64-bit floats.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from threadlens.llm.common import pick, raw_texts

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0  # fixed value of the public unigram tokenizers
CACHED_WORDS = 300_000
CACHED_BYTES = 48
VOCABULARY = Path("/opt/tokenizers/piece_bpe_32k.model")

Vocabulary = tuple[tuple[str, float], ...]


def read_vocabulary(path: str | Path = VOCABULARY) -> Vocabulary:
    """Pieces with scores from a sentencepiece file.

    A merge-ranked file has ranks in the place of log probabilities; its pieces get
    the Zipf score -ln(rank + 2). Control, byte and unknown pieces match no text.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(path))
    ids = [
        i
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))
    ]
    scores = [model.get_score(i) for i in ids]
    if all(float(s).is_integer() for s in scores):
        best = max(scores, default=0.0)
        scores = [-math.log(best - s + 2) for s in scores]
    return tuple((model.id_to_piece(i), s) for i, s in zip(ids, scores))


def automaton(vocabulary: Iterable[tuple[str, float]]) -> tuple[ahocorasick.Automaton, float]:
    found = ahocorasick.Automaton()
    lowest = 0.0
    for piece, score in vocabulary:
        if piece:
            found.add_word(piece, (len(piece), score))
            lowest = min(lowest, score)
    if len(found):
        found.make_automaton()
    return found, lowest - UNKNOWN_PENALTY


def count_word(word: str, pieces: ahocorasick.Automaton, unknown: float) -> tuple[float, int]:
    """Best score and number of pieces of one word, mark included."""
    size = len(word)
    ends: list[list[tuple[int, float]]] = [[] for _ in range(size)]
    if len(pieces):
        for end, piece in pieces.iter(word):  # longest piece of an end first
            ends[end].append(piece)
    best = [0.0] * (size + 1)
    taken = [0] * (size + 1)
    for end in range(size):
        top, count, single = None, 0, False
        for length, score in ends[end]:
            start = end + 1 - length
            total = score + best[start]
            single = single or length == 1
            if top is None or total > top:
                top, count = total, taken[start] + 1
        if not single:
            total = unknown + best[end]
            if top is None or total > top:
                top, count = total, taken[end] + len(word[end].encode("utf-8", "surrogatepass"))
        best[end + 1], taken[end + 1] = top, count
    return best[size], taken[size]


@lru_cache(maxsize=2)
def _ready(vocabulary: Vocabulary):
    return automaton(vocabulary)


def token_counts(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_words, n_tokens, score) for every row of (doc_id, text).

    Null and empty texts have no word, no token and score 0. Repeated rows each give
    a row; a null doc_id stays null. The vocabulary is one file's pieces, the only data
    sent to tasks. Each task remembers a bounded number of words; beyond it the memory
    starts afresh, which changes no result.
    """
    sent = documents.sparkSession.sparkContext.broadcast(tuple(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, unknown = _ready(sent.value)
        known: dict[bytes, tuple[float, int]] = {}
        for batch in batches:
            words_out, tokens_out, scores_out = [], [], []
            for text in raw_texts(batch.column("text")):
                words = text.split() if text else []
                score, tokens = 0.0, 0
                for word in words:
                    pair = known.get(word)
                    if pair is None:
                        pair = count_word(SPACE_MARK + word.decode("utf-8", "replace"), pieces, unknown)
                        if len(word) <= CACHED_BYTES:
                            if len(known) >= CACHED_WORDS:
                                known.clear()
                            known[word] = pair
                    score += pair[0]
                    tokens += pair[1]
                words_out.append(len(words))
                tokens_out.append(tokens)
                scores_out.append(score)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(words_out, pa.int64()),
                    pa.array(tokens_out, pa.int64()),
                    pa.array(scores_out, pa.float64()),
                ],
                ["doc_id", "n_words", "n_tokens", "score"],
            )

    rows = pick(documents, "doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long, score double")
