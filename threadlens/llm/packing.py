"""Packing documents into sequences of fixed length, every sequence near the target mixture.

Each source is a queue: its documents' tokens, one after another. Queues are served by
deficit round-robin. In every round, which is one sequence long, a queue's deficit grows by
its quantum, its target share of a sequence; a queue is served when its deficit reaches
the size of a service, in the order of the queues, and what is left over is carried to the
next round. What is served, end to end, is cut into sequences, so all of them are full but
the last.

A queue of tokens that may be cut anywhere makes the deficits a formula: after r rounds a
queue has earned r quanta, so service j falls in the first round that has earned
(j + 1) services. Any run of rounds is therefore packed by a task of its own, and takes
over the deficits, and the sequence left unfilled, from the runs before it:

1. Documents are tokenised once and written with their place among the tokens of their
   source in the same part.
2. Sums by part and source place each document in its queue.
3. Documents are cut where their services change to another run of rounds; sums by
   run give the place of a run's first token.
4. Each run orders its services and cuts them into sequences.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.common import in_pieces, pick, raw_texts
from threadlens.operators.running import running_total
from threadlens.sources.shared import materialise

SEQUENCE = 2048
END_ID = 1
#: A service of fewer tokens is not worth a cut, so small queues save up for one.
LEAST_SERVICE = 64
ROUNDS_PER_RUN = 128
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 500_000
CACHED_BYTES = 48
PIECE_BYTES = 4 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds(dict):
    """Ids of words as little-endian bytes, the frequent ones remembered.

    White space gives no token and none reaches across it, so a text's ids are those of its
    words, one after another. A run of letters is one piece for the merges, in
    lower case, and so is a mark behind it; for letters whose lower case and composition are
    plain the merges are applied at once, which costs a quarter of the whole tokenizer.
    When the memory is full a second one begins, and words found in the first move over.
    """

    LETTERS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
    #: A-Z in lower case; line ends and tabs are gaps as well.
    FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10) else c for c in range(256))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model
        self.letters = byte_letters()
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.format = "H" if self.kind.itemsize == 2 else "I"
        self.end = self.spelled([END_ID])
        self.older: dict[bytes, bytes] = {b"": b""}

    def spelled(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.format}", *ids)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.found(word)
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def found(self, word: bytes) -> bytes:
        if word.isalpha():
            return self.merged(word.decode("ascii"))
        if word[-1:] in b".,;:!?" and word[:-1].isalpha():
            return self[word[:-1]] + self[word[-1:]]
        text = word.decode("utf-8")
        lower = text.lower()
        plain = self.LETTERS.match(lower)
        if plain and len(lower) == len(text):
            rest = lower[plain.end() :]
            if rest == "" or rest in ".,;:!?":
                return self.merged("".join([self.letters[b] for b in plain[0].encode("utf-8")])) + (self[rest.encode()] if rest else b"")
        return self.spelled(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def merged(self, letters: str) -> bytes:
        return self.spelled([token.id for token in self.merges.tokenize(letters)])

    def document(self, text: bytes | None) -> bytes:
        """Ids of a text and the end id."""
        if not text:
            return self.end
        if b"<|" in text:  # special tokens keep their case
            return self.spelled(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids) + self.end
        return b"".join([self[word] for word in text.translate(self.FOLD).split(b" ")]) + self.end


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokenised(documents: DataFrame, path: str) -> DataFrame:
    """(part, doc_id, queue, before, n, width, ids): tokens of each document of (doc_id, source, text).

    `before` counts the tokens of the same queue earlier in the part; `queue` is the source
    with a mark that tells a null one from any text.
    """
    rows = pick(documents, "doc_id", "source", "text")
    rows = rows.select("doc_id", F.concat(F.expr("if(source IS NULL, '-', '=')"), F.coalesce("source", F.lit(""))).alias("queue"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = word_ids(path)
        width = known.kind.itemsize
        part = TaskContext.get().partitionId()
        seen: dict[str, int] = {}
        for batch in in_pieces(batches, "text", PIECE_BYTES):
            ids = [known.document(text) for text in raw_texts(batch.column("text"))]
            sizes = [len(i) // width for i in ids]
            before = []
            for queue, size in zip(batch.column("queue").to_pylist(), sizes):
                at = seen.get(queue, 0)
                before.append(at)
                seen[queue] = at + size
            same = [np.full(len(ids), x) for x in (part, width)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(same[0], pa.int32()), batch.column("doc_id"), batch.column("queue"), pa.array(before, pa.int64()),
                    pa.array(sizes, pa.int64()), pa.array(same[1], pa.int32()), pa.array(ids, pa.binary()),
                ],
                ["part", "doc_id", "queue", "before", "n", "width", "ids"],
            )

    return rows.mapInArrow(read, f"part int, doc_id {kind}, queue string, before long, n long, width int, ids binary")


def queues(sums: DataFrame, weights: DataFrame | None, sequence: int, least: int) -> DataFrame:
    """(queue, quantum, service, credit) from (part, queue, own): how each queue is served.

    A queue's weight is its row in `weights` (source, weight), or else its tokens, which
    empties all queues together. Services are equal and about a quantum, but not below `least`
    unless the queue is. Queues start with a part of a service as credit, from their hash, so
    that small queues of one size do not all come in the same round.
    """
    sizes = sums.groupBy("queue").agg(F.sum("own").alias("size"))
    if weights is None:
        weighed = sizes.withColumn("weight", F.col("size").cast("double"))
    else:
        named = pick(weights, "source", "weight").where("weight > 0").groupBy("source").agg(F.sum("weight").alias("given"))
        named = named.select(F.concat(F.expr("if(source IS NULL, '-', '=')"), F.coalesce("source", F.lit(""))).alias("name"), "given")
        tokens = float(sizes.agg(F.sum("size")).first()[0] or 1)
        weighed = sizes.join(named, F.col("queue") == F.col("name"), "left")
        share = F.coalesce(F.col("given").cast("double"), F.col("size") / F.lit(tokens))
        weighed = weighed.select("queue", "size", share.alias("weight"))
    total = weighed.agg(F.sum("weight")).first()[0] or 1.0
    quantum = F.lit(float(sequence)) * F.col("weight") / F.lit(float(total))
    served = weighed.withColumn("quantum", quantum)
    number = F.expr(f"greatest(1L, CAST(floor(size / greatest({least}D, quantum)) AS bigint))")
    return served.select(
        "queue",
        "quantum",
        F.ceil(F.col("size") / number).cast("long").alias("service"),
        (F.pmod(F.xxhash64("queue"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("credit"),
    )


def rounds_of(service_number: np.ndarray, quantum, service, credit) -> np.ndarray:
    """The round in which a queue has earned a service, counted from 0."""
    earned = np.ceil((service_number + 1 - credit) * service / quantum)
    return np.maximum(earned, 1).astype(np.int64) - 1


STRETCH = "run long, queue string, quantum double, service long, credit double, at long, size long"


def stretches(rows: DataFrame, per_run: int, with_ids: bool) -> DataFrame:
    """Documents cut where their services change to another run of rounds.

    Gives `STRETCH`: the run, how the queue is served, the first token's place in the queue
    and the size; with ids also doc_id, start, n, width and ids.
    """
    kind = rows.schema["doc_id"].dataType.simpleString() if with_ids else ""
    schema = STRETCH + (f", doc_id {kind}, start long, n long, width int, ids binary" if with_ids else "")
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, quantum, service, credit = (
                batch.column(c).to_numpy(zero_copy_only=False) for c in ("at", "n", "quantum", "service", "credit")
            )
            first, last = at // service, (at + n - 1) // service
            runs = [rounds_of(x, quantum, service, credit) // per_run for x in (first, last)]
            source, begin, size, run = [], [], [], []
            for i in range(batch.num_rows):
                if runs[0][i] == runs[1][i]:
                    source.append(i), begin.append(0), size.append(int(n[i])), run.append(int(runs[0][i]))
                    continue
                numbers = np.arange(first[i], last[i] + 1)
                own = rounds_of(numbers, quantum[i], service[i], credit[i]) // per_run
                new = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
                starts = np.maximum(numbers[new] * service[i], at[i]) - at[i]
                source += [i] * len(new)
                begin += starts.tolist()
                size += np.diff(starts, append=n[i]).tolist()
                run += own[new].tolist()
            picked = pa.array(source, pa.int64())
            column = {c: batch.column(c).take(picked) for c in ("queue", "quantum", "service", "credit")}
            begin_array = np.array(begin, np.int64)
            column |= {"run": pa.array(run, pa.int64()), "size": pa.array(size, pa.int64()), "at": pa.array(at[source] + begin_array)}
            if with_ids:
                column |= {c: batch.column(c).take(picked) for c in ("doc_id", "n", "width")}
                held, width = batch.column("ids"), batch.column("width").to_numpy(zero_copy_only=False)
                parts = [
                    held[i].as_buffer()[b * int(width[i]) : (b + s) * int(width[i])] for i, b, s in zip(source, begin, size)
                ]
                column |= {"start": pa.array(begin_array), "ids": pa.array([p.to_pybytes() for p in parts], pa.binary())}
            yield pa.RecordBatch.from_arrays([column[c] for c in names], names)

    return rows.mapInArrow(cut, schema)


def pieces_of_run(table: pa.Table, sequence: int) -> dict[str, object]:
    """The pieces of one run: services in order of round and queue, cut into sequences.

    Services of one stretch that follow one another in a sequence are one piece.
    """
    at, size, quantum, service, credit, start, first_token = (
        table.column(c).to_numpy() for c in ("at", "size", "quantum", "service", "credit", "start", "first_token")
    )
    names = table.column("queue").to_pylist()
    order_of = {q: i for i, q in enumerate(sorted(set(names), key=lambda q: (zlib.crc32(q.encode()), q)))}
    queue = np.array([order_of[q] for q in names])
    low = at // service
    count = (at + size - 1) // service - low + 1
    row = np.repeat(np.arange(len(at)), count)
    number = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    begin = np.maximum(number * service[row], at[row])
    length = np.minimum((number + 1) * service[row], at[row] + size[row]) - begin
    served = rounds_of(number, quantum[row], service[row], credit[row])
    order = np.lexsort((begin, queue[row], served))
    row, begin, length = row[order], begin[order], length[order]
    place = first_token[0] + np.cumsum(length) - length
    inside = begin - at[row]
    # Cut at the ends of sequences.
    cuts = (place + length - 1) // sequence - place // sequence + 1
    which = np.repeat(np.arange(len(row)), cuts)
    step = np.arange(len(which)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    sequence_id = place[which] // sequence + step
    from_place = np.maximum(place[which], sequence_id * sequence)
    to_place = np.minimum(place[which] + length[which], (sequence_id + 1) * sequence)
    row, inside = row[which], inside[which] + from_place - place[which]
    length = to_place - from_place
    # Join what follows on within a sequence.
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (sequence_id[1:] != sequence_id[:-1]) | (inside[1:] != inside[:-1] + length[:-1])
    head = np.flatnonzero(new)
    length = np.add.reduceat(length, head) if len(head) else length
    row, inside, sequence_id, from_place = row[head], inside[head], sequence_id[head], from_place[head]
    return {
        "row": row,
        "inside": inside,
        "start": start[row] + inside,
        "length": length,
        "sequence_id": sequence_id,
        "offset": from_place % sequence,
    }


def packed(
    documents: DataFrame,
    path: str,
    weights: DataFrame | None = None,
    sequence: int = SEQUENCE,
    least: int = LEAST_SERVICE,
    per_run: int = ROUNDS_PER_RUN,
) -> DataFrame:
    """(doc_id, source, start, length, ids, doc_tokens, sequence_id, offset): a row per piece.

    Every token of (doc_id, source, text) and each document's end id lie in one piece.
    `ids` are little-endian unsigned 32-bit numbers. Null and empty texts
    have the end id alone; a null source is a queue of its own; repeated rows are documents of
    their own; an empty table gives no piece. Weights that empty a queue early leave its
    share to the others.
    """
    rows = materialise(tokenised(documents, path), "packing-tokens")
    sums = rows.groupBy("part", "queue").agg(F.sum("n").alias("own"))
    # A row per part and queue: parts before this one, within a queue.
    earlier = W.partitionBy("queue").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sums = materialise(sums, "packing-sums")
    bases = sums.select("part", "queue", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"))
    service = bases.join(queues(sums, weights, sequence, least), "queue")
    service = materialise(service, "packing-queues")
    placed = rows.join(service, ["part", "queue"]).withColumn("at", F.col("base") + F.col("before"))
    # Ids are not read for the sums by run.
    plan = stretches(placed.select("queue", "quantum", "service", "credit", "at", "n"), per_run, False)
    firsts = running_total(plan.groupBy("run").agg(F.sum("size").alias("tokens")), "run", "tokens", "first_token")
    wanted = ("queue", "quantum", "service", "credit", "at", "n", "doc_id", "width", "ids")
    parts = stretches(placed.select(*wanted), per_run, True).join(firsts.select("run", "first_token"), "run")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def pack(run: pa.Table) -> pa.Table:
        found = pieces_of_run(run, sequence)
        held, width = run.column("ids").to_pylist(), run.column("width").to_numpy()
        ids = []
        for row, inside, length in zip(found["row"].tolist(), found["inside"].tolist(), found["length"].tolist()):
            own = np.frombuffer(held[row], f"<u{width[row]}", length, inside * int(width[row]))
            ids.append(own.astype("<u4").tobytes())
        picked = pa.array(found["row"])
        return pa.table(
            {
                "doc_id": run.column("doc_id").take(picked),
                "queue": run.column("queue").take(picked),
                "start": found["start"],
                "length": found["length"],
                "ids": pa.array(ids, pa.binary()),
                "doc_tokens": run.column("n").take(picked),
                "sequence_id": found["sequence_id"],
                "offset": found["offset"],
            }
        )

    out = parts.groupBy("run").applyInArrow(
        pack,
        f"doc_id {kind}, queue string, start long, length long, ids binary, "
        "doc_tokens long, sequence_id long, offset long",
    )
    return out.select(
        "doc_id", source_of("queue").alias("source"), "start", "length", "ids", "doc_tokens", "sequence_id", "offset"
    )


def source_of(queue: str) -> Column:
    return F.expr(f"if({queue} = '-', NULL, substr({queue}, 2))")
