"""Near-duplicate documents by SimHash fingerprints and a binary trie self-join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import in_pieces, pick, raw_texts
from threadlens.llm.components import components
from threadlens.sources.shared import materialise

SHINGLE = 3
SEED = 42
BUDGET = 3
PARTS = BUDGET + 1
ROWS_PER_SHARD = 100_000
GROUP_LIMIT = 50_000
FRONTIER = 300_000
HASHES_AT_ONCE = 65_536
PIECE_BYTES = 4_000_000


def shingle_hashes(text: bytes | None) -> list[int]:
    """XXH64 of the 3-word shingles, repeats included; of fewer words, of all of them."""
    words = text.lower().split() if text else []
    if not words:
        return []
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=0))
    digest = xxhash.xxh64_intdigest
    if len(words) <= SHINGLE:
        return [digest(joined, SEED)]
    return [digest(joined[a : b - 1], SEED) for a, b in zip(ends, ends[SHINGLE:])]


def fingerprint(hashes: list[int]) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without hashes."""
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), HASHES_AT_ONCE):
        part = np.array(hashes[start : start + HASHES_AT_ONCE], dtype=">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) for every row of (doc_id, text), and columns to keep; fp holds the 64 bits as a long.

    Letters A-Z count as a-z. Null, empty and blank texts have fingerprint 0.
    """
    rows = pick(documents, "doc_id", "text", *keep)
    carried = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in ("doc_id", *keep))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, "text", PIECE_BYTES):
            prints = [fingerprint(shingle_hashes(text)) for text in raw_texts(batch.column("text"))]
            signed = pa.array(np.array(prints, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", *keep)), signed], ["doc_id", *keep, "fp"])

    return rows.mapInArrow(take, f"{carried}, fp long")


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def finer(mask: int) -> list[int]:
    """Masks that add to `mask` one of four parts of the bits it leaves open."""
    open_bits = [i for i in range(64) if not mask >> i & 1]
    bounds = [round(k * len(open_bits) / PARTS) for k in range(PARTS + 1)]
    return [mask | sum(1 << i for i in open_bits[a:b]) for a, b in zip(bounds, bounds[1:])]


def dealt(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(fp, mask, value): rows that share mask and value are compared with each other.

    Of two prints that differ in at most three bits, at least one of four parts is
    equal, so each print joins four groups, one per part. A group over the limit is dealt
    again by four parts of its open bits, where the same holds; no pair is lost, and a
    group is never cut.
    """
    spark = prints.sparkSession
    masks = finer(0)
    rows = prints.select("fp", F.explode(F.array(*[F.lit(signed(m)).cast("long") for m in masks])).alias("mask"))
    done = None
    for _ in range(3):
        rows = rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = rows.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_limit)
        hot = materialise(sizes.drop("n"), "simhash-hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        settled = rows.join(hot, ["mask", "value"], "left_anti").select("fp", "mask", "value")
        done = settled if done is None else done.unionByName(settled)
        steps = spark.createDataFrame([(signed(m), [signed(f) for f in finer(m)]) for m in masks], "mask long, finer array<long>")
        again = rows.join(hot, ["mask", "value"], "left_semi").join(F.broadcast(steps), "mask")
        rows = again.select("fp", F.explode("finer").alias("mask"))
        masks = [f for m in masks for f in finer(m)]
    return done.unionByName(rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))))


def settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the label pairs (a, b); a label is its set's least place."""
    parent = np.arange(len(labels))
    a, b = labels[a], labels[b]
    while True:
        apart = a != b
        if not apart.any():
            return parent[labels]
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = parent[parent]
            if (further == parent).all():
                break
            parent = further
        a, b = parent[a], parent[b]


class Trie:
    """Sorted prints as an implicit binary trie: a node is a range and a depth."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.zeros: dict[int, np.ndarray] = {}

    def middle(self, depth: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where a node's second child starts."""
        counts = self.zeros.get(depth)
        if counts is None:
            zero = (self.prints >> np.uint64(63 - depth) & np.uint64(1)) == 0
            counts = self.zeros[depth] = np.concatenate([[0], np.cumsum(zero)]).astype(np.int32)
        return low + counts[high] - counts[low]


def linked_places(prints: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int = BUDGET) -> np.ndarray:
    """For each print the least place it reaches by links inside the given ranges.

    Node pairs are walked together, depth by depth; the differing bits of a pair's
    prefixes are its errors, and a pair over the budget goes. So does a pair whose
    prints are already known to be in one set, since links are only wanted up to that.
    """
    trie = Trie(prints)
    labels = np.arange(len(prints))
    big = ends - starts > 1
    first = np.stack([starts[big], ends[big], starts[big], ends[big], np.zeros(big.sum(), np.int64)])
    stack = [(0, first)]
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            half = pairs.shape[1] // 2
            stack += [(depth, pairs[:, half:]), (depth, pairs[:, :half])]
            continue
        if depth == 64 or not pairs.shape[1]:
            continue
        l1, h1, l2, h2, errors = pairs
        m1, m2 = trie.middle(depth, l1, h1), trie.middle(depth, l2, h2)
        own = l1 == l2
        cross = ~own
        pairs = np.concatenate(
            [
                np.stack([l1, m1, l2, m2, errors]),
                np.stack([m1, h1, m2, h2, errors]),
                np.stack([l1, m1, m2, h2, errors + 1]),
                np.stack([m1[cross], h1[cross], l2[cross], m2[cross], errors[cross] + 1]),
            ],
            axis=1,
        )
        l1, h1, l2, h2, errors = pairs
        same = l1 == l2
        keep = (h1 > l1) & (h2 > l2) & (errors <= budget) & (~same | (h1 - l1 > 1))
        pairs = pairs[:, keep]
        l1, h1, l2, h2, errors = pairs
        single = (h1 - l1 == 1) & (h2 - l2 == 1)
        if single.any():
            a, b = l1[single], l2[single]
            close = np.bitwise_count(prints[a] ^ prints[b]) <= budget
            labels = settle(labels, a[close], b[close])
            pairs = pairs[:, ~single]
            l1, h1, l2, h2, errors = pairs
        if pairs.shape[1]:
            changes = np.concatenate([[0], np.cumsum(labels[1:] != labels[:-1])])
            joined = (changes[h1 - 1] == changes[l1]) & (changes[h2 - 1] == changes[l2]) & (labels[l1] == labels[l2])
            pairs = pairs[:, ~joined]
        stack.append((depth + 1, pairs))
    return labels


def links(prints: DataFrame, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Edges (a, b) between distinct prints (fp) that connect all that link.

    Of the links inside a shard only as many are returned as connect its sets, at
    most one per print, so a dense group never yields all of its pairs.
    """
    rows = dealt(prints, group_limit)
    shards = max(1, -(-prints.count() * PARTS // ROWS_PER_SHARD))
    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("mask", "value"), F.lit(shards)))

    def join(shard: pa.Table) -> pa.Table:
        fp = shard.column("fp").to_numpy()
        mask = shard.column("mask").to_numpy()
        value = shard.column("value").to_numpy()
        order = np.lexsort((fp.view(np.uint64), value, mask))
        fp, mask, value = fp[order].view(np.uint64), mask[order], value[order]
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        labels = linked_places(fp, np.concatenate([[0], new]), np.concatenate([new, [len(fp)]]))
        moved = np.flatnonzero(labels != np.arange(len(fp)))
        return pa.table({"a": fp[moved].view(np.int64), "b": fp[labels[moved]].view(np.int64)})

    return sharded.groupBy("shard").applyInArrow(join, "a long, b long")


def near_duplicates(
    documents: DataFrame, group_limit: int = GROUP_LIMIT, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row of (doc_id, text), and columns to keep.

    root is one print of the component, component_id its smallest doc_id.

    Prints link at three or fewer differing bits, and components are over all links;
    component_id is the smallest doc_id in the component. Rows with equal texts, repeated
    rows among them, share a print and so a component. Null ids are never the
    smallest unless a component has no other; then component_id is null. An empty table
    gives an empty result.
    """
    rows = materialise(fingerprints(documents, keep), "simhash-prints")
    prints = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(prints.select("fp"), group_limit), "simhash-components")
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = placed.join(named, "root").select("fp", "root", "component_id")
    return rows.join(by_print, "fp").select("doc_id", *keep, "fp", "root", "component_id")


def survivors(rows: DataFrame) -> DataFrame:
    """One row of each component, with all of its columns, from rows of doc_id, text and others.

    It is the row with the smallest id, nulls last, and of rows that share the id the first by
    the MD5 of all columns, so neither the order of rows nor a task that runs again matters.
    Rows equal in every column are one row here.
    """
    marked = rows.withColumn("mark", F.md5(F.to_json(F.struct(*rows.columns)).cast("binary")))
    found = near_duplicates(marked.select("doc_id", "text", "mark"), keep=("mark",))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("mark"))).alias("first")
    chosen = found.groupBy("root").agg(first).select(F.col("first.mark").alias("mark"))
    return marked.join(chosen, "mark").dropDuplicates(["mark"]).drop("mark")


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
