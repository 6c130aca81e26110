"""Mixing sources to target weights by blocks of words.

Each source is a stream of its documents' words, packed into blocks of fixed length. The
output is a sequence of slots, cut into shards. Every slot draws a source by the sources'
shares of all slots, so a shard's counts are a multinomial draw; a source's slots are
numbered from these counts. Over all shards a source may be drawn a little too often or too
seldom (about the root of its slots); so many of its slots, found by a permutation over all
shards, go to the sources that lack them. A source's numbers run through its blocks in
a pseudorandom order, epoch by epoch, and blocks are joined to slots by index. The last
slot of a source is cut short, so that a source gives exactly its rounded target.

Permutations are swap-or-not networks: in each round an index and its mirror image swap
if a hash bit of the pair says so. They work for any length, need no table, and a slot is
computed alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from threadlens.llm.common import WORD, pick
from threadlens.llm.secrets import quoted
from threadlens.operators.running import running_total
from threadlens.sources.shared import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
ROUNDS = 12
BUCKET_DIGITS = 3
LEAST_BUCKETS = 64


def document_sizes(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size, mark): words of each text, 0 for null, and its place in its source's stream.

    The mark is the MD5 of the id, or of the text where there is no id, so that such rows are spread.
    """
    size = F.expr(f"CAST(regexp_count(coalesce(text, ''), {quoted(WORD)}) AS bigint)")
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    rows = pick(documents, "doc_id", "source", "text")
    return rows.select("doc_id", "source", size.alias("size"), F.md5(named.cast("binary")).alias("mark"))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS
) -> DataFrame:
    """(source, place, source_size, target): one row per source.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all
    words. A source's target stops at `most` times its size and the excess is shared
    anew by weight: targets are least(cap, level * weight), and the level that uses all
    up is the highest of the levels that follow from the sources in order of cap over
    weight. Places and sums over sources are running totals, as sources may be many.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    sums = sums.withColumns({"unnamed": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    placed = running_total(sums, ["unnamed", "source"], "one", "place")
    turn = F.array(*map(F.lit, weights))
    placed = placed.withColumn("weight", F.get(turn, F.pmod("place", F.lit(len(weights)))).cast("long"))
    placed = placed.withColumn("cap", (F.col("source_size") * most).cast("double"))
    placed = placed.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = ["ratio", "place"]
    ordered = running_total(running_total(placed, order, "cap", "cap_before"), order, "weight", "weight_before")
    whole = ordered.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(whole["words"] or 0)) * share - F.col("cap_before")) / (F.lit(whole["weight"] or 0) - F.col("weight_before"))
    highest = ordered.agg(F.max(level).alias("level")).first()["level"]
    target = F.least("cap", F.lit(highest or 0.0) * F.col("weight"))
    return ordered.select("source", "place", "source_size", target.alias("target"))


def permuted(index: str, length: str, key: str) -> Column:
    """The place of an index in a pseudorandom permutation of 0 .. length - 1."""
    mirror = f"pmod(r * 2654435761L + {length} - p, {length})"
    bit = f"substr(md5(concat_ws('/', {key}, r, greatest(p, {mirror}))), 1, 1) < '8'"
    return F.expr(f"aggregate(sequence(1L, {ROUNDS}L), {index}, (p, r) -> if({bit}, {mirror}, p))")


def keyed(rows: DataFrame) -> DataFrame:
    """A text key for a source, since a null one does not join."""
    return rows.withColumn("key", F.concat(F.when(F.col("source").isNull(), "null").otherwise("="), F.coalesce("source", F.lit(""))))


def placed_documents(sizes: DataFrame, digits: int = BUCKET_DIGITS) -> DataFrame:
    """sizes with `key` and `start`, a document's first word in its source's stream.

    Streams are ordered by the documents' marks. Sums of buckets of that hash come first, so no
    task ever orders a whole source; raise `digits` with the number of documents.
    """
    rows = keyed(sizes).withColumn("bucket", F.substring("mark", 1, digits))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("own"))
    earlier = W.partitionBy("key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("key", "bucket", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"))
    inside = W.partitionBy("key", "bucket").orderBy("mark", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return rows.join(bases, ["key", "bucket"]).select(
        "doc_id", "source", "size", "key", (F.col("base") + F.col("inside")).alias("start")
    )


def by_range(points: DataFrame, point: str, ranges: DataFrame, low: str, length: str, total: int) -> DataFrame:
    """`points` with the columns of the range that each falls in; ranges cover 0 .. total - 1 without overlap.

    Points and ranges meet by buckets of equal width, twice as many as ranges at least.
    """
    width = max(1, total // max(LEAST_BUCKETS, 2 * ranges.count()))
    covered = F.sequence(F.expr(f"{low} div {width}"), F.expr(f"({low} + {length} - 1) div {width}"))
    guide = ranges.where(F.col(length) > 0).withColumn("bucket", F.explode(covered))
    met = points.withColumn("bucket", F.expr(f"{point} div {width}")).join(guide, "bucket").drop("bucket")
    return met.where(f"{point} >= {low} AND {point} < {low} + {length}")


def seats(plan: DataFrame, total: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(slot, shard, place): every slot with the source it draws, by shares of `n_slots`."""
    # A number is named, or these few bytes a slot would be made in too few tasks.
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = plan.sparkSession.range(0, total, 1, tasks).withColumnRenamed("id", "slot")
    every = every.withColumn("point", F.expr(f"pmod(xxhash64('draw', slot), {max(1, total)}L)"))
    drawn = by_range(every, "point", plan.select("place", "first", "n_slots"), "first", "n_slots", total)
    return drawn.select("slot", F.expr(f"slot div {shard_slots}").alias("shard"), "place")


def draws(seat_rows: DataFrame) -> DataFrame:
    """(shard, place, n): how many slots of each shard drew a source, a multinomial draw by shard."""
    return seat_rows.groupBy("shard", "place").agg(F.count(F.lit(1)).alias("n"))


def numbered(plan: DataFrame, total: int, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(slot, shard, place, j): each slot with its source and its number 0 .. n_slots - 1 there."""
    seat_rows = materialise(seats(plan, total, shard_slots), "mix-seats")
    counts = running_total(draws(seat_rows), ["place", "shard"], "n", "before")
    got = counts.groupBy("place").agg(F.sum("n").alias("drawn"), F.min("before").alias("begun"))
    held = plan.select("place", "n_slots").join(got, "place", "left").fillna(0, ["drawn", "begun"])
    held = held.withColumn("over", F.expr("greatest(drawn - n_slots, 0L)"))
    held = held.withColumn("lack", F.expr("greatest(n_slots - drawn, 0L)"))
    held = running_total(running_total(held, "place", "over", "over_first"), "place", "lack", "lack_first")
    held = materialise(held, "mix-held")
    spare = held.agg(F.sum("lack").alias("n")).first()["n"] or 0
    # A shard's slots of one source, at most as many as the shard has, follow those of earlier shards.
    inside = F.row_number().over(W.partitionBy("shard", "place").orderBy("slot")) - 1
    rows = seat_rows.withColumn("inside", inside).join(counts.select("shard", "place", "before"), ["shard", "place"])
    rows = rows.join(held, "place").withColumn("i", F.expr("before - begun + inside"))
    rows = rows.withColumn("j", permuted("i", "drawn", "concat_ws('/', 'draw', place)"))
    rows = materialise(rows.select("slot", "shard", "place", "j", "n_slots", "over_first"), "mix-drawn")
    kept = rows.where("j < n_slots").select("slot", "shard", "place", "j")
    if not spare:
        return kept
    moved = rows.where("j >= n_slots").withColumn("s", F.expr("over_first + j - n_slots"))
    moved = moved.withColumn("point", permuted("s", f"{spare}L", "'spare'")).select("slot", "shard", "point")
    lacking = held.select("place", "drawn", "lack", "lack_first")
    moved = by_range(moved, "point", lacking, "lack_first", "lack", spare)
    return kept.unionByName(moved.select("slot", "shard", "place", F.expr("drawn + point - lack_first").alias("j")))


def slots(targets: DataFrame, block: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(key, block_index, epoch, slot, shard, used): one row per slot of the output.

    `used` is how many words of its block a slot takes: all, but for a source's last.
    """
    # Filters may run after the divisions below, hence the lower bounds of one.
    plan = keyed(targets).where((F.col("source_size") > 0) & (F.col("target") > 0)).select(
        "key",
        "place",
        "source_size",
        F.expr(f"greatest(1L, CAST(ceil(source_size / {block}) AS bigint))").alias("blocks"),
        F.expr("CAST(floor(target + 0.5D) AS bigint)").alias("wanted"),
    )
    plan = plan.withColumn("full", F.expr("wanted div greatest(source_size, 1L)"))
    plan = plan.withColumn("rest", F.expr("wanted - full * source_size"))
    # Where the short last block falls in the epoch that is cut off.
    plan = plan.withColumn("short_at", inverse_place("blocks - 1", "blocks", "concat_ws('/', 'block', place, full)"))
    plan = plan.withColumn("short", F.expr(f"{block} * blocks - source_size"))
    # Slots of the last epoch start at j * block, less what the short block lacks.
    plan = plan.withColumn(
        "extra",
        F.expr(
            f"CASE WHEN rest = 0 THEN 0L WHEN rest <= short_at * {block} THEN bigint(ceil(rest / {block})) "
            f"ELSE greatest(short_at + 1, bigint(ceil((rest + short) / {block}))) END"
        ),
    )
    plan = plan.withColumn("n_slots", F.expr("full * blocks + extra")).where("n_slots > 0")
    plan = materialise(running_total(plan, "place", "n_slots", "first"), "mix-plan")
    total = plan.agg(F.sum("n_slots").alias("n")).first()["n"] or 0
    given = numbered(plan, total, shard_slots).join(plan, "place")
    epochs = given.withColumn("epoch", F.expr("j div blocks")).withColumn("i", F.expr("j % blocks"))
    drawn = epochs.withColumn("block_index", permuted("i", "blocks", "concat_ws('/', 'block', place, epoch)"))
    begun = f"i * {block} - if(i > short_at, short, 0L)"
    used = F.expr(f"CASE WHEN epoch < full THEN {block}L ELSE least({block}L, rest - ({begun})) END")
    return drawn.select("key", "block_index", "epoch", "slot", "shard", used.alias("used"))


def inverse_place(value: str, length: str, key: str) -> Column:
    """The index that `permuted` sends to a value: the same swaps, last round first."""
    mirror = f"pmod(r * 2654435761L + {length} - p, {length})"
    bit = f"substr(md5(concat_ws('/', {key}, r, greatest(p, {mirror}))), 1, 1) < '8'"
    return F.expr(f"aggregate(sequence({ROUNDS}L, 1L, -1L), {value}, (p, r) -> if({bit}, {mirror}, p))")


def packed(placed: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """A row per document and block it has words in: block_index, its place there, words."""
    blocks = F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")
    pieces = placed.where("size > 0").withColumn("block_index", F.explode(blocks))
    low = F.expr(f"greatest(start, block_index * {block})")
    high = F.expr(f"least(start + size, (block_index + 1) * {block})")
    return pieces.select(
        "doc_id", "source", "key", "size", "start", "block_index",
        (low - F.col("block_index") * block).alias("place"),
        (high - low).alias("words"),
        (low - F.col("start")).alias("first_word"),
    )


def mix(pieces: DataFrame, slot_rows: DataFrame) -> DataFrame:
    """The mix as spans of documents: (shard, slot, place, doc_id, source, first_word, words, key, start, size).

    A slot's spans in order of `place`, their first word in it, are its words. `start` and
    `size` tell rows that repeat an id apart.
    """
    taken = F.expr("least(place + words, used) - place")
    # Slots grow with the data, which the planner cannot see behind the sequences.
    joined = pieces.join(slot_rows.hint("merge"), ["key", "block_index"]).withColumn("words", taken).where("words > 0")
    return joined.select("shard", "slot", "place", "doc_id", "source", "first_word", "words", "key", "start", "size")


def written_mix(placed: DataFrame, targets: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix, written in order: files hold ranges of slots, each sorted by slot and place."""
    spans = materialise(mix(packed(placed, block), slots(targets, block)), "mix-spans")
    return materialise(spans.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place"), "mix")


def source_mix(documents: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(shard, slot, place, doc_id, source, first_word, words, key, start, size): the mix of (doc_id, source, text).

    Words first_word .. first_word + words - 1 of a document stand in a shard's slot from
    `place` on. Reruns give the same rows.
    """
    sizes = materialise(document_sizes(documents), "mix-sizes")
    return written_mix(placed_documents(sizes), source_targets(sizes), block)


def mixed_documents(documents: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document row.

    `taken` sums a document's words in the mix, which is made first, repeats included; as a
    block is used at most twice, it is at most twice the size. Documents without words, null
    texts among them, have size and taken 0. Of rows that repeat an id within a
    source each has a stretch of the stream of its own. Reruns give the same rows.
    """
    sizes = materialise(document_sizes(documents), "mix-sizes")
    targets = materialise(source_targets(sizes), "mix-targets")
    placed = materialise(placed_documents(sizes), "mix-placed")
    taken = written_mix(placed, targets, block).groupBy("key", "start").agg(F.sum("words").alias("taken"))
    # A start is one document's, but for documents without words.
    rows = placed.where("size > 0").join(taken, ["key", "start"], "left")
    rows = rows.select("key", "doc_id", "size", F.coalesce("taken", F.lit(0)).alias("taken"))
    empty = keyed(sizes.where("size = 0")).select("key", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return rows.unionByName(empty).join(keyed(targets), "key").select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )
