"""Secrets in texts: rules, a trigram index that narrows them, spans, and masking.

The index is inverted: a posting list for each trigram the rules ask for, cut into shards by
the documents' keys. A rule's Boolean trigram query intersects and unites posting lists, and
its expression runs only on the candidates that are left; a rule without mandatory trigrams
runs on all. Everything is built-in SQL functions. The longer expressions are SQL text, since
one parse is far cheaper than building them call by call.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import pick, sha256_hex
from threadlens.llm.trigrams import ANY, Query, grams_in, query_of
from threadlens.sources.shared import materialise

BLOCK = 256
SHARD_ROWS = 5000  # rows of a shard of the index, and so the longest posting list


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches; those whose group is shorter than `least` fall away."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: A run too short for `access` or `hex` holds no match that is long enough, so a lower
#: bound inside the expression is the same as dropping short matches afterwards. For
#: `assign` it is not: a short match uses up text that another match could start in.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("hosting", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("signed", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES

SPANS = "array<struct<start:bigint,rank:int,kind:string,end:bigint>>"


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values) -> str:
    return f"array({', '.join(map(quoted, values))})"


def let(name: str, value: str, body: str) -> str:
    """Evaluate a value once per row and use it by name in a body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def running(values: str, join: Callable[[str, str], str]) -> str:
    """Running fold of an array of longs of any length, each place including itself.

    Appending to an array copies it, so the fold goes by blocks and then over the
    blocks' last places: the work per place is bounded by the block.
    """

    def fold(array: str) -> str:
        step = f"if(size(acc) = 0, x, {join('element_at(acc, -1)', 'x')})"
        return f"aggregate({array}, cast(array() AS array<bigint>), (acc, x) -> concat(acc, array({step})))"

    blocks = f"transform(sequence(0, size(vals) - 1, {BLOCK}), b -> {fold(f'slice(vals, b + 1, {BLOCK})')})"
    before = fold("transform(parts, part -> element_at(part, -1))")
    shifted = (
        "flatten(transform(parts, (part, k) -> if(k = 0, part, "
        f"transform(part, y -> {join('get(before, k - 1)', 'y')}))))"
    )
    whole = let("parts", blocks, let("before", before, shifted))
    return let("vals", values, f"if(size(vals) = 0, vals, {whole})")


def candidates_of(query: Query, lists: str) -> str:
    """Evaluate a trigram query on a shard's posting lists, a map from trigrams to keys."""
    if isinstance(query, str):
        return f"coalesce(try_element_at({lists}, {quoted(query)}), cast(array() AS array<bigint>))"
    kind, parts = query
    merge = "array_intersect" if kind == "and" else "array_union"
    out = candidates_of(parts[0], lists)
    for part in parts[1:]:
        out = f"{merge}({out}, {candidates_of(part, lists)})"
    return out


def keyed(rows: DataFrame) -> DataFrame:
    """`rows` with `_key`, a hash of id and text, so that copies under other ids are told apart.

    Rows that share a key share their candidate rules. Were different rows to share one, a
    rule would run once too often: an expression decides in any case.
    """
    return rows.withColumn("_key", F.xxhash64("doc_id", "text"))


def trigram_index(documents: DataFrame, grams: list[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(shard, gram, keys): the posting lists of some trigrams over (doc_id, text), in shards.

    Shards are dealt by key and follow the row count, so a list has about `shard_rows` keys at
    most; equal rows count once.
    """
    shards = max(1, -(-documents.count() // shard_rows))
    rows = keyed(pick(documents, "doc_id", "text")).where("text IS NOT NULL")
    # Bound by name, or the optimiser would lower the text once per trigram.
    held = F.expr(let("lowered", "lower(text)", f"filter({strings(grams)}, g -> contains(lowered, g))"))
    postings = rows.select("_key", F.explode(held).alias("gram"))
    shard = F.pmod("_key", F.lit(shards)).alias("shard")
    return postings.groupBy(shard, "gram").agg(F.collect_set("_key").alias("keys"))


def candidates(index: DataFrame, queries: list[Query]) -> DataFrame:
    """(_key, _ranks): the places of the queries that a row's trigrams pass; rows that pass none are left out."""
    lists = F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists")
    passed = [
        f"transform({candidates_of(query, 'lists')}, k -> named_struct('k', k, 'rank', {rank}))"
        for rank, query in enumerate(queries)
        if query != ANY
    ]
    met = index.groupBy("shard").agg(lists).select(F.explode(F.expr(f"concat({', '.join(passed)})")).alias("c"))
    return met.groupBy(F.col("c.k").alias("_key")).agg(F.collect_set("c.rank").alias("_ranks"))


def rule_spans(text: str, rule: Rule, rank: int) -> str:
    """Spans of one rule in code points, in order."""
    pattern = quoted(rule.pattern)

    def lengths(parts: str) -> str:
        return f"transform({parts}, piece -> cast(length(piece) AS bigint))"

    judged = lengths(f"regexp_extract_all({text}, {pattern}, {rule.group})") if rule.group else "sizes"
    gaps = lengths(f"split({text}, {pattern}, -1)")
    ends = running(f"zip_with({gaps}, sizes, (gap, n) -> gap + coalesce(n, 0L))", lambda a, b: f"({a} + {b})")
    span = (
        f"named_struct('start', get(ends, m) - n, 'rank', {rank}, 'kind', {quoted(rule.kind)}, 'end', get(ends, m))"
    )
    kept = f"filter(transform(sizes, (n, m) -> if(get(judged, m) >= {rule.least}, {span}, NULL)), s -> s IS NOT NULL)"
    found = let("sizes", lengths(f"regexp_extract_all({text}, {pattern}, 0)"), let("ends", ends, let("judged", judged, kept)))
    return f"IF(regexp_like({text}, {pattern}), {found}, array())"


def find_secrets(
    documents: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, text, spans) per document row, spans by start, then in the rules' order.

    Columns named in `keep` are carried along.

    A span is (start, rank, kind, end): code points, end exclusive, rank the rule's
    place. Null and empty texts have no spans. Rules are independent, so spans of
    different rules may overlap. Repeated rows each give a row.
    """
    queries = [query_of(rule.pattern) for rule in rules]
    grams = list(dict.fromkeys(g for q in queries for g in grams_in(q)))
    rows = keyed(pick(documents, "doc_id", "text", *keep)).withColumn("body", F.expr("coalesce(text, '')"))
    if grams:
        # Written, so that a join by broadcast is chosen by a known size only.
        index = materialise(trigram_index(documents, grams), "secrets-index")
        rows = rows.join(materialise(candidates(index, queries), "secrets-candidates"), "_key", "left")
    found = rows.withColumns(
        {
            f"s{rank}": F.expr(
                f"CAST(IF({'true' if query == ANY else f'array_contains(_ranks, {rank})'}, "
                f"{rule_spans('body', rule, rank)}, array()) AS {SPANS})"
            )
            for rank, (rule, query) in enumerate(zip(rules, queries))
        }
    )
    spans = F.sort_array(F.concat(*[F.col(f"s{rank}") for rank in range(len(rules))]))
    return found.select("doc_id", "text", *keep, spans.alias("spans"))


def spelled(spans: str) -> str:
    """kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, s -> concat_ws(':', s.kind, string(s.start), string(s.end))), ',')"


def masked(text: str, spans: str, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced by one mask; null stays null.

    `spans` must be in order of start. A span that starts inside an earlier one, or
    where it ends, lengthens that mask.
    """
    before = "if(m = 0, 0L, get(reach, m - 1))"
    cut = f"substring({text}, int({before} + 1), int(greatest(s.start - {before}, 0)))"
    piece = f"if(m > 0 AND s.start <= {before}, '', concat({cut}, {quoted(mask)}))"
    rest = f"substring({text}, int(element_at(reach, -1) + 1), length({text}))"
    reach = running(f"transform({spans}, s -> s.end)", lambda a, b: f"greatest({a}, {b})")
    rebuilt = f"concat(array_join(transform({spans}, (s, m) -> {piece}), ''), {rest})"
    return F.expr(f"IF(size({spans}) = 0, {text}, {let('reach', reach, rebuilt)})")


def count_of(spans: str, kind: str) -> Column:
    return F.expr(f"CAST(size(filter({spans}, s -> s.kind = {quoted(kind)})) AS bigint)")


def base_digest(spans: str) -> Column:
    return sha256_hex(F.expr(spelled(f"filter({spans}, s -> s.rank < {len(BASE_RULES)})")))
