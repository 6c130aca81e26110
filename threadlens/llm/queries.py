"""Registered queries of this subpackage with SQL counterparts where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import chat, decontaminate, langid, lexical, mixing, packing, quality, secrets, simhash, spelling, substrings, token_counts, toxicity
from threadlens.llm.common import pick, sha256_hex, table
from threadlens.llm.oracles import ORACLE  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(fn):
        QUERIES[name] = fn
        return fn

    return register


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.read_vocabulary())


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = decontaminate.items_digest(F.col("item_ids")).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    out = langid.held_out(F.col("doc_id"), 4, 2)
    model = langid.learn(documents.where(~out).select("text", "lang"))
    return langid.identify(documents, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@query("op5_secret_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[secrets.count_of("spans", rule.kind).alias(f"n_{rule.kind}") for rule in secrets.BASE_RULES],
        secrets.base_digest("spans").alias("base_sha256"),
        F.expr(secrets.spelled("spans")).alias("spans"),
    )


@query("op6_chat_format")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{control}'), (-7L, 1L, 'assistant', '{control}') AS t(conv_id, turn, role, text)"
    )
    messages = rows.unionByName(more).withColumn("parts", chat.text_parts(F.col("text")))
    read = chat.format_chats(messages).select(
        "conv_id",
        chat.read_turns().alias("turns"),
        chat.read_loss().alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    told = F.expr("array_join(transform(turns, t -> concat(t.role, '\n', t.text, '\n')), '')")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        sha256_hex(told).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256_hex(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


def mixed_parts() -> str:
    """Parts of every kind from a row of conversations; some have no kind, some a caption."""
    part = "named_struct('kind', {}, 'text', {}, 'ref', {}, 'width', {}, 'height', {}, 'seconds', {}, 'pages', {})".format
    name = "concat(conv_id, '-', turn)"
    parts = [
        part("'text'", "substr(text, 1, 5)", *["NULL"] * 5),
        part("'image'", "if(turn % 2 = 0, role, NULL)", name, "int(300 * turn)", "700", "NULL", "NULL"),
        part("NULL", "substr(text, 6)", *["NULL"] * 5),
        part("if(turn % 3 = 0, 'audio', 'document')", "NULL", name, "NULL", "NULL", "1.5D * turn", "int(turn)"),
    ]
    return f"CAST(array({', '.join(parts)}) AS array<{chat.PART}>)"


@query("op6_chat_parts")
def op6_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixed parts of all conversations, read back part by part with their references."""
    rows = pick(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    chats = chat.format_chats(rows.withColumn("parts", F.expr(mixed_parts()))).withColumn("turns", chat.read_turns())
    refs = "map_from_entries(transform(attachments, a -> struct(concat(a.turn, '.', a.part), a.ref)))"
    part = "concat(p.kind, '|', p.text, '|', coalesce(try_element_at(refs, concat(k, '.', p.part)), '-'), '\n')"
    told = f"array_join(flatten(transform(turns, (t, k) -> concat(array(concat(t.role, '\n')), transform(t.parts, p -> {part})))), '')"
    return chats.withColumn("refs", F.expr(refs)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.size("attachments").cast("long").alias("n_attachments"),
        "expanded_tokens",
        sha256_hex(F.expr(told)).alias("parts_sha256"),
        sha256_hex(chat.read_loss()).alias("loss_sha256"),
    )


@query("op7_source_mix")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


@query("op9_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.POLICIES["default-1"]).alias("kept"),
        "failed",
    )


@query("op9_quality_ablations")
def op9_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents")), quality.POLICIES["default-1"])


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    labels = pick(table(spark, sf_dir, "labels"), "doc_id", "toxic")
    out = langid.held_out(F.col("doc_id"), 5, 0)
    scored = toxicity.score(documents, toxicity.learn(documents.where(~out), labels))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")


@query("op11_mixture_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(table(spark, sf_dir, "documents"), packing.vocabulary_path())
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


@query("op13_lexical_search")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_spelling_variants")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")
