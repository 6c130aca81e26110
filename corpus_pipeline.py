"""A pipeline over `documents`: five stages, each by one operator of the llm subpackage.

Every stage but the last returns the columns it was given. A stage works on all rows the
one before it kept, and its decisions take effect: rows go, or texts are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import decontaminate, langid, mixing, secrets, simhash
from threadlens.llm.common import pick, table
from threadlens.sources.shared import materialise

#: Language identification rejects texts of no known language and very unsure ones.
LEAST_SCORE = 0.2


def wrapped(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): all other columns in a struct, by place, whatever their names."""
    places = [f"_{i}" for i in range(len(docs.columns))]
    text = places[docs.columns.index("text")]
    by_place = docs.toDF(*places)
    return by_place.select(
        F.col(places[docs.columns.index("doc_id")]).alias("doc_id"),
        F.col(text).alias("text"),
        F.struct(*[p for p in places if p != text]).alias("row"),
    )


def unwrapped(rows: DataFrame, docs: DataFrame, changed: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `docs` again, some of them changed."""
    values = []
    for place, name in enumerate(docs.columns):
        value = F.col("text") if name == "text" else F.col(f"row._{place}")
        values.append((changed or {}).get(name, value).alias(f"_{place}"))
    return rows.select(*values).toDF(*docs.columns)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter or of no language the model is sure of at all."""
    labelled = pick(docs, "doc_id", "text", "lang")
    model = langid.learn(labelled.where(~langid.held_out(F.col("doc_id"), 4, 2)).select("text", "lang"))
    found = langid.identify(wrapped(docs), model, keep=("row",))
    known = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)
    return unwrapped(found.where(known), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component."""
    return unwrapped(simhash.survivors(wrapped(docs)), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents contaminated by the benchmark."""
    found = decontaminate.find_contamination(wrapped(docs), table(spark, sf_dir, "benchmark"), keep=("row",))
    return unwrapped(found.where(~F.col("contaminated")), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in texts; n_chars, where it is a column, follows the new text."""
    found = secrets.find_secrets(wrapped(docs), keep=("row",)).withColumn("text", secrets.masked("text", "spans"))
    return unwrapped(found, docs, {"n_chars": F.length("text").cast("long")})


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How much of each document a mix to the target weights takes."""
    return mixing.mixed_documents(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", identify_languages),
    ("simhash_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
]

#: Learned language identification and XXH64 fingerprints have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
