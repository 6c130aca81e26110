"""Snapshots of analysed tickets: Parquet partitioned by run stamp, and CSV export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadlens.functions.labels import nullify_na
from threadlens.operators.running import running_total
from threadlens.schemas import ANALYSIS, csv_headings
from threadlens.sources.shared import materialise

STAMP = "snapshot_ts"
RUNS = T.StructType([T.StructField("stamp", T.StringType()), T.StructField("state", T.StringType())])
FILE_BYTES = 64 << 20
# Quotes are doubled, line breaks kept inside quotes and blanks left alone, so any
# text survives. An empty text is written as "" and null as nothing.
_CSV = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def _runs_path(path: str) -> str:
    # Folders that begin with an underscore are no data to a reader of ``path``.
    return f"{path}/_runs"


def _note(spark: SparkSession, path: str, stamp: str, state: str) -> None:
    row = spark.range(1).select(F.lit(stamp).alias("stamp"), F.lit(state).alias("state"))
    row.write.mode("overwrite").json(f"{_runs_path(path)}/run={stamp}")


def write_snapshot(analysed: DataFrame, path: str, stamp: str) -> None:
    """Write one run. Writing the same stamp again replaces it.

    The manifest has one small file per run and says that a run is done only after its
    data are written, so a half-written run is never taken for the newest.
    """
    spark = analysed.sparkSession
    _note(spark, path, stamp, "started")
    analysed.write.mode("overwrite").parquet(f"{path}/{STAMP}={stamp}")
    _note(spark, path, stamp, "done")


def finished_runs(spark: SparkSession, path: str) -> DataFrame:
    """(stamp) of the runs the manifest calls done; empty if there is no manifest."""
    runs = _or_empty(spark, RUNS, lambda r: r.json(_runs_path(path)))
    return runs.where(F.col("state") == "done").select("stamp")


def _or_empty(spark: SparkSession, schema: T.StructType, load) -> DataFrame:
    try:
        return load(spark.read.schema(schema))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_snapshot(spark: SparkSession, path: str, stamp: str) -> DataFrame:
    """One run, from its own folder; no row if it does not exist."""
    return _or_empty(spark, ANALYSIS, lambda r: r.parquet(f"{path}/{STAMP}={stamp}"))


def read_latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest finished run. Its stamp comes from the manifest, so no other run's files are
    listed or read; no row if there is none."""
    newest = finished_runs(spark, path).agg(F.max("stamp")).first()[0]
    return spark.createDataFrame([], ANALYSIS) if newest is None else read_snapshot(spark, path, newest)


def has_rows(df: DataFrame) -> bool:
    """False for a missing or empty run, which is a message, not a report."""
    return not df.isEmpty()


def write_csv(
    analysed: DataFrame, path: str, headings: dict[str, str] | None = None, file_bytes: int = FILE_BYTES
) -> None:
    """Export with the fixed headings, no index.

    Quoted line breaks keep a file from being split on reading, so files are cut when written: rows
    are dealt by a running total of their text bytes to files of about ``file_bytes``. The total is
    taken over numbers only; texts move once, to the file whose first row is the last not behind theirs.
    """
    names = headings or csv_headings()
    columns = ANALYSIS.fieldNames()
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(len(columns)))
    # The place tells equal rows apart, so very many copies of one row still come in several files.
    order = ["ticket_id", "_mark", "_place"]
    marked = analysed.select(*columns, F.xxhash64(*columns).alias("_mark"), F.monotonically_increasing_id().alias("_place"))
    sizes = materialise(marked.select(*order, width.cast("long").alias("_bytes")), "csv-sizes")
    placed = running_total(sizes, order, "_bytes", "_before")
    firsts = placed.groupBy(F.expr(f"_before div {file_bytes}L")).agg(F.min(F.struct(*order)).alias("first"))
    # One row: the first row's key of every file.
    firsts = materialise(firsts.agg(F.sort_array(F.collect_list("first")).alias("_firsts")), "csv-files")
    dealt = marked.join(F.broadcast(firsts)).withColumn("file", _place_among("_firsts", F.struct(*order))).drop("_firsts")
    # Rows of one file meet in one task; a task may write several files.
    files = dealt.repartition("file").sortWithinPartitions("file", *order)
    out = files.select("file", *[F.col(c).alias(names[c]) for c in columns])
    out.write.partitionBy("file").options(**_CSV).csv(path)


def _place_among(firsts: str, key: Column) -> Column:
    """Index of the last of the sorted ``firsts`` that is not above ``key``, by halving; 0 if all are."""
    steps = F.array(*[F.lit(1 << bit) for bit in range(30, -1, -1)])
    count = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.get(firsts, at + step - 1) <= key, at + step).otherwise(at)
    )
    return F.greatest(count - 1, F.lit(0))


def read_csv(
    spark: SparkSession,
    path: str,
    headings: dict[str, str] | None = None,
    missing_to_null: bool = True,
) -> DataFrame:
    """Read an export back. Missing tokens in text columns become null, as every
    breakdown expects."""
    names = headings or csv_headings()
    schema = T.StructType([T.StructField(names[f.name], f.dataType) for f in ANALYSIS.fields])
    # A null token no text can equal keeps "" (empty) apart from nothing (null).
    options = {**_CSV, "enforceSchema": False, "nullValue": "\x00"}
    table = spark.read.schema(schema).options(**options).csv(path)
    table = table.select(*[F.col(f"`{name}`") for name in schema.names]).toDF(*ANALYSIS.fieldNames())
    if not missing_to_null:
        return table
    texts = {f.name for f in ANALYSIS.fields if isinstance(f.dataType, T.StringType)}
    return table.select(
        *[(nullify_na(F.col(c)) if c in texts else F.col(c)).alias(c) for c in table.columns]
    )
