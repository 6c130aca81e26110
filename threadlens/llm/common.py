"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the six white-space characters of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
GAP_CHARACTERS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, spelled exactly so, whatever else the table carries.

    Other columns may differ from a wanted one in case only, which would make a plain
    select ambiguous; columns are therefore taken by place.
    """
    places = {name: place for place, name in reversed(list(enumerate(df.columns)))}
    by_place = df.toDF(*[f"_{place}" for place in range(len(df.columns))])
    return by_place.select(*[F.col(f"_{places[name]}").alias(name) for name in names])


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def in_pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece has about `limit` bytes in a column, or one row."""
    for batch in batches:
        ends = pc.cumulative_sum(
            pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())
        ).to_numpy(zero_copy_only=False)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(ends.searchsorted(before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
