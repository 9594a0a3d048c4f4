"""Helpers shared by the corpus operators: Arrow mapping, written intermediate tables, table reading."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, scratch, shared_dir, written

__all__ = ["discard", "fold", "map_arrow", "map_rows", "scratch", "shared_dir", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = 256) -> DataFrame:
    """Apply ``make()(columns)`` to slices of at most ``rows`` rows.

    ``make`` runs once per task, so models and caches are built there. The inner function gets a
    dict of Python lists by column name and returns a dict of lists by the names of ``schema``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = work({n: c.to_pylist() for n, c in zip(part.schema.names, part.columns, strict=True)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    return df.mapInArrow(run, schema)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], rows: int = 256) -> DataFrame:
    """Apply ``make()(batch)`` to slices of at most ``rows`` rows of all columns; the schema stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield work(batch.slice(at, rows))

    return df.mapInArrow(run, df.schema)


def fold(column: str, parts: int):
    """crc32 of the id as text, modulo ``parts``: the split between learning and held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts
