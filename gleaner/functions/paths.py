"""One spelling for paths that lead to the same file."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def spelling(path: Column) -> Column:
    """Separators of any kind and number as one, none in front, one kind of blank. Letters stay as they are composed."""
    one = F.regexp_replace(path, r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(one, "^/", ""), r"[\s\p{Zs}]", " ")


def _compose(at: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(at).dictionary_encode()
            words = pa.array([w if w is None else unicodedata.normalize("NFC", w) for w in column.dictionary.to_pylist()], pa.string())
            columns = list(b.columns)
            columns[at] = words.take(column.indices)
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def composed(df: DataFrame, column: str) -> DataFrame:
    """`df` with a string column in NFC, which the JVM has no function for; equal strings of a batch are composed once."""
    return df.mapInArrow(_compose(df.columns.index(column), to_arrow_schema(df.schema)), df.schema)


def normal_paths(df: DataFrame, column: str) -> DataFrame:
    """`df` with a path column in its one spelling."""
    return composed(df.withColumn(column, spelling(F.col(column))), column)
