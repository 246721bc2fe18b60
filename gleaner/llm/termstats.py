"""Frequency of every distinct term: occurrences, records, and a mark by frequency bounds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .text import terms

COUNTS = "term string, occurrences long, records long"


def _count(flush: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: Counter[str] = Counter()
        records: Counter[str] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            words = list(occurrences)
            for i in range(0, len(words), 20_000):
                part = words[i : i + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.string()), pa.array([occurrences[w] for w in part], pa.int64()), pa.array([records[w] for w in part], pa.int64())],
                    names=["term", "occurrences", "records"],
                )
            occurrences.clear()
            records.clear()

        for batch in batches:
            for text in batch.column(0):
                if value := text.as_py():
                    found = terms(value)
                    occurrences.update(found)
                    records.update(set(found))
                    if len(occurrences) >= flush:
                        yield from out()
        yield from out()

    return run


def term_statistics(df: DataFrame, text: str = "text", *, min_records: int = 3, max_share: float = 0.1, flush: int = 200_000) -> DataFrame:
    """One row per distinct term: ``term, occurrences, records, mark``.

    `mark` is ``rare`` if fewer than `min_records` records hold the term, else
    ``common`` if more than `max_share` of all records do, else ``kept``.

    Each task adds its records' term counts up in a hash table and hands on
    one row per term and flush (`flush` distinct terms bound its memory), so a
    term that every record holds reaches the shuffle as one row per task. The
    sums are then taken with Spark's own partial aggregation.

    Null and empty texts hold no term but count as records for `max_share`.
    Repeated rows count again. An empty table gives no rows. Other columns are
    not read.
    """
    column = df.select(F.col(text).alias("text"))
    total = df.count()
    counts = spread(column.where("text is not null and text <> ''")).mapInArrow(_count(flush), COUNTS)
    sums = counts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    mark = F.when(F.col("records") < min_records, "rare").when(F.col("records") > F.lit(max_share) * F.lit(total), "common").otherwise("kept")
    return sums.withColumn("mark", mark)
