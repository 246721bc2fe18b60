"""From hits to what is shown: own note left out, duplicates merged, cut off by relevance, split into groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical_title


def without_source(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """Hits that don't lie in the note the query comes from (``query_id, source_path``)."""
    own = queries.where("source_path is not null").select("query_id", F.col("source_path").alias("note_path"))
    return hits.join(own, ["query_id", "note_path"], "left_anti")


def dedupe(hits: DataFrame, tie: str = "chunk_id") -> DataFrame:
    """One hit per query and note, the best; of those one per title, endings of copies aside: the heaviest note, then the best.

    Ties go to the smallest `tie`. Both steps keep one row of each group by a maximum,
    so they combine before they are shuffled.
    """
    row = F.struct(*hits.columns)
    score = F.round("final_score", 9)
    order = F.struct(score, -F.col(tie))
    by_note = hits.groupBy("query_id", "note_path").agg(F.max_by(row, order).alias("h")).select("h.*")
    title = by_note.withColumn("__title", canonical_title(F.col("note_title")))
    heavy = F.struct(F.col("note_weight"), score, -F.col(tie))
    return title.groupBy("query_id", "__title").agg(F.max_by(row, heavy).alias("h")).select("h.*")


def cut_off(hits: DataFrame, relevance: int = 10) -> DataFrame:
    """Hits that score at least (1 - relevance / 10) of their query's best; all of them at 10."""
    if relevance >= 10:
        return hits
    top = F.max("final_score").over(W.partitionBy("query_id"))
    return hits.withColumn("__top", top).where(F.col("final_score") >= F.col("__top") * (1 - relevance / 10)).drop("__top")


def group_of(category: Column) -> Column:
    return F.when(category == "external", "external").otherwise("internal")


def present(hits: DataFrame, relevance: int = 10, pinned: DataFrame | None = None, tie: str = "chunk_id") -> DataFrame:
    """Hits with ``tab`` (internal, external) and ``place`` within it; pinned chunks (``chunk_id``) are shown apart, so left out.

    The cut is taken from the best hit before pinned ones are left out.
    """
    kept = cut_off(hits, relevance)
    if pinned is not None:
        kept = kept.join(pinned.select("chunk_id"), "chunk_id", "left_anti")
    kept = kept.withColumn("tab", group_of(F.col("category_id")))
    return kept.withColumn("place", F.row_number().over(W.partitionBy("query_id", "tab").orderBy(F.round("final_score", 9).desc(), tie)))


def hit_counts(hits: DataFrame) -> DataFrame:
    """``query_id, hits, by_terms, by_vectors, seconds``: hits of each query and how they were found; `seconds` from its first to its last, where they have ``logged_at``."""
    took = F.unix_micros(F.max("logged_at").cast("timestamp")) - F.unix_micros(F.min("logged_at").cast("timestamp")) if "logged_at" in hits.columns else F.lit(None)
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.count("bm25_rank").alias("by_terms"), F.count("vector_rank").alias("by_vectors"), (took / 1e6).alias("seconds"))


def tab_counts(shown: DataFrame) -> DataFrame:
    return shown.groupBy("query_id", "tab").agg(F.count("*").alias("hits"))
