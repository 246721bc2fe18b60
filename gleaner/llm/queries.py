"""The queries over the test tables, by problem."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import cooccurrence, knn, mixing, neardup, packing, skeleton, splitting, termstats

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    found = cooccurrence.path_pairs(table(spark, sf, "hits"), table(spark, sf, "notes"), min_together=8, min_lift=4.0)
    return found.select(F.col("item_1").alias("path_1"), F.col("item_2").alias("path_2"))


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of notes that 8 or more queries recall together, with counts, lift and log-likelihood ratio."""
    return _note_pairs(spark, sf, 8).drop("significant")


def p1_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of notes that any query recalls together, with the columns of `p1_pairs` and a mark on those significantly above chance."""
    return _note_pairs(spark, sf, 1)


def _note_pairs(spark: SparkSession, sf: str, min_together: int) -> DataFrame:
    found = cooccurrence.path_pairs(table(spark, sf, "hits"), table(spark, sf, "notes"), min_together=min_together)
    found = found.withColumns({c: F.round(c, 6) for c in ("lift", "llr")})
    return found.withColumnsRenamed({"item_1": "path_1", "item_2": "path_2"})


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return termstats.term_statistics(table(spark, sf, "chunks")).where("mark <> 'kept'").select("term", "mark")


def p2_terms(spark: SparkSession, sf: str) -> DataFrame:
    return termstats.term_statistics(table(spark, sf, "chunks"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "chunks")).where("piece = 0").select("chunk_id", "cut")


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "chunks"))


#: What TESTDATA.md asks of p4: runs of three terms, a similarity of 0.7, 20 terms at least.
EDITED = neardup.Params(shingle=3, threshold=0.7, min_terms=20)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(neardup.near_duplicates(table(spark, sf, "chunks"), params=EDITED))
    return pairs.withColumnsRenamed({"id_1": "chunk_id_1", "id_2": "chunk_id_2"})


def p4_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk's class and group at the usual five terms and a similarity of 0.8, chunks of fewer terms included."""
    groups = neardup.near_duplicate_groups(neardup.near_duplicates(table(spark, sf, "chunks"), params=neardup.Params(min_terms=0)))
    return groups.withColumnsRenamed({"id": "chunk_id"})


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    near = knn.nearest(table(spark, sf, "chunk_vectors")).where("cosine >= 0.85")
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_id_1"), F.greatest("chunk_id", "neighbour").alias("chunk_id_2")).distinct()


def p5_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return knn.nearest(table(spark, sf, "chunk_vectors"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Where every text lies: one row per text or piece, with its container's fill."""
    return packing.pack(packing.token_sizes(table(spark, sf, "documents"), ["doc_id"]))


def p6_fill(spark: SparkSession, sf: str) -> DataFrame:
    """Every container with its number of items, its tokens and its unused space."""
    return packing.containers(p6_containers(spark, sf))


def _mixture(spark: SparkSession, sf: str) -> mixing.Mixture:
    return mixing.mix(packing.token_sizes(table(spark, sf, "documents"), ["doc_id", "source"]), table(spark, sf, "mix_targets"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).copies


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """What each source was to give and gave. All shares are met, so the total follows the source that is shortest of tokens for its share."""
    return _mixture(spark, sf).shares


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return skeleton.look_alike_pairs(table(spark, sf, "documents"))


def p8_forms(spark: SparkSession, sf: str) -> DataFrame:
    return skeleton.visible_forms(table(spark, sf, "documents"))


def p3_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Of every oversized chunk: do its pieces cover the whole text in order, each within the limit, sharing no more than the overlap?"""
    chunks = table(spark, sf, "chunks").select("chunk_id", F.length("text").alias("n"))
    made = F.array_sort(F.collect_list(F.struct("piece", "start", "end", F.length("text").alias("n"), F.coalesce(F.length("heading"), F.lit(0)).alias("h"), F.octet_length("text").alias("b"))))
    pieces = p3_pieces(spark, sf).groupBy("chunk_id").agg(made.alias("p")).join(chunks, "chunk_id")
    last = F.element_at("p", -1)["end"]
    steps = F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))
    pairs = F.arrays_zip(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))).alias("a"), steps.alias("b"))
    shared = lambda x: x["a"]["end"] - x["b"]["start"]
    return pieces.select(
        "chunk_id",
        ((F.element_at("p", 1)["start"] == 0) & (last == F.col("n")) & F.forall("p", lambda x: (x["n"] == x["end"] - x["start"]))).alias("whole"),
        F.forall("p", lambda x: x["n"] + x["h"] <= 1500).alias("within"),
        F.forall(pairs, lambda x: (shared(x) >= 0) & (shared(x) <= 150)).alias("overlap"),
    )


def p6_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Of every document: do its pieces add up to it, and does none of their containers hold more than fits?"""
    packed = p6_containers(spark, sf)
    full = packed.groupBy("container").agg((F.sum("tokens") <= 2048).alias("fits"), (F.sum("tokens") == F.max("used")).alias("adds"))
    mine = packed.join(full, "container").groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.bool_and(F.col("fits") & F.col("adds")).alias("fits"), F.count("*").alias("pieces"))
    sizes = packing.token_sizes(table(spark, sf, "documents"), ["doc_id"])
    few = F.col("pieces") == F.greatest(F.lit(1), F.ceil(F.col("tokens") / 2048))
    return mine.join(sizes, "doc_id").select("doc_id", ((F.col("placed") == F.col("tokens")) & few).alias("whole"), "fits")


def p7_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Of every source: the share it could reach; does it reach it, to within one of its documents and 0.002 of all, and is no document used too often?"""
    sizes = packing.token_sizes(table(spark, sf, "documents"), ["source"])
    longest = sizes.groupBy(mixing.source_name(F.col("source")).alias("source")).agg(F.max("tokens").alias("longest"))
    shares = p7_shares(spark, sf)
    whole = shares.agg(F.sum("tokens")).first()[0] or 0
    miss = F.abs(F.col("tokens") - F.col("reachable_share") * F.lit(whole))
    met = miss <= F.coalesce("longest", F.lit(0)) + 0.002 * whole
    within = F.col("most_copies") <= F.col("max_repeats")
    return shares.join(longest, "source", "left").select("source", F.round("target_share", 6).alias("target_share"), F.round("reachable_share", 6).alias("reachable_share"), met.alias("met"), within.alias("within"))


def queries() -> dict[str, Query]:
    named = [p1_found, p1_pairs, p1_all, p2_found, p2_terms, p3_found, p3_pieces, p4_found, p4_groups, p5_found, p5_nearest, p6_containers, p6_fill, p7_mixture, p7_shares, p8_found, p8_forms, p3_checked, p6_checked, p7_checked]
    return {q.__name__: q for q in named}
