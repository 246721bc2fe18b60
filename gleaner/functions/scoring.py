"""Scores as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Of term scores, rank fusion, boosts, the noise gate and the weights of key tiers.
K1, B = 1.2, 0.75
FUSION = 60
HEADING_BOOST, OVERLAP_BOOST = 1.2, 0.5
LEAST_MATCHED, NOISE_COSINE = 2, 0.6
TIERS = {("doctrine", "exact"): 3.0, ("doctrine", "synonym"): 2.0, ("doctrine", "vector"): 1.0, ("tag", "exact"): 1.0, ("tag", "vector"): 0.5}
KEY_COSINE = {"doctrine": 0.5, "tag": 0.6}
KEYS_BY_VECTOR = 5


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def term_weight(tf: Column, length: Column, mean: Column) -> Column:
    """How much `tf` occurrences in a chunk of `length` terms count."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def reciprocal_rank(rank: Column) -> Column:
    return F.lit(1.0) / (F.lit(FUSION) + rank)


def final_score(fused: Column, weight: Column, heading: Column, coverage: Column, *, by_weight: bool = True, by_heading: bool = True, by_overlap: bool = True) -> Column:
    out = fused
    if by_weight:
        out = out * weight
    if by_heading:
        out = out * F.when(heading, HEADING_BOOST).otherwise(1.0)
    if by_overlap:
        out = out * (1 + coverage * OVERLAP_BOOST)
    return out


def passes_gate(matched: Column, total: Column, cosine: Column) -> Column:
    """Enough query terms, or close enough in meaning."""
    return (matched >= F.least(F.lit(LEAST_MATCHED), total)) | F.coalesce(cosine >= NOISE_COSINE, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where one of both has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def factor(weight: Column) -> Column:
    """The multiplier of a folder weight: whole, from 0 to 10, times its unit; 0 for what is no finite number."""
    from ..config import MOST_WEIGHT, WEIGHT_UNIT

    w = weight.cast("double")
    whole = F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(0), F.floor(w + 0.5)))
    return F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 0.0).otherwise(whole * WEIGHT_UNIT)


def nearest_rank(values: Column, q: float) -> Column:
    """The q-quantile of an array as sorted[min(n - 1, floor(n q))]; null for an empty one."""
    n = F.size(values)
    return F.when(n > 0, F.element_at(F.array_sort(values), F.least(n, F.floor(n * F.lit(q)).cast("int") + 1)))
