"""Near-duplicate records: b-bit MinHash signatures, band candidates, exact links, groups."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import materialise, spread
from .text import slices, terms

BITS = 4  # kept of each minimum


class Params(NamedTuple):
    """`shingle` terms in a row; `threshold` of the Jaccard similarity; `bands` of `rows` minima each.

    Texts below `min_terms` terms are left out; with 0 every row has a class.

    A pair at the threshold t is found with probability 1 - (1 - t**rows)**bands;
    bands * rows must be a multiple of 64.
    """

    shingle: int = 5
    threshold: float = 0.8
    min_terms: int = 5
    bands: int = 32
    rows: int = 4

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


class Near(NamedTuple):
    """`members`: (id, rep) of every row with `min_terms` terms, or of every row if that is 0; `links`: (rep_1, rep_2, similarity), rep_1 < rep_2."""

    members: DataFrame
    links: DataFrame


class _Hashes(dict):
    def __missing__(self, term: str) -> int:
        value = xxhash.xxh3_64_intdigest(term)
        if len(self) < 500_000:
            self[term] = value
        return value


_HASHES = _Hashes()


def shingles(text: str, n: int, least: int) -> np.ndarray | None:
    """Sorted 64-bit hashes of the distinct runs of `n` terms; None below `least` terms.

    Fewer than `n` terms are one run; a text without terms stands for itself, composed.
    """
    words = terms(text)
    if len(words) < least:
        return None
    if not words:
        return np.array([xxhash.xxh3_64_intdigest(unicodedata.normalize("NFC", text), seed=1)], np.uint64)
    n = min(n, len(words))
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    x = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        x = x * np.uint64(0x9E3779B97F4A7C15) ^ h[i : len(h) - n + 1 + i]
    return np.unique(_mix(x))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def minima(values: np.ndarray, start: np.ndarray, hashes: int) -> np.ndarray:
    """Of each set (concatenated, from `start` on) the minimum under each of `hashes` multiply-shift hashes."""
    rng = np.random.default_rng(20_240_229)
    a = rng.integers(0, 2**63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, hashes, np.uint64)
    out = np.empty((len(start), hashes), np.uint32)
    for k in range(hashes):
        out[:, k] = np.minimum.reduceat(((values * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), start)
    return out


def pack(m: np.ndarray) -> list[np.ndarray]:
    """The low BITS of every minimum as bit planes of 64-bit words, plane by plane."""
    words = []
    for p in range(BITS):
        plane = np.packbits(((m >> np.uint32(p)) & np.uint32(1)).astype(np.uint8), axis=1).view(np.int64)
        words += [plane[:, i] for i in range(plane.shape[1])]
    return words


def band_keys(m: np.ndarray, p: Params) -> np.ndarray:
    x = m.reshape(len(m), p.bands, p.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, p.bands + 1, dtype=np.uint64), x.shape[:2]).copy()
    for i in range(p.rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + x[:, :, i])
    return key.view(np.int64)


def _words(p: Params) -> int:
    return BITS * p.hashes // 64


def _sign(p: Params, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for part in slices(texts, 300_000):
                at, sets = [], []
                for i in part:
                    if texts[i] is not None and (s := shingles(texts[i], p.shingle, p.min_terms)) is not None:
                        at.append(i)
                        sets.append(s)
                if not at:
                    continue
                m = minima(np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])]), p.hashes)
                digest = b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets)
                halves = np.frombuffer(digest, np.int64).reshape(-1, 2)
                bands = band_keys(m, p)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, p.bands, dtype=np.int32)), pa.array(bands.ravel()))
                columns = [keys.take(pa.array(at)), *(pa.array(np.ascontiguousarray(c)) for c in (halves[:, 0], halves[:, 1], *pack(m))), lists]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) if c.type != f.type else c for c, f in zip(columns, schema)], schema=schema)

    return run


def estimate(p: Params) -> Column:
    """The similarity by the packed signatures s*_1, s*_2, corrected for low bits that agree by chance."""
    width = p.hashes // 64
    differ = F.lit(0)
    for w in range(width):
        planes = [F.col(f"s{q * width + w}_1").bitwiseXOR(F.col(f"s{q * width + w}_2")) for q in range(BITS)]
        any_bit = planes[0]
        for x in planes[1:]:
            any_bit = any_bit.bitwiseOR(x)
        differ = differ + F.bit_count(any_bit)
    agree = 1 - differ / F.lit(float(p.hashes))
    chance = 2.0**-BITS
    return (agree - chance) / (1 - chance)


def standard_error(similarity: float, hashes: int, bits: int) -> float:
    """Of the similarity that `bits` bits of each of `hashes` minima give, corrected for chance."""
    chance = 2.0**-bits
    agree = similarity + (1 - similarity) * chance
    return (agree * (1 - agree) / hashes) ** 0.5 / (1 - chance)


def met_in_bands(signed: DataFrame, p: Params) -> DataFrame:
    """``id_1, id_2``: pairs of rows that agree in a band and whose lowest bits don't say that they differ too much.

    The lowest bit of every minimum goes along with each band key, so that what meets by
    chance, or is one of many of a kind without being similar, is left out inside the
    join, before it is written or shuffled; the other bits are looked up for what stays.
    """
    lowest = [f"s{w}" for w in range(p.hashes // 64)]
    bands = signed.select("id", F.explode("bands").alias("band"), *lowest)
    a, b = bands.alias("a"), bands.alias("b")
    differ = F.lit(0)
    for w in lowest:
        differ = differ + F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}")))
    similar = 1 - 2 * differ / F.lit(float(p.hashes))
    least = p.threshold - 5 * standard_error(p.threshold, p.hashes, 1)
    near = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id")) & (similar >= least))
    return near.select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2")).distinct()


def _verify(p: Params, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}

        def of(key, text: str) -> np.ndarray:
            if key not in known:
                if len(known) > 2000:
                    known.clear()
                known[key] = shingles(text, p.shingle, p.min_terms)
            return known[key]

        for b in batches:
            rows = []
            one, two, text_1, text_2 = b.columns
            for i in range(b.num_rows):
                k, q = one[i].as_py(), two[i].as_py()
                x, y = of(k, text_1[i].as_py()), of(q, text_2[i].as_py())
                n = len(np.intersect1d(x, y, assume_unique=True))
                rows.append((k, q, n, len(x) + len(y) - n))
            columns = zip(*rows) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def signatures(source: DataFrame, p: Params) -> DataFrame:
    """``id, h1, h2``, the words of the packed minima and ``bands``, of rows (``id, text``) with a text of `min_terms` terms."""
    long = T.LongType()
    fields = [source.schema["id"], *(T.StructField(n, long) for n in ("h1", "h2", *(f"s{i}" for i in range(_words(p))))), T.StructField("bands", T.ArrayType(long))]
    schema = T.StructType(fields)
    return spread(source.where("text is not null")).mapInArrow(_sign(p, to_arrow_schema(schema)), schema)


def near_duplicates(df: DataFrame, key: str = "chunk_id", text: str = "text", params: Params = Params()) -> Near:
    """Rows whose sets of `shingle` consecutive terms have a Jaccard similarity of `threshold` or more.

    Rows with equal sets are one class, named by its smallest key: `members`
    has (id, rep) of every row, `links` the similar pairs of classes with
    their exact similarity. Copies, however many, thus never meet each other.

    Each row's minima under `bands * rows` hashes are computed once; a 64-bit
    key per band brings the classes that agree in a band together, the low
    BITS bits of every minimum stay as a packed signature. Candidates are
    thinned by the similarity that bit counts of two signatures give,
    corrected for chance, down to five standard errors below the threshold:
    by the lowest bits inside the join, by all of them after it; what remains
    is compared exactly. The join on band keys is a plain
    equi-join, which adaptive execution splits where a band key is frequent;
    nothing is capped.

    Texts below `shingle` terms have one shingle, of all their terms, and are
    thus one class with their copies. Null texts and those below `min_terms`
    terms are in neither table. With `min_terms` 0 every row is in `members`:
    texts without any term are one class if equal (composed), each null text is
    one of its own. Keys must be unique; rows repeated whole do no harm. An
    empty table gives empty tables. Other columns are not read.
    """
    p = params
    source = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind, long = source.schema["id"].dataType, T.LongType()
    names = [f"s{i}" for i in range(_words(p))]
    signed = materialise(signatures(source, p), "signatures")
    classes = signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    several = materialise(classes.where("n > 1").select("h1", "h2", "rep"), "classes")
    copies = materialise(signed.select("id", "h1", "h2").join(several, ["h1", "h2"]).select("id", "rep").where("id <> rep").distinct(), "copies")
    members = signed.select("id").join(copies, "id", "left").select("id", F.coalesce("rep", "id").alias("rep")).distinct()
    if p.min_terms <= 0:
        members = members.unionAll(source.where("text is null").select("id", F.col("id").alias("rep")).distinct())
    alone = signed.join(copies, "id", "left_anti")

    met = met_in_bands(alone, p)
    for k in "12":
        met = met.join(signed.select(F.col("id").alias(f"id_{k}"), *(F.col(n).alias(f"{n}_{k}") for n in names)), f"id_{k}")
    likely = materialise(met.where(estimate(p) >= p.threshold - 5 * standard_error(p.threshold, p.hashes, BITS)).select("id_1", "id_2").distinct(), "candidates")
    # only texts of candidates are read again
    wanted = likely.select(F.col("id_1").alias("id")).union(likely.select("id_2")).distinct()
    texts = source.join(wanted, "id", "left_semi")
    both = likely.join(texts.select(F.col("id").alias("id_1"), F.col("text").alias("text_1")), "id_1")
    both = both.join(texts.select(F.col("id").alias("id_2"), F.col("text").alias("text_2")), "id_2").select("id_1", "id_2", "text_1", "text_2")
    found = T.StructType([T.StructField("rep_1", kind), T.StructField("rep_2", kind), T.StructField("shared", long), T.StructField("total", long)])
    exact = both.mapInArrow(_verify(p, to_arrow_schema(found)), found)
    # whole numbers, so that no rounding moves a pair over the threshold
    links = exact.where(F.col("shared") * 1_000_000 >= F.col("total") * F.lit(round(p.threshold * 1_000_000)))
    links = links.select("rep_1", "rep_2", (F.col("shared") / F.col("total")).alias("similarity")).distinct()
    return Near(members, materialise(links, "links"))


def near_duplicate_pairs(near: Near) -> DataFrame:
    """``id_1, id_2``: every pair of rows of one class or of two linked classes, id_1 < id_2.

    This writes copies out into all their pairs; `near` itself says the same in one row each.
    """
    large = near.members.groupBy("rep").count().where("count > 1").select("rep")
    copies = materialise(near.members.join(large, "rep", "left_semi"), "copies")
    a, b = copies.alias("a"), copies.alias("b")
    within = a.join(b, (F.col("a.rep") == F.col("b.rep")) & (F.col("a.id") < F.col("b.id"))).select(F.col("a.id").alias("id_1"), F.col("b.id").alias("id_2"))
    across = near.links.select("rep_1", "rep_2")
    for k in "12":
        side = copies.select(F.col("rep").alias(f"rep_{k}"), F.col("id").alias(f"m_{k}"))
        across = across.join(side, f"rep_{k}", "left").withColumn(f"m_{k}", F.coalesce(f"m_{k}", f"rep_{k}"))
    across = across.select(F.least("m_1", "m_2").alias("id_1"), F.greatest("m_1", "m_2").alias("id_2"))
    return within.unionAll(across)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root``: the connected components of ``a, b`` edges, named by their smallest node.

    Alternating large-star and small-star rounds, each written to the shared
    folder; ends when a round changes nothing.
    """

    def edges(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = materialise(edges(links), "edges")
    before = state(now)
    for _ in range(most_rounds):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = edges(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b")))
        now = materialise(edges(small), "edges")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select("node", F.col("node").alias("root")))


def near_duplicate_groups(near: Near) -> DataFrame:
    """``id, rep, group_id, links``: every row, its class, its group (the smallest key in it) and the links of its class."""
    grouped = components(near.links.select(F.col("rep_1").alias("a"), F.col("rep_2").alias("b")))
    ends = near.links.select(F.col("rep_1").alias("rep")).unionAll(near.links.select("rep_2")).groupBy("rep").agg(F.count("*").alias("links"))
    facts = ends.join(grouped.withColumnRenamed("node", "rep"), "rep")
    out = near.members.join(facts, "rep", "left")
    return out.select("id", "rep", F.coalesce("root", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
