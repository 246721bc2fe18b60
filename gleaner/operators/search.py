"""Searches for batches of queries: by terms, by vectors, by both, by keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scoring import KEY_COSINE, KEYS_BY_VECTOR, TIERS, final_score, idf, passes_gate, reciprocal_rank, term_weight
from ..functions.text import is_blank, preview, query_tags, query_terms, strip_emoji, title_of
from ..runtime import materialise
from .ids import with_dense_ids
from .index import Index, corpus, unpacked
from .sums import best_sums
from .tokenize import terms_of

#: Rows and bytes up to which a side of a join is broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000
#: Lexicon keys up to which the pairs of letters they begin with stand in the plan.
SCANNED_KEYS = 5_000
#: Blocks of chunks that a task of `hybrid` takes, at most.
HYBRID_BLOCKS = 8
#: Most elements of the score matrix one step of a vector search holds.
SCORES_AT_ONCE = 4_000_000

#: The columns of a hit, the same for every way of searching.
HIT = [
    "query_id", "chunk_id", "note_path", "note_title", "heading", "preview", "full_text", "category_id", "note_weight", "rrf_score", "final_score",
    "bm25_rank", "vector_rank", "bm25_score", "vector_score", "heading_matched", "matched_query_terms", "query_terms_total",
]


@dataclass(frozen=True)
class Options:
    top: int = 10
    candidates: int = 30
    by_weight: bool = True
    by_heading: bool = True
    by_overlap: bool = True


def _small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    return df.limit(most + 1).count() <= most


def top_k(rows: DataFrame, k: int, score: str, tie: str, group: str = "query_id", rank: str = "rank") -> DataFrame:
    """The k best rows of every group with their rank from 1; scores equal to nine digits are ties, which go by `tie`."""
    w = W.partitionBy(group).orderBy(F.round(score, 9).desc(), F.col(tie))
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def exploded_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(query_terms(F.col("terms"))).alias("term"))


@dataclass(frozen=True)
class Wanted:
    """What a batch of queries can find: ``query_id, wants`` (key and df of its terms that occur), ``chunk_id, length, keys, tfs`` (of asked terms)."""

    asked: DataFrame
    held: DataFrame


def _numbered(known: pa.Table):
    """`term_packs` to lists of the numbers of known terms, a row for each chunk; without chunks that have none."""
    terms, keys = known.column("term").combine_chunks(), known.column("key").to_numpy()
    schema = pa.schema([("chunk_id", pa.int64()), ("length", pa.int64()), ("keys", pa.list_(pa.int64())), ("tfs", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunks, lengths, n, own, places, tfs in unpacked(b):
                number = pc.fill_null(pc.index_in(own, value_set=terms), -1).to_numpy()[places]
                kept = number >= 0
                n = np.bincount(np.repeat(np.arange(len(n)), n)[kept], minlength=len(n))
                rows = np.flatnonzero(n)
                ends = pa.array(np.append(0, np.cumsum(n[rows])).astype(np.int32))
                held = pa.array(keys[number[kept]]), pa.array(tfs[kept])
                yield pa.RecordBatch.from_arrays([*(x.take(pa.array(rows)) for x in (chunks, lengths)), *(pa.ListArray.from_arrays(ends, x) for x in held)], schema=schema)

    return run


def wanted(index: Index, queries: DataFrame, *, kept: bool = True) -> Wanted:
    """The terms of `queries` as numbers, a list for each query and each chunk; written once if they are `kept` for several uses.

    Where the index has lists and the terms are few enough, these go to the lists; else the postings meet them and are gathered by chunk.
    """
    asked = exploded_terms(queries)
    terms = materialise(asked.select("term").distinct().join(index.term_stats, "term").select("term", "df", F.monotonically_increasing_id().alias("key")), "terms")
    small = _small(terms)
    few = F.broadcast if small else lambda x: x
    wants = asked.join(few(terms), "term").groupBy("query_id").agg(F.collect_list(F.struct("key", "df")).alias("wants"))
    if small and index.lists is not None:
        held = index.lists.mapInArrow(_numbered(terms.select("term", "key").toArrow()), "chunk_id long, length long, keys array<long>, tfs array<int>")
    else:
        held = index.postings.join(few(terms.select("term", "key")), "term").groupBy("chunk_id").agg(F.collect_list(F.struct("key", "tf")).alias("held"))
        held = held.join(index.chunk_stats, "chunk_id", "left").select("chunk_id", "length", F.col("held.key").alias("keys"), F.col("held.tf").cast("array<int>").alias("tfs"))
    return Wanted(materialise(wants, "asked"), materialise(held, "held") if kept else held)


def bm25(index: Index, queries: DataFrame, k: int = 30, *, having: Wanted | None = None, blocks: int | None = None) -> DataFrame:
    """``query_id, chunk_id, bm25_score, bm25_rank``: the k chunks whose terms fit each query best.

    `queries` has ``query_id, terms``. The postings, or lists of them, are read once for all queries and keep only
    query terms, as numbers and a list for each chunk; where the terms are few enough they go to all tasks, so the postings are
    filtered as they are scanned. The scores of a block of chunks add up in one task (`best_sums`), and
    only the best rows of every query leave it. `having` is what `wanted` gave for the same queries, `blocks` how many blocks a task may take.
    """
    n, mean = corpus(index.chunks, index.chunk_stats)
    if not n or not mean:
        return queries.sparkSession.createDataFrame([], "query_id long, chunk_id long, bm25_score double, bm25_rank int")
    having = wanted(index, queries, kept=False) if having is None else having
    length = F.coalesce(F.col("length").cast("double"), F.lit(mean))
    docs = having.held.select(F.col("chunk_id").alias("doc"), F.lit(1.0).alias("factor"), "keys", F.col("tfs").alias("values"), length.alias("size"))
    weights = F.transform("wants", lambda x: F.struct(x["key"].alias("key"), idf(F.lit(float(n)), x["df"].cast("double")).alias("weight")))
    scores = best_sums(docs, having.asked.select("query_id", weights.alias("wants")), k, n, lambda tf, size: term_weight(tf, size, mean), blocks).withColumnsRenamed({"doc": "chunk_id", "total": "bm25_score"})
    return top_k(scores, k, "bm25_score", "chunk_id", rank="bm25_rank")


class _Best:
    """The k best rows of every query so far; scores equal to nine digits are ties, which go by chunk id. Zero vectors have a cosine of 0."""

    def __init__(self, asked: tuple[np.ndarray, np.ndarray], k: int, least: float):
        (self.ids, self.unit), self.k, self.least = asked, k, least
        self.bound = np.full(len(self.ids), least)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = self.kept = 0

    def add(self, chunk: np.ndarray, vectors: np.ndarray) -> None:
        length = np.linalg.norm(vectors, axis=1)
        unit = vectors / np.where(length > 0, length, 1.0)[:, None]
        step = max(1, SCORES_AT_ONCE // len(self.ids))
        for i in range(0, len(chunk), step):
            scores = self.unit @ unit[i : i + step].T
            scores[:, length[i : i + step] == 0] = 0.0
            bound = self.bound
            if not self.held:  # all ties of the last place stay
                k = min(self.k, scores.shape[1])
                bound = np.maximum(bound, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] - 2e-9)
            q, r = np.nonzero(scores >= bound[:, None])
            self.held.append((q, chunk[i : i + step][r], scores[q, r]))
            self.n += len(q)
            if self.n > self.kept + len(self.ids) * self.k // 2:
                self._cut()

    def _cut(self) -> None:
        """Only rows that reach each query's k-th best score, or a tie of it, stay; they are put in order where ties make them many, and at the end."""
        q, chunk, score = map(np.concatenate, zip(*self.held))
        order = np.argsort(q.astype(np.uint16) if len(self.ids) <= 1 << 16 else q, kind="stable")  # short numbers are counted, not compared
        q, chunk, score = q[order], chunk[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.ids)))[q]
        width = place.max(initial=-1) + 1
        if width > self.k and width * len(self.ids) <= 2 * SCORES_AT_ONCE:
            each = np.full((len(self.ids), width), -np.inf)
            each[q, place] = score
            each.partition(width - self.k, axis=1)
            self.bound = np.maximum(self.bound, each[:, width - self.k] - 2e-9)
            kept = score >= self.bound[q]
            q, chunk, score = q[kept], chunk[kept], score[kept]
        self.held = [(q, chunk, score)]
        if len(q) > 2 * len(self.ids) * self.k:
            self._sort()
        self.n = self.kept = len(self.held[0][0])

    def _sort(self) -> None:
        q, chunk, score = map(np.concatenate, zip(*self.held))
        order = np.lexsort((chunk, -np.round(score, 9), q))
        q, chunk, score = q[order], chunk[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.bound[q[last]] = np.maximum(score[last] - 2e-9, self.least)
        self.held = [(q[place < self.k], chunk[place < self.k], score[place < self.k])]

    def batches(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._sort()
            q, chunk, score = self.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(chunk), pa.array(score)], schema=schema)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _scan(asked: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]], k: int, least: float, schema: pa.Schema):
    """Vectors, batch by batch, against the queries of their model and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[str, int], _Best] = {}
        for b in batches:
            models, lengths = np.array(b.column("model").to_pylist(), object), b.column("vector").value_lengths().to_numpy()
            for model, dim in set(zip(models.tolist(), lengths.tolist())) & asked.keys():
                rows = b.take(pa.array(np.flatnonzero((models == model) & (lengths == dim))))
                best.setdefault((model, dim), _Best(asked[model, dim], k, least)).add(rows.column("chunk_id").to_numpy(), _matrix(rows.column("vector")))
        for one in best.values():
            yield from one.batches(schema)

    return run


def _scan_blocks(k: int, least: float, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        best = _Best((right.column("query_id").to_numpy(), _matrix(right.column("unit").combine_chunks())), k, least)
        best.add(left.column("chunk_id").to_numpy(), _matrix(left.column("vector").combine_chunks()))
        return pa.Table.from_batches(best.batches(schema), schema)

    return run


def vector_search(embeddings: DataFrame, queries: DataFrame, model: str | None = None, k: int = 30, *, least: float = -2.0, block: int = 4096) -> DataFrame:
    """``query_id, chunk_id, vector_score, vector_rank``: the k chunks with the highest exact cosine for each query vector.

    `queries` has ``query_id, embedding`` and, if no `model` is named for all, ``model``. A query is compared
    with the vectors of its own model and length, whatever lengths its batch has. Only cosines of
    `least` or more come out. A query vector of length 0 finds nothing, a zero chunk vector has the cosine 0;
    a vector with an element that is no number is not compared. Every batch of vectors is scored against all
    its queries in one matrix product and only each query's best rows of all batches leave the task. Queries that fit
    `BROADCAST_BYTES` go to the vectors; more of them are cut into blocks, and blocks of both sides meet.
    """
    spark = queries.sparkSession
    schema = "query_id long, chunk_id long, vector_score double"
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    own = F.col("model") if model is None else F.lit(model)
    asked = queries.select("query_id", own.alias("model"), "embedding", F.sqrt(size).alias("n")).where("model is not null and embedding is not null and n > 0 and not isnan(n)")
    asked = asked.select("query_id", "model", F.expr("transform(embedding, x -> cast(x as double) / n)").alias("unit"))
    kinds = asked.groupBy("model", F.size("unit").alias("dim")).count().collect()  # one row for each model and length
    if not kinds:
        return spark.createDataFrame([], schema + ", vector_rank int")
    known = F.broadcast(spark.createDataFrame([(r["model"], r["dim"]) for r in kinds], "model string, dim int"))
    rows = embeddings.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))).select("chunk_id", "model", "vector", F.size("vector").alias("dim")).join(known, ["model", "dim"], "left_semi")
    arrow = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("vector_score", pa.float64())])
    if sum(r["count"] * (r["dim"] + 1) * 8 for r in kinds) <= BROADCAST_BYTES:
        held: dict[tuple[str, int], list] = {}
        for r in asked.collect():
            held.setdefault((r["model"], len(r["unit"])), []).append(r)
        by_kind = {kind: (np.array([r["query_id"] for r in rs], np.int64), np.array([r["unit"] for r in rs], np.float64)) for kind, rs in held.items()}
        found = rows.select("chunk_id", "model", "vector").mapInArrow(_scan(by_kind, k, least, arrow), schema)
    else:
        n = sum(r["count"] for r in kinds)
        q_blocks, v_blocks = -(-n // block), -(-rows.count() // (4 * block)) or 1
        key = ["model", "dim", "v", "q"]
        left = rows.withColumn("v", F.pmod(F.xxhash64("chunk_id"), F.lit(v_blocks)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        right = asked.withColumn("dim", F.size("unit")).withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_scan_blocks(k, least, arrow), schema)
    return top_k(found, k, "vector_score", "chunk_id", rank="vector_rank")


def vector_keys(key_embeddings: DataFrame, queries: DataFrame, model: str, kind: str, *, allow: DataFrame | None = None, exclude: DataFrame | None = None, least: float | None = None, k: int = KEYS_BY_VECTOR) -> DataFrame:
    """``query_id, key, similarity``: up to k keys of a kind close enough to each query vector.

    `allow` (column key) restricts the keys; `exclude` (query_id, key) takes away what a query has already.
    Only keys close enough leave the scan, and of these k more than any query has excluded.
    """
    least = KEY_COSINE[kind] if least is None else least
    keys = key_embeddings.where((F.col("kind") == kind) & (F.col("model") == model))
    if allow is not None:
        keys = keys.join(allow.select("key"), "key", "left_semi")
    keys = keys.select(F.xxhash64("key").alias("chunk_id"), "model", "vector", "key")
    gone = 0
    if exclude is not None:
        gone = exclude.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    hits = vector_search(keys.select("chunk_id", "model", "vector"), queries, model, k + gone, least=least - 1e-9).where(F.round("vector_score", 9) >= least)
    hits = hits.join(keys.select("chunk_id", "key"), "chunk_id").select("query_id", "key", F.col("vector_score").alias("similarity"))
    if exclude is not None:
        hits = hits.join(exclude.select("query_id", "key"), ["query_id", "key"], "left_anti")
    return top_k(hits, k, "similarity", "key").drop("rank")


def fuse(by_terms: DataFrame, by_vectors: DataFrame) -> DataFrame:
    """Both result lists by (query_id, chunk_id), with the sum of their reciprocal ranks as ``rrf_score``."""
    met = by_terms.join(by_vectors, ["query_id", "chunk_id"], "full_outer")
    zero = F.lit(0.0)
    return met.withColumn("rrf_score", F.coalesce(reciprocal_rank(F.col("bm25_rank")), zero) + F.coalesce(reciprocal_rank(F.col("vector_rank")), zero))


def _heading_has(heading: Column, terms: Column) -> Column:
    return F.coalesce(F.exists(terms, lambda t: (F.length(t) > 0) & heading.contains(t)), F.lit(False))


def candidates(index: Index, queries: DataFrame, model: str, k: int, blocks: int | None = None) -> DataFrame:
    """Both lists of k fused, with what scores and the gate need of notes, headings and terms; only rows that pass the gate.

    Candidates meet headings and lists of terms by chunk; the queries' terms and the notes are broadcast where they are few enough.
    """
    having = wanted(index, queries)
    fused = materialise(fuse(bm25(index, queries, k, having=having, blocks=blocks), vector_search(index.embeddings, queries, model, k)), "fused")
    asks = queries.select("query_id", query_terms(F.col("terms")).alias("terms")).join(having.asked.select("query_id", F.col("wants.key").alias("keys")), "query_id", "left")
    asks = materialise(asks, "asks")
    size = asks.agg(F.sum(F.octet_length(F.array_join("terms", "  ")) + 8 * F.size("keys") + 64)).first()[0] or 0
    notes = index.notes.select(F.col("path").alias("note_path"), "category_id", F.col("weight").alias("note_weight"))
    rows = fused.join(index.chunks.select("chunk_id", "note_path", "heading"), "chunk_id").join(having.held.select("chunk_id", F.col("keys").alias("held")), "chunk_id", "left")
    rows = rows.join(F.broadcast(asks) if size <= BROADCAST_BYTES else asks, "query_id")
    matched = F.coalesce(F.when(F.col("keys").isNotNull() & F.col("held").isNotNull(), F.size(F.array_intersect("keys", "held"))), F.lit(0))
    rows = rows.withColumns({"matched_query_terms": matched, "query_terms_total": F.size("terms"), "heading_matched": _heading_has(F.col("heading"), F.col("terms"))}).drop("terms", "keys", "held")
    rows = rows.where(passes_gate(F.col("matched_query_terms"), F.col("query_terms_total"), F.col("vector_score")))
    return rows.join(F.broadcast(notes) if _small(notes) else notes, "note_path")


def _scored(rows: DataFrame, o: Options) -> DataFrame:
    """The best of `candidates` under some options."""
    total = F.col("query_terms_total")
    coverage = F.when(total > 0, F.col("matched_query_terms") / total).otherwise(0.0)
    score = final_score(F.col("rrf_score"), F.col("note_weight"), F.col("heading_matched"), coverage, by_weight=o.by_weight, by_heading=o.by_heading, by_overlap=o.by_overlap)
    return top_k(rows.withColumn("final_score", score), o.top, "final_score", "chunk_id").drop("rank")


def hybrid_scores(index: Index, queries: DataFrame, model: str, options: Options = Options(), blocks: int | None = None) -> DataFrame:
    """The hits of `hybrid` without their texts."""
    return _scored(candidates(index, queries, model, options.candidates, blocks), options)


def with_texts(hits: DataFrame, chunks: DataFrame, length: int = 80) -> DataFrame:
    """Hits with title, preview and full text; texts are joined to what is left after ranking."""
    hits = materialise(hits, "hits")
    texts = chunks.select("chunk_id", F.col("text").alias("full_text"), preview(F.col("text"), length).alias("preview"))
    small = F.broadcast(hits) if _small(hits, 50_000) else hits
    out = texts.join(small, "chunk_id").withColumn("note_title", title_of(F.col("note_path")))
    return out.select(*HIT)


def hybrid(index: Index, queries: DataFrame, model: str, options: Options = Options()) -> DataFrame:
    """Hits of queries (``query_id, terms, embedding``): terms and vectors fused, weighted by note, heading and coverage.

    The candidates of both lists are fused by reciprocal rank; a hit needs two of the query's
    terms (or all, if it has fewer) or a cosine of 0.6. Chunks whose note is missing are dropped.
    """
    return with_texts(hybrid_scores(index, queries, model, options, HYBRID_BLOCKS), index.chunks)


def ablation(index: Index, queries: DataFrame, model: str, top: int = 5) -> DataFrame:
    """Hits under three settings, one ``stage`` each: without weight and heading, with weight, with both."""
    rows = candidates(index, queries, model, Options.candidates).select("query_id", "chunk_id", "rrf_score", "note_weight", "heading_matched", "matched_query_terms", "query_terms_total")
    rows = materialise(rows, "candidates")
    stages = {"rrf": Options(top=top, by_weight=False, by_heading=False), "weight": Options(top=top, by_heading=False), "heading": Options(top=top)}
    out = None
    for name, o in stages.items():
        best = _scored(rows, o).withColumn("stage", F.lit(name))
        out = best if out is None else out.unionByName(best)
    return out


def _key_parts(clean: DataFrame, keys: DataFrame) -> DataFrame:
    """``query_id, key``: the keys, of two letters or more, that are a part of a text (``query_id, clean``).

    A key can only be part of a text that has its first two letters side by side; texts and keys meet by these.
    Up to SCANNED_KEYS keys, what they begin with filters a text's pairs of letters where they are made.
    """
    start = F.substring("key", 1, 2)
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("clean") - 1), lambda i: F.substring(F.col("clean"), i, F.lit(2))))
    texts = clean.where(F.length("clean") >= 2)
    if _small(keys, SCANNED_KEYS):
        starts = [r[0] for r in keys.select(start.alias("start")).distinct().collect()]
        met = texts.select("query_id", "clean", F.explode(F.array_intersect(pairs, F.array(*map(F.lit, starts)).cast("array<string>"))).alias("start"))
        return met.join(F.broadcast(keys.select("key", start.alias("start"))), "start").where(F.col("clean").contains(F.col("key"))).select("query_id", "key")
    met = texts.select("query_id", F.explode(pairs).alias("start")).join(keys.select("key", start.alias("start")), "start").select("query_id", "key").distinct()
    return met.join(texts, "query_id").where(F.col("clean").contains(F.col("key"))).select("query_id", "key")


def text_keys(queries: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """``query_id, key``: tags and links written in a query, and lexicon keys that are a term or, from two letters on, a part of it."""
    plain = queries.select("query_id", F.explode(query_tags(F.col(text))).alias("key"))
    clean = queries.select("query_id", strip_emoji(F.col(text)).alias("clean"))
    by_term = clean.select("query_id", F.explode(F.array_distinct(terms_of(F.col("clean")))).alias("key")).join(lexicon, "key", "left_semi").select("query_id", "key")
    inside = _key_parts(clean, lexicon.where(F.length("key") >= 2).select("key").distinct())
    return plain.unionAll(by_term).unionAll(inside).distinct()


def synonym_index(synonyms: DataFrame) -> DataFrame:
    """``key, stems``: the terms of every synonym of ``key, synonym``; a single one-letter term is too vague to count."""
    stems = synonyms.select("key", terms_of(strip_emoji(F.col("synonym"))).alias("stems"))
    return stems.where((F.size("stems") > 1) | ((F.size("stems") == 1) & (F.length(F.element_at("stems", 1)) >= 2))).distinct()


def synonym_keys(queries: DataFrame, stems: DataFrame, doctrines: DataFrame, exact: DataFrame, text: str = "text") -> DataFrame:
    """``query_id, key``: doctrine keys not found exactly, all terms of one of whose synonyms occur in the query.

    A synonym's terms are looked up one by one and counted, so nothing is compared that shares no term.
    """
    body = queries.select("query_id", F.explode(F.array_distinct(terms_of(strip_emoji(F.col(text))))).alias("stem"))
    known = stems.join(doctrines, "key", "left_semi").withColumn("synonym", F.xxhash64("key", "stems"))
    needed = known.select("key", "synonym", F.explode(F.array_distinct("stems")).alias("stem"), F.size(F.array_distinct("stems")).alias("n"))
    met = body.join(needed, "stem").groupBy("query_id", "key", "synonym").agg(F.count("*").alias("found"), F.first("n").alias("n"))
    return met.where("found = n").select("query_id", "key").distinct().join(exact, ["query_id", "key"], "left_anti")


def query_keys(queries: DataFrame, keys: DataFrame, *, synonyms: DataFrame | None = None, key_embeddings: DataFrame | None = None, model: str = "", least: dict[str, float] = KEY_COSINE) -> DataFrame:
    """``query_id, kind, tier, key``: the keys each query asks for: exact, by synonym, by vector.

    `keys` is the index's table of note keys; `synonyms` has ``key, synonym``; for keys by vector the queries need ``embedding``
    and the keys of each kind a cosine of `least`. The lexicon and what texts ask for are written once, as each later tier needs them again.
    """
    lexicon = materialise(keys.where(F.col("kind").isin("doctrine", "tag") & (F.col("key") != "")).select("kind", "key").distinct(), "lexicon")
    lexicons = {kind: lexicon.where(F.col("kind") == kind).select("key") for kind in ("doctrine", "tag")}
    found = materialise(text_keys(queries, lexicon.select("key").distinct()), "written")
    parts = [found.join(lex, "key", "left_semi").select("query_id", F.lit(kind).alias("kind"), F.lit("exact").alias("tier"), "key") for kind, lex in lexicons.items()]
    if synonyms is not None:
        exact = parts[0].select("query_id", "key")
        parts.append(synonym_keys(queries, synonym_index(synonyms), lexicons["doctrine"], exact).select("query_id", F.lit("doctrine").alias("kind"), F.lit("synonym").alias("tier"), "key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    if key_embeddings is not None:
        text_found = out = materialise(out, "text-keys")
        for kind, lex in lexicons.items():
            near = vector_keys(key_embeddings, queries, model, kind, allow=lex, exclude=text_found.where(F.col("kind") == kind).select("query_id", "key"), least=least[kind])
            out = out.unionAll(near.select("query_id", F.lit(kind).alias("kind"), F.lit("vector").alias("tier"), "key"))
    return out.distinct()


def tag_scores(index: Index, keys: DataFrame, top: int = 10, *, sources: DataFrame | None = None) -> DataFrame:
    """``query_id, note_path, category_id, note_weight, raw, final_score, total, rank``: notes by the keys they share with a query.

    `keys` is from `query_keys`; a key counts once per kind, by its best tier. `sources`
    (``query_id, source_path``) names the note a query comes from, which is left out. Sums add up in blocks of notes (`best_sums`), which
    keep as many more of each query's best as any query may have to leave out.
    """
    keys = materialise(keys, "keys")
    weight = F.coalesce(*[F.when((F.col("kind") == k) & (F.col("tier") == t), w) for (k, t), w in TIERS.items()])
    asked = keys.withColumn("w", weight).where("w is not null").groupBy("query_id", "kind", "key").agg(F.max("w").alias("w"))
    total = keys.groupBy("query_id").agg(F.countDistinct("key").alias("total"))
    number = materialise(asked.select("kind", "key").distinct().withColumn("id", F.monotonically_increasing_id()), "key-ids")
    few = F.broadcast if _small(number) else lambda x: x
    have = index.note_keys.select("note_path", "kind", "key").distinct().join(few(number), ["kind", "key"])
    held = have.groupBy("note_path").agg(F.collect_list(F.struct(F.col("id").alias("key"), F.lit(1.0).alias("value"))).alias("held"))
    notes = index.notes.select(F.col("path").alias("note_path"), "category_id", F.col("weight").alias("note_weight"))
    docs = materialise(with_dense_ids(held.join(notes, "note_path"), "doc", "note_path"), "keyed")
    wants = asked.join(few(number), ["kind", "key"]).groupBy("query_id").agg(F.collect_list(F.struct(F.col("id").alias("key"), F.col("w").alias("weight"))).alias("wants"))
    own = None if sources is None else sources.select("query_id", F.col("source_path").alias("note_path"))
    gone = 0 if own is None else own.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0
    best = best_sums(docs.select("doc", F.col("note_weight").alias("factor"), "held"), wants, top + gone, docs.count())
    known = docs.drop("held")
    scored = best.withColumnRenamed("total", "raw").join(F.broadcast(known) if _small(known) else known, "doc").drop("doc")
    if own is not None:
        scored = scored.join(own, ["query_id", "note_path"], "left_anti")
    scored = scored.withColumn("final_score", F.col("raw") * F.col("note_weight")).join(total, "query_id")
    return top_k(scored, top, "final_score", "note_path")


def tag_search(index: Index, keys: DataFrame, top: int = 10, *, sources: DataFrame | None = None) -> DataFrame:
    """Hits by keys: the best notes of `tag_scores`, each with its first chunk; notes without chunks are dropped after ranking."""
    best = materialise(tag_scores(index, keys, top, sources=sources), "best")
    wanted = best.select("note_path").distinct()
    first = index.chunks.join(F.broadcast(wanted) if _small(wanted) else wanted, "note_path", "left_semi").groupBy("note_path").agg(F.min_by(F.struct("chunk_id", "heading", "text"), "ord").alias("c"))
    hits = best.join(first, "note_path")
    none = F.lit(None)
    return hits.select(
        "query_id", F.col("c.chunk_id").alias("chunk_id"), "note_path", title_of(F.col("note_path")).alias("note_title"), F.col("c.heading").alias("heading"),
        preview(F.col("c.text"), 200).alias("preview"), F.col("c.text").alias("full_text"), "category_id", "note_weight", F.lit(0.0).alias("rrf_score"), "final_score",
        none.cast("int").alias("bm25_rank"), none.cast("int").alias("vector_rank"), none.cast("double").alias("bm25_score"), none.cast("double").alias("vector_score"),
        F.lit(False).alias("heading_matched"), F.floor(F.col("raw") + 0.5).cast("int").alias("matched_query_terms"), F.col("total").cast("int").alias("query_terms_total"),
    )


def usable_queries(queries: DataFrame, shortest: int = 10, text: str = "text") -> DataFrame:
    return queries.where(~is_blank(F.col(text)) & (F.length(text) >= shortest))
