"""The index: notes, chunks, postings, statistics and keys, as one lineage from note texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_hangul
from ..runtime import materialise, spread, tasks
from .chunking import MOST, chunk_notes
from .classify import classify, reapply
from .ids import with_dense_ids
from .parsing import note_keys, with_parts
from .tokenize import term_of_word, terms_of, words_of

#: Schemas of the index tables.
SCHEMAS = {
    "notes": "path string, mtime long, size long, category_id string, weight double, indexed_at long",
    "chunks": "chunk_id long, note_path string, ord int, heading string, text string",
    "postings": "chunk_id long, term string, tf long",
    "chunk_stats": "chunk_id long, length long",
    "term_stats": "term string, df long",
    "note_keys": "note_path string, kind string, key string",
    "embeddings": "chunk_id long, model string, dim int, vector array<float>",
    "key_embeddings": "kind string, key string, model string, dim int, vector array<float>, embedded_at long",
}

#: Chunks whose terms make one row of `term_packs`.
CHUNKS_AT_ONCE = 4000
_PACKED = pa.schema([("chunks", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n", pa.list_(pa.int32())), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int32())), ("places", pa.binary()), ("tfs", pa.binary())])


@dataclass(frozen=True)
class Index:
    """The tables of `SCHEMAS`; `lists` has the postings once more, as `term_packs`, where they were counted just now."""

    notes: DataFrame
    chunks: DataFrame
    postings: DataFrame
    chunk_stats: DataFrame
    term_stats: DataFrame
    note_keys: DataFrame
    embeddings: DataFrame
    key_embeddings: DataFrame
    lists: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


def empty_index(spark) -> Index:
    return Index(**{n: spark.createDataFrame([], s) for n, s in SCHEMAS.items()})


def postings_of(chunks: DataFrame, text: str = "text", tokenize: Callable | None = None) -> DataFrame:
    """``chunk_id, term, tf``: how often each term occurs in each chunk.

    Texts are shuffled by chunk before they are split, so that their terms, which are more, need not be.
    """
    terms = (tokenize or terms_of)(F.col(text))
    texts = chunks.select("chunk_id", text).repartition(tasks(chunks.sparkSession), "chunk_id")
    return texts.select("chunk_id", F.explode(terms).alias("term")).groupBy("chunk_id", "term").agg(F.count("*").alias("tf"))


def _packed(b: pa.RecordBatch) -> pa.RecordBatch:
    """The terms of rows as one row: distinct terms, and for each chunk the places and counts of its own."""
    if "words" in b.schema.names:
        words = pc.split_pattern(b.column("words"), " ")
    else:
        words = b.column("terms")
    n, words = words.value_lengths().to_numpy(), words.flatten().dictionary_encode("encode")
    row, which, known = np.repeat(np.arange(len(n)), n), words.indices.to_numpy().astype(np.int64), words.dictionary
    if "words" in b.schema.names:  # each distinct one becomes a term once
        each = [term_of_word(w) if w else None for w in known.to_pylist()]
        numbers = {t: i for i, t in enumerate(dict.fromkeys(t for t in each if t is not None))}
        known = pa.array(numbers, pa.string())
        which = np.array([-1 if t is None else numbers[t] for t in each], np.int64)[which]
        short = np.array([len(t) < 2 for t in numbers] + [False])[which]
        kept = (which >= 0) & (~short | b.column("hangul").to_numpy(zero_copy_only=False)[row])
        row, which = row[kept], which[kept]
        n = np.bincount(row, minlength=len(n))
    pairs, tf = np.unique(row * max(len(known), 1) + which, return_counts=True)
    row, which = np.divmod(pairs, max(len(known), 1))
    df = np.bincount(which, minlength=len(known))
    used = np.flatnonzero(df)
    places = (np.cumsum(df > 0) - 1)[which] if len(used) else which
    one = lambda x, kind: pa.array([x], pa.list_(kind))
    return pa.RecordBatch.from_arrays(
        [
            one(b.column("chunk_id").to_numpy(), pa.int64()), one(n.astype(np.int64), pa.int64()), one(np.bincount(row, minlength=len(n)).astype(np.int32), pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, len(used)], pa.int32()), known.take(pa.array(used))), one(df[used].astype(np.int32), pa.int32()),
            pa.array([places.astype("<i4").tobytes()], pa.binary()), pa.array([tf.astype("<i4").tobytes()], pa.binary()),
        ],
        schema=_PACKED,
    )


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, CHUNKS_AT_ONCE):
            yield _packed(b.slice(i, CHUNKS_AT_ONCE))


def unpacked(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Of each row of `term_packs` the chunks, their lengths, how many terms each has, the distinct terms, and the places among these and counts of each chunk's."""
    for i in range(b.num_rows):
        chunks, lengths, n, terms = (b.column(c).slice(i, 1).flatten() for c in ("chunks", "lengths", "n", "terms"))
        yield chunks, lengths, n.to_numpy(), terms, *(np.frombuffer(b.column(c)[i].as_buffer(), "<i4") for c in ("places", "tfs"))


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("chunk_id", pa.int64()), ("length", pa.int64()), ("terms", pa.list_(pa.string())), ("tfs", pa.list_(pa.int32()))])
    for b in batches:
        for chunks, lengths, n, terms, places, tfs in unpacked(b):
            ends = pa.array(np.append(0, np.cumsum(n)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([chunks, lengths, pa.ListArray.from_arrays(ends, terms.take(pa.array(places))), pa.ListArray.from_arrays(ends, pa.array(tfs))], schema=schema)


def term_packs(chunks: DataFrame, text: str = "text", tokenize: Callable | None = None) -> DataFrame:
    """The terms of `chunks`, counted where these are read, a row for some thousand of them.

    ``chunks, lengths, n, terms, dfs, places, tfs``: chunk ids, lengths, and numbers of distinct terms; the distinct terms of all and in how many chunks each
    is; then, chunk by chunk, places among `terms` and counts, as bytes of 32-bit numbers. By the rule of `terms_of`, only words are split in the JVM; what
    they become is found for each distinct word.
    """
    c = F.col(text)
    if tokenize:
        terms = [F.coalesce(tokenize(c), F.array().cast("array<string>")).alias("terms")]
    else:
        terms = [words_of(c).alias("words"), F.coalesce(has_hangul(c), F.lit(False)).alias("hangul")]
    schema = "chunks array<long>, lengths array<long>, n array<int>, terms array<string>, dfs array<int>, places binary, tfs binary"
    return spread(chunks.select("chunk_id", text)).select("chunk_id", *terms).mapInArrow(_pack, schema)


def lists_of(packs: DataFrame) -> DataFrame:
    """``chunk_id, length, terms, tfs``: `term_packs` with a row for each chunk."""
    return packs.mapInArrow(_unpack, "chunk_id long, length long, terms array<string>, tfs array<int>")


def term_lists(chunks: DataFrame, text: str = "text", tokenize: Callable | None = None) -> DataFrame:
    """``chunk_id, length, terms, tfs``: the distinct terms of each row of `chunks` and how often each occurs."""
    return lists_of(term_packs(chunks, text, tokenize))


def chunk_lengths(postings: DataFrame) -> DataFrame:
    return postings.groupBy("chunk_id").agg(F.sum("tf").alias("length"))


def term_records(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus(chunks: DataFrame, chunk_stats: DataFrame) -> tuple[int, float]:
    """Number of chunks and mean length; chunks without terms count."""
    n = chunks.count()
    total = chunk_stats.agg(F.sum("length")).first()[0] or 0
    return n, total / n if n else 0.0


def index_chunks(notes: DataFrame, chunks: DataFrame, *, keys: DataFrame | None = None, embeddings: DataFrame | None = None, key_embeddings: DataFrame | None = None, tokenize: Callable | None = None) -> Index:
    """An index over chunks that exist already; the lists of their terms are written once, and the statistics taken from these.

    Rows of one chunk id count as one chunk: where there are any, the postings are added up by chunk and term, and there are no lists.
    """
    none = empty_index(chunks.sparkSession)
    lists: DataFrame | None = materialise(term_packs(chunks, tokenize=tokenize), "lists")
    each = lists.select(F.explode(F.arrays_zip("chunks", "lengths")).alias("c")).select(F.col("c.chunks").alias("chunk_id"), F.col("c.lengths").alias("length"))
    found = each.agg(F.count("*").alias("rows"), F.countDistinct("chunk_id").alias("ids")).first()
    postings = lists_of(lists).select("chunk_id", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("chunk_id", F.col("p.terms").alias("term"), F.col("p.tfs").cast("long").alias("tf"))
    if found["rows"] == found["ids"]:
        terms = lists.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
        lengths, records = each.where("length > 0"), terms.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))
    else:
        postings, lists = materialise(postings.groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf")), "postings"), None
        lengths, records = materialise(chunk_lengths(postings), "lengths"), term_records(postings)
    keys, embeddings, key_embeddings = (b if a is None else a for a, b in ((keys, none.note_keys), (embeddings, none.embeddings), (key_embeddings, none.key_embeddings)))
    return Index(notes, chunks, postings, lengths, materialise(records, "records"), keys, embeddings, key_embeddings, lists)


def build_index(notes: DataFrame, folders: DataFrame, excluded: list[str] | None = None, *, lexicon: DataFrame | None = None, indexed_at: int = 0, most: int = MOST, dense_ids: bool = True, tokenize: Callable | None = None) -> Index:
    """The whole index from ``path, mtime, size, content``.

    Excluded and unmatched notes are left out. Chunk ids count in the order of (path, ord);
    with `dense_ids` off they are 64-bit hashes of it, which needs no ordering.
    """
    used = classify(notes, folders, excluded)
    parsed = with_parts(used)
    chunks = chunk_notes(parsed, tags="tags", most=most)
    if dense_ids:
        chunks = with_dense_ids(chunks, "chunk_id", "note_path", "ord")
    else:
        chunks = chunks.withColumn("chunk_id", F.xxhash64("note_path", "ord"))
    chunks = chunks.select("chunk_id", "note_path", "ord", "heading", "text")
    facts = used.select("path", "mtime", "size", "category_id", "weight", F.lit(indexed_at).cast("long").alias("indexed_at"))
    return index_chunks(facts, chunks, keys=note_keys(parsed, lexicon), tokenize=tokenize)


def with_folders(index: Index, folders: DataFrame, excluded: list[str] | None = None) -> Index:
    """The index with groups and weights of new folders; texts and terms stay as they are."""
    return replace(index, notes=reapply(index.notes, folders, excluded))


def latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Of the rows of each key the last by `order`: what an upsert in that order leaves."""
    value = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("__row")).select(*keys, "__row.*").select(*rows.columns)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """`table` with the rows of `changes` in place of those of the same keys."""
    return table.join(changes.select(*keys), keys, "left_anti").select(*table.columns).unionByName(changes.select(*table.columns))


def delete_keys(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti").select(*table.columns)


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """``chunk_id, text``: chunks with text and without a vector of the model."""
    from ..functions.text import is_blank

    have = embeddings.where(F.col("model") == model).select("chunk_id")
    return chunks.where(~is_blank(F.col("text"))).join(have, "chunk_id", "left_anti").select("chunk_id", "text")


def embedding_coverage(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``model, done, pending, state``: chunks with and without a vector by model; empty, pending or complete."""
    total = F.lit(chunks.count())
    done = embeddings.groupBy("model").agg(F.countDistinct("chunk_id").alias("done"))
    state = F.when(total == 0, "empty").when(F.col("done") >= total, "complete").otherwise("pending")
    return done.select("model", "done", F.greatest(total - F.col("done"), F.lit(0)).alias("pending"), state.alias("state"))


def embedding_of(embeddings: DataFrame, chunk_id: int) -> DataFrame:
    """``model, vector`` of one chunk; the filter reaches the scan."""
    return embeddings.where(F.col("chunk_id") == chunk_id).select("model", "vector")


def key_embedding_of(key_embeddings: DataFrame, kind: str, key: str) -> DataFrame:
    """``model, vector`` of one key."""
    return key_embeddings.where((F.col("kind") == kind) & (F.col("key") == key)).select("model", "vector")


def lexicon(keys: DataFrame, kind: str | None = None) -> DataFrame:
    """``key``: the distinct keys of a kind, or of both."""
    return (keys if kind is None else keys.where(F.col("kind") == kind)).where("key <> ''").select("key").distinct()


def embedding_state(key_embeddings: DataFrame, model: str) -> DataFrame:
    """``kind, n, last, fingerprint``: how many keys of a model have vectors, since when."""
    g = key_embeddings.where(F.col("model") == model).groupBy("kind").agg(F.count("*").alias("n"), F.coalesce(F.max("embedded_at"), F.lit(0)).alias("last"))
    return g.withColumn("fingerprint", F.concat(F.col("n").cast("string"), F.lit(":"), F.col("last").cast("string")))


def synonym_coverage(keys: DataFrame, synonyms: DataFrame) -> DataFrame:
    """``keys, covered, synonyms, mean``: how many keys (``key``) have synonyms (``key, synonym``), and how many."""
    counted = keys.select("key").distinct().join(synonyms.groupBy("key").agg(F.count("*").alias("n")), "key", "left")
    got = counted.agg(F.count("*").alias("keys"), F.count("n").alias("covered"), F.coalesce(F.sum("n"), F.lit(0)).alias("synonyms"))
    return got.withColumn("mean", F.try_divide("synonyms", "covered"))
