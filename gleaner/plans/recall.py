"""The engine: reindex, reapply, embed, recall."""

from __future__ import annotations

import time
from collections import OrderedDict
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.text import title_of
from ..operators import index as ix
from ..operators import present, search
from ..operators.tokenize import terms_of
from ..runtime import discarding, materialise
from ..sources.providers import Embedder, embed, embed_keys, embed_missing
from ..sources.store import Store

#: Hits a search brings and notes that are shown.
SEARCHED, SHOWN = 30, 10
#: Fixed value: results that a cache keeps.
KEPT = 50
#: Chunks that are embedded between two commits.
COMMITTED = 100_000


def prepare(queries: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """`queries` (``query_id, text, source_path``) with ``terms`` and ``embedding``; equal texts are embedded once. Too short ones are dropped."""
    rows = search.usable_queries(queries).withColumn("terms", terms_of(F.col("text")))
    if embedder is None:
        return rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    vectors = embed(rows.select(F.xxhash64("text").alias("k"), "text").dropDuplicates(["k"]), embedder)
    return rows.withColumn("k", F.xxhash64("text")).join(vectors.withColumnRenamed("vector", "embedding"), "k", "left").drop("k")


def semantic(index: ix.Index, queries: DataFrame, model: str, options: search.Options = search.Options(top=SEARCHED), shown: int = SHOWN) -> DataFrame:
    """Semantic hits of each query as they are shown: without its own note, one per title, the best `shown`; texts come last."""
    hits = search.hybrid_scores(index, queries, model, options).withColumn("note_title", title_of(F.col("note_path")))
    hits = present.dedupe(present.without_source(hits, queries))
    return search.with_texts(search.top_k(hits, shown, "final_score", "chunk_id").drop("rank"), index.chunks)


def by_tags(index: ix.Index, queries: DataFrame, model: str = "", *, synonyms: DataFrame | None = None, vectors: bool = False, top: int = SEARCHED, shown: int = SHOWN) -> DataFrame:
    """Hits by keys of each query as they are shown."""
    keys = search.query_keys(queries, index.note_keys, synonyms=synonyms, key_embeddings=index.key_embeddings if vectors else None, model=model)
    sources = queries.where("source_path is not null").select("query_id", "source_path")
    hits = search.tag_search(index, keys, top, sources=sources)
    return search.top_k(present.dedupe(hits), shown, "final_score", "chunk_id").drop("rank")


def recall(index: ix.Index, queries: DataFrame, mode: str = "semantic", model: str = "", relevance: int = 10, pinned: DataFrame | None = None, **how) -> DataFrame:
    """What is shown for each query in a mode: hits by tab and place."""
    hits = by_tags(index, queries, model, **how) if mode == "tag" else semantic(index, queries, model, **how)
    return present.present(hits, relevance, pinned)


def all_paths(semantic_hits: DataFrame, tag_hits: DataFrame) -> DataFrame:
    """``query_id, note_path, mode``: the notes of both modes' hits put together, one row per hit; a note that both find comes twice."""
    return semantic_hits.select("query_id", "note_path", F.lit("semantic").alias("mode")).unionAll(tag_hits.select("query_id", "note_path", F.lit("tag").alias("mode")))


class Engine:
    """Settings, a store and an embedder together."""

    def __init__(self, spark: SparkSession, store: Store, settings: config.Settings, embedder: Embedder | None = None):
        self.spark, self.store, self.settings, self.embedder = spark, store, settings, embedder

    def _folders(self) -> DataFrame:
        return config.folders_frame(self.spark, self.settings)

    def reindex(self, notes: DataFrame) -> dict:
        """Builds everything anew from ``path, mtime, size, content`` and puts it in the store's place; keys keep their vectors."""
        began = time.time()
        lexicon = self.spark.createDataFrame([(k,) for k in self.settings.keywords], "key string") if self.settings.keywords else None
        with self.store.writing(), discarding():
            index = ix.build_index(notes, self._folders(), list(self.settings.excluded), lexicon=lexicon, indexed_at=int(began * 1000))
            index = replace(index, key_embeddings=self.store.load_index().key_embeddings)
            self.store.save_index(index, folders=config.fingerprint(self.settings))
            if self.embedder:
                self._embed()
        saved = self.store.load_index()
        return {"notes": saved.notes.count(), "chunks": saved.chunks.count(), "seconds": time.time() - began}

    def reapply(self) -> int:
        """Groups and weights of the present folders for all notes; only the notes are written. How many there are."""
        with self.store.writing():
            notes = ix.with_folders(self.store.load_index(), self._folders(), list(self.settings.excluded)).notes
            self.store.save({"notes": notes}, folders=config.fingerprint(self.settings))
        return self.store.table("notes").count()

    def embed(self, at_once: int = COMMITTED) -> int:
        """Vectors for chunks that have none, committed `at_once` chunks at a time: a failure keeps what was done. How many have one."""
        with self.store.writing(), discarding():
            self._embed(at_once)
        return self.store.table("embeddings").count()

    def _embed(self, at_once: int = COMMITTED) -> None:
        index = self.store.load_index()
        missing = ix.missing_embeddings(index.chunks, index.embeddings, self.embedder.model).select("chunk_id")
        missing = materialise(missing, "missing")
        parts = max(1, -(-missing.count() // at_once))
        none = self.spark.createDataFrame([], ix.SCHEMAS["embeddings"])
        for i in range(parts):
            part = missing.where(F.pmod(F.xxhash64("chunk_id"), F.lit(parts)) == i)
            self.store.append("embeddings", embed_missing(index.chunks.join(part, "chunk_id", "left_semi"), none, self.embedder))
        # one vector per chunk stays: the new one
        if not index.embeddings.join(missing, "chunk_id", "left_semi").isEmpty():
            new = self.store.table("embeddings").where(F.col("model") == self.embedder.model)
            self.store.save({"embeddings": ix.upsert(index.embeddings, new, ["chunk_id"])})

    def embed_keys(self, kind: str, rebuild: bool | None = None) -> int:
        """Vectors for the keys of a kind: doctrines always anew and with synonyms, tags where missing."""
        doctrine = kind == "doctrine"
        synonyms = [(k, w) for k, words in self.settings.synonyms.items() for w in words]
        words = self.spark.createDataFrame(synonyms, "key string, synonym string") if doctrine and synonyms else None
        with self.store.writing():
            index = self.store.load_index()
            out = embed_keys(ix.lexicon(index.note_keys, kind), index.key_embeddings, kind, self.embedder, int(time.time() * 1000), synonyms=words, rebuild=doctrine if rebuild is None else rebuild)
            self.store.save({"key_embeddings": out})
        return self.store.table("key_embeddings").where(F.col("kind") == kind).count()

    def in_sync(self) -> bool:
        """Whether the index was built or reapplied under the present folders."""
        return self.store.meta("folders") == config.fingerprint(self.settings)

    def recall(self, queries: DataFrame, mode: str | None = None, pinned: DataFrame | None = None) -> DataFrame:
        mode = mode or self.settings.mode
        model = self.embedder.model if self.embedder else ""
        asked = prepare(queries, self.embedder)
        how = {}
        if mode == "tag":
            synonyms = [(k, w) for k, words in self.settings.synonyms.items() for w in words]
            how = {"synonyms": self.spark.createDataFrame(synonyms, "key string, synonym string") if synonyms else None, "vectors": self.embedder is not None}
        return recall(self.store.load_index(), asked, mode, model, self.settings.relevance, pinned, **how)

    def next_step(self) -> str:
        """What is to be done next: folders (none is set up), index (none, or under other folders), embed (chunks without vectors), none."""
        if not self.settings.folders:
            return "folders"
        index = self.store.load_index()
        if index.chunks.isEmpty() or not self.in_sync():
            return "index"
        if self.embedder and not ix.missing_embeddings(index.chunks, index.embeddings, self.embedder.model).isEmpty():
            return "embed"
        return "none"

    def all_paths(self, queries: DataFrame) -> DataFrame:
        """`all_paths` of what `recall` gives in either mode, whatever the setting."""
        return all_paths(self.recall(queries, "semantic"), self.recall(queries, "tag"))


class Recaller:
    """Answers single queries of an editor: keeps the newest `most` results, of either mode, until the store or the settings change."""

    def __init__(self, engine: Engine, most: int = KEPT):
        self.engine, self.most = engine, most
        self.kept: OrderedDict[tuple, tuple[list[Row], float]] = OrderedDict()
        self.state: tuple = ()

    def _fresh(self) -> None:
        m = self.engine.store.manifest()
        state = repr(m["tables"]), repr(m["meta"]), repr(self.engine.settings)
        if state != self.state:
            self.kept.clear()
            self.state = state

    def recall(self, text: str, source_path: str | None = None, mode: str | None = None) -> tuple[list[Row], float]:
        """The hits shown for a text and the seconds that finding them took; asked again, the same from memory."""
        self._fresh()
        key = mode or self.engine.settings.mode, text, source_path
        if key in self.kept:
            self.kept.move_to_end(key)
            return self.kept[key]
        began = time.perf_counter()
        asked = self.engine.spark.createDataFrame([(1, text, source_path)], "query_id long, text string, source_path string")
        with discarding():
            rows = self.engine.recall(asked, key[0]).orderBy("tab", "place").collect()
        self.kept[key] = rows, time.perf_counter() - began
        while len(self.kept) > self.most:
            self.kept.popitem(last=False)
        return self.kept[key]
