"""The engine's operators over the test tables, one query each; scores come out rounded to six digits."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions import scoring, text
from ..functions.paths import normal_paths
from ..operators import classify, index, parsing, present, search, timings
from ..operators.chunking import chunk_notes, sections
from ..operators.parsing import note_keys, with_parts
from ..operators.tokenize import terms_of
from ..runtime import materialise, scratch_dir, spread, table
from ..sources import providers, store
from ..sources.vault import is_note, paragraph_at, query_contexts
from ..streaming import reactive
from .recall import SEARCHED, SHOWN, all_paths, semantic

Query = Callable[[SparkSession, str], DataFrame]
MODEL, TRASH = "note-embed-s", [".trash/"]
#: Events of the test table are minutes apart.
PAUSE = 3_600_000
#: Cosines from which a key is near here; means of many vectors are further from any one than single ones are.
NEAR_KEY = {"doctrine": 0.1, "tag": 0.15}


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Every note once, as it was indexed last."""
    return index.latest(table(spark, sf, "notes"), ["path"], "indexed_at", "mtime", "size")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that have their dim and only numbers; a row delivered twice once."""
    good = table(spark, sf, "chunk_vectors").where("vector is not null and size(vector) = dim").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    return good.groupBy("chunk_id", "model", "dim").agg(F.min("vector").alias("vector"))


def tag_keys(spark: SparkSession, sf: str) -> DataFrame:
    """note_tags in plain form: note_path, kind, key; each once."""
    key = text.normalize_tag(F.col("tag_key"))
    return table(spark, sf, "note_tags").select("note_path", F.lit("tag").alias("kind"), key.alias("key")).where("key <> ''").distinct()


def the_index(spark: SparkSession, sf: str) -> index.Index:
    return index.index_chunks(notes(spark, sf), table(spark, sf, "chunks"), keys=tag_keys(spark, sf), embeddings=vectors(spark, sf))


def keyed_index(spark: SparkSession, sf: str, keys: DataFrame, near: DataFrame | None = None) -> index.Index:
    """Without postings, which a search by keys doesn't read."""
    ix = replace(index.empty_index(spark), notes=notes(spark, sf), chunks=table(spark, sf, "chunks"), note_keys=keys)
    return ix if near is None else replace(ix, key_embeddings=near)


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The query set: chunks whose id is divisible by 20, asking with their heading, or text where there is none, and their vector."""
    chunks = table(spark, sf, "chunks").where("chunk_id % 20 = 0")
    vector = vectors(spark, sf).where(F.col("model") == MODEL).where("dim = 64").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("embedding"))
    said = F.coalesce(F.when(~text.is_blank(F.col("heading")), F.col("heading")), F.col("text"))
    rows = chunks.select(F.col("chunk_id").alias("query_id"), F.col("note_path").alias("source_path"), said.alias("text")).withColumn("terms", terms_of(F.col("text")))
    return materialise(rows.join(vector, "query_id", "left"), "queries")


def scan_notes(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-01, FLT-01/02, JOIN-06: notes in weighted folders."""
    found = classify.classify(notes(spark, sf).select("path", "mtime", "size"), table(spark, sf, "folders"), TRASH)
    return found.select("path", "category_id", r6("weight").alias("weight"))


def reapply_folders(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-11, OP-02: groups and weights anew for all notes."""
    return classify.reapply(notes(spark, sf), table(spark, sf, "folders"), TRASH).select("path", "category_id", r6("weight").alias("weight"))


def latest_notes(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-07: what upserts in the order of indexing leave."""
    return notes(spark, sf).select("path", "mtime", "size", "indexed_at")


def suggest_folders(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-20, FN-28, SRT-11: the first 100 folders with "20" in their path."""
    return classify.suggest_folders(table(spark, sf, "notes"), "20")


def _settings(spark: SparkSession, sf: str) -> config.Settings:
    """Settings with the folders of the test tables; folders are configuration."""
    rows = table(spark, sf, "folders").orderBy("pos").collect()
    return config.Settings(folders=tuple(config.Folder(r["path"], r["group_id"], r["weight"]) for r in rows))


def folders_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-18, OP-16."""
    return spark.createDataFrame([(config.fingerprint(_settings(spark, sf)),)], "fingerprint string")


def folder_factors(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-03/04: weights to factors and back."""
    rows = [(f.path, round(config.to_factor(f.weight), 6), config.from_factor(config.to_factor(f.weight))) for f in _settings(spark, sf).folders]
    return spark.createDataFrame(rows, "path string, factor double, weight long")


def path_factors(spark: SparkSession, sf: str) -> DataFrame:
    """OP-17: the factor of each folder's own path, one by one."""
    s = _settings(spark, sf)
    rows = [(f.path, config.folder_factor(s, f.path + "x.md")) for f in s.folders]
    return spark.createDataFrame(rows, "path string, factor double").select("path", r6("factor").alias("factor"))


def plain_tags(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-06, FN-05: tag keys in plain form, each once a note."""
    return tag_keys(spark, sf).select("note_path", "key")


def note_key_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """note_path, kind, key: for want of doctrines in the test tables, keys of an even number of characters are such."""
    return tag_keys(spark, sf).withColumn("kind", F.when(F.length("key") % 2 == 0, "doctrine").otherwise("tag"))


def key_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """For every key the mean vector of the chunks of its notes; as a time, when the last of these was indexed."""
    keys = note_key_kinds(spark, sf)
    vector = vectors(spark, sf).where(F.col("model") == MODEL).where("dim = 64").select("chunk_id", "vector")
    facts = keys.join(table(spark, sf, "chunks").select("note_path", "chunk_id"), "note_path").join(vector, "chunk_id")
    each = facts.select("kind", "key", F.posexplode("vector").alias("pos", "x")).groupBy("kind", "key", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    mean = each.groupBy("kind", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda p: p["m"]).alias("vector"))
    at = keys.join(notes(spark, sf).select(F.col("path").alias("note_path"), "indexed_at"), "note_path").groupBy("kind", "key").agg(F.max("indexed_at").alias("embedded_at"))
    return materialise(mean.join(at, ["kind", "key"]).select("kind", "key", F.lit(MODEL).alias("model"), F.lit(64).alias("dim"), "vector", "embedded_at"), "key-vectors")


def key_synonyms(spark: SparkSession, sf: str) -> DataFrame:
    """key, synonym: for want of others, the headings of a doctrine's notes that sort first and last."""
    heads = table(spark, sf, "chunks").where(~text.is_blank(F.col("heading"))).select("note_path", "heading")
    met = note_key_kinds(spark, sf).where("kind = 'doctrine'").join(heads, "note_path").groupBy("key").agg(F.min("heading").alias("a"), F.max("heading").alias("b"))
    return met.select("key", F.explode(F.array_distinct(F.array("a", "b"))).alias("synonym"))


def tag_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-14, OP-11, SET-01/02: the distinct keys of each kind, and of both together."""
    keys = note_key_kinds(spark, sf)
    out = index.lexicon(keys).withColumn("kind", F.lit("both"))
    for kind in ("doctrine", "tag"):
        out = out.unionAll(index.lexicon(keys, kind).withColumn("kind", F.lit(kind)))
    return out


def vector_keys(spark: SparkSession, sf: str) -> DataFrame:
    """OP-08, SRC-06, FLT-15/17, JOIN-14, SRT-03, SET-04: keys near each query that it does not write itself."""
    queries, kinds, near = asked(spark, sf), note_key_kinds(spark, sf), key_vectors(spark, sf)
    written = materialise(search.text_keys(queries, index.lexicon(kinds)), "written")
    out = [search.vector_keys(near, queries, MODEL, kind, allow=index.lexicon(kinds, kind), exclude=written, least=NEAR_KEY[kind]).withColumn("kind", F.lit(kind)) for kind in NEAR_KEY]
    return out[0].unionAll(out[1]).select("query_id", "kind", "key", r6("similarity").alias("similarity"))


def query_keys_synonym(spark: SparkSession, sf: str) -> DataFrame:
    """FN-23/27, JOIN-09, FLT-19: doctrines by the words of their synonyms."""
    queries, kinds = asked(spark, sf), note_key_kinds(spark, sf)
    return search.query_keys(queries, kinds, synonyms=key_synonyms(spark, sf)).select("query_id", "kind", "tier", "key")


def _tiers(spark: SparkSession, sf: str, queries: DataFrame) -> tuple[index.Index, DataFrame]:
    kinds, near = note_key_kinds(spark, sf), key_vectors(spark, sf)
    return keyed_index(spark, sf, kinds, near), search.query_keys(queries, kinds, synonyms=key_synonyms(spark, sf), key_embeddings=near, model=MODEL, least=NEAR_KEY)


def tag_search_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """OP-10, FN-35: all tiers: doctrines written, by synonym, by vector; tags written and by vector."""
    queries = asked(spark, sf)
    ix, keys = _tiers(spark, sf, queries)
    found = search.tag_search(ix, keys, SHOWN, sources=queries.select("query_id", "source_path"))
    return _hit(found).select("query_id", "chunk_id", "note_path", "final_score", "matched_query_terms", "query_terms_total")


def both_modes(spark: SparkSession, sf: str) -> DataFrame:
    """OP-14, SET-07: the notes that are shown in either mode."""
    queries = asked(spark, sf)
    ix, keys = _tiers(spark, sf, queries)
    hits = present.dedupe(search.tag_search(ix, keys, SEARCHED, sources=queries.select("query_id", "source_path")))
    shown = search.top_k(hits, SHOWN, "final_score", "chunk_id")
    return all_paths(semantic(the_index(spark, sf), queries, MODEL), shown)


def key_state(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-12/13/15: how many keys have vectors, since when."""
    return index.embedding_state(key_vectors(spark, sf), MODEL).select("kind", "n", "last", "fingerprint")


def synonym_stats(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-17."""
    got = index.synonym_coverage(index.lexicon(note_key_kinds(spark, sf), "doctrine"), key_synonyms(spark, sf))
    return got.select("keys", "covered", "synonyms", r6("mean").alias("mean"))


def key_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-10, FN-10, FLT-24: what is embedded for each doctrine."""
    return providers.key_texts(index.lexicon(note_key_kinds(spark, sf), "doctrine"), key_synonyms(spark, sf))


def synonym_json(spark: SparkSession, sf: str) -> DataFrame:
    """FN-41, FLT-25: lists of synonyms to JSON and what can be used of it back."""
    lists = key_synonyms(spark, sf).groupBy("key").agg(F.collect_list("synonym").alias("words"))
    said = lists.select(F.to_json(F.create_map("key", F.concat("words", F.array("key", F.lit(" x "))))).alias("json"))
    return said.select(F.explode(text.synonym_lists(F.col("json"))).alias("key", "words")).select("key", F.explode("words").alias("synonym"))


def vector_dim_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-13: every query vector of any model and length, whatever its `dim` says, against those of its own model and length."""
    rows = table(spark, sf, "chunk_vectors").where("vector is not null").where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x)))
    rows = materialise(rows.groupBy("chunk_id", "model", F.size("vector").alias("length")).agg(F.min("vector").alias("vector")), "any-vectors")
    number = F.when(F.col("model") == MODEL, 0).when(F.col("model") == "note-embed-w", 1).otherwise(2)
    queries = rows.where("chunk_id % 20 = 0").select((F.col("chunk_id") * 3000 + number * 1000 + F.col("length")).alias("query_id"), "model", F.col("vector").alias("embedding"))
    found = search.vector_search(rows, queries, k=SHOWN)
    return found.select("query_id", "chunk_id", r6("vector_score").alias("vector_score"), F.col("vector_rank").cast("long").alias("vector_rank"))


def hybrid_no_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """OP-09 without vectors: queries that none could be made for."""
    queries = asked(spark, sf).withColumn("embedding", F.lit(None).cast("array<float>"))
    found = search.hybrid_scores(the_index(spark, sf), queries, MODEL, search.Options(top=SHOWN))
    return _hit(found).select("query_id", "chunk_id", "final_score", "bm25_rank", "matched_query_terms")


def one_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-07: the vector of one chunk, the first that has any."""
    rows = vectors(spark, sf)
    first = rows.agg(F.min("chunk_id")).first()[0]
    return index.embedding_of(rows, first).select("model", F.size("vector").cast("long").alias("length"))


def one_key_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-08: that of one key."""
    rows = key_vectors(spark, sf)
    first = rows.where("kind = 'doctrine'").agg(F.min("key")).first()[0]
    return index.key_embedding_of(rows, "doctrine", first).select("model", F.size("vector").cast("long").alias("length"))


def vector_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """FN-40: vectors to bytes and back."""
    back = store.vectors_from_bytes(store.vectors_to_bytes(vectors(spark, sf)))
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("chunk_id", "model", F.size("vector").cast("long").alias("length"), r6(total).alias("total"))


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    """OP-03, JOIN-16, SRT-13: chunks with a vector of another model get one of the default one; one for each chunk stays."""
    return providers.embed_missing(table(spark, sf, "chunks"), vectors(spark, sf), providers.HashEmbedder()).select("chunk_id", "model", F.col("dim").cast("long").alias("dim"), F.size("vector").cast("long").alias("length"))


def upserted_notes(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-07/08: the first delivery of each note, the last of those that came again put in its place."""
    rows = table(spark, sf, "notes")
    again = rows.groupBy("path").count().where("count > 1").select("path")
    first = rows.groupBy("path").agg(F.min_by(F.struct("mtime", "size", "category_id", "weight", "indexed_at"), F.struct("indexed_at", "mtime", "size")).alias("n")).select("path", "n.*")
    return index.upsert(first, notes(spark, sf).join(again, "path", "left_semi"), ["path"]).select("path", "mtime", "size", "indexed_at")


def kept_tags(spark: SparkSession, sf: str) -> DataFrame:
    """SNK-09: tag keys after those of notes without weight are deleted."""
    gone = notes(spark, sf).where("weight = 0").select(F.col("path").alias("note_path"))
    return index.delete_keys(tag_keys(spark, sf), gone, ["note_path"]).select("note_path", "key")


def markdown_notes(spark: SparkSession, sf: str) -> DataFrame:
    """FLT-03: logged paths that are notes, and how often."""
    return table(spark, sf, "hits").where(is_note(F.col("note_path"))).groupBy("note_path").agg(F.count("*").alias("hits"))


def ages(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-09: how long before it was indexed a note was changed."""
    return notes(spark, sf).select("path", text.ago(F.col("mtime"), F.col("indexed_at")).alias("age"))


def document_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """FN-01: lengths of documents without their front matter."""
    return table(spark, sf, "documents").where("text is not null").select("doc_id", F.length(text.strip_frontmatter(F.col("text"))).cast("long").alias("characters"))


def document_links(spark: SparkSession, sf: str) -> DataFrame:
    """FN-08: link targets with the number of links in each document."""
    links = table(spark, sf, "documents").select("doc_id", F.explode(text.wikilinks(F.col("text"))).alias("link"))
    return links.groupBy("doc_id", "link").agg(F.count("*").alias("links"))


def document_hashtags(spark: SparkSession, sf: str) -> DataFrame:
    """FN-07."""
    return table(spark, sf, "documents").select("doc_id", F.explode(text.hashtags(F.col("text"))).alias("tag")).groupBy("doc_id", "tag").agg(F.count("*").alias("times"))


def link_variants(spark: SparkSession, sf: str) -> DataFrame:
    """FN-06: plain forms of all tag keys as links."""
    keys = table(spark, sf, "note_tags").select("tag_key").distinct()
    return keys.select("tag_key", F.explode(text.link_variants(F.col("tag_key"))).alias("key"))


def document_keys(spark: SparkSession, sf: str) -> DataFrame:
    """FN-19/20/21, JOIN-13, SET-03: keys of every document from front matter, tags and links."""
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return note_keys(with_parts(docs))


def routed_keys(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-13, FN-21: the same with a lexicon of doctrines, to which links of their name lead."""
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return note_keys(with_parts(docs), index.lexicon(note_key_kinds(spark, sf), "doctrine"))


def document_tags(spark: SparkSession, sf: str) -> DataFrame:
    """FN-24: all that a document is tagged with."""
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return parsing.note_tags(with_parts(docs))


def written_tags(spark: SparkSession, sf: str) -> DataFrame:
    """FN-24: tags and links that a text writes."""
    return table(spark, sf, "documents").select("doc_id", F.explode(text.query_tags(F.col("text"))).alias("tag"))


def document_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """FN-18, over whole documents."""
    return table(spark, sf, "documents").select("doc_id", F.explode(text.keywords(F.col("text"))).alias("keyword"))


def highlighted(spark: SparkSession, sf: str) -> DataFrame:
    """FN-17, FLT-26, SRT-10, PRJ-02: the start of each chunk with the terms of its heading marked."""
    start = text.preview(F.col("text"), 80)
    shown = text.highlight_terms(start, terms_of(F.col("heading")))
    return table(spark, sf, "chunks").select("chunk_id", start.alias("start"), shown.alias("shown")).where("start <> shown").drop("start")


def document_sections(spark: SparkSession, sf: str) -> DataFrame:
    """FN-02, WIN-07: sections by heading."""
    body = text.strip_frontmatter(F.col("text"))
    rows = table(spark, sf, "documents").where("text is not null").select("doc_id", F.posexplode(sections(body)).alias("place", "s"))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), F.col("s.heading").alias("heading"), F.length("s.text").cast("long").alias("characters"))


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """FN-03/04, WIN-08: chunks of up to 1,500 characters."""
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return chunk_notes(spread(docs)).select(F.col("note_path").cast("long").alias("doc_id"), F.col("ord").cast("long").alias("ord"), "heading", "text")


def stored_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """OP-01, SNK-05, SRT-07, PRJ-05, SRC-04: documents indexed as notes, written to a store and read again: dense ids, tags in front."""
    path = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md"))
    docs = table(spark, sf, "documents").where("text is not null").select(path.alias("path"), F.lit(0).cast("long").alias("mtime"), F.col("n_chars").alias("size"), F.col("text").alias("content"))
    s = config.Settings(folders=(config.Folder(""),))
    kept = store.Store(spark, f"{scratch_dir(spark)}/gleaner-store-{uuid.uuid4().hex}")
    with kept.writing():
        kept.save_index(index.build_index(spread(docs), config.folders_frame(spark, s)), folders=config.fingerprint(s))
    return kept.load_index().chunks.select("chunk_id", "note_path", F.col("ord").cast("long").alias("ord"), "heading", "text")


def postings(spark: SparkSession, sf: str) -> DataFrame:
    """FN-11..15, AGG-05: term frequencies."""
    return index.postings_of(table(spark, sf, "chunks"))


def chunk_lengths(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-03."""
    return index.chunk_lengths(postings(spark, sf))


def term_records(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-04."""
    return index.term_records(postings(spark, sf))


def corpus_size(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-01/02, SRC-21."""
    n, mean = index.corpus(table(spark, sf, "chunks"), chunk_lengths(spark, sf))
    return spark.createDataFrame([(n, round(n * mean), round(mean, 6))], "chunks long, terms long, mean double")


def bm25(spark: SparkSession, sf: str) -> DataFrame:
    """OP-06, JOIN-04, AGG-06, WIN-01, SRT-01."""
    found = search.bm25(the_index(spark, sf), asked(spark, sf), SEARCHED)
    return found.select("query_id", "chunk_id", r6("bm25_score").alias("bm25_score"), F.col("bm25_rank").cast("long").alias("bm25_rank"))


def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """OP-07, SRC-05, FN-34, FLT-13/16, WIN-02, SRT-02."""
    found = search.vector_search(vectors(spark, sf), asked(spark, sf), MODEL, SEARCHED)
    return found.select("query_id", "chunk_id", r6("vector_score").alias("vector_score"), F.col("vector_rank").cast("long").alias("vector_rank"))


def missing_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """JOIN-03, FLT-04."""
    return index.missing_embeddings(table(spark, sf, "chunks"), table(spark, sf, "chunk_vectors"), MODEL).select("chunk_id")


def embedding_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-11: chunks with and without a vector by model."""
    return index.embedding_coverage(table(spark, sf, "chunks"), table(spark, sf, "chunk_vectors"))


def _hit(rows: DataFrame) -> DataFrame:
    long = [c for c in ("bm25_rank", "vector_rank", "matched_query_terms", "query_terms_total") if c in rows.columns]
    scores = [c for c in ("note_weight", "rrf_score", "final_score", "bm25_score", "vector_score") if c in rows.columns]
    return rows.withColumns({c: F.col(c).cast("long") for c in long} | {c: r6(c) for c in scores})


def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """OP-09: JOIN-01/02/05/15, AGG-07/08, FN-32/33, FLT-08, SRT-04, PRJ-01/02."""
    found = search.hybrid(the_index(spark, sf), asked(spark, sf), MODEL, search.Options(top=SEARCHED))
    return _hit(found).drop("full_text")


def semantic_recall(spark: SparkSession, sf: str) -> DataFrame:
    """OP-14: hits as they are shown: FLT-09, OP-12, SRT-06."""
    found = semantic(the_index(spark, sf), asked(spark, sf), MODEL)
    return _hit(found).select("query_id", "chunk_id", "note_path", "note_title", "final_score")


def ablation(spark: SparkSession, sf: str) -> DataFrame:
    """OP-15: five hits of each query under three settings."""
    return _hit(search.ablation(the_index(spark, sf), asked(spark, sf), MODEL)).select("stage", "query_id", "chunk_id", "final_score")


def written_keys(spark: SparkSession, sf: str) -> DataFrame:
    """FN-22, JOIN-07/08: lexicon keys that are terms or parts of documents, and those written as tags or links."""
    docs = table(spark, sf, "documents").where("text is not null").select(F.col("doc_id").alias("query_id"), "text")
    keys = search.text_keys(docs, index.lexicon(tag_keys(spark, sf)))
    return keys.join(index.lexicon(tag_keys(spark, sf)), "key", "left_semi").select("query_id", "key")


def tag_search(spark: SparkSession, sf: str) -> DataFrame:
    """OP-10: notes by shared keys: JOIN-10/11/12, AGG-09/11, FLT-23, SRT-05, PRJ-07."""
    tags = tag_keys(spark, sf)
    queries = asked(spark, sf)
    keys = search.query_keys(queries, tags)
    found = search.tag_search(keyed_index(spark, sf, tags), keys, SHOWN, sources=queries.select("query_id", "source_path"))
    return _hit(found).select("query_id", "chunk_id", "note_path", "final_score", "matched_query_terms", "query_terms_total")


def logged_hits(spark: SparkSession, sf: str) -> DataFrame:
    """What queries recalled, a row logged again once, with titles; without hits of notes deleted since (`chunk_id` null)."""
    seen = table(spark, sf, "hits").where("chunk_id is not null").groupBy("query_id", "chunk_id")
    rows = seen.agg(F.max_by(F.struct("note_path", "heading", "category_id", "note_weight", "rrf_score", "final_score", "bm25_rank", "vector_rank", "heading_matched", "matched_query_terms", "query_terms_total"), F.struct("logged_at", "note_path")).alias("h"))
    return rows.select("query_id", "chunk_id", "h.*").withColumn("note_title", text.title_of(F.col("note_path")))


def hit_notes(spark: SparkSession, sf: str) -> DataFrame:
    """FN-25: logged rows by the note their path leads to, however it is spelled."""
    known = normal_paths(table(spark, sf, "notes").select("path", F.col("path").alias("key")).distinct(), "key")
    rows = normal_paths(spread(table(spark, sf, "hits").select(F.col("note_path").alias("key"))), "key")
    return rows.groupBy("key").agg(F.count("*").alias("hits")).join(known, "key").select("path", "hits")


def dedupe_hits(spark: SparkSession, sf: str) -> DataFrame:
    """OP-12, AGG-10, WIN-03/04, FN-16 over the recall log (`logged_hits`, so without notes deleted since)."""
    return present.dedupe(logged_hits(spark, sf)).select("query_id", "chunk_id", "note_path", r6("final_score").alias("final_score"))


def shown_hits(spark: SparkSession, sf: str) -> DataFrame:
    """OP-13, FLT-10/11/12, WIN-05/09: cut at relevance 7, chunks of the inbox pinned, split into tabs; without notes deleted since."""
    pinned = table(spark, sf, "chunks").where(F.col("note_path").startswith("Inbox/")).select("chunk_id")
    shown = present.present(logged_hits(spark, sf), 7, pinned)
    return shown.select("query_id", "chunk_id", "tab", F.col("place").cast("long").alias("place"))


def tab_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-19: hits by tab, without notes deleted since."""
    return present.tab_counts(present.present(logged_hits(spark, sf)))


def fused_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """FN-32, AGG-08: scores anew from the ranks in the log, without notes deleted since."""
    part = lambda c: F.coalesce(scoring.reciprocal_rank(F.col(c)), F.lit(0.0))
    return logged_hits(spark, sf).select("query_id", "chunk_id", r6(part("bm25_rank") + part("vector_rank")).alias("rrf_score"))


def hit_labels(spark: SparkSession, sf: str) -> DataFrame:
    """PRJ-01/06, SNK-15: titles, flags and links of logged hits, without notes deleted since."""
    rows = logged_hits(spark, sf)
    marks = text.flags(F.col("bm25_rank"), F.col("vector_rank"), F.col("heading_matched"), F.col("matched_query_terms"), F.col("query_terms_total"))
    return rows.select("query_id", "chunk_id", "note_title", marks.alias("flags"), text.wikilink(F.col("note_title"), F.col("heading")).alias("link"))


def query_counts(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-21: hits of each query by way of finding, those of notes deleted since too, and the time it was logged over."""
    one = ["query_id", F.coalesce("chunk_id", F.lit(-1)).alias("chunk_id"), F.when(F.col("chunk_id").isNull(), F.col("note_path")).alias("gone")]
    last = table(spark, sf, "hits").groupBy(*one).agg(F.max_by(F.struct("bm25_rank", "vector_rank", "logged_at"), F.struct("logged_at", "note_path")).alias("h"))
    counts = present.hit_counts(last.select("query_id", "h.*"))
    return counts.withColumn("seconds", r6("seconds"))


def timings_by_type(spark: SparkSession, sf: str) -> DataFrame:
    """AGG-16: sums and nearest-rank percentiles of event values by type."""
    return timings.summary(table(spark, sf, "events"), "event_type", "value").withColumn("total", r6("total"))


def slowest(spark: SparkSession, sf: str) -> DataFrame:
    """SRT-09: the five largest values."""
    return timings.slowest(table(spark, sf, "events"), "value", "event_id").select("event_id", "value")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def debounced(spark: SparkSession, sf: str) -> DataFrame:
    """STR-01: the last event of every run without a pause of an hour, by user."""
    fired = reactive.debounce(_events(spark, sf), "user_id", quiet_ms=PAUSE)
    return fired.select("user_id", F.unix_micros("fired_at").alias("fired_at"), "events", F.col("last.event_id").alias("event_id"))


def changed_types(spark: SparkSession, sf: str) -> DataFrame:
    """STR-02: events of another type than the one before."""
    return reactive.changes(_events(spark, sf), "user_id", "event_type").select("event_id", "user_id", "event_type")


def newest_generation(spark: SparkSession, sf: str) -> DataFrame:
    """STR-03: of each user's events those of the last day they were active."""
    rows = _events(spark, sf).withColumn("generation", F.to_date("ts"))
    return reactive.latest_wins(rows, "user_id").select("event_id", "user_id")


def sticky_queries(spark: SparkSession, sf: str) -> DataFrame:
    """STR-06: the last search of each user at every event."""
    k = F.when(F.col("event_type") == "view", F.get_json_object("props", "$.k").cast("long"))
    return reactive.sticky(_events(spark, sf).withColumn("k", k), "user_id", "k").select("event_id", "k")


def unsuppressed(spark: SparkSession, sf: str) -> DataFrame:
    """STR-04/05: events that don't follow a purchase of the same kind of event within an hour; errors always pass."""
    rows = _events(spark, sf).withColumns({"session": F.col("user_id"), "path": F.get_json_object("props", "$.k"), "manual": F.col("event_type") == "error"})
    opened = rows.where("event_type = 'purchase'").select("session", "path", F.col("ts").alias("opened_at"))
    return reactive.not_suppressed(rows.where("event_type <> 'purchase'"), opened, ms=PAUSE * 24).select("event_id")


def gated(spark: SparkSession, sf: str) -> DataFrame:
    """STR-04/05: with purchases as openings, sign-ups as pauses that end at the next view, errors as manual triggers."""
    kind = F.create_map(*[F.lit(x) for kv in (("purchase", "open"), ("signup", "pause"), ("view", "resume"), ("error", "manual")) for x in kv])[F.col("event_type")]
    rows = _events(spark, sf).select("event_id", "ts", F.col("user_id").alias("session"), F.get_json_object("props", "$.k").alias("path"), F.coalesce(kind, F.lit("trigger")).alias("kind"))
    return reactive.gate(rows, ms=PAUSE * 24).select("event_id", "kind")


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-17/19, FLT-21, STR-06: documents as states of an editor, a session for each language: the title of every third is selected."""
    note = F.concat(F.lit("note"), (F.col("doc_id") / 3).cast("long") % 7)
    states = table(spark, sf, "documents").where("text is not null and lang is not null").select(
        F.col("lang").alias("session"), note.alias("path"), F.col("doc_id").alias("at"), F.when(F.col("doc_id") % 3 == 0, F.col("title")).alias("selection"), F.col("text").alias("content"), F.lit(2).alias("line")
    )
    return query_contexts(states)


def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """SRC-18, WIN-06: of every document the paragraph around its third line."""
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", paragraph_at(F.col("text"), F.lit(2)).alias("paragraph"))
    return docs.where("paragraph is not null")


def unique_queries(spark: SparkSession, sf: str) -> DataFrame:
    """STR-07: how often each query text occurs; only one of each is embedded."""
    return asked(spark, sf).groupBy(text.query_key(F.col("text"))).agg(F.min("text").alias("text"), F.count("*").alias("times"), F.min("query_id").alias("first")).select("text", "times", "first")


def queries() -> dict[str, Query]:
    named = [
        hybrid, bm25, vector_search, tag_search, semantic_recall, ablation, scan_notes, reapply_folders, latest_notes, suggest_folders, folders_fingerprint, folder_factors, plain_tags, tag_lexicon,
        document_bodies, document_links, document_hashtags, link_variants, document_keys, document_sections, document_chunks, postings, chunk_lengths, term_records, corpus_size, missing_embeddings,
        embedding_coverage, written_keys, hit_notes, dedupe_hits, shown_hits, tab_counts, fused_ranks, hit_labels, query_counts, timings_by_type, slowest, debounced, changed_types, newest_generation, sticky_queries,
        unsuppressed, paragraphs, unique_queries, path_factors, vector_keys, query_keys_synonym, tag_search_tiers, both_modes, key_state, synonym_stats, key_inputs, synonym_json, vector_dim_mismatch,
        hybrid_no_embedding, one_embedding, one_key_embedding, vector_bytes, embedded, upserted_notes, kept_tags, markdown_notes, ages, routed_keys, document_tags, written_tags, document_keywords, highlighted,
        stored_chunks, gated, contexts,
    ]
    return {q.__name__: q for q in named}
