"""Best sums by blocks against brute force, and that pairs of queries and documents stay inside their tasks."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.operators import index, search, sums
from gleaner.operators.tokenize import words_of

NOTES = "path string, mtime long, size long, category_id string, weight double, indexed_at long"
CHUNKS = "chunk_id long, note_path string, ord int, heading string, text string"


@pytest.fixture(scope="module")
def small(spark):
    words = "apple banana cherry date elder fig grape".split()
    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame([(i, f"n{i % 9}.md", i, "apple pie" if i % 4 else None, " ".join(rng.choice(words, rng.integers(1, 6)))) for i in range(60)], CHUNKS)
    notes = spark.createDataFrame([(f"n{i}.md", 0, 0, "internal", [0.0, 0.75, 1.5][i % 3], 0) for i in range(9)], NOTES)
    vectors = spark.createDataFrame([(i, "m", 4, rng.normal(size=4).tolist()) for i in range(0, 60, 2)], index.SCHEMAS["embeddings"])
    return index.index_chunks(notes, chunks, embeddings=vectors)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("asked_bytes, at_once", [(64_000_000, 30_000), (64_000_000, 7), (200, 30)])
def test_best_sums(spark, monkeypatch, asked_bytes, at_once):
    monkeypatch.setattr(sums, "ASKED_BYTES", asked_bytes)
    monkeypatch.setattr(sums, "DOCS_AT_ONCE", at_once)
    rng = np.random.default_rng(5)
    held = {d: {int(x): float(rng.integers(1, 4)) for x in rng.choice(12, rng.integers(1, 7), replace=False)} for d in range(200)}
    factor = {d: [1.0, 0.0, 0.5, None][d % 4] for d in held}
    wants = {q: {int(x): 0.5 for x in rng.choice(15, rng.integers(1, 5), replace=False)} for q in range(20)}
    docs = spark.createDataFrame([(d, factor[d], list(h.items())) for d, h in held.items()], "doc long, factor double, held array<struct<key:long,value:double>>")
    asked = spark.createDataFrame([(q, list(w.items())) for q, w in wants.items()], "query_id long, wants array<struct<key:long,weight:double>>")
    got = {(r["query_id"], r["doc"]): r["total"] for r in sums.best_sums(docs, asked, 6, 200).collect()}
    for q, w in wants.items():
        total = {d: sum(x * w[t] for t, x in h.items() if t in w) for d, h in held.items()}
        best = sorted((d for d in total if total[d] > 0), key=lambda d: (-round(total[d] * factor[d], 9) if factor[d] is not None else 1e9, d))[:6]
        assert all(got[q, d] == total[d] for d in best)
        assert at_once < 30_000 or sum(a == q for a, _ in got) <= 6 * spark.sparkContext.defaultParallelism


def test_bm25_pairs_stay_in_their_task(spark, small):
    q = spark.createDataFrame([(i, ["apple", "banana", "fig"][: i % 4]) for i in range(8)], "query_id long, terms array<string>")
    assert "keys=[query_id" not in plan(search.bm25(small, q, 5))


def test_tag_pairs_stay_in_their_task_and_ties_go_by_path(spark, small):
    keys = spark.createDataFrame([(f"n{i}.md", "tag", "k") for i in range(9)] * 2, index.SCHEMAS["note_keys"])
    asked = spark.createDataFrame([(1, "tag", "exact", "k"), (2, "tag", "exact", "k")], "query_id long, kind string, tier string, key string")
    own = spark.createDataFrame([(1, "n2.md"), (2, None)], "query_id long, source_path string")
    got = search.tag_scores(index.replace(small, note_keys=keys), asked, 4, sources=own)
    assert "sum(w" not in plan(got)
    rows = {q: [r["note_path"] for r in got.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (1, 2)}
    assert rows == {1: ["n5.md", "n8.md", "n1.md", "n4.md"], 2: ["n2.md", "n5.md", "n8.md", "n1.md"]}


def test_terms_are_counted_where_texts_are_read(spark, small):
    q = spark.createDataFrame([(1, ["apple", "fig", "none"]), (2, [])], "query_id long, terms array<string>")
    having = search.wanted(small, q, kept=False)
    assert "Exchange" not in plan(having.held) and "Exchange" not in plan(small.chunk_stats)
    wants = {w["key"]: w["df"] for r in having.asked.collect() for w in r["wants"]}
    held = {r["chunk_id"]: (r["length"], dict(zip(r["keys"], r["tfs"]))) for r in having.held.collect()}
    texts = {r["chunk_id"]: r["text"].split() for r in small.chunks.collect()}
    assert set(held) == {c for c, t in texts.items() if {"apple", "fig"} & set(t)}
    assert all(n == len(texts[c]) and sorted(tfs.values()) == sorted(texts[c].count(t) for t in {"apple", "fig"} & set(texts[c])) for c, (n, tfs) in held.items())
    assert sorted(wants.values()) == sorted(sum(t in x for x in texts.values()) for t in ("apple", "fig"))


def test_lists_and_postings_agree(spark):
    chunks = spark.createDataFrame([(1, "n.md", 0, None, "은혜는 믿음 은혜"), (2, "n.md", 1, None, None), (3, "n.md", 2, None, "!"), (4, "n.md", 3, None, "b믿음을, AA aa.")], CHUNKS)
    notes = spark.createDataFrame([("n.md", 0, 0, "internal", 1.0, 0)], NOTES)
    for rows, lists in ((chunks, True), (chunks.unionAll(chunks), False)):
        ix = index.index_chunks(notes, rows)
        assert (ix.lists is not None) == lists and "lists" not in ix.tables()
        assert sorted(map(tuple, ix.postings.collect())) == sorted(map(tuple, index.postings_of(rows).collect()))
        assert sorted(map(tuple, ix.chunk_stats.collect())) == sorted(map(tuple, index.chunk_lengths(ix.postings).collect()))
        assert sorted(map(tuple, ix.term_stats.collect())) == sorted(map(tuple, index.term_records(ix.postings).collect()))
        q = spark.createDataFrame([(1, ["은혜", "aa"])], "query_id long, terms array<string>")
        found = [tuple(r) for r in search.bm25(ix, q).select("chunk_id", F.round("bm25_score", 6)).collect()]
        assert found == [tuple(r) for r in search.bm25(index.replace(ix, lists=None), q).select("chunk_id", F.round("bm25_score", 6)).collect()] and len(found) == 2


def test_keys_of_texts_are_found_once(spark):
    keys = spark.createDataFrame([("n.md", "doctrine", "grace"), ("n.md", "tag", "hope"), ("n.md", "tag", ""), ("m.md", "tag", "hope")], index.SCHEMAS["note_keys"])
    near = spark.createDataFrame([("doctrine", "grace", "m", 2, [1.0, 0.0], 0), ("tag", "hope", "m", 2, [1.0, 0.1], 0)], index.SCHEMAS["key_embeddings"])
    words = spark.createDataFrame([("grace", "free gift")], "key string, synonym string")
    q = spark.createDataFrame([(1, "a gift that is free", [1.0, 0.0]), (2, "hope and grace", [0.0, 1.0])], "query_id long, text string, embedding array<float>")
    got = search.query_keys(q, keys, synonyms=words, key_embeddings=near, model="m")
    assert "regexp_extract_all" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, "doctrine", "synonym", "grace"), (1, "tag", "vector", "hope"), (2, "doctrine", "exact", "grace"), (2, "tag", "exact", "hope")]


def test_candidates_don_t_explode_terms(spark, small):
    q = spark.createDataFrame([(1, ["apple", "fig"], [1.0, 0.0, 0.0, 0.0]), (2, ["none"], None), (3, None, [0.0, 1.0, 0.0, 1.0])], "query_id long, terms array<string>, embedding array<float>")
    rows = search.hybrid_scores(small, q, "m", search.Options(top=5))
    assert "Generate" not in plan(rows)
    held = {r["chunk_id"]: set(r["text"].split()) for r in small.chunks.collect()}
    assert all(r["matched_query_terms"] == len(held[r["chunk_id"]] & {"apple", "fig"}) for r in rows.where("query_id = 1").collect())


def test_ablation_finds_candidates_once(spark, small):
    q = spark.createDataFrame([(1, ["apple", "fig"], [1.0, 0.0, 0.0, 0.0])], "query_id long, terms array<string>, embedding array<float>")
    out = search.ablation(small, q, "m")
    assert out.inputFiles() and all("gleaner-candidates" in f for f in out.inputFiles())
    assert {r["stage"] for r in out.select("stage").collect()} == {"rrf", "weight", "heading"}


def test_a_task_gives_each_query_s_best_of_all_batches():
    rng = np.random.default_rng(7)
    unit = rng.normal(size=(3, 4))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    vectors = np.round(rng.normal(size=(500, 4)), 1)
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("vector_score", pa.float64())])
    kind = pa.schema([("chunk_id", pa.int64()), ("model", pa.string()), ("vector", pa.list_(pa.float32()))])
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 50)), pa.array(["m"] * 50), pa.array(vectors[i : i + 50].astype(np.float32).tolist(), pa.list_(pa.float32()))], schema=kind) for i in range(0, 500, 50)]
    got = pa.Table.from_batches(search._scan({("m", 4): (np.arange(3), unit)}, 8, -2.0, schema)(iter(batches))).to_pylist()
    v = vectors.astype(np.float32).astype(np.float64)
    length = np.linalg.norm(v, axis=1)
    cos = np.round(np.where(length > 0, unit @ v.T / np.where(length > 0, length, 1), 0), 9)
    want = {(q, int(c)) for q in range(3) for c in np.argsort(-cos[q], kind="stable")[:8]}
    assert {(r["query_id"], r["chunk_id"]) for r in got} == want and len(got) == 24


QUERIES = "query_id long, terms array<string>, embedding array<float>"


def same_without_postings(small, search_of):
    """A search of lists gives what one of postings does, and needs no postings."""
    plain = [sorted(map(str, search_of(x).drop("rank").collect())) for x in (index.replace(small, postings=None), index.replace(small, lists=None))]
    assert plain[0] == plain[1] and plain[0]


def test_hybrid_without_embedding_needs_no_postings(spark, small):
    q = spark.createDataFrame([(1, ["apple", "fig"], None), (2, ["grape"], None), (3, [], None)], QUERIES)
    same_without_postings(small, lambda ix: search.hybrid_scores(ix, q, "m").select("query_id", "chunk_id", F.round("final_score", 9)))


def test_hybrid_needs_no_postings(spark, small):
    q = spark.createDataFrame([(1, ["apple", "fig"], [1.0, 0.0, 0.0, 0.0]), (2, ["grape"], [0.0, 1.0, 1.0, 0.0])], QUERIES)
    same_without_postings(small, lambda ix: search.hybrid(ix, q, "m").select("query_id", "chunk_id", "full_text", "matched_query_terms", F.round("final_score", 9)))


def test_ablation_needs_no_postings(spark, small):
    q = spark.createDataFrame([(1, ["apple", "fig"], [1.0, 0.0, 0.0, 0.0]), (2, ["grape"], [0.0, 1.0, 1.0, 0.0])], QUERIES)
    same_without_postings(small, lambda ix: search.ablation(ix, q, "m").select("stage", "query_id", "chunk_id", F.round("final_score", 9)))


def test_words_become_terms_once_for_each_distinct_word(spark):
    rng = np.random.default_rng(11)
    parts = [*"은는이가로도하나가믿음ㄱ가aBΣİΑß9१ 恩", " ", ", ", "-", "으로부터", "에서", "처럼", "이라도", "에게서", "사람", "사람은", "우리를", "주", "\u0307"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)] + [None, "", "가", "a b cc", "은혜으로부터는", "ΑΣ가나은 ΑΣ"]
    chunks = spark.createDataFrame([(i, "n.md", i, None, t) for i, t in enumerate(texts)], CHUNKS)
    got = index.term_lists(chunks)
    assert "regexp_replace" not in plan(got) and "isin" not in plan(got).lower() and " IN " not in plan(got)
    rows = lambda df: sorted((r["chunk_id"], r["length"], tuple(sorted(zip(r["terms"], r["tfs"])))) for r in df.collect())
    assert rows(got) == rows(index.term_lists(chunks, tokenize=index.terms_of))


def docs_and_asked(n: int, queries: int, plain: int):
    rng = np.random.default_rng(13)
    held = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)) for _ in range(n)]
    docs = pa.table({"doc": pa.array(rng.permutation(n)), "factor": pa.array(np.where(np.arange(n) < plain, 1.0, 0.5)), "keys": pa.array([h.tolist() for h in held], pa.list_(pa.int64())), "values": pa.array([rng.integers(1, 4, len(h)).tolist() for h in held], pa.list_(pa.int32()))})
    idf = rng.integers(1, 9, 40) / 4
    wants = [[{"key": int(x), "weight": float(idf[x])} for x in rng.choice(40, rng.integers(1, 7), replace=False)] for _ in range(queries)]
    asked = pa.table({"query_id": pa.array(range(queries)), "wants": pa.array(wants, pa.list_(pa.struct([("key", pa.int64()), ("weight", pa.float64())])))})
    return docs, asked


@pytest.mark.parametrize("held_rows, plain", [(2_000_000, 1000), (2_000_000, 500), (2_000_000, 0), (0, 500)])
def test_a_task_gives_each_query_s_best_of_all_blocks(monkeypatch, held_rows, plain):
    monkeypatch.setattr(sums, "DOCS_AT_ONCE", 100)
    monkeypatch.setattr(sums, "HELD_ROWS", held_rows)
    docs, asked = docs_and_asked(1000, 30, plain)
    got = pa.Table.from_batches(sums._scan(sums._Asked(asked), 6, None)(iter(docs.to_batches(max_chunksize=50)))).to_pylist()
    assert held_rows == 0 or len(got) == 6 * 30
    found = {(r["query_id"], r["doc"]): r["total"] for r in got}
    for q, w in enumerate(asked.column("wants").to_pylist()):
        weight = {x["key"]: x["weight"] for x in w}
        total = {r["doc"]: sum(weight.get(x, 0) * v for x, v in zip(r["keys"], r["values"])) for r in docs.to_pylist()}
        factor = {r["doc"]: r["factor"] for r in docs.to_pylist()}
        assert all(found[q, d] == total[d] for d in sorted((d for d in total if total[d]), key=lambda d: (-total[d] * factor[d], d))[:6])


def few_leave_a_task(monkeypatch, search_of, k: int):
    """Of each query no more than k chunks leave a task, though each block holds one chunk."""
    seen = []
    monkeypatch.setattr(sums, "DOCS_AT_ONCE", 1)
    monkeypatch.setattr(sums, "BLOCKS", 8)
    monkeypatch.setattr(search, "best_sums", lambda *a: seen.append(sums.best_sums(*a)) or seen[0])
    assert search_of().count()
    tasks = seen[0].rdd.getNumPartitions()
    n = seen[0].groupBy("query_id").count().agg(F.max("count")).first()[0]
    assert n <= k * tasks and n < 20


def test_hybrid_keeps_the_best_of_a_task(spark, small, monkeypatch):
    q = spark.createDataFrame([(1, ["apple", "fig", "grape", "date"], [1.0, 0.0, 0.0, 0.0])], QUERIES)
    few_leave_a_task(monkeypatch, lambda: search.hybrid(small, q, "m", search.Options(candidates=2)), 2)


def test_hybrid_keeps_the_terms_of_many_chunks_in_a_row(spark, small, monkeypatch):
    monkeypatch.setattr(index, "CHUNKS_AT_ONCE", 2)
    ix = index.index_chunks(small.notes, small.chunks, embeddings=small.embeddings)
    assert small.lists.count() < small.chunks.count() and dict(small.lists.dtypes)["places"] == "binary"
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(ix.postings) == rows(small.postings) and rows(ix.chunk_stats) == rows(small.chunk_stats) and rows(ix.term_stats) == rows(small.term_stats) == rows(index.term_records(small.postings))
    q = spark.createDataFrame([(1, ["apple", "fig"], [1.0, 0.0, 0.0, 0.0]), (2, ["grape"], [0.0, 1.0, 1.0, 0.0])], QUERIES)
    assert rows(search.hybrid_scores(ix, q, "m").drop("rank")) == rows(search.hybrid_scores(small, q, "m").drop("rank"))


def test_words_of_a_text_lowered_at_once(spark):
    signs = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000]
    texts = [f"A{s}Bc {s}D{s} 'E{s}'" for s in signs] + ["", None, "ΑΣ'Α ΑΣ", "İSTANBUL B", "AΣ ΣΑ", "aΣ.Σb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    alone = F.transform(F.regexp_extract_all("t", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)
    assert df.where(words_of(F.col("t")) != F.coalesce(F.array_join(alone, " "), F.lit(""))).count() == 0


@pytest.mark.parametrize("copies, sorts", [(1, 1), (200, None)])
def test_hybrid_sorts_vectors_only_at_the_end(monkeypatch, copies, sorts):
    monkeypatch.setattr(search, "SCORES_AT_ONCE", 800)
    done = []
    monkeypatch.setattr(search._Best, "_sort", lambda self, sort=search._Best._sort: (done.append(1), sort(self)))
    rng = np.random.default_rng(5)
    vectors = np.repeat(rng.normal(size=(2000 // copies, 8)), copies, axis=0)
    unit = rng.normal(size=(20, 8))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    best, ids = search._Best((np.arange(20) + 100, unit), 6, -0.5), rng.permutation(2000)
    for i in range(0, 2000, 250):
        best.add(ids[i : i + 250], vectors[i : i + 250])
        assert best.n <= 20 * 6 * 3 + 20 * 40  # what is held stays bounded, however many tie
    schema = pa.schema([("query_id", pa.int64()), ("chunk_id", pa.int64()), ("vector_score", pa.float64())])
    got = pa.Table.from_batches(best.batches(schema)).to_pylist()
    cos = np.round(unit @ (vectors / np.linalg.norm(vectors, axis=1)[:, None]).T, 9)
    want = {(q + 100, int(ids[c])) for q in range(20) for c in np.lexsort((ids, -cos[q]))[:6] if cos[q, c] >= -0.5}
    assert {(r["query_id"], r["chunk_id"]) for r in got} == want and len(got) == len(want)
    assert sorts is None or len(done) == sorts
