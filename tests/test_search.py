import pytest
from pyspark.sql import functions as F

from gleaner.operators import classify, index, present, search, timings
from gleaner.operators.ids import with_dense_ids

NOTES = "path string, mtime long, size long, category_id string, weight double, indexed_at long"
CHUNKS = "chunk_id long, note_path string, ord int, heading string, text string"


@pytest.fixture(scope="module")
def small(spark):
    chunks = spark.createDataFrame([(1, "n1.md", 0, "apple pie", "apple banana apple"), (2, "n2.md", 0, None, "banana cherry"), (3, "n3.md", 0, None, "cherry")], CHUNKS)
    notes = spark.createDataFrame([(f"n{i}.md", 0, 0, "internal", w, 0) for i, w in ((1, 0.75), (2, 1.5), (3, 1.05))], NOTES)
    vectors = spark.createDataFrame([(1, "m", 2, [1.0, 1.0]), (2, "m", 2, [0.0, 1.0]), (3, "m", 2, [1.0, 0.0]), (4, "m", 3, [1.0, 0.0, 0.0]), (5, "other", 2, [1.0, 0.0])], index.SCHEMAS["embeddings"])
    return index.index_chunks(notes, chunks, embeddings=vectors)


def queries(spark, rows):
    return spark.createDataFrame(rows, "query_id long, terms array<string>, embedding array<float>")


def test_bm25(spark, small):
    got = search.bm25(small, queries(spark, [(7, ["apple", "banana", "apple"], None), (8, [], None), (9, ["none"], None)])).orderBy("bm25_rank").collect()
    assert [(r["query_id"], r["chunk_id"], round(r["bm25_score"], 9), r["bm25_rank"]) for r in got] == [(7, 1, 1.572561203, 1), (7, 2, 0.470003629, 2)]


def test_vectors(spark, small):
    got = search.vector_search(small.embeddings, queries(spark, [(7, [], [1.0, 0.0]), (8, [], [0.0, 0.0]), (9, [], None)]), "m").orderBy("vector_rank").collect()
    assert [(r["query_id"], r["chunk_id"], round(r["vector_score"], 9)) for r in got] == [(7, 3, 1.0), (7, 1, 0.707106781), (7, 2, 0.0)]


def test_vectors_of_several_lengths_and_models(spark, monkeypatch):
    e = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", [1.0, 1.0, 0.0]), (3, "n", [0.0, 1.0]), (4, "m", [float("nan"), 1.0, 0.0])], "chunk_id long, model string, vector array<float>")
    q = spark.createDataFrame([(1, "m", [1.0, 0.0]), (2, "m", [2.0, 0.0]), (3, "m", [0.0, 1.0, 0.0]), (4, "n", [0.0, 2.0]), (5, "m", [1.0] * 5), (6, None, [1.0, 0.0])], "query_id long, model string, embedding array<float>")
    want = {(1, 1), (2, 1), (3, 2), (4, 3)}
    assert {tuple(r)[:2] for r in search.vector_search(e, q).select("query_id", "chunk_id").collect()} == want
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    assert {tuple(r)[:2] for r in search.vector_search(e, q, block=2).select("query_id", "chunk_id").collect()} == want
    assert search.vector_search(e, q, least=0.9, block=2).count() == 3


def test_many_keys_by_first_letters(spark, monkeypatch):
    q = spark.createDataFrame([(1, "the green hills"), (2, None), (3, ""), (4, "x")], "query_id long, text string")
    lexicon = spark.createDataFrame([("green hills",), ("gr",), ("hillside",), ("x",)], "key string")
    want = {(1, "green hills"), (1, "gr")}
    assert want <= {tuple(r) for r in search.text_keys(q, lexicon).collect()}
    monkeypatch.setattr(search, "SCANNED_KEYS", 0)
    assert {tuple(r) for r in search.text_keys(q, lexicon).collect()} == want
    plan = search.text_keys(q, lexicon)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_vector_keys_leave_the_scan_only_if_near(spark):
    keys = spark.createDataFrame([("tag", f"k{i}", "m", 2, [1.0, float(i)], 0) for i in range(200)], index.SCHEMAS["key_embeddings"])
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    gone = spark.createDataFrame([(1, "k0"), (1, "other")], "query_id long, key string")
    got = search.vector_keys(keys, q, "m", "tag", exclude=gone, least=0.3, k=2)
    assert [r["key"] for r in got.orderBy("similarity", ascending=False).collect()] == ["k1", "k2"]


def test_timings(spark):
    rows = spark.createDataFrame([("a", float(i % 7)) for i in range(100)] + [("b", 5.0)] * 300 + [("c", None)], "kind string, v double")
    got = {r["kind"]: r for r in timings.summary(rows, "kind", "v").collect()}
    values = sorted(i % 7 for i in range(100))
    assert (got["a"]["p50"], got["a"]["p95"], got["a"]["n"]) == (values[50], values[95], 100) and got["b"]["p95"] == 5.0 and got["c"]["p50"] is None
    assert timings.summary(rows.limit(0), "kind", "v").count() == 0


def test_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(i, "m", 8, rng.normal(size=8).tolist()) for i in range(300)]
    e = spark.createDataFrame(rows, index.SCHEMAS["embeddings"])
    q = queries(spark, [(i, [], rng.normal(size=8).tolist()) for i in range(30)])
    one = {tuple(r)[:2] for r in search.vector_search(e, q, "m", 5).select("query_id", "chunk_id").collect()}
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    two = {tuple(r)[:2] for r in search.vector_search(e, q, "m", 5, block=7).select("query_id", "chunk_id").collect()}
    assert one == two and len(one) == 150


def test_hybrid(spark, small):
    hits = search.hybrid(small, queries(spark, [(7, ["apple", "banana", "apple"], [1.0, 0.0])]), "m").orderBy(F.desc("final_score")).collect()
    assert [(r["chunk_id"], round(r["rrf_score"], 9), round(r["final_score"], 9)) for r in hits] == [(1, 0.032522475, 0.043905341), (3, 0.016393443, 0.017213115)]
    assert hits[0]["heading_matched"] and hits[0]["note_title"] == "n1" and hits[0]["preview"] == "apple banana apple" and hits[1]["bm25_rank"] is None
    plain = search.hybrid(small, queries(spark, [(7, ["apple", "banana"], [1.0, 0.0])]), "m", search.Options(by_heading=False)).where("chunk_id = 1").first()
    assert round(plain["final_score"], 9) == 0.036587784
    assert search.hybrid(small, queries(spark, [(7, [], [1.0, 0.0])]), "m").count() == 3
    assert search.hybrid(small, queries(spark, [(7, [], None)]), "m").count() == 0


def test_empty_index(spark):
    q = queries(spark, [(7, ["a"], [1.0])])
    assert search.hybrid(index.empty_index(spark), q, "m").count() == 0
    assert search.bm25(index.empty_index(spark), q).count() == 0


def test_tag_search(spark):
    notes = spark.createDataFrame([("n1", 0, 0, "internal", 0.75, 0), ("n2", 0, 0, "internal", 1.5, 0), ("n3", 0, 0, None, 0.0, 0), ("n4", 0, 0, "internal", 1.0, 0)], NOTES)
    chunks = spark.createDataFrame([(i, f"n{i}", 0, None, "t") for i in (1, 2, 3)] + [(9, "n1", 1, None, "u")], CHUNKS)
    keys = spark.createDataFrame([("n1", "doctrine", "A"), ("n1", "doctrine", "B"), ("n1", "tag", "A"), ("n2", "doctrine", "C"), ("n2", "tag", "D"), ("n3", "doctrine", "A"), ("n4", "tag", "A"), ("n4", "tag", "A")], index.SCHEMAS["note_keys"])
    ix = index.index_chunks(notes, chunks, keys=keys)
    asked = spark.createDataFrame([(1, "doctrine", "exact", "A"), (1, "doctrine", "synonym", "B"), (1, "doctrine", "vector", "C"), (1, "tag", "exact", "A"), (1, "tag", "vector", "D")], "query_id long, kind string, tier string, key string")
    got = [(r["note_path"], r["final_score"], r["matched_query_terms"], r["query_terms_total"]) for r in search.tag_search(ix, asked).orderBy(F.desc("final_score")).collect()]
    assert got == [("n1", 4.5, 6, 4), ("n2", 2.25, 2, 4), ("n3", 0.0, 3, 4)]
    own = spark.createDataFrame([(1, "n1")], "query_id long, source_path string")
    assert search.tag_search(ix, asked, sources=own).where("note_path = 'n1'").count() == 0


def test_query_keys(spark):
    keys = spark.createDataFrame([("n", "doctrine", "K"), ("n", "tag", "river"), ("n", "tag", "x"), ("n", "tag", "dir/y")], index.SCHEMAS["note_keys"])
    q = spark.createDataFrame([(1, "the rivers new birth z #dir/y [[a/x]]"), (2, "x")], "query_id long, text string")
    synonyms = spark.createDataFrame([("K", "new birth"), ("K", "x"), ("L", "new birth")], "key string, synonym string")
    got = {tuple(r) for r in search.query_keys(q, keys, synonyms=synonyms).select("query_id", "kind", "tier", "key").collect()}
    assert got == {(1, "tag", "exact", "river"), (1, "tag", "exact", "dir/y"), (1, "tag", "exact", "x"), (1, "doctrine", "synonym", "K")}


def test_keys_inside_texts_by_their_first_letters(spark, monkeypatch):
    lexicon = spark.createDataFrame([("river",), ("ri",), ("x",), ("green hills",), ("absent",), ("🔖",)], "key string")
    q = spark.createDataFrame([(1, "the rivers and green hills"), (2, "x"), (3, "")], "query_id long, text string")
    one = {tuple(r) for r in search.text_keys(q, lexicon).collect()}
    monkeypatch.setattr(search, "SCANNED_KEYS", 0)
    assert one == {tuple(r) for r in search.text_keys(q, lexicon).collect()} == {(1, "river"), (1, "ri"), (1, "green hills")}


def test_synonym_coverage(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    synonyms = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z")], "key string, synonym string")
    assert tuple(index.synonym_coverage(keys, synonyms).first()) == (2, 1, 2, 2.0)


def test_vector_keys(spark):
    e = spark.createDataFrame([("tag", k, "m", 2, v, 0) for k, v in (("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("c", [0.0, 1.0]))], index.SCHEMAS["key_embeddings"])
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, embedding array<float>")
    assert {r["key"] for r in search.vector_keys(e, q, "m", "tag").collect()} == {"a", "b"}
    gone = spark.createDataFrame([(1, "a")], "query_id long, key string")
    assert {r["key"] for r in search.vector_keys(e, q, "m", "tag", exclude=gone).collect()} == {"b"}


FOLDERS = [(0, "src1", "internal", 5), (1, "src3/", "internal", 8), (2, "src3/de/", "external", 0), (3, "src7/", "external", 10)]
PATHS = ["src1/en/a.md", "src10/en/a.md", "src3/en/a.md", "src3/de/a.md", "src7/es/a.md", "src7/fr/a.md", "other/a.md"]


@pytest.mark.parametrize("inline", [500, 2])
def test_classify(spark, monkeypatch, inline):
    monkeypatch.setattr(classify, "INLINE", inline)
    folders = spark.createDataFrame(FOLDERS, "pos int, path string, group_id string, weight int")
    notes = spark.createDataFrame([(p,) for p in PATHS], "path string")
    got = {(r["path"], r["category_id"], round(r["weight"], 2)) for r in classify.classify(notes, folders, ["src7/fr/"]).collect()}
    assert got == {(PATHS[0], "internal", 0.75), (PATHS[1], "internal", 0.75), (PATHS[2], "internal", 1.2), (PATHS[4], "external", 1.5)}
    again = {r["path"]: (r["category_id"], r["weight"]) for r in classify.reapply(notes, folders, ["src7/fr/"]).collect()}
    assert len(again) == 7 and again[PATHS[3]] == again[PATHS[5]] == again[PATHS[6]] == (None, 0.0)


def test_dense_ids(spark):
    rows = with_dense_ids(spark.createDataFrame([(f"p{i % 7}", i) for i in range(500)], "p string, i int"), "id", "p", "i").orderBy("p", "i").collect()
    assert [r["id"] for r in rows] == list(range(1, 501))


def test_build_index(spark):
    notes = spark.createDataFrame([("b/x.md", 1, 2, "---\ntags: t\n---\n# H\nfaith hope"), ("a/y.md", 1, 2, "love\n\nlove"), ("z.md", 1, 2, "no")], "path string, mtime long, size long, content string")
    folders = spark.createDataFrame([(0, "a/", "internal", 5), (1, "b/", "external", 10)], "pos int, path string, group_id string, weight int")
    ix = index.build_index(notes, folders)
    assert [tuple(r) for r in ix.chunks.orderBy("chunk_id").collect()] == [(1, "a/y.md", 0, None, "love\n\nlove"), (2, "b/x.md", 0, "H", "[태그: t] faith hope")]
    assert {tuple(r) for r in ix.postings.where("chunk_id = 2").collect()} == {(2, "t", 1), (2, "faith", 1), (2, "hope", 1)}
    assert {tuple(r) for r in ix.note_keys.collect()} == {("b/x.md", "tag", "t")}
    assert ix.notes.count() == 2 and index.build_index(notes, folders, dense_ids=False).chunks.count() == 2


HIT = "query_id long, chunk_id long, note_path string, note_title string, category_id string, note_weight double, final_score double"


def test_dedupe(spark):
    rows = [(1, 1, "a/제목.md", "제목", None, 1.0, 0.5), (1, 2, "a/제목.md", "제목", None, 1.0, 0.4), (1, 3, "b/제목 2.md", "제목 2", "external", 1.5, 0.1), (1, 4, "c/제목 복사본.md", "제목 복사본", "internal", 1.5, 0.2), (1, 5, "d", "else", "external", 1.0, 0.3), (2, 6, "a/제목.md", "제목", None, 1.0, 0.5)]
    hits = spark.createDataFrame(rows, HIT)
    once = present.dedupe(hits)
    assert sorted((r["query_id"], r["chunk_id"]) for r in once.collect()) == [(1, 4), (1, 5), (2, 6)]
    assert sorted(map(tuple, present.dedupe(once).collect())) == sorted(map(tuple, once.collect()))


@pytest.mark.parametrize("relevance, kept", [(10, 3), (7, 2), (0, 1)])
def test_cut_off(spark, relevance, kept):
    hits = spark.createDataFrame([(1, i, "p", "t", None, 1.0, s) for i, s in enumerate((0.04, 0.02, 0.011))], HIT)
    assert present.cut_off(hits, relevance).count() == kept


def test_present(spark):
    hits = spark.createDataFrame([(1, 1, "p", "t", None, 1.0, 0.4), (1, 2, "p", "t", "external", 1.0, 0.3), (1, 3, "p", "t", "internal", 1.0, 0.1)], HIT)
    shown = present.present(hits, 5, spark.createDataFrame([(1,)], "chunk_id long"))
    assert [(r["chunk_id"], r["tab"], r["place"]) for r in shown.collect()] == [(2, "external", 1)]
    assert {tuple(r) for r in present.tab_counts(present.present(hits)).collect()} == {(1, "internal", 2), (1, "external", 1)}
    own = spark.createDataFrame([(1, "p")], "query_id long, source_path string")
    assert present.without_source(hits, own).count() == 0


def test_upserts(spark):
    e = spark.createDataFrame([(1, "m", 1, [1.0]), (2, "m", 1, [2.0])], index.SCHEMAS["embeddings"])
    new = spark.createDataFrame([(2, "n", 1, [3.0]), (3, "n", 1, [4.0])], index.SCHEMAS["embeddings"])
    assert sorted((r["chunk_id"], r["model"]) for r in index.upsert(e, new, ["chunk_id"]).collect()) == [(1, "m"), (2, "n"), (3, "n")]
    assert index.delete_keys(e, new, ["chunk_id"]).count() == 1
    chunks = spark.createDataFrame([(1, "p", 0, None, "t"), (3, "p", 1, None, " \n"), (4, "p", 2, None, "u")], CHUNKS)
    assert [r["chunk_id"] for r in index.missing_embeddings(chunks, e, "m").collect()] == [4]


def test_embedding_state(spark):
    e = spark.createDataFrame([("tag", "a", "m", 1, [1.0], 5), ("tag", "b", "m", 1, [1.0], 9), ("tag", "c", "x", 1, [1.0], 99)], index.SCHEMAS["key_embeddings"])
    assert [tuple(r) for r in index.embedding_state(e, "m").collect()] == [("tag", 2, 9, "2:9")]
