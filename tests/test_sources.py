import json
import os
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from gleaner import config, runtime
from gleaner.operators import index
from gleaner.plans import recall
from gleaner.plans.recall import Engine, prepare
from gleaner.sources import providers, store, vault
from gleaner.streaming import reactive


def test_vault(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "한글+.md").write_text("# H\nx\n\ny", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("no")
    rows = vault.read_vault(spark, str(tmp_path)).collect()
    assert [(r["path"], r["content"], r["size"]) for r in rows] == [("a b/한글+.md", "# H\nx\n\ny", 8)] and rows[0]["mtime"] > 1.6e12


@pytest.mark.parametrize("line, expected", [(1, "one one one\ntwo two two"), (2, "one one one\ntwo two two"), (4, "three three three"), (3, "one one one\ntwo two two\n\nthree three three"), (9, None)])
def test_paragraph(spark, line, expected):
    content = "\none one one\ntwo two two\n\nthree three three\n "
    assert spark.range(1).select(vault.paragraph_at(F.lit(content), F.lit(line))).first()[0] == expected


def test_query_contexts(spark):
    rows = [("a", 1, "selected text here", "", 0), ("a", 2, "", "short", 0), ("b", 3, "", "x", 0), ("b", 4, "", "a paragraph of text", 0), ("a", 5, "", "x", 0)]
    got = vault.query_contexts(spark.createDataFrame([("s", *r) for r in rows], "session string, path string, at int, selection string, content string, line int")).drop("session").orderBy("at").collect()
    assert [tuple(r) for r in got] == [("a", 1, "selected text here", "selection"), ("a", 2, "selected text here", "selection"), ("b", 4, "a paragraph of text", "paragraph")]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.load_index().chunks.count() == 0 and s.meta("x") is None
    one = spark.createDataFrame([(1, "p", 0, None, "t")], index.SCHEMAS["chunks"])
    s.save({"chunks": one}, x=1)
    s.save({"chunks": one.unionAll(one)})
    assert s.table("chunks").count() == 2 and s.meta("x") == 1
    os.rename(tmp_path / "s" / "manifest.json", tmp_path / "gone")
    assert s.table("chunks").count() == 1  # the previous state
    (tmp_path / "s" / "manifest.json").write_text("{broken")
    os.remove(tmp_path / "s" / ".manifest.json.crc") if (tmp_path / "s" / ".manifest.json.crc").exists() else None
    assert s.table("chunks").count() == 1 and any("corrupt" in f for f in os.listdir(tmp_path / "s"))
    s.set_meta("y", 2)
    s.vacuum()
    assert s.table("chunks").count() == 1


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    (tmp_path / "manifest.json").write_text(json.dumps({"version": 1, "tables": {"chunks": "old"}, "meta": {"k": 1}}))
    assert s.manifest() == {"version": 2, "tables": {}, "meta": {"k": 1}}
    (tmp_path / "manifest.json").write_text(json.dumps({"version": 99}))
    with pytest.raises(store.NewerSchemaError):
        s.manifest()


def test_one_writer(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    with s.writing():
        with pytest.raises(store.BusyError):
            with s.writing():
                pass
    with s.writing():
        pass


def test_lock_left_behind(spark, tmp_path):
    s, other = store.Store(spark, str(tmp_path)), store.Store(spark, str(tmp_path))
    with s.writing(seconds=-1):  # as if its time were over
        with other.writing():  # takes it over
            with pytest.raises(store.BusyError):
                s.set_meta("x", 1)
            other.set_meta("x", 2)
    assert s.meta("x") == 2 and not (tmp_path / "lock").exists()


def test_append(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "p", 0, None, "t")], index.SCHEMAS["chunks"])
    s.append("chunks", one)
    s.append("chunks", one)
    s.vacuum()
    assert s.table("chunks").count() == 2
    s.save({"chunks": one})
    s.save({"chunks": one})
    s.vacuum()
    assert s.table("chunks").count() == 1 and sum(f.startswith("chunks-") for f in os.listdir(tmp_path)) == 2


def test_embedding_that_fails_keeps_what_was_done(spark, tmp_path):
    class Failing(providers.HashEmbedder):
        def embed(self, texts):
            if any("bread" in t for t in texts):
                raise providers.EmbedError(400, "no")
            return super().embed(texts)

    notes = spark.createDataFrame([(f"n{i}.md", 1, 1, f"{'bread' if i == 4 else 'water'} and wine {i}") for i in range(6)], "path string, mtime long, size long, content string")
    engine = Engine(spark, store.Store(spark, str(tmp_path / "e")), config.Settings(folders=(config.Folder(""),)))
    engine.reindex(notes)
    assert engine.next_step() == "none"
    engine.embedder = Failing()
    assert engine.next_step() == "embed"
    with pytest.raises(Exception, match="400"):
        engine.embed(at_once=3)
    done = engine.store.table("embeddings").count()
    engine.embedder = providers.HashEmbedder()
    assert 0 <= done < 6 and engine.embed() == 6 and engine.next_step() == "none"
    engine.embedder = providers.HashEmbedder(model="other")
    assert engine.embed() == 6 and {r["model"] for r in engine.store.table("embeddings").collect()} == {"other"}
    engine.settings = config.add_folder(engine.settings, "x/")
    assert engine.next_step() == "index" and Engine(spark, engine.store, config.Settings()).next_step() == "folders"


def test_results_are_kept(spark, tmp_path):
    notes = spark.createDataFrame([("n1.md", 1, 1, "the river runs through green hills"), ("n2.md", 1, 1, "bread and wine and water")], "path string, mtime long, size long, content string")
    engine = Engine(spark, store.Store(spark, str(tmp_path / "e")), config.Settings(folders=(config.Folder(""),)))
    engine.reindex(notes)
    r = recall.Recaller(engine, most=2)
    first, seconds = r.recall("river green hills")
    assert [h["note_path"] for h in first] == ["n1.md"] and r.recall("river green hills") == (first, seconds)
    r.recall("bread and wine")
    r.recall("river green hills")
    r.recall("green hills and water")
    assert [k[1] for k in r.kept] == ["river green hills", "green hills and water"]
    engine.settings = config.edit_folder(engine.settings, "", weight=1)
    engine.reapply()
    r.recall("river green hills")
    assert len(r.kept) == 1


def test_scratch_is_discarded(spark):
    with runtime.discarding():
        kept = runtime.materialise(spark.range(3), "x")
        assert kept.count() == 3
        path = runtime._WRITTEN[-1][1].removeprefix("file:")
        assert os.path.isdir(path)
    assert not os.path.isdir(path)


def test_bytes(spark):
    rows = spark.createDataFrame([([1.5, -2.0],), (None,)], "vector array<float>")
    back = store.vectors_from_bytes(store.vectors_to_bytes(rows))
    assert [r[0] for r in back.collect()] == [[1.5, -2.0], None]


def test_retries():
    pauses, calls = [], []

    def failing(status):
        def call():
            calls.append(1)
            raise providers.EmbedError(status, "x" * 300)

        return call

    with pytest.raises(providers.EmbedError) as e:
        providers.with_retries(failing(500), sleep=pauses.append)
    assert pauses == [0.5, 1.0] and len(calls) == 3 and len(e.value.detail) == 200
    with pytest.raises(providers.EmbedError):
        providers.with_retries(failing(400), sleep=pauses.append)
    assert len(calls) == 4
    with pytest.raises(providers.MissingCredentialError):
        providers.HttpEmbedder("http://localhost", " ", "m", 2).embed(["x"])


def test_embed_missing_and_keys(spark):
    e = providers.HashEmbedder(dim=8)
    chunks = spark.createDataFrame([(1, "p", 0, None, "text"), (2, "p", 1, None, " ")], index.SCHEMAS["chunks"])
    got = providers.embed_missing(chunks, spark.createDataFrame([], index.SCHEMAS["embeddings"]), e).collect()
    assert [(r["chunk_id"], r["model"], len(r["vector"])) for r in got] == [(1, "hash-trigram", 8)]
    none = spark.createDataFrame([], index.SCHEMAS["key_embeddings"])
    keys = spark.createDataFrame([("🔖 a",), ("",), ("b",)], "key string")
    one = providers.embed_keys(keys, none, "tag", e, 5)
    assert {(r["key"], r["embedded_at"]) for r in one.collect()} == {("🔖 a", 5), ("b", 5)}
    assert {r["embedded_at"] for r in providers.embed_keys(keys, one, "tag", e, 6).collect()} == {5}
    assert {r["embedded_at"] for r in providers.embed_keys(keys, one, "tag", e, 6, rebuild=True).collect()} == {6}


def test_synonyms(spark):
    class Fixed:
        def synonyms(self, keys):
            return {k: [f" {k}ness ", k, "x", 3] for k in keys} | {"unasked": ["zz"]}

    keys = spark.createDataFrame([("hope",), ("old",)], "key string")
    got = providers.generate_synonyms(keys, Fixed(), spark.createDataFrame([("old", "kept")], "key string, synonym string"))
    assert {tuple(r) for r in got.collect()} == {("old", "kept"), ("hope", "hopeness")}


def test_chat_service():
    said = []

    class Handler(BaseHTTPRequestHandler):
        answers = iter([(503, "busy"), (200, {"choices": [{"message": {"content": json.dumps({"hope": [" trust ", "hope", 5], "joy": "no list"})}}]}), (200, {"choices": [{"message": {"content": "not json"}}]})])

        def do_POST(self):
            said.append((self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, body = next(self.answers)
            self.send_response(status)
            self.end_headers()
            self.wfile.write((body if isinstance(body, str) else json.dumps(body)).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        ask = providers.HttpSynonyms(f"http://127.0.0.1:{server.server_port}", "secret", "m")
        found = providers.with_retries(lambda: ask.synonyms(["hope", "joy"]), sleep=lambda _: None)
        assert providers.sane_synonyms(found, ["hope", "joy"]) == {"hope": ["trust"]} and len(said) == 2
        assert said[0][0] == "Bearer secret" and said[0][1]["messages"][1]["content"] == "hope\njoy"
        assert ask.synonyms(["x"]) == {}
    finally:
        server.shutdown()
    with pytest.raises(providers.MissingCredentialError):
        providers.HttpSynonyms("http://localhost", "", "m").synonyms(["x"])


def test_engine(spark, tmp_path):
    notes = spark.createDataFrame(
        [("a/n1.md", 1, 1, "# Rivers\nthe river runs through green hills #water"), ("a/n2.md", 1, 1, "a river of hope and water and green hills"), ("b/n3.md", 1, 1, "bread and wine #water")], "path string, mtime long, size long, content string"
    )
    s = config.Settings(folders=(config.Folder("a/"), config.Folder("b/", "external", 10)))
    engine = Engine(spark, store.Store(spark, str(tmp_path / "e")), s, providers.HashEmbedder())
    assert engine.reindex(notes)["chunks"] == 3 and engine.in_sync() and engine.embed() == 3 and engine.embed_keys("tag") == 1
    q = spark.createDataFrame([(1, "river water green hills", "a/n2.md")], "query_id long, text string, source_path string")
    hits = engine.recall(q).collect()
    assert hits and hits[0]["note_path"] == "a/n1.md" and all(h["note_path"] != "a/n2.md" for h in hits)
    assert {h["note_path"] for h in engine.recall(q, "tag").collect()} == {"a/n1.md", "b/n3.md"}
    engine.settings = config.edit_folder(s, "b/", weight=0)
    assert not engine.in_sync() and engine.reapply() == 3 and engine.in_sync()
    assert engine.store.table("notes").where("path = 'b/n3.md'").first()["weight"] == 0.0
    assert prepare(q.withColumn("text", F.lit("short"))).count() == 0


def test_all_paths(spark, tmp_path):
    notes = spark.createDataFrame([("n1.md", 1, 1, "the river runs through green hills #water"), ("n2.md", 1, 1, "bread and wine #water"), ("n3.md", 1, 1, "a river of water and green hills")], "path string, mtime long, size long, content string")
    engine = Engine(spark, store.Store(spark, str(tmp_path / "e")), config.Settings(folders=(config.Folder(""),)))
    engine.reindex(notes)
    q = spark.createDataFrame([(1, "river water green hills", None)], "query_id long, text string, source_path string")
    got = [(r["note_path"], r["mode"]) for r in engine.all_paths(q).collect()]
    parts = {m: sorted(r["note_path"] for r in engine.recall(q, m).collect()) for m in ("semantic", "tag")}
    assert sorted(got) == sorted((p, m) for m, ps in parts.items() for p in ps)
    assert ("n2.md", "tag") in got and ("n3.md", "semantic") in got and {("n1.md", "tag"), ("n1.md", "semantic")} <= set(got)


EVENTS = "session string, event_id int, ts timestamp, value string"


def events(spark):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([("s", i, t + timedelta(seconds=x), v) for i, (x, v) in enumerate(((0, "a"), (1, "a"), (2, "b"), (6, None)))], EVENTS)


def test_debounce(spark):
    got = reactive.debounce(events(spark), "session").orderBy("fired_at").collect()
    assert [(r["events"], r["last"]["event_id"]) for r in got] == [(3, 2), (1, 3)]


def test_changes(spark):
    assert [r["event_id"] for r in reactive.changes(events(spark), "session", "value").orderBy("event_id").collect()] == [0, 2, 3]
    assert [r["value"] for r in reactive.sticky(events(spark), "session", "value").orderBy("event_id").collect()] == ["a", "a", "b", "b"]
    assert [r["event_id"] for r in reactive.latest_wins(events(spark).withColumnRenamed("event_id", "generation"), "session").withColumnRenamed("generation", "event_id").collect()] == [3]


def test_streams(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    q = reactive.stream_changes(stream, "session", "value").writeStream.format("memory").queryName("changed").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["value"] or "" for r in spark.table("changed").collect()) == ["", "a", "b"]
    seen = []
    q = reactive.debounce(stream, "session", watermark="1 second").writeStream.format("memory").queryName("fired").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["events"] for r in spark.table("fired").collect()] == [3]  # the second run is not over yet
    t = stream.select("session", F.col("ts").alias("fired_at"), "value")
    q = reactive.run_recall(t, lambda b: b, lambda b: seen.extend(b.collect()), str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert len(seen) == 1 and seen[0]["value"] is None


def test_suppression(spark):
    t = datetime(2024, 1, 1)
    rows = [("s", t + timedelta(milliseconds=m), p, manual) for m, p, manual in ((100, "a", False), (100, "a", True), (900, "a", False), (100, "b", False), (100, "c", False))]
    triggers = spark.createDataFrame(rows, "session string, ts timestamp, path string, manual boolean")
    opened = spark.createDataFrame([("s", "a", t)], "session string, path string, opened_at timestamp")
    shown = spark.createDataFrame([("s", "c")], "session string, path string")
    got = {(r["path"], r["manual"], r["ts"].microsecond) for r in reactive.not_suppressed(triggers, opened, shown).collect()}
    assert got == {("a", True, 100000), ("a", False, 900000), ("b", False, 100000)}


def test_gate_of_tables_and_streams(spark, tmp_path):
    t = datetime(2024, 1, 1)
    steps = [(0, "a", "open"), (100, "a", "trigger"), (200, "b", "trigger"), (300, "a", "manual"), (900, "a", "trigger"), (1000, None, "pause"), (1100, "b", "trigger"), (1200, "b", "manual"), (1300, None, "resume"), (1400, "b", "trigger"), (1500, None, "trigger")]
    rows = spark.createDataFrame([("s", i, t + timedelta(milliseconds=ms), p, kind) for i, (ms, p, kind) in enumerate(steps)], "session string, event_id int, ts timestamp, path string, kind string")
    want = [2, 3, 4, 7, 9, 10]
    assert sorted(r["event_id"] for r in reactive.gate(rows).collect()) == want
    for i, part in enumerate((rows.where("event_id < 6"), rows.where("event_id >= 6"))):  # the state outlives a run
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = reactive.stream_gate(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(60)
    got = sorted((r["ts"], r["path"], r["kind"]) for r in spark.read.parquet(str(tmp_path / "out")).fillna("").collect())
    assert got == sorted((t + timedelta(milliseconds=steps[i][0]), steps[i][1] or "", steps[i][2]) for i in want)


def test_sticky_stream(spark, tmp_path):
    events(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    q = reactive.stream_sticky(stream, "session", "value").writeStream.format("memory").queryName("stuck").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["value"] for r in spark.table("stuck").orderBy("ts").collect()] == ["a", "a", "b", "b"]
