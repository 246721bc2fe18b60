import pytest
from pyspark.sql import functions as F

from gleaner.functions import scoring, text
from gleaner.operators import tokenize
from gleaner.operators.chunking import chunk_notes
from gleaner.operators.parsing import note_keys, with_parts
from gleaner.operators.tokenize import analyzed_terms, terms_of


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_strip_frontmatter(spark):
    got = column(spark, ["---\na: 1\n---\n\nbody", "---\n---\nx", "x\n---\na\n---\n", "---\r\na\r\n---\r\nb", None, ""], text.strip_frontmatter)
    assert got == ["body", "---\n---\nx", "x\n---\na\n---\n", "b", None, ""]


def test_normalize_tag(spark):
    assert column(spark, ["#a/b", "[[x|y]]", "x#s", "x^b", "🔖 x", "  ", "🔖🔖 #y", "[[]]", "[[a#b|c]]"], text.normalize_tag) == ["a/b", "x", "x", "x", "x", "", "", "", "a"]


def test_link_variants(spark):
    got = column(spark, ["[[dir/x#s|alias]]", "#a/b", "x", "", "dir/"], text.link_variants)
    assert got == [["dir/x", "x"], ["a/b", "b"], ["x"], [], ["dir/"]]


def test_plain_terms(spark):
    got = column(spark, ["Äpfel, a b2 _x_ BM25 bm25", "하나님 은혜", None], text.plain_terms)
    assert got == [["äpfel", "b2", "bm25", "bm25"], ["은혜"], []]


def test_hangul_terms(spark):
    assert column(spark, ["은혜는 GPT-4 모델을 주", "BM25 검색", ""], terms_of) == [["은혜", "gpt", "4", "모델"], ["bm25", "검색"], []]


def test_analyzer(spark):
    class Split:
        def analyze(self, t):
            return [(w, "NNG" if len(w) > 1 else "JX") for w in t.split()]

    rows = spark.createDataFrame([(1, "은혜 는 GPT 하나님"), (2, "plain Text"), (3, None)], "i int, text string")
    got = {r["i"]: r["terms"] for r in analyzed_terms(rows, "text", Split).collect()}
    assert got == {1: ["은혜", "gpt"], 2: ["plain", "text"], 3: []}


def test_canonical_title(spark):
    got = column(spark, ["제목", "제목 2", "제목 복사본", "제목 복사본 3", "제목 2 복사본", " 3"], text.canonical_title)
    assert got == ["제목", "제목", "제목", "제목", "제목 2", ""]


def test_titles_links_flags(spark):
    assert column(spark, ["a/b.md", "c.md.md", "d"], text.title_of) == ["b", "c.md", "d"]
    row = spark.range(1).select(text.wikilink(F.lit("t"), F.lit(None).cast("string")), text.wikilink(F.lit("t"), F.lit("h")), text.flags(F.lit(2), F.lit(None).cast("int"), F.lit(True), F.lit(1), F.lit(3))).first()
    assert list(row) == ["[[t]]", "[[t#h]]", "B2 H 1/3"]


def test_ago(spark):
    now = 1_700_000_000_000
    got = column(spark, [now - 5_000, now - 120_000, now - 7_200_000, now - 90_000_000], lambda c: text.ago(c, F.lit(now)), "long")
    assert got == ["5 s", "2 min", "2 h", "2023-11-13"]


def test_paths(spark):
    from gleaner.functions.paths import normal_paths

    rows = spark.createDataFrame([("/a//b\\c d.md",), (None,), ("e\u0301",)], "p string")
    assert [r[0] for r in normal_paths(rows, "p").collect()] == ["a/b/c d.md", None, "\u00e9"]


def test_highlight(spark):
    got = column(spark, ["Grace and grAceful a.b"], lambda c: text.highlight(c, ["grace", "graceful", "a.b", "x", "하나님"]))
    assert got == ["<mark>Grace</mark> and <mark>grAceful</mark> <mark>a.b</mark>"]


def test_synonym_lists(spark):
    got = column(spark, ['{"k":["ab"," cd ","e","k"],"z":3}', "no json", None], text.synonym_lists)
    assert got == [{"k": ["ab", "cd"]}, {}, {}]


def chunks(spark, body, most=1500):
    rows = chunk_notes(spark.createDataFrame([("n", body)], "path string, content string"), most=most)
    return [(r["ord"], r["heading"], r["text"]) for r in rows.orderBy("ord").collect()]


@pytest.mark.parametrize(
    "body, most, expected",
    [
        ("a\n# H\n\n## K\ntext", 1500, [(0, None, "a"), (1, "K", "text")]),
        ("aaaa\n\nbbbb\n\ncc", 10, [(0, None, "aaaa\n\nbbbb"), (1, None, "cc")]),
        ("abcdefghijklmno", 10, [(0, None, "abcdefghij"), (1, None, "klmno")]),
        ("#nospace", 1500, [(0, None, "#nospace")]),
        ("  \n ", 1500, []),
        ("# H\r\nx\r\n", 1500, [(0, "H", "x")]),
        ("# A\na\n#\tB \t\nb", 1500, [(0, "A", "a"), (1, "B", "b")]),
    ],
)
def test_chunks(spark, body, most, expected):
    assert chunks(spark, body, most) == expected


def test_chunks_against_plain_python(spark):
    import random

    def plain(t, most):
        out, buf = [], ""
        if len(t) <= most:
            return [t]
        import re

        for p in re.split("\n{2,}", t):
            if len(buf) + len(p) + 2 > most and buf:
                out += [buf.strip()] if buf.strip() else []
                buf = ""
            buf = buf + "\n\n" + p if buf else p
            while len(buf) > most:
                out.append(buf[:most].strip())
                buf = buf[most:]
        return [x for x in [*out, buf.strip()] if x.strip()]

    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b ", "\n", "\n\n", "가"]) for _ in range(rng.randrange(1, 120))).strip() for _ in range(60)]
    rows = chunk_notes(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, content string"), most=12)
    got = {}
    for r in rows.orderBy("ord").collect():
        got.setdefault(int(r["note_path"]), []).append(r["text"])
    assert got == {i: w for i, t in enumerate(texts) if (w := [x for x in plain(t, 12) if x.strip()])}
    assert all(len(x) <= 12 for w in got.values() for x in w)


def test_note_keys(spark):
    content = "---\ntags: [one, '#two/x']\ndoctrine:\n  - \"[[Grace|g]]\"\n---\nbody #three #12 [[dir/Faith#s|f]] [[other]]"
    parsed = with_parts(spark.createDataFrame([("n", content), ("m", None), ("e", "")], "path string, content string"))
    assert parsed.where("path = 'n'").first()["tags"] == ["one", "two/x", "three"]
    keys = note_keys(parsed, spark.createDataFrame([("Faith",)], "key string"))
    assert {(r["kind"], r["key"]) for r in keys.collect()} == {("doctrine", "Grace"), ("doctrine", "Faith"), ("tag", "dir/Faith"), ("tag", "one"), ("tag", "two/x"), ("tag", "x"), ("tag", "three"), ("tag", "other")}


def test_nearest_rank(spark):
    rows = spark.createDataFrame([([5, 1, 4, 2],), ([],)], "v array<int>")
    got = rows.select(scoring.nearest_rank(F.col("v"), 0.5), scoring.nearest_rank(F.col("v"), 0.95)).collect()
    assert [tuple(r) for r in got] == [(4, 5), (None, None)]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 1.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in rows.select(scoring.cosine(F.col("a"), F.col("b"))).collect()] == [0.707106781, 0]


def test_tokenizer_is_timed(spark):
    took = tokenize.timed(spark, "some words of a text", runs=2)
    assert set(took) == {"words", "terms"} and all(0 < v < 60_000 for v in took.values())
