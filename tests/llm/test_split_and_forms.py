import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleaner.llm import skeleton as sk
from gleaner.llm import splitting


@settings(max_examples=400, deadline=None)
@given(st.text("aaaaab가é. !\n\ŕᅡ", max_size=300), st.integers(1, 60), st.integers(0, 40))
def test_pieces(text, room, overlap):
    out, run = splitting.pieces(text, room, overlap)
    assert (not out) == (not text)
    if out:
        assert out[0][0] == 0 and out[-1][1] == len(text)
    assert all(0 < e - s <= room for s, e, _ in out)
    for (s, e, _), (s2, e2, _) in zip(out, out[1:]):
        assert s < s2 <= e < e2 and e - s2 <= overlap
    assert run == max(map(len, re.split(r"[\s.!?。！？]+", text)))
    assert any(h for *_, h in out) == (run > room)


def test_boundaries():
    text = "First one. Second one.\n\nA new paragraph here"
    cut, _ = splitting.pieces(text, 30, 0)
    assert [text[s:e] for s, e, _ in cut] == ["First one. Second one.\n\n", "A new paragraph here"]
    cut, _ = splitting.pieces("aaaa bbbb cccc dddd", 12, 6)
    assert [("aaaa bbbb cccc dddd")[s:e] for s, e, _ in cut] == ["aaaa bbbb ", "bbbb cccc ", "cccc dddd"]


def test_marks_stay_with_their_letter():
    text = "é" * 50
    cut, _ = splitting.pieces(text, 7, 0)
    assert all(text[s] == "e" for s, _, _ in cut)


def test_split(spark):
    long = "word " * 400
    rows = [(1, "H", long), (2, None, long), (3, "H", "short"), (4, None, None), (5, None, "x" * 3000), (6, "h" * 1600, "text"), (7, "", ""), (1, "H", long), (8, "h" * 1499, "ab cd"), (9, None, "y" * 200_000 + " end")]
    df = spark.createDataFrame(rows, "chunk_id long, heading string, text string").withColumns({"piece": F.lit("p"), "cut": F.lit("c"), "key": F.lit(1)})
    out = splitting.split_oversized(df)
    got = out.collect()
    texts = {r[0]: r[2] for r in rows}
    assert {r["chunk_id"] for r in got} == {1, 2, 5, 6, 8, 9}
    for r in got:
        assert len(r["heading"] or "") + len(r["text"]) <= 1500 and r["text"] == texts[r["chunk_id"]][r["start"] : r["end"]]
    assert {r["chunk_id"]: r["cut"] for r in got} == {1: "natural", 2: "natural", 5: "forced", 6: "forced", 8: "forced", 9: "forced"}
    assert sum(r["chunk_id"] == 1 and r["piece"] == 0 for r in got) == 2 and {r["heading"] for r in got if r["chunk_id"] == 2} == {None}
    assert splitting.split_oversized(df.limit(0)).count() == 0


def test_overlong_headings(spark):
    """Nothing of a heading is lost, and an item without text has pieces too."""
    heads = {1: "h" * 1600, 2: "k" * 1600, 3: "word " * 800, 4: "h" * 1500}
    texts = {1: "text", 2: "", 3: "more " * 500, 4: "x"}
    df = spark.createDataFrame([(i, heads[i], texts[i]) for i in heads], "chunk_id long, heading string, text string")
    got = sorted(splitting.split_oversized(df).collect())
    for i, head in heads.items():
        mine = [r for r in got if r["chunk_id"] == i]
        assert [r["piece"] for r in mine] == list(range(len(mine))) and all(len(r["heading"]) + len(r["text"]) <= 1500 for r in mine)
        own = [r["heading"] for r in mine if not r["text"]]
        cut, _ = splitting.pieces(head, 1500, 150)
        assert own == [head[s:e] for s, e, _ in cut] and cut[-1][1] == len(head)
        rest = [r for r in mine if r["text"]]
        assert all(r["heading"] == head[:750] for r in rest) and bool(rest) == bool(texts[i]) and (not rest or rest[-1]["end"] == len(texts[i]))
    assert {r["chunk_id"] for r in got if r["piece"] == 0} == set(heads)


@pytest.mark.parametrize(
    "a, b",
    [("Ⅳ", "IV"), ("ﬁn", "fin"), ("가", "가"), ("ｗｉｄｅ！", "wide!"), ("a b　c", "a b c"), ("z​e­r﻿t", "zert"), ("раѕѕ", "pass"), ("ΑΒΕ", "ABE"), ("é", "é"), ("Å", "Å"), ("ї", "ï"), ("ｱ", "ア"), ("№ ㎏", "No kg"), ("樂", "樂"), ("а́", "á")],
)
def test_alike(a, b):
    assert sk.skeleton(a) == sk.skeleton(b)


@pytest.mark.parametrize("a, b", [("a", "A"), ("e", "é"), ("2", "²"), ("2", "②"), ("l", "1"), ("l", "I"), ("O", "0"), (".", "!"), ("a b", "a  b"), ("a b", "ab"), ("½", "1/2"), ("к", "k"), ("ㄱㅏ", "가"), ("\n", " "), ("c", "ç"), (",", ";")])
def test_apart(a, b):
    assert sk.skeleton(a) != sk.skeleton(b)


@pytest.mark.parametrize("a, b", [("\u04c0", "I"), ("\u04af", "y"), ("Г", "Γ"), ("П", "Π"), ("Ф", "Φ"), ("\u0470", "Ψ"), ("\u0471", "ψ"), ("\u0585\u057d", "ou"), ("\u0555\u054d", "OU"), ("\u0570\u0578", "hn"), ("\u13a0\u13aa\u13df\u13c3", "DACZ"), ("Ѓ", "Γ\u0301")])
def test_further_alphabets(a, b):
    assert a != b and sk.skeleton(a) == sk.skeleton(b)


@pytest.mark.parametrize("a, b", [("\u04c0", "l"), ("Г", "T"), ("п", "π"), ("Д", "Δ"), ("Л", "Λ"), ("\u13d2", "R")])
def test_further_letters_apart(a, b):
    assert sk.skeleton(a) != sk.skeleton(b)


def test_published_letters(spark):
    """Letters that only the published table joins; one form of one form is itself, for every sign of the table."""
    table = sk.prototypes(spark)
    form = lambda x: sk.skeleton(x, table)
    for a, b in ("\u03bdv", "\u0461\u0461", "\u2c9eO", "\ua4eeA", "\u0261g", "\u04afy", "\u0585o", "\u13aaA"):
        assert form(a) == form(b)
    for a, b in ("\u0433r", "\u0131i", "\u03b1a", "\u043f\u03c0", "lI", "l1", "O0", "\u0406l", "\u0627I", "\u0423Y", "ßβ"):
        assert form(a) != form(b)
    assert all(form(form(c)) == form(c) for c in map(chr, table))
    df = spark.createDataFrame([(1, "\u03bd\u2c9f\u2c9e"), (2, "voO"), (3, "voo")], "doc_id long, text string")
    assert [tuple(r) for r in sk.look_alike_pairs(df).collect()] == [(1, 2)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_one_form(text):
    assert sk.skeleton(sk.skeleton(text)) == sk.skeleton(text)


def test_look_alike_pairs(spark):
    rows = [(1, "pass"), (2, "раѕѕ"), (3, "pass"), (4, None), (5, ""), (6, "​"), (7, "other"), (8, "other"), (2, "раѕѕ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"form_1": F.lit("f"), "key": F.lit("k")})
    assert sorted(map(tuple, sk.look_alike_pairs(df).collect())) == [(1, 2), (2, 3), (5, 6)]
    many = spark.createDataFrame([(i, "copy") for i in range(3000)] + [(5000, "с\u043epy")], "doc_id long, text string")
    assert sk.look_alike_pairs(many).count() == 3000
    forms = {(r["doc_id"], r["form"]) for r in sk.visible_forms(df).collect()}
    assert (2, "pass") in forms and (4, None) in forms and (6, "") in forms and len(forms) == 8
    assert sk.look_alike_pairs(df.limit(0)).count() == 0
