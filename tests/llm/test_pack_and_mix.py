import random

import pytest
from pyspark.sql import functions as F

from gleaner.llm import mixing, packing
from gleaner.llm.text import encoder


def check(rows, placed, capacity):
    """Every item whole and in order, no container over its capacity, figures right; the number of containers."""
    want, got, fill = {}, {}, {}
    for k, n in rows:
        if n is not None:
            want.setdefault(k, []).append(n)
    for r in placed:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["tokens"]))
        fill.setdefault(r["container"], []).append(r)
    assert set(got) == set(want)
    for k, sizes in want.items():
        pieces = [(i, s, min(capacity, n - s)) for n in sizes for i, s in enumerate(range(0, max(n, 1), capacity))]
        assert sorted(pieces) == sorted(got[k])
    for inside in fill.values():
        used = sum(r["tokens"] for r in inside)
        assert used <= capacity and {(r["used"], r["unused"]) for r in inside} == {(used, capacity - used)}
    return len(fill)


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, int(rng.paretovariate(1.1) * 20)) for i in range(3000)] + [(4000, 0), (4001, None), (4002, 10_000), (4003, 1000), (4004, 2000), (1, 500), (None, 7)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").repartition(7).withColumns({"container": F.lit("x"), "key": F.lit(1), "window": F.lit(2)})
    placed = packing.pack(df, capacity=1000, open_windows=16).collect()
    n = check(rows, placed, 1000)
    assert n <= 1.03 * -(-sum(x or 0 for _, x in rows) // 1000) + 2


def test_many_tasks_merge_their_leftovers(spark, monkeypatch):
    rows = [(i, 30) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").repartition(40)
    assert check(rows, packing.pack(df, capacity=1000).collect(), 1000) <= 8
    monkeypatch.setattr(packing, "MERGED_AT_ONCE", 10)
    assert check(rows, packing.pack(df, capacity=1000).collect(), 1000) <= 12


def test_pack_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, tokens long")
    assert packing.pack(none).count() == 0 and packing.containers(packing.pack(none)).count() == 0
    empty = spark.createDataFrame([(1, 0)], "doc_id long, tokens long")
    assert [(r["tokens"], r["unused"]) for r in packing.pack(empty).collect()] == [(0, 2048)]


def test_sizes(spark):
    rows = [(1, "one two"), (2, None), (3, ""), (4, "<|endoftext|> 가나다"), (5, "a" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("x"))
    got = {r["doc_id"]: r["tokens"] for r in packing.token_sizes(df, ["doc_id"]).collect()}
    assert got == {i: None if t is None else len(encoder().encode_ordinary(t)) for i, t in rows} and got[3] == 0


TARGETS = [("A", 0.5, 2), (" b", 0.3, 4), ("C", 0.1, 1), ("missing", 0.1, 3), ("zero", 0.0, 5), ("none", None, 1), (None, 0.2, 1)]


def documents(seed=1, n=4000):
    rng = random.Random(seed)
    names = ["a", "A ", "b", "c", "c", "c", "zero", "none", "other", None]
    return [(i, rng.choice(names), int(rng.lognormvariate(4, 1.2))) for i in range(n)] + [(n, "a", None), (n + 1, "b", 0), (None, "c", 50)]


def test_mix(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long").withColumns({"key": F.lit("k"), "slot": F.lit(1), "cap": F.lit(0)})
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int").withColumn("tokens", F.lit(1))
    m = mixing.mix(df, targets)
    copies = m.copies.collect()
    by_id = {i: (s.strip().lower() if s else s, t) for i, s, t in rows}
    cap = {"a": 2, "b": 4, "c": 1}
    assert copies and all(by_id[r["doc_id"]] == (r["source"], r["tokens"]) and 1 <= r["copies"] <= cap[r["source"]] for r in copies)
    assert len({r["doc_id"] for r in copies}) == len(copies)
    total = sum(r["tokens"] * r["copies"] for r in copies)
    shares = {r["source"]: r for r in m.shares.collect()}
    for s, want in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        mine = sum(r["tokens"] * r["copies"] for r in copies if r["source"] == s)
        assert abs(mine / total - want) < 0.001 and mine == shares[s]["tokens"] and abs(shares[s]["actual_share"] - mine / total) < 1e-12
        assert abs(shares[s]["reachable_share"] - want) < 1e-12
    assert shares["missing"]["tokens"] == shares["zero"]["tokens"] == shares["none"]["tokens"] == 0
    have = {s: sum(t for x, t in by_id.values() if x == s and t) for s in cap}
    most = min(cap[s] * have[s] / w for s, w in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)))
    assert abs(total / most - 0.98) < 0.002
    again = mixing.mix(df, targets).copies.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, copies))


def test_rates_that_are_not_solved_are_an_error(spark):
    cells = spark.createDataFrame([("a", t, 10) for t in (1, 5, 20, 100)] + [("b", t, 3) for t in (2, 50)], "source string, tokens long, n long")
    with pytest.raises(RuntimeError, match="misses its goal"):
        mixing.solve_rates(cells, {"a": (900.0, 1.0), "b": (200.0, 3.0)}, rounds=1)


def test_rates_solve_the_dual(spark):
    import math

    cells = spark.createDataFrame([("a", t, 10) for t in (1, 5, 20, 100)] + [("b", t, 3) for t in (2, 50)], "source string, tokens long, n long")
    goals = {"a": (900.0, 1.0), "b": (200.0, 3.0)}
    rates = mixing.solve_rates(cells, goals)
    for s, (goal, cap) in goals.items():
        base, tilt, scale = rates[s]
        given = sum(r["n"] * r["tokens"] * cap / (1 + math.exp(-(base + tilt * r["tokens"] / scale))) for r in cells.where(F.col("source") == s).collect())
        assert abs(given - goal) < 1e-5 * goal
    assert rates["a"][1] < 0 < rates["b"][1]  # less and more than the even rate: tilted down and up


@pytest.mark.parametrize("docs, targets", [([], TARGETS), (documents(n=50), []), ([(1, "other", 5)], TARGETS), ([(1, "a", 7)], TARGETS), ([(i, "a", 100) for i in range(300)], TARGETS)])
def test_mix_edges(spark, docs, targets):
    df = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    m = mixing.mix(df, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    shares = m.shares.collect()
    copies = m.copies.collect()
    assert len(shares) == (6 if targets else 0) and all(r["copies"] <= 2 for r in copies)
    if len(docs) == 300:
        assert abs(sum(r["copies"] for r in copies) - 0.98 * 600) <= 1
