import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import cooccurrence as co
from gleaner.llm import queries, termstats
from gleaner.llm.text import terms
from gleaner.runtime import materialise


def brute_pairs(rows, least, lift):
    baskets = {}
    for b, i in rows:
        if b is not None:
            baskets.setdefault(b, set()).update([i] if i is not None else [])
    single = Counter(i for s in baskets.values() for i in s)
    met = Counter(p for s in baskets.values() for p in combinations(sorted(s), 2))
    n = len(baskets)
    return {(x, y): (c, single[x], single[y], n) for (x, y), c in met.items() if c >= least and c * n >= lift * single[x] * single[y]}


def found(df):
    return {(r["item_1"], r["item_2"]): (r["together"], r["records_1"], r["records_2"], r["records"]) for r in df.collect()}


def make(seed, baskets=120, items=25):
    rng = random.Random(seed)
    rows = [(b, f"i{min(rng.randrange(items), rng.randrange(items)):02}") for b in range(baskets) for _ in range(rng.randrange(7))]
    return rows + rows[:40] + [(None, "i01"), (5, None), (9999, None)]


@pytest.mark.parametrize("lift", [0.0, 1.5])
def test_pairs(spark, lift):
    rows = make(1)
    df = spark.createDataFrame(rows, "b int, i string").withColumns({"key": F.lit("x"), "basket": F.lit("y"), "id": F.lit(1)})
    assert found(co.item_pairs(df, "b", "i", min_together=3, min_lift=lift)) == brute_pairs(rows, 3, lift)


def test_large_baskets_hot_items_and_shuffle_joins(spark, monkeypatch):
    """Every other way through: no broadcast, salted stripes, baskets in blocks, the largest ones looked up."""
    rows = make(2) + [(b, f"i{i:02}") for b in range(1000, 1006) for i in range(25) if (i + b) % 6] + [(b, "i00") for b in range(2000, 2100)]
    monkeypatch.setattr(co, "BROADCAST_BYTES", 0)
    df = spark.createDataFrame(rows, "b int, i string")
    got = co.item_pairs(df, "b", "i", min_together=3, block=6, hot_rows=3, flush=50)
    want = brute_pairs(rows, 3, 0)
    assert found(got) == want
    row = got.where("item_1 = 'i00'").orderBy(F.desc("together")).first()
    c, a, b, n = want[(row["item_1"], row["item_2"])]

    def term(k, r, s):
        return k * math.log(k * n / (r * s)) if k else 0.0

    llr = 2 * (term(c, a, b) + term(a - c, a, n - b) + term(b - c, n - a, b) + term(n - a - b + c, n - a, n - b))
    assert math.isclose(row["llr"], llr, rel_tol=1e-9) and math.isclose(row["lift"], c * n / (a * b))


def test_parts_follow_support():
    """An item's parts double with its baskets; ids rise as support falls."""
    hot = np.array([9, 4, 1])  # ids up to 9 have more than n baskets, up to 4 more than 2 n, up to 1 more than 4 n
    assert co.parts_of(np.array([0, 1, 2, 4, 5, 9, 10, 99]), hot).tolist() == [8, 8, 4, 4, 2, 2, 1, 1]
    assert co.parts_of(np.array([0, 7]), np.zeros(0, np.int64)).tolist() == [1, 1]


def test_least_ratio(spark):
    df = spark.createDataFrame(make(4), "b int, i string")
    every = co.item_pairs(df, "b", "i", min_together=1)
    assert 0 < co.item_pairs(df, "b", "i", min_together=1, min_llr=2.0).count() == every.where("llr >= 2.0").count() < every.count()


def test_significance(spark):
    """Marked are pairs that chance hardly gives; not those at chance, nor those far below it."""
    rows = [(b, i) for b in range(20) for i in "xy"] + [(b, "z") for b in range(0, 200, 2)] + [(b, "p" if b % 2 else "q") for b in range(200)] + [(1, "q")]
    got = {(r["item_1"], r["item_2"]): r for r in co.item_pairs(spark.createDataFrame(rows, "b int, i string"), "b", "i", min_together=1).collect()}
    assert got["x", "y"]["significant"] and not got["x", "z"]["significant"]
    assert not got["p", "q"]["significant"] and got["p", "q"]["llr"] > co.SIGNIFICANT
    assert all(r["significant"] == (r["llr"] >= 10.828 and r["lift"] > 1) for r in got.values())


def test_path_spellings(spark):
    notes = spark.createDataFrame([("가/b c.md",), ("가/b c.md",), ("x/y.md",), (None,)], "path string")
    hits = [(q, p) for q in range(8) for p in ("/가//b c.md", "x\\y.md", "gone.md")] + [(1, None), (None, "x/y.md")]
    df = spark.createDataFrame(hits, "query_id int, note_path string").withColumn("path", F.lit("z"))
    assert found(co.path_pairs(df, notes)) == {("x/y.md", "가/b c.md"): (8, 8, 8, 8)}


def test_every_pair_with_baskets_in_blocks(spark, monkeypatch):
    """With one common basket enough none is looked up, and large baskets are still cut into blocks."""
    rows = make(3) + [(1000, f"i{i:02}") for i in range(25)]
    written = []
    monkeypatch.setattr(co, "materialise", lambda df, label: written.append(label) or materialise(df, label))
    got = co.item_pairs(spark.createDataFrame(rows, "b int, i string"), "b", "i", min_together=1, block=6)
    assert found(got) == brute_pairs(rows, 1, 0)
    assert "blocks" in written


def test_all_note_pairs(spark, tmp_path):
    spark.createDataFrame([("a.md",), ("b.md",), ("c.md",)], "path string").write.parquet(f"{tmp_path}/notes.parquet")
    hits = [(q, p) for q in range(9) for p in ("a.md", "b.md")] + [(0, "c.md"), (9, "c.md")]
    spark.createDataFrame(hits, "query_id long, note_path string").write.parquet(f"{tmp_path}/hits.parquet")
    got = queries.queries()["p1_all"](spark, str(tmp_path)).collect()
    assert {(r["path_1"], r["path_2"]): (r["together"], r["records_1"], r["records_2"], r["records"]) for r in got} == {("a.md", "b.md"): (9, 9, 9, 10), ("a.md", "c.md"): (1, 9, 2, 10), ("b.md", "c.md"): (1, 9, 2, 10)}
    assert queries.queries()["p1_pairs"](spark, str(tmp_path)).count() == 1


def test_no_pairs(spark):
    assert co.item_pairs(spark.createDataFrame([], "b int, i string"), "b", "i").count() == 0
    one = spark.createDataFrame([(1, "a"), (1, "b")], "b int, i string")
    assert co.item_pairs(one, "b", "i").count() == 0 and co.item_pairs(one, "b", "i", min_together=1).count() == 1


def test_terms():
    assert terms("Äpfel a_b2 ﬁx ²³ 가나") == ["äpfel", "b2", "ﬁx", "²³", "가나"]


@pytest.mark.parametrize("flush", [3, 200_000])
def test_statistics(spark, flush):
    texts = ["one two two", "two, Three", None, "", "x" * 2_000_000 + " two", "two", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumns({"term": F.lit(1), "records": F.lit(2)})
    occurrences, records = Counter(), Counter()
    for t in texts:
        occurrences.update(terms(t or ""))
        records.update(set(terms(t or "")))
    got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in termstats.term_statistics(df, min_records=2, max_share=0.4, flush=flush).collect()}
    assert got == {t: (n, records[t], "rare" if records[t] < 2 else "common" if records[t] > 0.4 * 7 else "kept") for t, n in occurrences.items()}
    assert got["two"] == (5, 4, "common") and got["one"][2] == "kept"
    assert termstats.term_statistics(df.limit(0)).count() == 0
