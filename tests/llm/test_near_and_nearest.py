import os
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.llm import knn, neardup, queries

P = neardup.Params(shingle=3, threshold=0.7, min_terms=5)


def texts(seed=3, families=12):
    rng = random.Random(seed)
    out = []
    for _ in range(families):
        base = [f"w{rng.randrange(4000)}" for _ in range(80)]
        out.append(" ".join(base))
        for edits in (0, 1, 2, 4, 7, 12):
            new = base[:]
            for _ in range(edits):
                new[rng.randrange(len(new))] = f"v{rng.randrange(4000)}"
            out.append(" ".join(new))
    rng.shuffle(out)
    return out


def brute(rows, p):
    sets = {i: neardup.shingles(t, p.shingle, p.min_terms) for i, t in rows if t}
    sets = {i: set(s.tolist()) for i, s in sets.items() if s is not None}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= p.threshold * len(sets[a] | sets[b])}


def test_pairs(spark):
    rows = list(enumerate(texts())) + [(900, None), (901, ""), (902, "too short"), (903, "same few words here now ok"), (904, "same few words here now ok")]
    df = spark.createDataFrame(rows, "chunk_id long, text string").withColumns({"id": F.lit("x"), "rep": F.lit("y"), "band": F.lit(1)})
    near = neardup.near_duplicates(df, params=P)
    assert {tuple(r) for r in neardup.near_duplicate_pairs(near).collect()} == brute(rows, P)
    assert (903, 904) in brute(rows, P)
    groups = {r["id"]: r for r in neardup.near_duplicate_groups(near).collect()}
    assert len(groups) == len(rows) - 3 and groups[904]["group_id"] == groups[904]["rep"] == 903
    root = {i: i for i in groups}

    def top(i):
        return i if root[i] == i else top(root[i])

    for a, b in brute(rows, P):
        x, y = sorted((top(a), top(b)))
        root[y] = x
    assert {i: g["group_id"] for i, g in groups.items()} == {i: top(i) for i in groups}


def test_many_copies_are_one_class(spark):
    t = texts(4, 2)
    rows = [(i, t[0]) for i in range(400)] + [(400 + i, x) for i, x in enumerate(t)]
    near = neardup.near_duplicates(spark.createDataFrame(rows, "chunk_id long, text string"), params=P)
    assert near.members.count() == len(rows) and near.links.count() < 60
    assert near.members.where("rep = 0").count() >= 401


def test_every_chunk_has_a_class(spark, tmp_path):
    rows = [(1, "TODO"), (2, "todo!"), (3, "아멘."), (4, "아멘"), (5, "(빈 절)"), (6, "(빈 절)"), (7, "---"), (8, ""), (9, ""), (10, None), (11, None), (12, "one two"), (13, "two one"), (14, "one two three four five"), (15, "one two three four")]
    spark.createDataFrame(rows, "chunk_id long, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["chunk_id"]: r["rep"] for r in queries.queries()["p4_groups"](spark, str(tmp_path)).collect()}
    assert got == {i: {2: 1, 4: 3, 6: 5, 9: 8}.get(i, i) for i, _ in rows}


def test_a_family_that_is_not_similar_stays_in_the_join(spark):
    """Chunks made from one template that share a third of their shingles: they agree in some bands, but none is a candidate."""
    rng = random.Random(5)
    head = [f"t{i}" for i in range(100)]
    rows = [(i, " ".join(head + [f"w{rng.randrange(10**6)}" for _ in range(100)])) for i in range(250)]
    p = neardup.Params(shingle=3, threshold=0.8, min_terms=5)
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    signed = neardup.signatures(df.select(F.col("chunk_id").alias("id"), "text"), p)
    bands = signed.select("id", F.explode("bands").alias("band"))
    meet = bands.alias("a").join(bands.alias("b"), "band").where("a.id < b.id").count()
    assert meet > 2000 and neardup.met_in_bands(signed, p).count() < meet / 50
    assert neardup.near_duplicates(df, params=p).links.count() == 0


def test_standard_error():
    assert abs(neardup.standard_error(0.5, 128, 64) - (0.25 / 128) ** 0.5) < 1e-9
    assert neardup.standard_error(0.7, 128, 1) > neardup.standard_error(0.7, 128, 4) > (0.21 / 128) ** 0.5


def test_none(spark):
    near = neardup.near_duplicates(spark.createDataFrame([], "chunk_id long, text string"), params=P)
    assert near.members.count() == near.links.count() == neardup.near_duplicate_pairs(near).count() == neardup.near_duplicate_groups(near).count() == 0


def test_estimate(spark):
    p = neardup.Params()
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 1000, np.uint64)
    for share in (0.0, 0.5, 0.9):
        other = np.unique(np.concatenate([base[: int(share * 1000)], rng.integers(0, 2**63, 1000 - int(share * 1000), np.uint64)]))
        m = neardup.minima(np.concatenate([np.unique(base), other]), np.array([0, 1000]), p.hashes)
        w = neardup.pack(m)
        row = {f"s{i}_{k + 1}": int(x[k]) for i, x in enumerate(w) for k in (0, 1)}
        got = spark.createDataFrame([row]).select(neardup.estimate(p)).first()[0]
        assert abs(got - share / (2 - share)) < 0.16


def vectors(seed, n, dim, spread=0.4):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 12 + 1, dim))
    return (centers[rng.integers(0, len(centers), n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)


def nearest_by_force(ids, x, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {int(i): [(int(ids[j]), s[r, j]) for j in np.lexsort((ids, -s[r]))[:k]] for r, i in enumerate(ids)}


def test_nearest(spark):
    x, y = vectors(1, 900, 24), vectors(2, 300, 9)
    rows = [(i, "a", 24, v.tolist()) for i, v in enumerate(x)] + [(i, "b", 9, v.tolist()) for i, v in enumerate(y)]
    bad = [(5000, "a", 24, None), (5001, "a", 24, [0.0] * 24), (5002, "a", 24, [float("nan")] + [1.0] * 23), (5003, "a", 3, x[0].tolist()), (5004, None, 9, y[0].tolist()), (5005, "a", 24, [None] + [1.0] * 23), (None, "b", 9, y[0].tolist()), (5006, "lone", 2, [1.0, 0.0]), (5007, "b", None, y[0].tolist())]
    df = spark.createDataFrame(rows + bad + rows[:50], "chunk_id long, model string, dim int, vector array<float>").withColumns({"part": F.lit("p"), "id": F.lit("q"), "g": F.lit(1)})
    p = knn.Params(tile_rows=150, per_part=50, query_rows=110, rerank=20, sample=600)
    got = knn.nearest(df, params=p)
    by = {}
    for r in got.collect():
        by.setdefault((r["model"], r["chunk_id"]), []).append((r["rank"], r["neighbour"], r["cosine"]))
    assert {m for m, _ in by} == {"a", "b"} and len(by) == 1200
    hit = total = 0
    for m, v in (("a", x), ("b", y)):
        for i, want in nearest_by_force(np.arange(len(v)), v, 10).items():
            mine = sorted(by[(m, i)])
            assert [r for r, _, _ in mine] == list(range(1, 11)) and i not in {n for _, n, _ in mine}
            cosines = dict(want)
            assert all(abs(c - cosines[n]) < 1e-5 for _, n, c in mine if n in cosines)
            hit += len({n for n, _ in want} & {n for _, n, _ in mine})
            total += 10
    assert hit / total >= 0.9


def recall(got, ids, x, k=10):
    mine = {}
    for r in got:
        mine.setdefault(r["chunk_id"], set()).add(r["neighbour"])
    want = nearest_by_force(ids, x, k)
    return sum(len({n for n, _ in w} & mine.get(i, set())) for i, w in want.items()) / (k * len(want))


def test_partitions_are_parted_again(spark):
    """A level's sample allows 20 partitions at most here, so larger ones are parted by a second level."""
    x = vectors(6, 4000, 12)
    df = spark.createDataFrame([(i, "a", 12, v.tolist()) for i, v in enumerate(x)], "chunk_id long, model string, dim int, vector array<float>")
    p = knn.Params(tile_rows=40, per_part=20, sample=400)
    routed, cells = knn._parted(knn.packed(df.select(F.lit(0).alias("g"), F.col("chunk_id").alias("id"), "vector")), {0: 4000}, {0: 12}, p)
    assert sum(r["n"] for r in cells.collect()) == 4000 and routed.select("part").distinct().count() > 60 and routed.select("id").distinct().count() == 4000
    got = knn.nearest(df, params=p).collect()
    assert len(got) == 40_000 and recall(got, np.arange(4000), x) >= 0.9


def test_recall_of_each_model(spark):
    """Against brute force over all vectors of the test data, with production parameters."""
    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test data here")
    df = spark.read.parquet(f"{sf}/chunk_vectors.parquet")
    got = knn.nearest(df).toPandas()
    rows = knn.usable(df, "chunk_id", "model", "dim", "vector").toPandas()
    for (model, dim), mine in rows.groupby(["model", "dim"]):
        if len(mine) > 100:
            found = got[(got["model"] == model) & (got["dim"] == dim)].to_dict("records")
            assert len(found) == 10 * len(mine)
            assert recall(found, mine["id"].to_numpy(), np.stack([np.frombuffer(v, "<f4") for v in mine["vector"]])) >= 0.95


def test_a_third_are_copies(spark):
    x = vectors(8, 400, 8)
    rows = [(i, "a", 8, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, "a", 8, x[3].tolist()) for i in range(200)] + [(2000 + i, "a", 8, x[i].tolist()) for i in range(40)]
    got = knn.nearest(spark.createDataFrame(rows, "chunk_id long, model string, dim int, vector array<float>"), params=knn.Params(tile_rows=100, per_part=30)).collect()
    by = {}
    for r in got:
        by.setdefault(r["chunk_id"], []).append((r["rank"], r["neighbour"], r["cosine"]))
    ids = np.array([r[0] for r in rows])
    want = nearest_by_force(ids, np.array([r[3] for r in rows], np.float32), 10)
    assert by.keys() == set(ids.tolist()) and all(len(v) == 10 for v in by.values())
    assert [n for _, n, _ in sorted(by[1150])] == [3, *range(1000, 1009)] and [n for _, n, _ in sorted(by[3])] == list(range(1000, 1010))
    assert all(sorted(by[2000 + i])[0][1] == i for i in range(40) if i != 3)
    close = sum(abs(sorted(v)[-1][2] - want[i][-1][1]) < 1e-9 for i, v in by.items())
    assert close / len(by) >= 0.9


def test_copies_of_one_vector(spark):
    rows = [(i, "a", 4, [1.0, 2.0, 3.0, 4.0]) for i in range(300)] + [(300, "a", 4, [4.0, 3.0, 2.0, 1.0])]
    got = knn.nearest(spark.createDataFrame(rows, "chunk_id long, model string, dim int, vector array<float>"), params=knn.Params(tile_rows=50, per_part=20))
    assert got.where("chunk_id < 300 and cosine < 0.999999").count() == 0 and got.count() == 3010
    assert knn.nearest(spark.createDataFrame([], "chunk_id long, model string, dim int, vector array<float>")).count() == 0


def test_score_aware_codes_keep_the_direction():
    x = vectors(3, 800, 16)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float64)
    ix = knn.fit(x, len(x), knn.Params(per_part=200, threshold=0.6))
    part = np.argmax(x @ ix.parts.T, axis=1)

    def parallel(codes):
        shown = ix.parts[part] + ix.books[np.arange(codes.shape[1]), codes].reshape(len(x), -1)[:, :16]
        return (((x - shown) * x).sum(1) ** 2).mean()

    assert parallel(knn.encode(x, ix, part)) < parallel(knn.encode(x, ix._replace(eta=1.0), part))


def test_scan_is_the_sum_of_table_entries():
    rng = np.random.default_rng(5)
    books, codes, q = rng.normal(size=(5, 16, 2)), rng.integers(0, 16, (40, 5)).astype(np.uint8), rng.normal(size=(7, 10))
    true = np.stack([sum(q[:, 2 * m : 2 * m + 2] @ books[m].T[:, codes[:, m]] for m in range(5))])[0]
    got = knn.scan(q, knn.pack(codes), books, 2).astype(float)
    assert all(np.corrcoef(a, b)[0, 1] > 0.999 for a, b in zip(true, got))


def test_scan_of_many_dimensions_does_not_wrap():
    """1,536 dimensions of equal weight: the best row's sum is beyond two bytes."""
    blocks = 768
    books = np.repeat(np.linspace(-1, 1, 16)[None, :, None], blocks, 0) * np.ones(2)
    codes = np.array([[15] * blocks, [8] * blocks, [0] * blocks], np.uint8)
    got = knn.scan(np.ones((1, 2 * blocks)), knn.pack(codes), books, 2)[0]
    assert got[0] > got[1] > got[2] and got[0] == 127 * blocks
