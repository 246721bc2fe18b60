"""Items that appear together: counts of pairs by stripes, and how far they lie above chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import normal_paths
from ..runtime import materialise, spread

#: Bytes of keys and ids up to which the items' table is broadcast.
BROADCAST_BYTES = 32_000_000
#: An item beyond this share of the rows is looked up by broadcast; there are at most as many as its inverse.
HOT_SHARE = 1 / 1000
#: How often an item's baskets may double beyond `hot_rows` for its stripes still to be cut further.
DOUBLINGS = 24
#: Fixed value: the log-likelihood ratio that chance alone exceeds once in a thousand (chi-square, one degree of freedom).
SIGNIFICANT = 10.828


def _stripes(hot: np.ndarray, flush: int):
    """Arrays of items by basket to stripes: item, part, its neighbours and their counts, combined within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[np.ndarray] = []
        right: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if left:
                yield from as_stripes(*add_up(np.concatenate(left), np.concatenate(right), None), hot)
            left.clear()
            right.clear()
            size = 0

        def take(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal size
            left.append(x)
            right.append(y)
            size += len(x)
            if size >= flush:
                yield from out()

        for b in batches:
            mine, other = b.column(0), b.column(1)
            crossed = other.is_valid().to_numpy(zero_copy_only=False)
            flat, start = mine.values.to_numpy(), mine.offsets.to_numpy()
            length = np.diff(start)
            for n in np.unique(length[~crossed]):
                if n < 2:
                    continue
                at = start[:-1][~crossed & (length == n)]
                i, j = np.triu_indices(n, 1)
                rows = max(1, flush // len(i))
                for k in range(0, len(at), rows):  # baskets of one size at a time
                    items = np.sort(flat[at[k : k + rows, None] + np.arange(n)], axis=1)
                    yield from take(items[:, i].ravel(), items[:, j].ravel())
            for k in np.flatnonzero(crossed):  # two blocks of one large basket
                x, y = flat[start[k] : start[k + 1]], other[int(k)].values.to_numpy()
                rows = max(1, flush // len(y))
                for i in range(0, len(x), rows):
                    p, q = np.repeat(x[i : i + rows], len(y)), np.tile(y, len(x[i : i + rows]))
                    yield from take(np.minimum(p, q), np.maximum(p, q))
        yield from out()

    return run


def add_up(x: np.ndarray, y: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (x, y), sorted, and the sums of their counts (1 each if None)."""
    order = np.lexsort((y, x))
    x, y = x[order], y[order]
    start = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, int)
    n = np.diff(np.append(start, len(x))) if counts is None else np.add.reduceat(counts[order], start) if len(x) else np.zeros(0, int)
    return x[start], y[start], n


def parts_of(x: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Into how many parts the stripes of the items `x` are cut: two for items up to id `hot[0]`, twice as many up to `hot[1]`, and so on.

    Ids rise as support falls, and the bounds of `hot` fall.
    """
    return 1 << (len(hot) - np.searchsorted(hot[::-1], x, "left"))


def as_stripes(x: np.ndarray, y: np.ndarray, n: np.ndarray, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    part = (y * 0x9E3779B1 >> 7) % parts_of(x, hot)
    order = np.lexsort((y, part, x))
    x, y, n, part = x[order], y[order], n[order], part[order]
    start = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (part[1:] != part[:-1]))))
    cut = pa.array(np.append(start, len(x)).astype(np.int32))
    whole = pa.RecordBatch.from_arrays(
        [pa.array(x[start]), pa.array(part[start].astype(np.int32)), pa.ListArray.from_arrays(cut, pa.array(y)), pa.ListArray.from_arrays(cut, pa.array(n.astype(np.int64)))],
        names=["item", "part", "others", "counts"],
    )
    for i in range(0, whole.num_rows, 20_000):
        yield whole.slice(i, 20_000)


def _merge(least: int):
    """Stripes sorted by item and part to pairs; a stripe's counts are added up before the next begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple | None = None
        for b in batches:
            others, counts = b.column("others"), b.column("counts")
            lengths = others.value_lengths().to_numpy()
            x, part = (np.repeat(b.column(c).to_numpy(), lengths) for c in ("item", "part"))
            y, n = others.flatten().to_numpy(), counts.flatten().to_numpy()
            if kept is not None:
                x, part, y, n = (np.concatenate(p) for p in zip(kept, (x, part, y, n)))
            if not len(x):
                continue
            last = (x == x[-1]) & (part == part[-1])
            if (~last).any():
                yield from pairs(x[~last], y[~last], n[~last], least)
            kx, ky, kn = add_up(x[last], y[last], n[last])
            kept = kx, np.full(len(kx), part[-1]), ky, kn
        if kept is not None:
            yield from pairs(kept[0], kept[2], kept[3], least)

    return run


def pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray, least: int) -> Iterator[pa.RecordBatch]:
    x, y, n = add_up(x, y, n)
    ok = n >= least
    whole = pa.RecordBatch.from_arrays([pa.array(x[ok]), pa.array(y[ok]), pa.array(n[ok].astype(np.int64))], names=["id_1", "id_2", "together"])
    for i in range(0, whole.num_rows, 50_000):
        yield whole.slice(i, 50_000)


def log_likelihood_ratio(c: Column, a: Column, b: Column, n: Column) -> Column:
    """Of the 2 x 2 table of records that hold both, one and none of two items."""

    def part(k: Column, row: Column, column: Column) -> Column:
        return F.when(k > 0, k * F.log(k * n / (row * column))).otherwise(0.0)

    c, a, b, n = (x.cast("double") for x in (c, a, b, n))
    return 2 * (part(c, a, b) + part(a - c, a, n - b) + part(b - c, n - a, b) + part(n - a - b + c, n - a, n - b))


def item_pairs(
    rows: DataFrame, basket: str, item: str, *, names: DataFrame | None = None, min_together: int = 8, min_lift: float = 0.0, min_llr: float = 0.0, block: int = 2048, hot_rows: int = 10_000, flush: int = 1_000_000
) -> DataFrame:
    """Pairs of items that at least `min_together` baskets hold: ``item_1, item_2, together, records_1, records_2, records, lift, llr, significant``.

    `records_1`, `records_2` are the baskets that hold each item, `records`
    all distinct baskets, `lift` how many times more often the pair occurs
    than by chance (at least `min_lift`), `llr` the log-likelihood ratio (at least `min_llr`).
    `significant` are pairs above chance (lift over 1) whose ratio is SIGNIFICANT
    or more; the others come out too.
    Items are compared by value, ``item_1 < item_2``. `names` (columns ``key,
    name``, keys unique) restricts the items to its keys and gives the names that come out.

    Stripes: every task turns its baskets into rows (item, neighbours,
    counts), one per item, adding up equal ones before they are shuffled;
    stripes of an item meet in one task, which adds the arrays up. The stripes
    of an item in more than `hot_rows` baskets are cut by neighbour into twice as
    many parts for every doubling of its baskets, so none grows with the data. Items below `min_together`, or so frequent that no pair of
    theirs can reach `min_lift` (c <= min(a, b) gives c N / (a b) <= N / max(a, b)),
    are left out beforehand: no pair is lost.

    Baskets above `block` items are cut into blocks, which meet two by two.
    Of these, the up to `min_together` - 1 largest are not expanded at all:
    a pair in enough baskets is also in some other, so they are only
    looked up for pairs found elsewhere, as bits of each item. With
    `min_together` 1 there is no such basket: all are expanded, and every pair
    that occurs comes out.

    Null baskets are no baskets; a null item counts for no item but its basket
    counts in `records`. Repeated rows count once. An empty table gives no
    rows. Other columns are not read.
    """
    spark = rows.sparkSession
    held = rows.select(F.col(basket).alias("basket"), F.col(item).alias("key")).where("basket is not null").distinct()
    held = materialise(held, "baskets")
    total, size = held.agg(F.countDistinct("basket"), F.count("key")).first()
    most = total / min_lift if min_lift > 0 else total
    support = held.where("key is not null").groupBy("key").agg(F.count("*").alias("records")).where((F.col("records") >= min_together) & (F.col("records") <= most))
    if names is not None:
        support = support.join(names.select("key", "name"), "key")
    else:
        support = support.withColumn("name", F.col("key"))
    # ids by falling support, fixed by being written; at the front the hot items
    support = support.repartitionByRange(F.col("records").desc(), F.col("key")).sortWithinPartitions(F.col("records").desc(), F.col("key"))
    support = materialise(support.withColumn("id", F.monotonically_increasing_id()), "items")
    hot_from = max(size * HOT_SHARE, hot_rows)
    up_to = lambda bound: F.coalesce(F.max(F.when(F.col("records") > F.lit(bound), F.col("id"))), F.lit(-1))
    known, hot_below, *hot = support.agg(F.coalesce(F.sum(F.octet_length("key") + 16), F.lit(0)), up_to(float(hot_from)), *(up_to(float(hot_rows << j)) for j in range(DOUBLINGS))).first()
    hot = np.array([h for h in hot if h >= 0], np.int64)

    ids = support.select("key", "id")
    full = held.where("key is not null")
    if known <= BROADCAST_BYTES:
        coded = full.join(F.broadcast(ids), "key").select("basket", "id")
    else:
        # few hot keys by broadcast, the rest by a shuffle that none of them can skew
        often = ids.where(F.col("id") <= hot_below).withColumnRenamed("id", "hot")
        marked = full.join(F.broadcast(often), "key", "left")
        cold = marked.where("hot is null").select("basket", "key").join(ids.where(F.col("id") > hot_below), "key").select("basket", "id")
        coded = marked.where("hot is not null").select("basket", F.col("hot").alias("id")).unionAll(cold)
    coded = materialise(coded, "coded")
    sizes = coded.groupBy("basket").count().where(F.col("count") > block)
    largest = sizes.orderBy(F.col("count").desc(), "basket").limit(max(1, min_together - 1)).collect()  # few rows; one at least tells if there are any
    aside = [r["basket"] for r in largest[: max(0, min_together - 1)]]

    flat = coded.where(~F.col("basket").isin(aside)) if aside else coded
    if largest:
        large = materialise(sizes.where(~F.col("basket").isin(aside)) if aside else sizes, "large")
        small = flat.join(large, "basket", "left_anti")
        blocks = flat.join(large, "basket").withColumn("blocks", F.ceil(F.col("count") / block).cast("int"))
        blocks = blocks.groupBy("basket", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("at")).agg(F.collect_list("id").alias("mine"))
        blocks = materialise(blocks, "blocks")
        own = blocks.select("mine", F.lit(None).cast("array<long>").alias("other"))
        a, b = blocks.alias("a"), blocks.alias("b")
        crossed = a.join(b, (F.col("a.basket") == F.col("b.basket")) & (F.col("a.at") < F.col("b.at"))).select(F.col("a.mine").alias("mine"), F.col("b.mine").alias("other"))
        # the blocks of one basket go to different tasks
        extra = own.unionAll(crossed).repartition(F.xxhash64("mine"), F.xxhash64("other"))
    else:
        small, extra = flat, None
    baskets = small.groupBy("basket").agg(F.collect_list("id").alias("mine")).where("size(mine) > 1").select("mine", F.lit(None).cast("array<long>").alias("other"))
    if extra is not None:
        baskets = baskets.unionAll(extra)
    stripes = baskets.mapInArrow(_stripes(hot, flush), "item long, part int, others array<long>, counts array<long>")
    least = max(1, min_together - len(aside))
    # every row has one item and part; the number of partitions is the session's
    merged = stripes.repartition("item", "part").sortWithinPartitions("item", "part").mapInArrow(_merge(least), "id_1 long, id_2 long, together long")

    facts = support.select("id", "name", "records")
    if aside:
        bit = {b: i for i, b in enumerate(aside)}
        numbers = F.create_map(*[F.lit(x) for kv in bit.items() for x in kv])
        bits = coded.where(F.col("basket").isin(aside)).groupBy("id").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), numbers[F.col("basket")])).alias("bits"))
        facts = facts.join(bits, "id", "left")
    else:
        facts = facts.withColumn("bits", F.lit(0))
    facts = facts.withColumn("bits", F.coalesce("bits", F.lit(0)))
    for k in "12":
        merged = merged.join(facts.select(*(F.col(c).alias(f"{c}_{k}") for c in ("id", "name", "records", "bits"))), f"id_{k}")
    together = F.col("together") + F.bit_count(F.col("bits_1").bitwiseAND(F.col("bits_2")))
    out = merged.withColumn("together", together.cast("long")).where(F.col("together") >= min_together)
    c, a, b, n = F.col("together"), F.col("records_1"), F.col("records_2"), F.lit(total).cast("long")
    swap = F.col("name_1") > F.col("name_2")
    lift = c.cast("double") * n / (a.cast("double") * b)
    out = out.where(c.cast("double") * n >= F.lit(float(min_lift)) * a * b)
    if min_llr > 0:
        out = out.where(log_likelihood_ratio(c, a, b, n) >= min_llr)
    return out.select(
        F.least("name_1", "name_2").alias("item_1"),
        F.greatest("name_1", "name_2").alias("item_2"),
        "together",
        F.when(swap, b).otherwise(a).alias("records_1"),
        F.when(swap, a).otherwise(b).alias("records_2"),
        n.alias("records"),
        lift.alias("lift"),
        log_likelihood_ratio(c, a, b, n).alias("llr"),
    ).withColumn("significant", (F.col("llr") >= SIGNIFICANT) & (F.col("lift") > 1))


def path_pairs(hits: DataFrame, notes: DataFrame, **how) -> DataFrame:
    """`item_pairs` of the notes that one query recalls together, spelled as in `notes.path`.

    Spellings that lead to one file are one note. A path that no note has
    counts for no item; its query still counts. Null paths likewise.
    """
    keys = normal_paths(notes.select(F.col("path").alias("name"), F.col("path").alias("key")).where("name is not null").distinct(), "key")
    names = keys.groupBy("key").agg(F.min("name").alias("name"))
    rows = normal_paths(spread(hits.select("query_id", F.col("note_path").alias("key"))), "key")
    return item_pairs(rows, "query_id", "key", names=names, **how)
