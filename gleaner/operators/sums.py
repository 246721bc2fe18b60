"""Sums of weights over the keys that queries and documents share: the best documents of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that one step holds, about.
DOCS_AT_ONCE = 30_000
#: Bytes of keys of queries up to which all of them go to every task; beyond, blocks of both sides meet.
ASKED_BYTES = 64_000_000
#: Blocks of documents that one task takes, at most; it keeps the best of all of them up to so many rows, else of each.
BLOCKS, HELD_ROWS = 1, 2_000_000
#: Rows of a batch that leaves a task.
ROWS_AT_ONCE = 100_000
#: A key that more than one of so many documents has is kept as a full row of values.
DENSE = 5

_SCHEMA = pa.schema([("query_id", pa.int64()), ("doc", pa.int64()), ("total", pa.float64())])
_OUT = "query_id long, doc long, total double"
#: What the value of a key counts in a document, by value and the document's size.
Weigh = Callable[[np.ndarray, np.ndarray], np.ndarray]


class _Asked:
    """The keys of queries, one list after the other."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.ids = table.column("query_id").to_numpy()
        wants = table.column("wants").combine_chunks() if table.num_rows else pa.array([], table.schema.field("wants").type)
        n, flat = wants.value_lengths().to_numpy(), wants.flatten()
        self.keys, self.weights = flat.field("key").to_numpy(), flat.field("weight").to_numpy()
        self.owner = np.repeat(np.arange(len(n)), n)
        self.known, first, which = np.unique(self.keys, return_index=True, return_inverse=True)
        #: The weight of each of `known`, where it is the same for all queries.
        self.one = self.weights[first] if (self.weights == self.weights[first][which]).all() else None


class _Found:
    """The best documents of each query so far, as `_best` gives them; `least` is what the rank of a further one must reach."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.held = k, np.full(queries, -np.inf), None

    def add(self, *rows: np.ndarray) -> None:
        if self.held is not None:
            most = max(len(rows), len(self.held))  # where only one of both has ranks, the other's are its sums
            rows = tuple(map(np.concatenate, zip(*((*x, x[-1])[:most] for x in (self.held, rows)))))
        q, doc, rank = *rows[:2], rows[-1]
        order = np.lexsort((doc, -np.round(rank, 9), q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = order[place == self.k - 1]
        self.least[rows[0][last]] = rank[last]
        order = order[place < self.k]
        self.held = tuple(x[order] for x in rows)


def _best(asked: _Asked, docs: pa.Table, k: int, weigh: Weigh | None, least: np.ndarray | None = None) -> tuple[np.ndarray, ...] | None:
    """Of each query the k best of `docs` that share a key with it: by sum times factor, to nine digits, then by number; those that reach `least`.

    Places of queries, documents and their sums, query by query; then what they rank by, if by something else.
    """
    doc, factor = docs.column("doc").to_numpy(), docs.column("factor").to_numpy(zero_copy_only=False).astype(np.float64)
    keys, values = docs.column("keys").combine_chunks(), docs.column("values").combine_chunks()
    n, key, value = keys.value_lengths().to_numpy(), keys.flatten().to_numpy(), values.flatten().to_numpy().astype(np.float64)
    if weigh:
        value = weigh(value, np.repeat(docs.column("size").to_numpy(), n))
    order = np.argsort(doc, kind="stable")
    place = np.empty(len(doc), np.int64)
    place[order] = np.arange(len(doc))
    doc, factor = doc[order], factor[order]
    at = np.repeat(place, n)
    del docs, place, keys, values
    order = np.lexsort((at, key))
    key, at, value = key[order], at[order], value[order]
    del order
    known, first = np.unique(key, return_index=True)
    if not len(known) or not len(asked.known):
        return None
    one = asked.one is not None
    if one:  # weights that no query differs in are multiplied once
        own = np.minimum(np.searchsorted(asked.known, known), len(asked.known) - 1)
        value *= np.repeat(np.where(asked.known[own] == known, asked.one[own], 0.0), np.diff(np.append(first, len(key))))
    ends = np.append(first, len(key)).tolist()
    pos = np.minimum(np.searchsorted(known, asked.keys), len(known) - 1)
    met = known[pos] == asked.keys
    pos, weights = pos[met].tolist(), asked.weights[met].tolist()
    starts = np.searchsorted(asked.owner[met], np.arange(len(asked.ids) + 1)).tolist()

    columns = max(256, 4 * k)
    size = -(-len(doc) // columns) * columns
    total, part = np.zeros(size), np.zeros(size)
    plain = bool((factor == 1).all())
    factor = np.append(factor, np.zeros(size - len(doc)))
    unknown = np.isnan(factor)
    full = {}
    for p in np.flatnonzero(np.diff(ends) * DENSE > len(doc)).tolist():
        full[p] = np.zeros(size)
        full[p][at[ends[p] : ends[p + 1]]] = value[ends[p] : ends[p + 1]]
    least = [-np.inf] * len(asked.ids) if least is None else least.tolist()

    found: list[tuple[np.ndarray, ...]] = []
    done: list[tuple[np.ndarray, ...]] = []

    def gather() -> None:
        if found:
            each, best, *sums = zip(*found)
            done.append((np.repeat(each, list(map(len, best))), doc[np.concatenate(best)], *map(np.concatenate, sums)))
            found.clear()

    for q in range(len(asked.ids)):
        if starts[q] == starts[q + 1]:
            continue
        total.fill(0)
        for i in range(starts[q], starts[q + 1]):
            p, w = pos[i], weights[i]
            if p in full:
                np.add(total, full[p] if one else np.multiply(full[p], w, out=part), out=total)
            else:
                a, b = ends[p], ends[p + 1]
                v = value[a:b] if one else value[a:b] * w
                if b - a < 256:  # below, a sum of rows taken out is faster
                    total[at[a:b]] += v
                else:
                    np.add.at(total, at[a:b], v)
        rank = total
        if not plain:
            rank = np.where(total > 0, total * factor, -np.inf)
            rank[unknown & (total > 0)] = -1e200
        bound = least[q]
        if bound == -np.inf:  # the k-th of the maxima of disjoint parts is no more than the k-th of all
            bound = np.partition(rank.reshape(-1, columns).max(axis=0), columns - k)[columns - k]
        best = np.flatnonzero(rank >= bound - 2e-9) if bound > (0 if plain else -np.inf) else np.flatnonzero(total > 0)
        best = best[total[best] > 0]
        if len(best) > k:
            best = best[np.argsort(-np.round(rank[best], 9), kind="stable")[:k]]
        if len(best):
            found.append((q, best, total[best]) if plain else (q, best, total[best], rank[best]))
        if len(found) == 4096:
            gather()
    gather()
    return tuple(map(np.concatenate, zip(*done))) if done else None


def _batches(asked: _Asked, rows: tuple[np.ndarray, ...] | None) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows[0]) if rows else 0, ROWS_AT_ONCE):
        q, doc, total = (x[i : i + ROWS_AT_ONCE] for x in rows[:3])
        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[q]), pa.array(doc), pa.array(total)], schema=_SCHEMA)


def _scan(asked: _Asked, k: int, weigh: Weigh | None, least: int | None = None):
    """Documents, in blocks of `least` or more, against all queries; the best of all blocks, where these are few enough to be held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Found(len(asked.ids), k) if len(asked.ids) * k <= HELD_ROWS else None

        def block(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = _best(asked, pa.Table.from_batches(held), k, weigh, best and best.least)
            if best is None:
                yield from _batches(asked, rows)
            elif rows:
                best.add(*rows)

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= (least or 2 * DOCS_AT_ONCE):
                yield from block(held)
                held, n = [], 0
        if n and best and best.held is None:  # the only block
            yield from _batches(asked, _best(asked, pa.Table.from_batches(held), k, weigh))
        elif n:
            yield from block(held)
        yield from _batches(asked, best and best.held)

    return run


def _meet(k: int, weigh: Weigh | None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _SCHEMA.empty_table()
        asked = _Asked(right)
        return pa.Table.from_batches(_batches(asked, _best(asked, left, k, weigh)), _SCHEMA)

    return run


def best_sums(docs: DataFrame, asked: DataFrame, k: int, n: int, weigh: Weigh | None = None, blocks: int | None = None) -> DataFrame:
    """``query_id, doc, total``: the k documents or more whose keys fit each query best; the k best of all are among them.

    `docs` has ``doc, factor, held`` with `held` an array of (key, value), each key once, or ``keys, values`` as two arrays in its place;
    with `weigh` also ``size``, and values count as `weigh` makes of them and the size. `asked` has
    ``query_id, wants`` with `wants` an array of (key, weight). `total` sums weight times value, which are above 0, over shared
    keys. Documents rank by total times factor to nine digits, then by number; those of a null factor come last. A task adds up
    blocks of documents for all queries, each in one row of sums, and keeps each query's k best, so other pairs of queries
    and documents never leave it; what it has kept bounds what it looks at in its next blocks. `n`, about how many documents there are,
    decides on the number of tasks, which take up to `blocks` blocks (`BLOCKS`). Queries above `ASKED_BYTES` are cut into blocks, which meet blocks of documents.
    """
    spark = asked.sparkSession
    cores = spark.sparkContext.defaultParallelism
    lists = [F.col("held.key").alias("keys"), F.col("held.value").alias("values")] if "held" in docs.columns else ["keys", "values"]
    docs = docs.select(F.col("doc").cast("long"), F.col("factor").cast("double"), *lists, *["size"] * bool(weigh))
    asked = asked.select(F.col("query_id").cast("long"), "wants")
    size = 16 * (asked.agg(F.sum(F.size("wants"))).first()[0] or 0)
    parts = cores * max(1, -(-n // (cores * DOCS_AT_ONCE)))
    if size <= ASKED_BYTES:
        parts = cores * max(1, -(-n // (cores * DOCS_AT_ONCE * (blocks or BLOCKS))))
        least = DOCS_AT_ONCE if blocks else None  # where blocks are many, the last may be small
        return docs.repartition(parts, "doc").mapInArrow(_scan(_Asked(asked.toArrow()), k, weigh, least), _OUT)
    blocks = -(-size // ASKED_BYTES)
    left = docs.withColumn("v", F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = asked.withColumn("q", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return left.groupBy("v", "q").cogroup(right.groupBy("v", "q")).applyInArrow(_meet(k, weigh), _OUT)
