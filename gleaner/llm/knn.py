"""The most similar vectors of every vector: partitions, score-aware 4-bit codes, table scans, exact reranking."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import materialise, spread, tasks

#: Bytes of centers that are sent to the tasks at once, and bytes of one task's rows or queries.
MODEL_BYTES, TILE_BYTES = 64_000_000, 64_000_000
#: Bytes of the files of a table up to which it is broadcast.
BROADCAST_BYTES = 4_000_000
#: Levels of partitions; what is too large then is cut into blocks by hash.
LEVELS = 4
#: A partition's number is its tile's, shifted, and its place in the tile; the last place stands for all of a tile.
SHIFT = 20
ALL = (1 << SHIFT) - 1
#: Tasks of one scan at most; beyond, a task scans several tiles.
MOST_TASKS = 100_000
CENTERS = 16  # of each block of dimensions: a code has four bits


class Params(NamedTuple):
    """`sample`: rows at most, about, that the centers of one level are fitted on; `per_part` rows to a partition and
    `tile_rows` to the tile of neighbouring partitions that one task holds; `block_dims` dimensions to a code;
    `threshold` T of the score-aware loss; `rerank` rows a query compares exactly in each partition; `recall` that the
    number of partitions asked is chosen for; `query_rows` the most queries, about, that one task scans a tile for."""

    k: int = 10
    sample: int = 20_000
    tile_rows: int = 16_000
    per_part: int = 2_000
    block_dims: int = 2
    threshold: float = 0.2
    rerank: int = 40
    recall: float = 0.97
    query_rows: int = 24_000


class Index(NamedTuple):
    """What codes are made with: unit `parts`, `books` (blocks x 16 x block_dims), the weight of error along the vector."""

    parts: np.ndarray
    books: np.ndarray
    eta: float
    block_dims: int


class Level(NamedTuple):
    """The unit centers that part some rows, their numbers, and how many of them a query asks."""

    centers: np.ndarray
    numbers: np.ndarray
    ask: int


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sums(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the rows of each of k groups the sum."""
    out = np.zeros((k, *x.shape[1:]))
    if len(x):
        order = np.argsort(at, kind="stable")
        start = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order][start]] = np.add.reduceat(x[order], start, axis=0)
    return out


def _k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, unit: bool) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T - (0 if unit else (c * c).sum(1) / 2), axis=1)
        n = np.bincount(at, minlength=k)
        sums = _sums(x, at, k)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _blocks(x: np.ndarray, width: int) -> np.ndarray:
    """(rows, blocks, width), with zeros to fill the last block."""
    more = -x.shape[1] % width
    return np.pad(x, ((0, 0), (0, more))).reshape(len(x), -1, width)


def encode(x: np.ndarray, ix: Index, part: np.ndarray, sweeps: int = 2) -> np.ndarray:
    """Codes (rows, blocks) of unit vectors' residuals under the score-aware loss.

    Loss: squared error across x plus `eta` times the squared error along x.
    The error along x sums over all blocks, so blocks are set in turn, each
    given the others.
    """
    residual, direction = _blocks(x - ix.parts[part], ix.block_dims), _blocks(x, ix.block_dims)
    rows = np.arange(len(x))
    # of every block and center: squared error, error along x
    across = (residual**2).sum(2)[:, :, None] - 2 * np.einsum("nmw,mcw->mnc", residual, ix.books).transpose(1, 0, 2) + (ix.books**2).sum(2)[None]
    parallel = (residual * direction).sum(2)[:, :, None] - np.einsum("nmw,mcw->mnc", direction, ix.books).transpose(1, 0, 2)
    across, parallel = (np.ascontiguousarray(a.transpose(1, 0, 2)) for a in (across, parallel))
    codes = np.argmin(across, axis=2).astype(np.uint8)
    along = np.take_along_axis(parallel, codes[:, :, None], 2)[:, :, 0]
    whole = along.sum(0)
    for _ in range(sweeps):
        for m in range(len(codes)):
            rest = whole - along[m]
            codes[m] = np.argmin(across[m] + (ix.eta - 1) * (rest[:, None] + parallel[m]) ** 2, axis=1)
            along[m] = parallel[m, rows, codes[m]]
            whole = rest + along[m]
    return codes.T


def _refit(x: np.ndarray, ix: Index, part: np.ndarray, codes: np.ndarray) -> None:
    """Each center to the least loss for the rows it codes, given the other blocks: small linear systems."""
    residual, direction = _blocks(x - ix.parts[part], ix.block_dims), _blocks(x, ix.block_dims)
    rows = np.arange(len(x))
    along = np.stack([((residual[:, m] - ix.books[m][codes[:, m]]) * direction[:, m]).sum(1) for m in range(residual.shape[1])], axis=1)
    whole = along.sum(1)
    w, eye = ix.block_dims, np.eye(ix.block_dims)
    for m in range(residual.shape[1]):
        d, r = direction[:, m], residual[:, m]
        rest = whole - along[:, m] + (r * d).sum(1)
        left = _sums(eye + (ix.eta - 1) * d[:, :, None] * d[:, None, :], codes[:, m], CENTERS)
        right = _sums(r + (ix.eta - 1) * rest[:, None] * d, codes[:, m], CENTERS)
        n = np.bincount(codes[:, m], minlength=CENTERS)
        solved = np.linalg.solve(left + 1e-9 * eye, right[:, :, None])[:, :, 0]
        ix.books[m] = np.where(n[:, None] > 0, solved, ix.books[m])
        now = ((r - ix.books[m][codes[rows, m]]) * d).sum(1)
        whole += now - along[:, m]
        along[:, m] = now


def fit(x: np.ndarray, rows: int, p: Params) -> Index:
    """Partitions and block centers for about `rows` unit vectors like the sample `x`."""
    rng = np.random.default_rng(7)
    dim = x.shape[1]
    k = int(min(max(1, round(rows / p.per_part)), max(1, len(x) // 20)))
    parts = _k_means(x, k, 10, rng, True)
    eta = max(1.0, (dim - 1) * p.threshold**2 / (1 - p.threshold**2))
    at = np.argmax(x @ parts.T, axis=1)
    residual = _blocks(x - parts[at], p.block_dims)
    books = np.stack([_k_means(residual[:, m], CENTERS, 8, rng, False) for m in range(residual.shape[1])])
    ix = Index(parts, books, eta, p.block_dims)
    for _ in range(2):
        _refit(x, ix, at, np.concatenate([encode(x[i : i + 2000], ix, at[i : i + 2000], 1) for i in range(0, len(x), 2000)]))
    return ix


def fit_level(x: np.ndarray, rows: int, p: Params) -> Level:
    """Partitions for about `rows` rows like the sample `x` (at most a twentieth of it), in tiles of neighbouring ones.

    A query asks so many that sample queries find the wanted share of their `k` best rows of the sample.
    """
    rng = np.random.default_rng(11)
    n = int(min(max(1, round(rows / p.per_part)), max(1, len(x) // 20), ALL))
    centers = _k_means(x, n, 10, rng, True)
    at = np.argmax(x @ centers.T, axis=1)
    tiles = int(min(n, max(1, round(rows / p.tile_rows))))
    tile = np.argmax(centers @ _k_means(centers, tiles, 10, rng, True).T, axis=1) if tiles > 1 else np.zeros(n, np.int64)
    ask = n
    if n > 1:
        q = x[rng.choice(len(x), min(500, len(x)), replace=False)]
        near = np.argsort(-(q @ x.T), axis=1)[:, 1 : p.k + 1]
        place = np.argsort(np.argsort(-(q @ centers.T), axis=1), axis=1)
        ask = int(min(n, np.quantile(np.take_along_axis(place, at[near], axis=1), p.recall) + 1))
    return Level(centers.astype(np.float32), (tile << SHIFT) + np.arange(n), ask)


def scan(queries: np.ndarray, codes: np.ndarray, books: np.ndarray, width: int) -> np.ndarray:
    """Scores (queries, rows): sums of entries of each query's tables of 16, in whole numbers.

    `codes` has two codes to a byte. A byte's entry of the two tables is added up for all queries
    at once: the tables lie side by side, so what is read for a row is one run of memory.
    """
    tables = np.einsum("qmw,mcw->qmc", _blocks(queries, width), books)
    tables -= tables.min(axis=2, keepdims=True)
    if tables.shape[1] % 2:
        tables = np.pad(tables, ((0, 0), (0, 1), (0, 0)))
    # a query's largest entry becomes 127; a byte of codes adds 254 at most, and beyond 258 of them two bytes would wrap
    kind = np.uint16 if 127 * tables.shape[1] <= 65_535 else np.uint32
    whole = np.rint(tables * (127 / np.maximum(tables.max(axis=(1, 2), keepdims=True), 1e-12))).astype(kind)
    whole = np.ascontiguousarray(whole.transpose(1, 2, 0))
    scores, read = np.zeros((len(codes), len(queries)), kind), np.empty((len(codes), len(queries)), kind)
    for m in range(codes.shape[1]):
        both = (whole[2 * m + 1][:, None, :] + whole[2 * m][None, :, :]).reshape(256, -1)
        np.take(both, codes[:, m].astype(np.intp), axis=0, out=read, mode="clip")
        scores += read
    return scores.T


def pack(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, 0::2] | codes[:, 1::2] << 4


def _picked(scores: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the `most` best rows of every query and of all that tie with the last."""
    scores = np.ascontiguousarray(scores)
    bound = np.partition(scores, scores.shape[1] - most, axis=1)[:, scores.shape[1] - most]
    return np.nonzero(scores >= bound[:, None])


def best(queries: np.ndarray, q_ids: np.ndarray, asked: tuple[np.ndarray, np.ndarray], x: np.ndarray, ids: np.ndarray, part: np.ndarray, ix: Index, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Ids and cosines (queries, k) of each query's best other rows of a tile, all unit vectors; -inf where there are fewer.

    `asked` has (query, partition), `part` each row's partition. A partition
    is scanned by its codes for those who ask it, the `rerank` best are
    compared exactly, and a query keeps its `k` best so far.
    """
    order = np.argsort(part, kind="stable")
    x, ids = x[order], ids[order]
    parts, at = np.unique(part[order], return_inverse=True)
    ix = ix._replace(parts=_unit(_sums(x, at, len(parts)) + 1e-12))
    codes = pack(np.concatenate([encode(x[i : i + 2000], ix, at[i : i + 2000]) for i in range(0, len(x), 2000)]))
    edge = np.searchsorted(at, np.arange(len(parts) + 1))
    who, what = asked
    whole = (what & ALL) == ALL
    everything = np.unique(who[whole])

    top_id, top = np.full((len(queries), p.k), -1), np.full((len(queries), p.k), -np.inf)
    for j, number in enumerate(parts):
        mine, own = x[edge[j] : edge[j + 1]], ids[edge[j] : edge[j + 1]]
        asking = np.concatenate([who[what == number], everything]) if len(everything) else who[what == number]
        step = int(min(512, max(16, 4_000_000 // len(mine))))
        for i in range(0, len(asking), step):
            at_q = asking[i : i + step]
            q = queries[at_q]
            row, col = _picked(scan(q, codes[edge[j] : edge[j + 1]], ix.books, p.block_dims), min(len(mine), p.rerank + 1))
            cosine = np.einsum("ij,ij->i", q[row], mine[col])
            cosine[own[col] == q_ids[at_q][row]] = -np.inf
            place = np.arange(len(row)) - np.searchsorted(row, row)
            wide = np.full((len(q), p.k + int(place.max()) + 1), -np.inf)
            wide_id = np.full(wide.shape, -1)
            wide[:, : p.k], wide_id[:, : p.k] = top[at_q], top_id[at_q]
            wide[row, p.k + place], wide_id[row, p.k + place] = cosine, own[col]
            first = np.lexsort((wide_id, -wide), axis=1)[:, : p.k]
            top[at_q], top_id[at_q] = np.take_along_axis(wide, first, 1), np.take_along_axis(wide_id, first, 1)
    return top_id, top


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of packed vectors of one length as unit rows in double precision."""
    return _unit(np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(len(column), -1).astype(np.float64))


def packed(rows: DataFrame) -> DataFrame:
    """`rows` with ``vector`` as bytes, which tables and tasks read far faster than lists; those with an element that is no finite number or all zero are dropped."""
    schema = T.StructType([T.StructField(f.name, T.BinaryType()) if f.name == "vector" else f for f in rows.schema])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vector")
            data = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            cut = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).astype(int)
            sums = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[cut])
            kept = np.flatnonzero((sums(~np.isfinite(data)) == 0) & (sums(data != 0) > 0))
            data = data.tobytes()
            vector = pa.array([data[4 * cut[i] : 4 * cut[i + 1]] for i in kept], pa.binary())
            rest = b.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([vector if n == "vector" else rest.column(n) for n in arrow.names], schema=arrow)

    return rows.mapInArrow(run, schema)


def _fit_groups(p: Params, rows: dict[int, int]):
    def run(t: pa.Table) -> pa.Table:
        g = t.column("g")[0].as_py()
        return pa.table({"g": pa.array([g], pa.int32()), "model": pa.array([pickle.dumps(fit(_vectors(t.column("vector")), rows[g], p))], pa.binary())})

    return run


def _fit_levels(p: Params, schema: pa.Schema):
    def run(t: pa.Table) -> pa.Table:
        g, part, n = (t.column(c)[0].as_py() for c in ("g", "part", "n"))
        return pa.table([[g], [part], [pickle.dumps(fit_level(_vectors(t.column("vector")), n, p))]], schema=schema)

    return run


def _route(levels: dict[tuple[int, int], Level], schema: pa.Schema):
    """Rows of partitions that are parted again to their children; who asks such a partition asks the nearest of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, part = b.column("g").to_numpy(), b.column("part").to_numpy().copy()
            asked = b.column("asked")
            who = np.repeat(np.arange(b.num_rows), asked.value_lengths().to_numpy())
            what = asked.flatten().to_numpy()
            kept, more = np.ones(len(what), bool), []
            for group, number in set(zip(g[who].tolist(), what.tolist())) & levels.keys():
                level = levels[group, number]
                at = np.flatnonzero((what == number) & (g[who] == group))
                near = _vectors(b.column("vector").take(pa.array(who[at]))) @ level.centers.T
                nearest = level.numbers[np.argsort(-near, axis=1, kind="stable")[:, : level.ask]]
                kept[at] = False
                more.append((np.repeat(who[at], nearest.shape[1]), nearest.ravel()))
            for group, number in set(zip(g.tolist(), part.tolist())) & levels.keys():
                level = levels[group, number]
                at = np.flatnonzero((b.column("part").to_numpy() == number) & (g == group))
                part[at] = level.numbers[np.argmax(_vectors(b.column("vector").take(pa.array(at))) @ level.centers.T, axis=1)]
            who, what = np.concatenate([who[kept], *(w for w, _ in more)]), np.concatenate([what[kept], *(t for _, t in more)])
            order = np.argsort(who, kind="stable")
            cut = np.searchsorted(who[order], np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("g"), b.column("id"), b.column("vector"), pa.array(part), pa.ListArray.from_arrays(pa.array(cut), pa.array(what[order].astype(np.int64)))], schema=schema)

    return run


def _scan_tile(indexes: dict[int, Index], p: Params, schema: pa.Schema):
    def run(t: pa.Table) -> pa.Table:
        role, ids = t.column("role").to_numpy(), t.column("id").to_numpy()
        held, asks = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        if not len(held) or not len(asks):
            return schema.empty_table()
        g, x = t.column("g")[0].as_py(), _vectors(t.column("vector"))
        wants = t.column("wants").combine_chunks().take(pa.array(asks))
        asked = np.repeat(np.arange(len(asks)), wants.value_lengths().to_numpy()), wants.flatten().to_numpy()
        near, cosine = best(x[asks], ids[asks], asked, x[held], ids[held], t.column("part").to_numpy()[held], indexes[g], p)
        ok = np.isfinite(cosine)
        return pa.table([pa.array(np.full(ok.sum(), g, np.int32)), pa.array(np.repeat(ids[asks], ok.sum(1))), pa.array(near[ok]), pa.array(cosine[ok])], schema=schema)

    return run


def usable(df: DataFrame, id: str, model: str, dim: str, vector: str) -> DataFrame:
    """``id, model, dim, vector``, the vector as bytes: one row for every id, model and dim with a usable vector; of differing ones the smallest.

    Vectors are packed and written once. Only ids are shuffled to find those that come twice, and only the vectors of these.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(model).alias("model"), F.col(dim).cast("int").alias("dim"), F.col(vector).cast("array<float>").alias("vector"))
    rows = rows.where("id is not null and model is not null and vector is not null and size(vector) = dim and dim > 0")
    key = ["id", "model", "dim"]
    good = materialise(packed(rows), "packed")
    twice = _few(materialise(good.groupBy(*key).count().where("count > 1").select(*key), "twice"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    single = rows.join(twice, key, "left_semi").where(finite).groupBy(*key).agg(F.min("vector").alias("vector"))
    single = materialise(packed(single.select(*key, "vector")), "single")
    return good.join(twice, key, "left_anti").select(*key, "vector").unionAll(single)


def _few(df: DataFrame) -> DataFrame:
    """A table that follows from written ones, to be broadcast if their files are small."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= BROADCAST_BYTES else df


def nearest(df: DataFrame, id: str = "chunk_id", model: str = "model", dim: str = "dim", vector: str = "vector", params: Params = Params()) -> DataFrame:
    """``<id>, neighbour, model, dim, rank, cosine``: the `k` most similar vectors of other ids for every usable vector.

    Only vectors of one model and dim are compared. A vector is usable if it
    and its id and model are not null, it has `dim` elements, all of them
    finite numbers, and is not all zero; a row delivered twice counts once.

    Equal vectors are one class, searched once: its rows take each other, by
    falling cosine and rising id, and what the class found.

    Unit centers fitted on a bounded sample part the rows of a (model, dim)
    into partitions of about `per_part`; one far too large after that is parted
    again by a sample of its own rows, so partitions grow in number with the
    rows, not in size. Neighbouring ones form tiles of about `tile_rows`. Every
    row asks the partitions that samples say it needs and is sent once to each
    tile that has some of them. There the rows are coded by 16 centers per
    block of dimensions (found with the score-aware loss, which weighs error
    along the vector `eta` times as much as error across it), each partition is
    scanned by table sums for those who ask it, and the `rerank` best are
    compared in double precision on the stored vectors: that is the cosine that
    comes out. Tiles still too large after LEVELS levels are cut into blocks by
    hash, and so are the queries of a tile, so no task holds more than
    TILE_BYTES or so of either. Centers are fitted and sent MODEL_BYTES at a
    time. A row that met fewer rows than wanted asks all tiles.

    Equal cosines are ordered by id. Groups of one row give none. An empty
    table gives no rows; other columns are not read. `id` must be a whole
    number.
    """
    p, spark = params, df.sparkSession
    rows = usable(spread(df.select(id, model, dim, vector)), id, model, dim, vector)
    sizes = rows.groupBy("model", "dim").count().orderBy("model", "dim").collect()  # one row per model and dim
    out = None
    while sizes:  # groups together as long as their models fit
        bytes_, n = 0, 0
        while n < len(sizes) and (not n or bytes_ + _model_bytes(sizes[n], p) <= MODEL_BYTES):
            bytes_ += _model_bytes(sizes[n], p)
            n += 1
        found = _nearest_in(rows, sizes[:n], p).withColumnRenamed("id", id)
        out = found if out is None else out.unionAll(found)
        sizes = sizes[n:]
    return spark.createDataFrame([], f"`{id}` long, neighbour long, model string, dim int, rank int, cosine double") if out is None else out


def _model_bytes(size, p: Params) -> int:
    return 8 * size["dim"] * (2 * CENTERS + p.sample // 20)


ROUTED = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("vector", T.BinaryType()), T.StructField("part", T.LongType()), T.StructField("asked", T.ArrayType(T.LongType()))])
LEVEL = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("model", T.BinaryType())])
FOUND = T.StructType([T.StructField("g", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("neighbour", T.LongType()), T.StructField("cosine", T.DoubleType())])


def _tile(part: Column) -> Column:
    return F.shiftright(part, SHIFT)


def _of(values: dict[int, float]) -> Column:
    """What a group (column ``g``) has in a dictionary with one entry for each."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("g")]


def _draw(rows: DataFrame, share: Column, seed: int) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))


def _parted(rows: DataFrame, count: dict[int, int], dims: dict[int, int], p: Params) -> tuple[DataFrame, DataFrame]:
    """``g, id, vector`` with ``part`` and the partitions ``asked``, and the written table of ``g, tile, n, q``: rows in and asking each tile."""
    spark = rows.sparkSession
    zero = F.lit(0).cast("long")
    routed = rows.select("g", "id", "vector", zero.alias("part"), F.array(zero).alias("asked"))
    large = [(g, 0, n) for g, n in count.items()]
    tiles = 1
    for level in range(LEVELS):
        while large:  # as many as their centers fit
            size = [4 * dims[g] * min(n // p.per_part + 1, p.sample // 20) for g, _, n in large]
            now = max(1, int(np.searchsorted(np.cumsum(size), MODEL_BYTES, "right")))
            cells = F.broadcast(spark.createDataFrame(large[:now], "g int, part long, n long"))
            drawn = _draw(routed.join(cells, ["g", "part"]), F.least(F.lit(1.0), p.sample / F.col("n")), 17 + level)
            fitted = drawn.select("g", "part", "n", "vector").groupBy("g", "part").applyInArrow(_fit_levels(p, to_arrow_schema(LEVEL)), LEVEL).collect()
            levels = {}
            for r in sorted(fitted, key=lambda r: (r["g"], r["part"])):
                fit_ = pickle.loads(r["model"])
                levels[r["g"], r["part"]] = fit_._replace(numbers=fit_.numbers + (tiles << SHIFT))
                tiles += int(fit_.numbers.max() >> SHIFT) + 1
            routed = routed.mapInArrow(_route(levels, to_arrow_schema(ROUTED)), ROUTED)
            large = large[now:]
        if level:
            routed = materialise(routed, "routed")
        of = lambda at, asks: F.struct(at.alias("at"), F.lit(asks).alias("asks"))
        each = F.concat(F.array(of(F.col("part"), False)), F.transform(F.array_distinct(F.transform("asked", _tile)), lambda t: of(t, True)))
        counts = materialise(routed.select("g", F.explode(each).alias("c")).groupBy("g", "c.at", "c.asks").count(), "counts")
        large = [(r["g"], r["at"], r["count"]) for r in counts.where(~F.col("asks") & (F.col("count") > 2 * p.tile_rows)).collect()]
        if not large:
            break
    tile = F.when(F.col("asks"), F.col("at")).otherwise(_tile(F.col("at"))).alias("tile")
    cells = counts.groupBy("g", tile).agg(F.sum(F.when(F.col("asks"), 0).otherwise(F.col("count"))).alias("n"), F.sum(F.when(F.col("asks"), F.col("count")).otherwise(0)).alias("q"))
    return routed, materialise(cells, "cells")


def _scanned(routed: DataFrame, cells: DataFrame, indexes: dict[int, Index], dims: dict[int, int], p: Params) -> DataFrame:
    """``g, id, neighbour, cosine``: the `k` best rows of each asking row in the partitions it asks."""
    most_rows = {g: max(1, min(2 * p.tile_rows, TILE_BYTES // (4 * d))) for g, d in dims.items()}
    most_asks = {g: max(1, min(p.query_rows, TILE_BYTES // (4 * d))) for g, d in dims.items()}
    blocks = cells.where("n > 0 and q > 0").select("g", "tile", F.ceil(F.col("n") / _of(most_rows)).cast("int").alias("nb"), F.ceil(F.col("q") / _of(most_asks)).cast("int").alias("qb"))
    # four tasks to a block, as blocks fall into tasks by hash and two in one would take twice as long
    n_tasks = tasks(routed.sparkSession, min(4 * blocks.agg(F.coalesce(F.sum(F.col("nb") * F.col("qb")), F.lit(0))).first()[0], MOST_TASKS))

    home = _tile(F.col("part"))
    every = F.array_union(F.array(home), F.transform("asked", _tile))
    sent = routed.select("g", "id", "vector", "part", "asked", F.explode(every).alias("tile")).join(_few(blocks), ["g", "tile"])
    sent = sent.withColumn("wants", F.filter("asked", lambda a: _tile(a) == F.col("tile")))
    mine, ask = F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"), F.pmod(F.xxhash64("id", F.lit(3)), F.col("qb")).cast("int")
    at = lambda n, q, role: F.struct(n.alias("n"), q.alias("q"), F.lit(role).alias("role"))
    asks = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: at(i, ask, 2))
    holds = F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda j: at(mine, j, 1))
    both = F.concat(F.array(at(mine, ask, 3)), F.filter(asks, lambda s: s["n"] != mine), F.filter(holds, lambda s: s["q"] != ask))
    in_home, wants = F.col("tile") == home, F.size("wants") > 0
    where = F.explode(F.when(in_home & wants, both).when(in_home, holds).otherwise(asks)).alias("at")
    sent = sent.select("g", "tile", "id", "part", "wants", "vector", where).select("g", "tile", F.col("at.n").alias("n"), F.col("at.q").alias("q"), "id", F.col("at.role").alias("role"), "part", "wants", "vector")
    key = ["g", "tile", "n", "q"]
    found = sent.repartition(n_tasks, *key).groupBy(*key).applyInArrow(_scan_tile(indexes, p, to_arrow_schema(FOUND)), FOUND)
    return _first(found, p.k)


def _first(found: DataFrame, k: int) -> DataFrame:
    """Of ``g, id, neighbour, cosine`` each row's `k` best, by cosine and then by id."""
    place = F.row_number().over(W.partitionBy("g", "id").orderBy(F.col("cosine").desc(), "neighbour"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def _nearest_in(rows: DataFrame, sizes: list, p: Params) -> DataFrame:
    """`nearest` for some groups (model, dim, count) of the usable rows."""
    spark = rows.sparkSession
    count, dims = {g: r["count"] for g, r in enumerate(sizes)}, {g: r["dim"] for g, r in enumerate(sizes)}
    groups = F.broadcast(spark.createDataFrame([(g, r["model"], r["dim"]) for g, r in enumerate(sizes)], "g int, model string, dim int"))
    rows = rows.join(groups, ["model", "dim"]).select("g", "id", "vector")

    # rows of equal vectors are one class, named by its smallest id
    digests = rows.select("g", "id", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(1), "vector").alias("h2"))
    classes = digests.groupBy("g", "h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c")
    copies = materialise(digests.join(_few(materialise(classes, "classes")), ["g", "h1", "h2"]).select("g", "id", "rep"), "copies")
    later = copies.where("id <> rep").select("g", "id")
    alone = rows.join(_few(later), ["g", "id"], "left_anti")

    models = _draw(alone, _of({g: min(1.0, p.sample / n) for g, n in count.items()}), 11).groupBy("g").applyInArrow(_fit_groups(p, count), "g int, model binary").collect()  # one small model per group
    indexes = {r["g"]: pickle.loads(r["model"]) for r in models}
    for g in set(count) - set(indexes):  # a group so small that the draw took none
        x = pa.array([bytes(r["vector"]) for r in alone.where(F.col("g") == g).limit(p.sample).collect()])
        indexes[g] = fit(_vectors(x), count[g], p)
    routed, cells = _parted(alone, count, dims, p)
    best_ = materialise(_scanned(routed, cells, indexes, dims, p), "best")

    # whoever met too few rows in the partitions it asked asks all of them
    have = {r["g"]: r["n"] for r in cells.groupBy("g").agg(F.sum("n").alias("n")).collect()}
    short = None
    if best_.count() < sum(n * min(p.k, n - 1) for n in have.values()):
        met = best_.groupBy("g", "id").count()
        short = routed.select("g", "id").join(met, ["g", "id"], "left")
        short = materialise(short.where(F.coalesce("count", F.lit(0)) < _of({g: min(p.k, n - 1) for g, n in have.items()})).select("g", "id"), "short")
    if short is not None:
        asking = routed.join(short.withColumn("asks", F.lit(True)), ["g", "id"], "left")
        # as many tiles as the data's bytes over a tile's
        all_tiles = cells.where("n > 0").groupBy("g").agg(F.collect_list(F.shiftleft("tile", SHIFT) + ALL).alias("every"))
        none = F.array().cast("array<bigint>")
        asking = asking.join(F.broadcast(all_tiles), "g").select("g", "id", "vector", "part", F.when(F.col("asks"), F.col("every")).otherwise(none).alias("asked"))
        more = cells.drop("q").join(F.broadcast(short.groupBy("g").agg(F.count("*").alias("q"))), "g")
        again = _scanned(asking, more, indexes, dims, p)
        best_ = best_.join(short, ["g", "id"], "left_anti").unionByName(again)

    if not copies.isEmpty():
        best_ = _with_copies(best_, copies, p.k)
    return best_.join(groups, "g").select("id", "neighbour", "model", "dim", "rank", "cosine")


def _with_copies(found: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """``g, id, neighbour, cosine, rank`` of classes to those of all rows; `copies` has ``g, id, rep`` of classes of several rows.

    Of a class its k + 1 smallest ids are enough: any row takes k of them at most besides itself.
    """
    place = F.row_number().over(W.partitionBy("g", "rep").orderBy("id"))
    members = materialise(copies.withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "members")
    reps = members.select("g", F.col("rep").alias("id")).distinct()
    # rows that found no class of several keep what they have
    near_class = found.join(_few(reps.withColumnRenamed("id", "neighbour")), ["g", "neighbour"], "left_semi").select("g", "id")
    touched = _few(materialise(near_class.unionAll(reps).distinct(), "touched"))
    kept = found.join(touched, ["g", "id"], "left_anti").select("g", "id", "neighbour", "cosine", "rank")
    of_near = _few(members.select("g", F.col("rep").alias("neighbour"), F.col("id").alias("member")))
    wide = found.join(touched, ["g", "id"], "left_semi").drop("rank").join(of_near, ["g", "neighbour"], "left").select("g", "id", F.coalesce("member", "neighbour").alias("neighbour"), "cosine")
    wide = materialise(_first(wide, k), "wide")
    reps = _few(reps)
    own = members.select("g", F.col("rep").alias("id"), F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    # at most 2 k + 1 entries to a class
    lists = wide.drop("rank").join(reps, ["g", "id"], "left_semi").unionByName(own).groupBy("g", "id").agg(F.collect_list(F.struct((-F.col("cosine")).alias("far"), "neighbour")).alias("near"))
    each = copies.join(_few(lists.withColumnRenamed("id", "rep")), ["g", "rep"]).select("g", "id", F.slice(F.array_sort(F.filter("near", lambda n: n["neighbour"] != F.col("id"))), 1, k).alias("near"))
    each = each.select("g", "id", F.posexplode("near").alias("place", "n")).select("g", "id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.far")).alias("cosine"), (F.col("place") + 1).alias("rank"))
    return kept.unionAll(wide.join(reps, ["g", "id"], "left_anti").select(*each.columns)).unionAll(each)
