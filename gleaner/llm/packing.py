"""Filling fixed-capacity containers with items: bounded-space best fit, leftovers merged at the end."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import materialise, spread
from .text import TOKENIZER, encoder

#: Leftover containers that one task merges.
MERGED_AT_ONCE = 200_000


def _tokens(path: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = [None if t is None else len(e.encode_ordinary(t)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], schema=schema)

    return run


def token_sizes(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns `keep` and ``tokens``, the length of `text` in tokens of a public tokenizer; null for a null text."""
    rows = df.select(*keep, F.col(text).alias("tokens"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("tokens", T.LongType())])
    return spread(rows).mapInArrow(_tokens(tokenizer, to_arrow_schema(schema)), schema)


class OpenWindows:
    """At most `most` open containers, kept in order of the room they have left."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.room: list[tuple[int, int]] = []

    def put(self, size: int, fresh: int) -> tuple[int, tuple[int, int] | None, bool]:
        """Container for an item, the (room, container) that had to close for it, whether the container is new."""
        i = bisect.bisect_left(self.room, (size, -1))
        if i < len(self.room):
            left, container = self.room.pop(i)
            self._keep(left - size, container)
            return container, None, False
        closed = self.room.pop(0) if len(self.room) >= self.most else None
        self._keep(self.capacity - size, fresh)
        return fresh, closed, True

    def _keep(self, left: int, container: int) -> None:
        bisect.insort(self.room, (left, container))


def _pack(capacity: int, most: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        windows, made = OpenWindows(capacity, most), 0
        held: dict[int, list[tuple]] = {}

        def flush(container: int, left: int, leftover: bool) -> list[tuple]:
            return [(base + container, *item, capacity - left, leftover) for item in held.pop(container)]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        rows: list[tuple] = []
        for b in batches:
            for key, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for piece, start in enumerate(range(0, max(size, 1), capacity)):
                    n = min(capacity, size - start)
                    if n == capacity:  # fills a container of its own
                        rows.append((base + made, key, piece, start, n, n, False))
                        made += 1
                        continue
                    container, closed, new = windows.put(n, made)
                    made += new
                    held.setdefault(container, []).append((key, piece, start, n))
                    if closed is not None:
                        rows += flush(closed[1], closed[0], False)
                if len(rows) >= 20_000:
                    yield out(rows)
                    rows = []
        for left, container in windows.room:
            rows += flush(container, left, True)
        yield out(rows)

    return run


def _merge(capacity: int, schema: pa.Schema):
    """Whole leftover containers as items, the fullest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(-u, c) for b in batches for c, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        items.sort()
        windows, used, to = OpenWindows(capacity, len(items) + 1), {}, []
        for size, container in items:
            into, _, _ = windows.put(-size, container)
            to.append((container, into))
            used[into] = used.get(into, 0) - size
        columns = zip(*[(c, i, used[i]) for c, i in to]) if to else [[] for _ in schema]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "tokens", *, capacity: int = 2048, open_windows: int = 64) -> DataFrame:
    """``container, <key>, piece, start, tokens, used, unused``: where every item lies, one row per item or piece.

    An item above `capacity` is cut into pieces of `capacity` tokens and a
    rest; any other stays whole. `start` is the piece's first token within its
    item, `used` and `unused` what its container holds and has left.

    Each task keeps `open_windows` containers open and puts an item where the
    least room remains; if it fits nowhere the fullest is closed and a new one
    opened. What is open at the end of a task, `open_windows` containers at
    most, is merged as wholes with the leftovers of other tasks, in tasks of
    MERGED_AT_ONCE. A container's number depends on how rows were split into
    tasks; it is fixed by being written before it is used twice.

    An item without tokens takes no room and lies in some container; a null
    size is no item. Repeated keys are items of their own. An empty table
    gives no rows. Other columns are not read.
    """
    rows = sizes.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where("size is not null")
    long, whole = T.LongType(), T.IntegerType()
    schema = T.StructType([T.StructField("window", long), T.StructField("key", rows.schema["key"].dataType), T.StructField("piece", whole), T.StructField("start", long), T.StructField("tokens", long), T.StructField("used", long), T.StructField("leftover", T.BooleanType())])
    placed = materialise(rows.mapInArrow(_pack(capacity, open_windows, to_arrow_schema(schema)), schema), "placed")
    left = placed.where("leftover").groupBy("window").agg(F.max("used").alias("used"))
    n = left.count()
    merged = T.StructType([T.StructField("window", long), T.StructField("into", long), T.StructField("together", long)])
    moved = left.repartition(max(1, -(-n // MERGED_AT_ONCE))).mapInArrow(_merge(capacity, to_arrow_schema(merged)), merged)
    moved = materialise(moved, "moved")
    moved = F.broadcast(moved) if n <= MERGED_AT_ONCE else moved
    out = placed.join(moved, "window", "left")
    used = F.coalesce("together", "used")
    return out.select(F.coalesce("into", "window").alias("container"), F.col("key").alias(key), "piece", "start", "tokens", used.alias("used"), (F.lit(capacity) - used).alias("unused"))


def containers(packed: DataFrame) -> DataFrame:
    """``items, used, unused, containers``: how many containers hold so many items and so many tokens; for a report."""
    return packed.groupBy("container").agg(F.count("*").alias("items"), F.max("used").alias("used"), F.max("unused").alias("unused"))
