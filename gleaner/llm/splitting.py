"""Splitting oversized items at natural boundaries, with overlap."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import spread

#: Fixed value: signs that end a sentence.
ENDERS = ".!?。！？"
NEWLINE = 10


@cache
def _break_table() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it white space; is it white space or an ender."""
    space = np.zeros(0x110000, bool)
    space[[ord(c) for c in re.findall(r"\s", "".join(map(chr, range(0x3001))))]] = True
    either = space.copy()
    either[[ord(c) for c in ENDERS]] = True
    return space, either


def _attached(text: str, at: int) -> bool:
    """Whether the sign at `at` belongs to the one before it: a mark, a jamo that completes a syllable, a joiner."""
    c = text[at]
    return unicodedata.category(c)[0] == "M" or "\u1160" <= c <= "\u11ff" or "\u200d" in (c, text[at - 1])


class Boundaries:
    """The places where a text may be cut, as prefix sums over its tokens.

    A token is a maximal run without white space and enders, or one such sign;
    the prefix sums of the token lengths are the sorted offsets of all natural
    boundaries. Finer lists hold the better ones: paragraph, line, sentence
    and word starts.
    """

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        space, either = _break_table()
        blank, brk = space[codes], either[codes]
        edge = np.flatnonzero(brk[1:] | brk[:-1]) + 1
        lengths = np.diff(np.concatenate(([0], edge, [len(codes)])))
        self.length = len(codes)
        self.all = np.cumsum(lengths)
        inside = ~brk[np.concatenate(([0], edge))] if len(codes) else np.zeros(0, bool)
        self.longest_run = int(lengths[inside].max()) if inside.any() else 0
        at = self.all[:-1]
        lines = at[codes[at - 1] == NEWLINE]
        before = np.array([self._line_before_is_blank(codes, p) for p in lines], bool) if len(lines) else np.zeros(0, bool)
        ender = brk & ~blank
        words = at[blank[at - 1] & ~brk[at]]
        sentences = words[self._after_ender(blank, ender, words)] if len(words) else words
        wide = at[ender[at - 1] & (codes[at - 1] > 127) & ~ender[at]]
        self.ranked = [lines[before], lines, np.union1d(sentences, wide), words]
        self.words = words

    @staticmethod
    def _line_before_is_blank(codes: np.ndarray, p: int) -> bool:
        i = p - 2
        while i >= 0 and codes[i] in (13, 32, 9):
            i -= 1
        return i < 0 or codes[i] == NEWLINE

    @staticmethod
    def _after_ender(blank: np.ndarray, ender: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Which word starts have an ender as the last sign before the blanks in front."""
        last = np.maximum.accumulate(np.where(blank, -1, np.arange(len(blank))))
        seen = last[words - 1]
        return (seen >= 0) & ender[np.maximum(seen, 0)]

    def last_in(self, where: np.ndarray, low: int, high: int) -> int:
        """The last boundary in (low, high], or -1; by binary search."""
        i = int(np.searchsorted(where, high, "right")) - 1
        return int(where[i]) if i >= 0 and where[i] > low else -1

    def first_from(self, where: np.ndarray, low: int, high: int) -> int:
        i = int(np.searchsorted(where, low, "left"))
        return int(where[i]) if i < len(where) and where[i] <= high else -1


def pieces(text: str, room: int, overlap: int) -> tuple[list[tuple[int, int, bool]], int]:
    """(start, end, hard) of the pieces of `text`, at most `room` characters each; the longest unbroken run."""
    b = Boundaries(text)
    n, back, out = b.length, min(overlap, room // 2), []
    start = end = 0
    while end < n:
        done, high, hard = end, start + room, False
        if high >= n:
            end = n
        else:
            end = -1
            for k, where in enumerate(b.ranked):
                end = b.last_in(where, max(done, start + room // 2 if k < 3 else start), high)
                if end > 0:
                    break
            if end < 0:
                end = b.last_in(b.all, done, high)
            if end < 0:
                end, hard = high, True
                while end > max(done, start) + 1 and end > high - 64 and _attached(text, end):
                    end -= 1
                if _attached(text, end):
                    end = high
        out.append((start, end, hard))
        if end >= n:
            break
        following = int(b.all[np.searchsorted(b.all, end, "right")])
        low = max(end - back, start + 1)
        if following - end <= room:  # the next run fits whole; don't step back so far that it wouldn't
            low = max(low, following - room)
        step = b.first_from(b.words, low, end)
        if step < 0:
            step = b.first_from(b.all, low, end)
        if step < 0:
            step = low if hard and following - end > room - back else end
        start = step
    return out, b.longest_run


def _split(limit: int, overlap: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            columns = zip(*rows) if rows else [[] for _ in schema]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for batch in batches:
            for key, heading, text in zip(*(c.to_pylist() for c in batch.columns)):
                head = heading or ""
                if len(head) >= limit:
                    shown = head[: limit // 2]
                    own, _ = pieces(head, limit, overlap)
                else:
                    shown, own = head, []
                cut, run_length = pieces(text, limit - len(shown), overlap)
                mark = "forced" if run_length > limit - len(head) else "natural"
                for i, (s, e, hard) in enumerate(own):
                    rows.append((key, i, 0, 0, head[s:e], "", hard, mark))
                    size += e - s
                for i, (s, e, hard) in enumerate(cut, len(own)):
                    rows.append((key, i, s, e, shown if heading is not None else None, text[s:e], hard, mark))
                    size += e - s
                if size > 4_000_000:
                    yield out()
                    rows, size = [], 0
        yield out()

    return run


def split_oversized(df: DataFrame, key: str = "chunk_id", heading: str = "heading", text: str = "text", *, limit: int = 1500, overlap: int = 150) -> DataFrame:
    """The ordered pieces of every item longer than `limit` characters, heading included.

    ``<key>, piece, start, end, heading, text, hard, cut``: `text` is
    characters `start` to `end` of the item, the heading stands in front of
    each piece, and both together have at most `limit` characters. Consecutive
    pieces share at most `overlap` characters, in whole words. A piece ends,
    in this order, after a paragraph, a line, a sentence (each in the second
    half of the room) or a blank, else beside any blank or sentence ender;
    only inside a run without those that is longer than the room is it cut
    `hard`. `cut` is ``forced`` for items with such a run, else ``natural``.

    Offsets count code points. A null heading is none; one of `limit` or more
    characters comes first and whole, cut like a text into pieces of its own
    (`start` and `end` 0, `text` empty), and is repeated only with its first
    half limit. Null texts are not
    longer than the limit. Repeated rows come out again; an empty table gives
    no rows; other columns are not read. Each item is cut on its own, in the
    task that reads it, so nothing is shuffled.
    """
    kind = df.schema[key].dataType
    schema = T.StructType(
        [T.StructField(key, kind)]
        + [T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("heading", T.StringType()), ("text", T.StringType()), ("hard", T.BooleanType()), ("cut", T.StringType()))]
    )
    from pyspark.sql.pandas.types import to_arrow_schema

    long = df.select(F.col(key).alias("key"), F.col(heading).alias("heading"), F.col(text).alias("text")).where(F.length("text") + F.coalesce(F.length("heading"), F.lit(0)) > limit)
    return spread(long).mapInArrow(_split(limit, overlap, to_arrow_schema(schema)), schema)
