"""Editor events to query triggers: debounce, change detection, latest wins, suppression; for streams and for tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Quiet time before a trigger and time for which an opened note is left alone, in milliseconds.
QUIET, LEFT_ALONE = 2500, 800
#: Milliseconds without an event after which a stream forgets a key.
FORGOTTEN = 24 * 3_600_000
#: How late an event of such a stream may be; later ones are dropped.
LATE = "1 hour"


def debounce(events: DataFrame, key: str, at: str = "ts", order: str = "event_id", quiet_ms: int = QUIET, watermark: str | None = None) -> DataFrame:
    """One trigger for each run of events of a key with no longer pause than `quiet_ms`: the last event, when it is over, how many there were.

    ``<key>, fired_at, events, last``. For a table or a stream alike; a stream needs a `watermark`, events later than it are dropped.
    """
    rows = events.withWatermark(at, watermark) if watermark else events
    last = F.struct(*events.columns)
    sessions = rows.groupBy(key, F.session_window(at, f"{quiet_ms} milliseconds")).agg(F.count("*").alias("events"), F.max_by(last, F.struct(at, order)).alias("last"))
    return sessions.select(key, F.col("session_window.end").alias("fired_at"), "events", "last")


def changes(events: DataFrame, key: str, value: str, at: str = "ts", order: str = "event_id") -> DataFrame:
    """Events of a table whose value differs from the one before in their key; the first counts if it isn't empty."""
    before = F.coalesce(F.lag(value).over(W.partitionBy(key).orderBy(at, order)), F.lit(""))
    return events.withColumn("__before", before).where(F.coalesce(F.col(value), F.lit("")) != F.col("__before")).drop("__before")


def _forget(state, times: pd.Series, after_ms: int) -> None:
    """Lets a key's state end so long after its last event, by the time of events."""
    state.setTimeoutTimestamp(max(int(times.max().timestamp() * 1000), state.getCurrentWatermarkMs()) + after_ms)


def stream_changes(events: DataFrame, key: str, value: str, at: str = "ts", forget_ms: int = FORGOTTEN, late: str = LATE) -> DataFrame:
    """The same for a stream: ``<key>, <value>, <at>`` of each change; the last value of a key is kept until it was silent for `forget_ms`."""
    types = dict(events.dtypes)
    schema = f"{key} {types[key]}, {value} {types[value]}, {at} {types[at]}"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else ""
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        shown = rows[value].fillna("")
        changed = shown != shown.shift(fill_value=last)
        if len(rows):
            state.update((shown.iloc[-1],))
            _forget(state, rows[at], forget_ms)
        yield pd.DataFrame({key: k[0], value: rows[value][changed], at: rows[at][changed]})

    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, f"last {types[value]}", "append", GroupStateTimeout.EventTimeTimeout)


def stream_sticky(events: DataFrame, key: str, value: str, at: str = "ts", forget_ms: int = FORGOTTEN, late: str = LATE) -> DataFrame:
    """`sticky` for a stream: ``<key>, <at>, <value>`` of every event; a key's last value is kept until it was silent for `forget_ms`."""
    types = dict(events.dtypes)
    schema = f"{key} {types[key]}, {at} {types[at]}, {value} {types[value]}"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        known = [state.get[0]] if state.exists else [None]
        out = []
        for v in rows[value].astype(object).where(rows[value].notna(), None):
            known.append(known[-1] if v is None else v)
            out.append(known[-1])
        if known[-1] is not None:
            state.update((known[-1],))
            _forget(state, rows[at], forget_ms)
        yield pd.DataFrame({key: k[0], at: rows[at], value: pd.Series(out, index=rows.index, dtype=object)})

    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, f"last {types[value]}", "append", GroupStateTimeout.EventTimeTimeout)


#: What an event may be to `gate`.
OPEN, TRIGGER, MANUAL, PAUSE, RESUME = "open", "trigger", "manual", "pause", "resume"


def gate(events: DataFrame, key: str = "session", at: str = "ts", order: str = "event_id", ms: int = LEFT_ALONE) -> DataFrame:
    """Of a table of events (``<key>, <at>, <order>, path, kind``) the triggers that pass.

    `kind` is open (a note was opened), trigger, manual, pause or resume. A
    trigger passes if its key isn't paused and its note wasn't opened less than
    `ms` before; a manual one always does.
    """
    before = W.partitionBy(key).orderBy(at, order).rowsBetween(W.unboundedPreceding, 0)
    of_note = W.partitionBy(key, "path").orderBy(at, order).rowsBetween(W.unboundedPreceding, 0)
    switch = F.last(F.when(F.col("kind").isin(PAUSE, RESUME), F.col("kind")), ignorenulls=True).over(before)
    opened = F.last(F.when(F.col("kind") == OPEN, F.unix_millis(at)), ignorenulls=True).over(of_note)
    rows = events.withColumn("__switch", switch).withColumn("__opened", opened)
    alone = F.coalesce(F.unix_millis(at) - F.col("__opened") < ms, F.lit(False)) & F.col("path").isNotNull()
    paused = F.coalesce(F.col("__switch") == PAUSE, F.lit(False))
    return rows.where((F.col("kind") == MANUAL) | ((F.col("kind") == TRIGGER) & ~paused & ~alone)).drop("__switch", "__opened")


def stream_gate(events: DataFrame, key: str = "session", at: str = "ts", ms: int = LEFT_ALONE, forget_ms: int = FORGOTTEN, late: str = LATE) -> DataFrame:
    """`gate` for a stream: ``<key>, <at>, path, kind`` of the triggers that pass.

    A key's state is whether it is paused and the notes opened within `ms`; it is dropped when the key was silent for `forget_ms`.
    """
    types = dict(events.dtypes)
    schema = f"{key} {types[key]}, {at} {types[at]}, path string, kind string"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        paused, opened = (state.get[0], json.loads(state.get[1])) if state.exists else (False, {})
        rows = pd.concat(list(batches)).sort_values(at, kind="stable")
        passed = []
        for when, path, kind in zip(rows[at].dt.as_unit("ms").astype("int64"), rows["path"], rows["kind"]):
            if kind in (PAUSE, RESUME):
                paused = kind == PAUSE
            elif kind == OPEN and path is not None:
                opened = {p: t for p, t in opened.items() if when - t < ms} | {path: int(when)}
            passed.append(kind == MANUAL or (kind == TRIGGER and not paused and not (path in opened and when - opened[path] < ms)))
        state.update((bool(paused), json.dumps(opened)))
        _forget(state, rows[at], forget_ms)
        kept = rows[passed]
        yield pd.DataFrame({key: k[0], at: kept[at], "path": kept["path"], "kind": kept["kind"]})

    return events.withWatermark(at, late).groupBy(key).applyInPandasWithState(run, schema, "paused boolean, opened string", "append", GroupStateTimeout.EventTimeTimeout)


def latest_wins(results: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """Of the results of every key those of its newest generation."""
    return results.withColumn("__newest", F.max(generation).over(W.partitionBy(key))).where(F.col(generation) == F.col("__newest")).drop("__newest")


def not_suppressed(triggers: DataFrame, opened: DataFrame, shown: DataFrame | None = None, key: str = "session", at: str = "ts", ms: int = LEFT_ALONE) -> DataFrame:
    """Triggers (``<key>, <at>, path, manual``) that aren't of a note opened (``<key>, path, opened_at``) less than `ms` before
    nor of one shown already (``<key>, path``); manual ones always pass."""
    o = opened.select(F.col(key).alias("__k"), F.col("path").alias("__p"), "opened_at")
    since = F.unix_millis(at) - F.unix_millis("opened_at")
    held = (F.col(key) == F.col("__k")) & (F.col("path") == F.col("__p")) & (since >= 0) & (since < ms) & ~F.coalesce(F.col("manual"), F.lit(False))
    out = triggers.join(o, held, "left_anti")
    if shown is not None:
        s = shown.select(F.col(key).alias("__k"), F.col("path").alias("__p"))
        out = out.join(s, (F.col(key) == F.col("__k")) & (F.col("path") == F.col("__p")) & ~F.coalesce(F.col("manual"), F.lit(False)), "left_anti")
    return out


def sticky(events: DataFrame, key: str, value: str, at: str = "ts", order: str = "event_id") -> DataFrame:
    """Every event with the last non-null value of its key so far."""
    w = W.partitionBy(key).orderBy(at, order).rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn(value, F.last(value, ignorenulls=True).over(w))


def run_recall(triggers: DataFrame, recall: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, key: str = "session", generation: str = "fired_at"):
    """Starts a query over a stream of triggers that recalls for the newest of each key in a micro-batch; older ones are dropped unseen."""

    def each(batch: DataFrame, _: int) -> None:
        write(recall(latest_wins(batch, key, generation)))

    return triggers.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
