"""Mixing sources to target weights: entropy balancing of document rates, rounded into copies."""

from __future__ import annotations

import math
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..runtime import materialise

#: Documents of one source and size are ranked in parts, this many at least, and more from so many documents on.
SLOTS, PER_SLOT = 64, 1_000_000


class Mixture(NamedTuple):
    """`copies`: (key, source, tokens, copies) of every document used; `shares`: what each source was to give and gave."""

    copies: DataFrame
    shares: DataFrame


def source_name(c: Column) -> Column:
    """Blanks and letter case aside."""
    return F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def solve_rates(cells: DataFrame, goals: dict[str, tuple[float, float]], *, rounds: int = 60, tolerance: float = 1e-9) -> dict[str, tuple[float, float]]:
    """(tilt, scale) by source: the rate of a document with t tokens is cap * sigmoid(base + tilt * t / scale).

    `goals` has by source the tokens it is to give and its cap. The rates are
    those nearest in entropy to one even rate for all documents that meet the
    goals and stay within 0 and the cap. The dual is convex, with one unknown per source; every
    Newton round sums its slope and curvature over the cells on the cluster
    and brings one row per source back. A step that leaves the bracket of the
    root is replaced by bisection. Rates that don't meet the goals after `rounds`
    are an error.
    """
    stats = {r["source"]: r for r in cells.groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens"), F.sum("n").alias("n")).collect()}
    state = {s: [0.0, -math.inf, math.inf] for s in goals}  # tilt, and what it lies between
    even = sum(goal for goal, _ in goals.values()) / sum(stats[s]["tokens"] for s in goals)
    base = {}
    for s, (_, cap) in goals.items():
        share = min(max(even / cap, 0.001), 0.999)
        base[s] = math.log(share / (1 - share))
    scale = {s: stats[s]["tokens"] / stats[s]["n"] for s in goals}
    spark = cells.sparkSession
    for _ in range(rounds):
        now = spark.createDataFrame([(s, base[s], state[s][0], scale[s], float(goals[s][1])) for s in goals], "source string, base double, tilt double, scale double, cap double")
        x = F.col("tokens") / F.col("scale")
        rate = F.col("cap") / (1 + F.exp(-(F.col("base") + F.col("tilt") * x)))
        given = cells.join(F.broadcast(now), "source").withColumn("rate", rate)
        sums = given.groupBy("source").agg(
            F.sum(F.col("n") * F.col("rate") * F.col("tokens")).alias("tokens"),
            F.sum(F.col("n") * F.col("rate") * (1 - F.col("rate") / F.col("cap")) * F.col("tokens") * x).alias("slope"),
        )
        worst = 0.0
        for r in sums.collect():
            s, at = r["source"], state[r["source"]]
            miss = r["tokens"] - goals[s][0]
            worst = max(worst, abs(miss) / goals[s][0])
            at[1 if miss < 0 else 2] = at[0]
            step = at[0] - miss / r["slope"] if r["slope"] > 0 else math.inf
            if not at[1] < step < at[2]:
                low, high = at[1] if at[1] > -math.inf else at[0] - 8, at[2] if at[2] < math.inf else at[0] + 8
                step = (low + high) / 2
            if abs(miss) > tolerance * goals[s][0]:
                at[0] = step
        if worst <= tolerance:
            break
    else:
        if worst > 1e-6:  # beyond what sums of doubles differ by
            raise RuntimeError(f"no rates in {rounds} rounds: a source misses its goal by a share of {worst:.2g}")
    return {s: (base[s], state[s][0], scale[s]) for s in goals}


def _round_down_the_sizes(cells: pd.DataFrame) -> pd.DataFrame:
    """Whole copies and extra ones of each size of one source, from the longest down.

    The tokens that rounding one size owes or has given too much are passed on
    to the next smaller one, so at the end about half a shortest document is
    missing. A source has one row per distinct size here, however many documents.
    """
    cells = cells.sort_values("tokens", ascending=False)
    debt, extra = 0.0, []
    for t, n, rate, cap in zip(cells["tokens"].to_numpy(), cells["n"].to_numpy(), cells["rate"].to_numpy(), cells["cap"].to_numpy()):
        owed = n * (rate - math.floor(rate)) * t + debt
        more = min(max(round(owed / t), 0), n if math.floor(rate) < cap else 0)
        debt = owed - more * t
        extra.append(int(more))
    return pd.DataFrame({"source": cells["source"], "tokens": cells["tokens"], "whole": cells["rate"].map(math.floor), "extra": extra, "of": cells["n"]})


def mix(sizes: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", size: str = "tokens", *, share: str = "target_share", cap: str = "max_repeats", fill: float = 0.98) -> Mixture:
    """A mixture whose tokens divide among the sources as `targets` says, no document above its source's cap.

    The total is the largest at which every source that has tokens can still
    meet its share within its cap, times `fill`, so all shares are met. A
    source with a target but no tokens gives nothing, and the rest keep their
    proportions; a source without target (or with share 0, a null or negative
    one, or a cap below 1) is not used. Names agree but for blanks and letter
    case; targets named twice count with the sum of shares and the least cap.

    Rates follow from `solve_rates`. Copies are their whole part plus, for the
    fraction, one more for some of the documents of equal size. What rounding
    one size leaves is carried to the next smaller one, so a source misses its
    goal by about its shortest document. Which documents of a size get the
    extra copy is drawn by a hash of the key.

    `targets` is configuration, one row per source, and is held by the driver;
    everything that grows with the documents stays on the cluster: documents
    are first summed into (source, tokens) cells. Null keys, sizes and sources
    and documents without tokens are not used. Keys should be unique. Empty
    tables give an empty mixture. Other columns are not read.
    """
    spark = sizes.sparkSession
    docs = sizes.select(F.col(key).alias("key"), source_name(F.col(source)).alias("source"), F.col(size).cast("long").alias("tokens")).where("key is not null and source is not null and tokens > 0")
    docs = materialise(docs, "sized")
    slot = F.pmod(F.xxhash64("key", F.lit(3)), F.lit(max(SLOTS, docs.count() // PER_SLOT))).cast("int").alias("slot")
    docs = docs.select("*", slot)
    wanted = targets.select(source_name(F.col(source)).alias("source"), F.col(share).cast("double").alias("share"), F.col(cap).cast("int").alias("cap")).where("source is not null")
    wanted = wanted.groupBy("source").agg(F.sum("share").alias("share"), F.min("cap").alias("cap"))
    cells = docs.groupBy("source", "tokens", "slot").agg(F.count("*").alias("n"))
    cells = materialise(cells, "cells")
    by_size = cells.groupBy("source", "tokens").agg(F.sum("n").alias("n"))
    have = {r["source"]: r["tokens"] for r in by_size.join(F.broadcast(wanted), "source", "left_semi").groupBy("source").agg(F.sum(F.col("n") * F.col("tokens")).alias("tokens")).collect()}
    plan = {r["source"]: (r["share"] or 0.0, r["cap"] or 0) for r in wanted.collect()}
    able = {s: v for s, v in plan.items() if v[0] > 0 and v[1] >= 1 and have.get(s)}
    reach = sum(v[0] for v in able.values())
    total = fill * min((v[1] * have[s] * reach / v[0] for s, v in able.items()), default=0.0)
    goals = {s: (total * v[0] / reach, float(v[1])) for s, v in able.items()}
    rates = solve_rates(materialise(by_size.where(F.col("source").isin(list(goals))), "sizes"), goals) if goals else {}
    solved = spark.createDataFrame([(s, *rates[s], goals[s][1]) for s in goals], "source string, base double, tilt double, scale double, cap double")
    rate = F.col("cap") / (1 + F.exp(-(F.col("base") + F.col("tilt") * F.col("tokens") / F.col("scale"))))
    rated = cells.join(F.broadcast(solved), "source").select("source", "tokens", "slot", "n", "cap", rate.alias("rate"))
    each = rated.groupBy("source", "tokens").agg(F.sum("n").alias("n"), F.first("rate").alias("rate"), F.first("cap").alias("cap"))
    owed = each.groupBy("source").applyInPandas(_round_down_the_sizes, "source string, tokens long, whole int, extra long, of long")
    # the extra copies of one size, dealt to its slots in proportion
    along = W.partitionBy("source", "tokens").orderBy("slot")
    rated = rated.select("source", "tokens", "slot", "n").join(owed, ["source", "tokens"])
    rated = rated.withColumn("upto", F.floor(F.col("extra") * F.sum("n").over(along.rowsBetween(W.unboundedPreceding, 0)) / F.col("of") + 1e-9))
    rated = rated.select("source", "tokens", "slot", "whole", (F.col("upto") - F.coalesce(F.lag("upto").over(along), F.lit(0))).alias("extra"))
    slotted = docs.join(rated, ["source", "tokens", "slot"])
    place = F.row_number().over(W.partitionBy("source", "tokens", "slot").orderBy(F.xxhash64("key", F.lit(5)), "key"))
    copies = slotted.withColumn("copies", (F.col("whole") + (place <= F.col("extra")).cast("long")).cast("int")).where("copies > 0").select("key", "source", "tokens", "copies")
    copies = materialise(copies, "mixture")
    used = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    whole = copies.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    goal = spark.createDataFrame([(s, goals[s][0] / total) for s in goals], "source string, reachable_share double")
    shares = wanted.join(F.broadcast(goal), "source", "left").join(used, "source", "left")
    shares = shares.select(
        "source",
        F.coalesce("share", F.lit(0.0)).alias("target_share"),
        F.coalesce("reachable_share", F.lit(0.0)).alias("reachable_share"),
        (F.coalesce("tokens", F.lit(0)) / F.lit(float(max(whole, 1)))).alias("actual_share"),
        F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.col("cap").alias("max_repeats"),
    )
    return Mixture(copies.withColumnRenamed("key", key), shares)
