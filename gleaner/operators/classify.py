"""Notes to folders: the longest matching prefix decides group and weight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import factor

#: Up to so many folders stand in the plan as one constant; more are joined by prefix.
INLINE = 500


def _excluded(path: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def with_folder(notes: DataFrame, folders: DataFrame, path: str = "path") -> DataFrame:
    """`notes` with ``folder``, a struct (path, group_id, weight) of the longest folder that is a prefix of the path; null if none is.

    A plain string prefix, without regard to path parts. Of equally long ones the first (`pos`) wins.
    """
    rows = folders.select("pos", "path", "group_id", "weight").orderBy("pos").limit(INLINE + 1).collect()
    kind = "struct<path:string,group_id:string,weight:int>"
    if not rows:
        return notes.withColumn("folder", F.lit(None).cast(kind))
    if len(rows) <= INLINE:
        known = F.array(*[F.struct(F.lit(len(r["path"])).alias("n"), F.lit(-r["pos"]).alias("p"), F.lit(r["path"]).alias("path"), F.lit(r["group_id"]).alias("group_id"), F.lit(r["weight"]).cast("int").alias("weight")) for r in rows])
        best = F.array_max(F.filter(known, lambda f: F.col(path).startswith(f["path"])))
        return notes.withColumn("folder", F.when(best.isNotNull(), F.struct(best["path"].alias("path"), best["group_id"].alias("group_id"), best["weight"].alias("weight"))))
    # many folders: a path meets them by its prefixes of the lengths that occur
    lengths = [r[0] for r in folders.select(F.length("path")).distinct().collect()]
    first = folders.groupBy(F.col("path").alias("__prefix")).agg(F.min_by(F.struct("path", "group_id", "weight"), "pos").alias("__folder"))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    met = notes.select(path).distinct().withColumn("__prefix", F.explode(F.array_compact(prefixes))).join(first, "__prefix")
    best = met.groupBy(path).agg(F.max_by("__folder", F.length("__prefix")).alias("folder"))
    return notes.join(best.withColumn("folder", F.col("folder").cast(kind)), path, "left")


def classify(notes: DataFrame, folders: DataFrame, excluded: list[str] | None = None, path: str = "path") -> DataFrame:
    """Notes that a search uses, with ``category_id`` and ``weight``: not excluded, in a folder whose weight isn't 0.

    The weight is looked at after the longest folder is found, so a folder of weight 0 hides its notes even inside a weighted one.
    """
    kept = with_folder(notes.where(~_excluded(F.col(path), excluded or [])), folders, path).where("folder is not null and folder.weight <> 0")
    return kept.withColumn("category_id", F.col("folder.group_id")).withColumn("weight", factor(F.col("folder.weight"))).drop("folder")


def reapply(notes: DataFrame, folders: DataFrame, excluded: list[str] | None = None, path: str = "path") -> DataFrame:
    """All notes with group and weight of the present folders; those without get null and 0."""
    found = with_folder(notes, folders, path)
    used = ~_excluded(F.col(path), excluded or []) & F.coalesce(F.col("folder.weight") != 0, F.lit(False))
    return found.withColumn("category_id", F.when(used, F.col("folder.group_id"))).withColumn("weight", F.when(used, factor(F.col("folder.weight"))).otherwise(0.0)).drop("folder")


def suggest_folders(notes: DataFrame, query: str = "", path: str = "path", most: int = 100) -> DataFrame:
    """``folder``: the first folders of the collection whose path holds `query`, letter case aside."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    folders = notes.where(F.instr(path, "/") > 0).select(F.explode(above).alias("folder")).where("folder <> ''").distinct()
    if query:
        folders = folders.where(F.lower("folder").contains(query.lower()))
    return folders.orderBy("folder").limit(most)
