"""Notes from a folder of Markdown files, from tables, and query texts from editor states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, trimmed

SHORTEST_QUERY = 10


def read_vault(spark: SparkSession, folder: str, ending: str = ".md") -> DataFrame:
    """``path, mtime, size, content`` of every note below `folder`; paths are relative to it, times in epoch milliseconds."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{ending}").text(folder, wholetext=True)
    # file names are percent-encoded in the metadata column
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return files.select(
        F.substring_index(full, folder.rstrip("/") + "/", -1).alias("path"),
        F.unix_millis("_metadata.file_modification_time").alias("mtime"),
        F.col("_metadata.file_size").alias("size"),
        F.col("value").alias("content"),
    )


def is_note(path: Column) -> Column:
    return path.endswith(".md")


def paragraph_at(content: Column, line: Column) -> Column:
    """The paragraph around a line (from 0): the lines before and after it up to a blank one; null if it is too short.

    A blank line itself takes the runs on both its sides, since only its neighbours are looked at.
    """
    lines = F.split(content, "\n")
    at = line + 1
    blank = F.transform(lines, is_blank)
    before = F.array_max(F.filter(F.sequence(F.lit(0), F.greatest(at - 1, F.lit(0))), lambda i: (i == 0) | F.coalesce(F.get(blank, (i - 1).cast("int")), F.lit(True))))
    after = F.array_min(F.filter(F.sequence(at, F.greatest(F.size(lines), at)), lambda i: F.coalesce(F.get(blank, i.cast("int")), F.lit(True))))
    text = trimmed(F.array_join(F.slice(lines, (before + 1).cast("int"), (after - before).cast("int")), "\n"))
    return F.when((line >= 0) & (line < F.size(lines)) & (F.length(text) >= SHORTEST_QUERY), text)


def selected(selection: Column) -> Column:
    text = trimmed(selection)
    return F.when(F.length(text) >= SHORTEST_QUERY, text)


def query_contexts(states: DataFrame) -> DataFrame:
    """``session, path, at, text, mode`` of editor states (``session, path, at, selection, content, line``): the selection, else the
    paragraph, else the session's last query, if it was of the same note; states without any are dropped."""
    from pyspark.sql import Window as W

    own = states.withColumn("s", selected(F.col("selection"))).withColumn("p", paragraph_at(F.col("content"), F.col("line")))
    query = F.when(F.col("s").isNotNull(), F.struct(F.col("s").alias("text"), F.lit("selection").alias("mode"))).when(F.col("p").isNotNull(), F.struct(F.col("p").alias("text"), F.lit("paragraph").alias("mode")))
    # the one query kept is of whichever note asked last, so it holds only until another note asks
    last = own.withColumn("q", F.when(query.isNotNull(), F.struct("path", query.alias("q"))))
    kept = F.last("q", ignorenulls=True).over(W.partitionBy("session").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    return last.withColumn("k", kept).where(F.col("k.path") == F.col("path")).select("session", "path", "at", F.col("k.q.text").alias("text"), F.col("k.q.mode").alias("mode"))
