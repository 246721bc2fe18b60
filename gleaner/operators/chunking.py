"""Notes to chunks: sections by heading, long ones packed by paragraph. Narrow column work, nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, is_blank, strip_frontmatter, tag_prefix, trimmed

MOST = 1500
_IN_LINE = BLANKS.replace("\\n", "")
_ENDS = "\\n\\r\\u2028\\u2029"
HEADING = f"#{{1,6}}[{_IN_LINE}]+([^{_ENDS}]+?)[{_IN_LINE}]*"


def sections(body: Column) -> Column:
    """array<struct<heading, text>>: the text before the first heading and what follows each; lengths count code points."""
    parts = F.split(F.concat(F.lit("\n"), body), f"\\n(?={HEADING}(?:\\n|\\z))")
    line = f"\\A{HEADING}(?:\\n|\\z)"

    def section(part: Column, i: Column) -> Column:
        heading = F.when(i > 0, F.regexp_extract(part, line, 1))
        return F.struct(heading.alias("heading"), trimmed(F.when(i > 0, F.regexp_replace(part, line, "")).otherwise(part)).alias("text"))

    return F.transform(parts, section)


def _hard(buffer: Column, most: int) -> Column:
    """Struct of the full windows of an overlong buffer and what is left of it."""
    k = F.when(F.length(buffer) > most, F.floor((F.length(buffer) - 1) / most)).otherwise(0).cast("int")
    cut = F.when(k > 0, F.transform(F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0))), lambda i: trimmed(F.substring(buffer, (i * most + 1).cast("int"), F.lit(most))))).otherwise(F.array().cast("array<string>"))
    return F.struct(cut.alias("cut"), F.substring(buffer, (k * most + 1).cast("int"), F.length(buffer)).alias("rest"))


def packed(text: Column, most: int = MOST) -> Column:
    """array<string>: paragraphs of `text` joined while they fit into `most` characters; a longer one is cut hard."""
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("out"), F.lit("").alias("rest"))

    def put(acc: Column, p: Column) -> Column:
        full = (F.length(acc["rest"]) + F.length(p) + 2 > most) & (F.length(acc["rest"]) > 0)
        done = F.when(full & ~is_blank(acc["rest"]), F.array(trimmed(acc["rest"]))).otherwise(empty)
        kept = F.when(full, F.lit("")).otherwise(acc["rest"])
        buffer = F.when(F.length(kept) > 0, F.concat(kept, F.lit("\n\n"), p)).otherwise(p)
        hard = _hard(buffer, most)
        return F.struct(F.concat(acc["out"], done, hard["cut"]).alias("out"), hard["rest"].alias("rest"))

    def end(acc: Column) -> Column:
        return F.concat(acc["out"], F.when(~is_blank(acc["rest"]), F.array(trimmed(acc["rest"]))).otherwise(empty))

    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(F.split(text, "\\n{2,}"), start, put, end))


def chunks_of(body: Column, most: int = MOST) -> Column:
    """array<struct<heading, text>> of the non-empty chunks of a note's body, in order."""
    each = F.transform(sections(body), lambda s: F.transform(packed(s["text"], most), lambda t: F.struct(s["heading"].alias("heading"), t.alias("text"))))
    return F.filter(F.flatten(each), lambda c: ~is_blank(c["text"]))


def chunk_notes(notes: DataFrame, content: str = "content", path: str = "path", tags: str | None = None, most: int = MOST) -> DataFrame:
    """``note_path, ord, heading, text``: the chunks of every note; a note's tags, if given, stand before each of its chunks."""
    prefix = tag_prefix(F.col(tags)) if tags else F.lit("")
    rows = notes.select(F.col(path).alias("note_path"), prefix.alias("__prefix"), F.posexplode(chunks_of(strip_frontmatter(F.col(content)), most)).alias("ord", "__chunk"))
    return rows.select("note_path", "ord", F.col("__chunk.heading").alias("heading"), F.concat("__prefix", "__chunk.text").alias("text"))
