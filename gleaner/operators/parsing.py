"""What a note says about itself: front matter fields, tags, links, and the keys that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import frontmatter_of, link_variants, normalize_tag, strip_frontmatter, trimmed, wikilinks

_NONE = "array<string>"


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(trimmed(c), "\\A([\"'])(.*)\\1\\z", "$2")


def field(frontmatter: Column, name: str) -> Column:
    """struct<one, many>: a field of a front matter as a single string or, for a list in either notation, as strings."""
    inline = trimmed(F.regexp_extract(frontmatter, f"(?m)^{name}:[ \\t]*([^\\r\\n]*)", 1))
    block = F.regexp_extract(frontmatter, f"(?m)^{name}:[ \\t]*\\r?\\n((?:[ \\t]*-[ \\t]+[^\\r\\n]*(?:\\r?\\n|\\z))+)", 1)
    listed = F.when(
        inline.rlike(r"\A\[.*\]\z"),
        F.transform(F.regexp_extract_all(F.substring(inline, F.lit(2), F.length(inline) - 2), F.lit("\"[^\"]*\"|'[^']*'|[^,]+"), F.lit(0)), _unquoted),
    ).when((inline == "") & (block != ""), F.transform(F.regexp_extract_all(block, F.lit("-[ \\t]+([^\\r\\n]*)"), F.lit(1)), _unquoted))
    return F.struct(F.when((inline != "") & listed.isNull(), _unquoted(inline)).alias("one"), listed.alias("many"))


def _filled(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (trimmed(v) != ""))


def _variants(values: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(_filled(values), link_variants)))


def inline_tags(body: Column) -> Column:
    """Tags in the text: after white space or at the start, not of digits alone."""
    return F.filter(F.regexp_extract_all(body, F.lit(r"(?:^|(?<=\s))#([\p{L}\p{N}_\-/]+)"), F.lit(1)), lambda t: ~t.rlike(r"^\d+$"))


def link_targets(body: Column) -> Column:
    return F.transform(wikilinks(body), lambda t: F.substring_index(t, "|", 1))


def with_parts(notes: DataFrame, content: str = "content") -> DataFrame:
    """`notes` with ``body, tags, own_doctrines, own_tags, links``: all that a note's text says without a lexicon.

    `tags` is what stands before its chunks; `own_doctrines` and `own_tags` the plain
    forms of the front matter fields (`doctrine` a list or one string, `tags` a list or
    strings between commas) and of tags in the text; `links` those of the links.
    """
    empty = F.array().cast(_NONE)
    head, body = frontmatter_of(F.col(content)), strip_frontmatter(F.col(content))
    doctrine, tags = field(head, "doctrine"), field(head, "tags")
    tag_values = F.coalesce(tags["many"], F.split(tags["one"], ","), empty)
    found = inline_tags(body)
    plain = F.transform(F.concat(tag_values, found), lambda t: trimmed(F.regexp_replace(trimmed(t), r"\A#", "")))
    return notes.select(
        "*",
        body.alias("body"),
        F.array_distinct(F.filter(plain, lambda t: t != "")).alias("tags"),
        _variants(F.coalesce(doctrine["many"], F.array_compact(F.array(doctrine["one"])), empty)).alias("own_doctrines"),
        F.array_distinct(F.concat(_variants(tag_values), F.filter(F.transform(found, normalize_tag), lambda t: t != ""))).alias("own_tags"),
        _variants(link_targets(body)).alias("links"),
    )


def note_tags(parsed: DataFrame, path: str = "path") -> DataFrame:
    """``note_path, tag``: all that a note from `with_parts` is tagged with, in front matter, text and links; each once."""
    return parsed.select(F.col(path).alias("note_path"), F.explode(F.array_distinct(F.concat("own_doctrines", "own_tags", "links"))).alias("tag"))


def note_keys(parsed: DataFrame, lexicon: DataFrame | None = None, path: str = "path") -> DataFrame:
    """``note_path, kind, key``, distinct: doctrine and tag keys of notes from `with_parts`.

    A link whose key the doctrine lexicon (column `key`) has is a doctrine key, any other a tag key.
    A key that is a doctrine key of a note is not also its tag key.
    """

    def each(column: str, kind: str) -> DataFrame:
        return parsed.select(F.col(path).alias("note_path"), F.lit(kind).alias("kind"), F.explode(column).alias("key"))

    links = parsed.select(F.col(path).alias("note_path"), F.explode("links").alias("key"))
    if lexicon is None:
        links = links.select("note_path", F.lit("tag").alias("kind"), "key")
    else:
        marked = links.join(lexicon.select("key", F.lit(True).alias("known")).distinct(), "key", "left")
        links = marked.select("note_path", F.when(F.col("known"), "doctrine").otherwise("tag").alias("kind"), "key")
    every = each("own_doctrines", "doctrine").unionAll(each("own_tags", "tag")).unionAll(links)
    # 'doctrine' sorts before 'tag', so the smallest kind of a key is the one that counts
    return every.groupBy("note_path", "key").agg(F.min("kind").alias("kind")).select("note_path", "kind", "key")
