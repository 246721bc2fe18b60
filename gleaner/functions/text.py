"""Text functions as Spark columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as editors' scripting defines it, for regular expressions.
BLANKS = "\\t\\n\\u000b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
#: Pictographic signs, as ranges of characters (Unicode's Extended_Pictographic).
EMOJI = (
    "©®‼⁉™ℹ↔-↙↩-↪⌚-⌛⌨⎈⏏⏩-⏳⏸-⏺Ⓜ"
    "▪-▫▶◀◻-◾☀-★☇-☒☔-⚅⚐-✅✈-✒✔✖✝✡"
    "✨✳-✴❄❇❌❎❓-❕❗❣-❧➕-➗➡➰➿⤴-⤵⬅-⬇"
    "⬛-⬜⭐⭕〰〽㊗㊙\U0001f000-\U0001f0ff\U0001f10d-\U0001f10f\U0001f12f\U0001f16c-\U0001f171"
    "\U0001f17e-\U0001f17f\U0001f18e\U0001f191-\U0001f19a\U0001f1ad-\U0001f1e5\U0001f201-\U0001f20f\U0001f21a\U0001f22f\U0001f232-\U0001f23a"
    "\U0001f23c-\U0001f23f\U0001f249-\U0001f3fa\U0001f400-\U0001f53d\U0001f546-\U0001f64f\U0001f680-\U0001f6ff\U0001f774-\U0001f77f"
    "\U0001f7d5-\U0001f7ff\U0001f80c-\U0001f80f\U0001f848-\U0001f84f\U0001f85a-\U0001f85f\U0001f888-\U0001f88f\U0001f8ae-\U0001f8ff"
    "\U0001f90c-\U0001f93a\U0001f93c-\U0001f945\U0001f947-\U0001faff\U0001fc00-\U0001fffd"
)
#: Parts that emoji are put together from, besides digits, # and *.
EMOJI_PARTS = "‍⃣︀-️\U0001f1e6-\U0001f1ff\U0001f3fb-\U0001f3ff\U000e0020-\U000e007f"
#: Words that are no search terms.
STOP_WORDS = (
    "하나님 예수 주 주님 사람 우리 분 분들 때 일 삶 마음 세상 곳 안 속 위 것 수 점 자 중 오늘 내일 어제 지금 여기 우리들 자기 나 너 그 하 되 있 없 보 받 살 알 시 오 들 이 가 태그"
).split()


def is_stop_word(term: Column) -> Column:
    return term.isin(*STOP_WORDS)


def trimmed(c: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(c, f"^[{BLANKS}]+|[{BLANKS}]+$(?!\\n)", "")


def is_blank(c: Column) -> Column:
    return ~c.rlike(f"[^{BLANKS}]")


def title_of(path: Column) -> Column:
    """The last part of a path, without .md at its end."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.md$", "")


def preview(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def strip_frontmatter(c: Column) -> Column:
    """The text after a leading block between lines of three hyphens."""
    return F.regexp_replace(c, f"\\A---\\r?\\n[\\s\\S]*?\\r?\\n---[{BLANKS}]*\\r?\\n?", "")


def frontmatter_of(c: Column) -> Column:
    """What stands between those lines; empty if there is no such block."""
    return F.regexp_extract(c, f"\\A---\\r?\\n([\\s\\S]*?)\\r?\\n---[{BLANKS}]*(?:\\r?\\n|$)", 1)


def _until(c: Column, sign: str) -> Column:
    return F.substring_index(c, sign, 1)


def _without_brackets(c: Column) -> Column:
    return F.when(c.startswith("[[") & c.endswith("]]") & (F.length(c) >= 4), F.substring(c, F.lit(3), F.length(c) - 4)).when(c.startswith("[[") & c.endswith("]]"), F.lit("")).otherwise(c)


def normalize_tag(c: Column) -> Column:
    """A tag or link target in its plain form: no #, brackets, alias, section, block mark or leading emoji."""
    t = F.regexp_replace(trimmed(c), r"\A#", "")
    t = _until(_until(_until(_without_brackets(t), "|"), "#"), "^")
    return trimmed(F.regexp_replace(t, f"\\A([{EMOJI}]\\ufe0f?[{BLANKS}]*)+", ""))


def link_variants(c: Column) -> Column:
    """The plain forms of a link target and of its last path part; without empty ones."""
    target = _until(_without_brackets(trimmed(c)), "|")
    last = F.when(F.instr(target, "/") > 0, normalize_tag(F.element_at(F.split(target, "/"), -1)))
    return F.array_distinct(F.filter(F.array(normalize_tag(c), last), lambda x: x.isNotNull() & (x != "")))


def hashtags(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"#([\p{L}\p{N}_\-/]+)"), F.lit(1))


def wikilinks(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1))


def query_tags(c: Column) -> Column:
    """array<string>: the plain forms of the tags and links that a text writes, each once."""
    written = F.concat(F.filter(F.transform(hashtags(c), normalize_tag), lambda t: t != ""), F.flatten(F.transform(wikilinks(c), link_variants)))
    return F.array_distinct(written)


def strip_emoji(c: Column) -> Column:
    """Every pictographic sign as a blank, for matching."""
    return F.regexp_replace(c, f"[{EMOJI}\\ufe0f]", " ")


def strip_symbols(c: Column) -> Column:
    """Without signs of the emoji blocks, for embedding."""
    return trimmed(F.regexp_replace(c, "[\U0001f300-\U0001faff☀-➿️]", ""))


def has_hangul(c: Column) -> Column:
    return c.rlike("[ㄱ-ㆎ가-힣]")


def plain_terms(c: Column) -> Column:
    """Runs of letters and digits, lower-cased, two or longer, without stop words; repetitions stay."""
    words = F.transform(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)
    return F.coalesce(F.filter(words, lambda w: (F.length(w) >= 2) & ~is_stop_word(w)), F.array().cast("array<string>"))


def query_terms(terms: Column) -> Column:
    """Distinct non-empty terms."""
    return F.array_distinct(F.filter(terms, lambda t: F.length(t) > 0))


def canonical_title(c: Column, copy_word: str = "복사본") -> Column:
    """A title without the endings that duplicating a note adds."""
    t = F.regexp_replace(c, f"[{BLANKS}]+[0-9]+\\z", "")
    return trimmed(F.regexp_replace(t, f"[{BLANKS}]+{copy_word}([{BLANKS}]+[0-9]+)?\\z", ""))


def wikilink(title: Column, heading: Column) -> Column:
    return F.concat(F.lit("[["), title, F.coalesce(F.concat(F.lit("#"), heading), F.lit("")), F.lit("]]"))


def tag_prefix(tags: Column) -> Column:
    """What stands before the text of every chunk of a tagged note."""
    return F.when(F.size(tags) > 0, F.concat(F.lit("[태그: "), F.array_join(tags, ", "), F.lit("] "))).otherwise("")


def highlight(c: Column, terms: list[str], left: str = "<mark>", right: str = "</mark>") -> Column:
    """`c` with every occurrence of a term marked, the longest term first, letter case aside.

    The terms of one query; those shorter than two characters or on the stop list are not marked.
    """
    kept = sorted({t for t in terms if len(t) >= 2 and t not in STOP_WORDS}, key=lambda t: (-len(t), t))
    if not kept:
        return c
    pattern = "(?iu)(" + "|".join("\\Q" + t.replace("\\E", "\\E\\\\E\\Q") + "\\E" for t in kept) + ")"
    return F.regexp_replace(c, pattern, f"{left}$1{right}")


def highlight_terms(c: Column, terms: Column, left: str = "<mark>", right: str = "</mark>") -> Column:
    """`highlight` with the terms of each row's own array."""
    kept = F.filter(F.array_distinct(terms), lambda t: (F.length(t) >= 2) & ~is_stop_word(t))
    longest = F.array_sort(F.transform(kept, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    quoted = F.transform(longest, lambda t: F.concat(F.lit("\\Q"), F.replace(t["t"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")))
    pattern = F.concat(F.lit("(?iu)("), F.array_join(quoted, "|"), F.lit(")"))
    return F.when(F.size(kept) > 0, F.regexp_replace(c, pattern, F.lit(f"{left}$1{right}"))).otherwise(c)


def keywords(c: Column) -> Column:
    """array<string>: what stands in ``[[...]]`` and then in double quotes, cut at a bar, without leading emoji, digits, # and *; each once."""
    found = F.concat(wikilinks(c), F.regexp_extract_all(c, F.lit('["\u201c\u201d]([^"\u201c\u201d\\n]+)["\u201c\u201d]'), F.lit(1)))
    clean = F.transform(found, lambda w: trimmed(F.regexp_replace(trimmed(_until(w, "|")), f"\\A[{EMOJI}{EMOJI_PARTS}0-9#*]+", "")))
    return F.array_distinct(F.filter(clean, lambda w: w != ""))


def query_key(c: Column) -> Column:
    """Identity of a query text, for caches and for dropping repeated queries."""
    return F.xxhash64(c)


def flags(bm25_rank: Column, vector_rank: Column, heading: Column, matched: Column, total: Column) -> Column:
    """How a hit was found, in short: B and V ranks, H for a heading, matched of all terms."""
    return F.concat_ws(
        " ",
        F.concat(F.lit("B"), bm25_rank.cast("string")),
        F.concat(F.lit("V"), vector_rank.cast("string")),
        F.when(heading, F.lit("H")),
        F.concat(matched.cast("string"), F.lit("/"), total.cast("string")),
    )


def ago(then: Column, now: Column) -> Column:
    """How long ago a time in epoch milliseconds was: seconds, minutes or hours, from a day on the date."""
    seconds = F.floor((now - then) / 1000)
    counted = F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s"))).when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit(" min"))).when(seconds < 86400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(" h")))
    return F.coalesce(counted, F.date_format(F.timestamp_millis(then), "yyyy-MM-dd"))


def synonym_lists(json: Column, shortest: int = 2) -> Column:
    """A JSON object of string lists as map<string, array<string>>: trimmed strings of `shortest` characters or more
    that differ from their key; other values are skipped, and what is no object gives an empty map."""
    outer = F.from_json(json, "map<string,string>")
    lists = F.map_filter(outer, lambda _, v: v.startswith("["))
    # a number in a list comes back as a string of digits without quotes, so only quoted items count
    strings = F.transform_values(lists, lambda k, v: F.filter(F.transform(F.from_json(v, "array<string>"), trimmed), lambda w: w.isNotNull() & (F.length(w) >= shortest) & (w != k)))
    return F.coalesce(F.map_filter(strings, lambda _, v: v.isNotNull() & (F.size(v) > 0)), F.create_map().cast("map<string,array<string>>"))
