"""Texts that look the same, brought to one form."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialise, spread

#: Letters drawn like one of another alphabet, and that one: the Latin one, or the Greek one if no Latin letter is.
LOOKALIKES = {
    # Cyrillic, small
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    # Cyrillic, capital
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "\u04c0": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "Ү": "Y",
    # Greek
    "ο": "o", "ϳ": "j", "ϲ": "c", "Ϲ": "C", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϳ": "J",
    # Cyrillic drawn like Greek
    "Г": "Γ", "П": "Π", "Ф": "Φ", "Ѱ": "Ψ", "ѱ": "ψ",
    # Armenian
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    # Latin, phonetic
    "ɡ": "g",
    # Cherokee
    "Ꭰ": "D", "Ꭱ": "R", "Ꭲ": "T", "Ꭺ": "A", "Ꭻ": "J", "Ꭼ": "E", "Ꮃ": "W", "Ꮇ": "M", "Ꮋ": "H", "Ꮐ": "G", "Ꮓ": "Z", "Ꮟ": "b", "Ꮩ": "V", "Ꮪ": "S", "Ꮮ": "L", "Ꮯ": "C", "Ꮲ": "P", "Ꮶ": "K", "Ᏼ": "B",
}
#: Letters that the published table joins with Latin ones though they are drawn otherwise.
APART = frozenset("αγισгᴦꮁⲅѡաᏒᏔᏕᏻցռքգզҽꙇꭵУ")
#: Blocks of Hangul letters; they make up syllables and stay.
JAMO = ((0x1100, 0x1200), (0x3130, 0x3190), (0xA960, 0xA980), (0xAC00, 0xD800))
#: Compatibility forms that show the same signs; raised, lowered, encircled and fraction forms can be told apart.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<square>", "<small>", "<font>", "<vertical>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Compatibility signs whose mapping shows something else than they do.
KEPT = {"\u1680", *"ſϐϑϒϕϖϰϱϴϵ"}
#: Format signs that are drawn, though their category is Cf.
DRAWN = {*map(chr, range(0x0600, 0x0606)), *"\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"}
#: Signs without a drawing whose category is not Cf.
INVISIBLE = {*"\u034f\u115f\u1160\u17b4\u17b5\u3164\uffa0", *map(chr, range(0x180B, 0x1810)), *map(chr, range(0xFE00, 0xFE10)), *map(chr, range(0xE0100, 0xE01F0))}


def published(spark: SparkSession) -> dict[str, str]:
    """Letters of other alphabets that Unicode's published table of confusables gives the prototype of a Latin letter of the same case.

    The table is read from the ICU library that Spark brings along, letter by letter, and
    kept to letters of one case: the table itself makes one of I, l and 1, which readers
    tell apart. Without that library there are none but LOOKALIKES.
    """
    try:
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    except TypeError:
        return {}
    alphabet = lambda c: unicodedata.name(c, "").split(" ")[0]
    kind = lambda c: "Lu" if alphabet(c) == "LISU" else unicodedata.category(c)  # noqa: E731 - Lisu has one case, drawn as capitals
    letters = [c for c in map(chr, range(0x20000)) if kind(c) in ("Lu", "Ll") and not unicodedata.decomposition(c) and not any(a <= ord(c) < b for a, b in JAMO)]
    shown = {}
    for i in range(0, len(letters), 5000):
        shown |= zip(letters[i : i + 5000], checker.getSkeleton("\n".join(letters[i : i + 5000])).split("\n"))
    latin = {(shown[c], kind(c)): c for c in letters if c.isascii()}
    found = {c: latin.get((s, kind(c)), c) for c, s in shown.items()}
    return {c: to for c, to in found.items() if c != to and alphabet(c) != "LATIN" and c not in APART}


def _prototype(c: str, letters: dict[str, str]) -> str | None:
    """What one sign of a decomposed text becomes; None if it stays."""
    if c in INVISIBLE or unicodedata.category(c) == "Cf" and c not in DRAWN:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if c in letters:
        return letters[c]
    if c in KEPT:
        return None
    if unicodedata.category(c) == "Zs":
        return " "
    how, *to = unicodedata.decomposition(c).split() or [""]
    if how not in SAME_LOOK or "ㄱ" <= c <= "ㆎ":  # single jamo don't join into syllables as their letters would
        return None
    shown = "".join(chr(int(x, 16)) for x in to)
    if shown.startswith(" ") and len(shown) > 1:  # spacing accents
        return None
    shown = unicodedata.normalize("NFD", shown)
    return "".join(x if (p := _prototype(x, letters)) is None else p for x in shown)


@cache
def _prototypes(letters: tuple[tuple[str, str], ...]) -> dict[int, str]:
    known = dict(letters)
    return {i: p for i in range(0x110000) if not 0xD800 <= i < 0xE000 and (p := _prototype(chr(i), known)) is not None and p != chr(i)}


def prototypes(spark: SparkSession | None = None) -> dict[int, str]:
    """The look-alike table, for str.translate: made by rule from the character database, the lists above and, with a session, the published table."""
    return _prototypes(tuple(sorted(published(spark).items())) if spark else ())


def skeleton(text: str, table: dict[int, str] | None = None) -> str:
    """Decompose, replace every sign by its prototype, decompose again; composed for storage."""
    if text.isascii():
        return text
    shown = unicodedata.normalize("NFD", text).translate(prototypes() if table is None else table)
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", shown))


def _halves(x: bytes) -> tuple[int, int]:
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def _forms(schema: pa.Schema, whole: bool, table: dict[int, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                form = None if text is None else skeleton(text, table)
                if whole:
                    rows.append((key, form))
                elif form is not None:
                    rows.append((key, *_halves(xxhash.xxh3_128_digest(form.encode())), *_halves(xxhash.xxh3_128_digest(text.encode()))))
            columns = zip(*rows) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


def _run(df: DataFrame, key: str, text: str, fields: list[tuple[str, T.DataType]], whole: bool) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *(T.StructField(n, t) for n, t in fields)])
    return spread(df.select(F.col(key).alias("key"), F.col(text).alias("text"))).mapInArrow(_forms(to_arrow_schema(schema), whole, prototypes(df.sparkSession)), schema)


def visible_forms(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, form``: each text in the one form that all texts of its look share.

    A null text has the form null, an empty one the empty form. Repeated rows
    come out again; an empty table gives no rows; other columns are not read.
    Nothing is shuffled.
    """
    return _run(df, key, text, [("form", T.StringType())], True).withColumnRenamed("key", key)


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>, form_1, form_2, text_1, text_2``: 128-bit digests of each text's form and of the text itself.

    Rows of one look share the form digest; rows of one stored text share both.
    Null texts have no row.
    """
    long = T.LongType()
    return _run(df, key, text, [("form_1", long), ("form_2", long), ("text_1", long), ("text_2", long)], False).withColumnRenamed("key", key)


def look_alike_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``<key>_1, <key>_2``, the first smaller: rows whose texts differ but look the same.

    The texts of a form are paired first, each once; the rows of both are
    joined to these pairs, so the work follows the result: copies of a text
    that has no look-alike, however many, cost one partial sum, and copies
    never meet each other. Null texts have no pair. Repeated rows count once;
    a key is not paired with itself.
    """
    classes = materialise(look_alike_classes(df, key, text).withColumnRenamed(key, "key"), "looks")
    form, words = ["form_1", "form_2"], ["text_1", "text_2"]
    texts = classes.select(*form, *words).distinct()
    several = texts.groupBy(*form).count().where("count > 1").select(*form)
    texts = materialise(texts.join(several, form, "left_semi"), "texts")
    a, b = texts.alias("a"), texts.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in form]
    after = (F.col("a.text_1") < F.col("b.text_1")) | ((F.col("a.text_1") == F.col("b.text_1")) & (F.col("a.text_2") < F.col("b.text_2")))
    pairs = a.join(b, [*same, after]).select(*(F.col(f"{t}.{c}").alias(f"{t}_{c}") for t in "ab" for c in words))
    rows = materialise(classes.join(texts.select(*words), words, "left_semi").select("key", *words).distinct(), "rows")
    for t in "ab":
        side = rows.select(F.col("key").alias(f"{t}_key"), *(F.col(c).alias(f"{t}_{c}") for c in words))
        pairs = pairs.join(side, [f"{t}_{c}" for c in words])
    pairs = pairs.where("a_key <> b_key").select(F.least("a_key", "b_key").alias(f"{key}_1"), F.greatest("a_key", "b_key").alias(f"{key}_2"))
    return pairs.distinct()
