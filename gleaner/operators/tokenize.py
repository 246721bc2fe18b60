"""Terms of texts. Latin and other scripts are split in the JVM; Hangul texts by an analyzer of choice."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, has_hangul, is_stop_word, plain_terms

#: The parts of speech whose words become terms.
KEPT_POS = ("NNG", "NNP", "VV", "VA", "SL", "SH", "SN")
#: Common particles and endings, taken off a Hangul word where two letters or more remain.
PARTICLES = "으로부터 에서부터 에게서 이라도 으로써 으로서 처럼 까지 부터 에서 에게 한테 으로 라도 보다 마다 조차 밖에 하고 이나 은 는 이 가 을 를 에 의 도 와 과 로 만".split()

_PARTICLES, _STOP = frozenset(PARTICLES), frozenset(STOP_WORDS)
_PARTICLE_LENGTHS = sorted({len(p) for p in PARTICLES}, reverse=True)


class Analyzer(Protocol):
    """Splits a text into (word, part of speech). Built once per Python worker."""

    def analyze(self, text: str) -> list[tuple[str, str]]: ...


def hangul_terms(c: Column) -> Column:
    """The default for Hangul texts: words without their particle; single letters count, stop words don't.

    Particles are cut where words end in the whole text, before it is split: one replacement for a text, not one for a word.
    """
    ending = f"([가-힣]{{2}})(?:{'|'.join(PARTICLES)})(?![\\p{{L}}\\p{{N}}])"
    words = F.transform(F.regexp_extract_all(F.regexp_replace(c, ending, "$1"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.lower)
    return F.coalesce(F.filter(words, lambda w: ~is_stop_word(w)), F.array().cast("array<string>"))


def terms_of(c: Column) -> Column:
    """array<string>: the terms of a text, repetitions kept; a text with any Hangul goes the Hangul way as a whole."""
    empty = F.array().cast("array<string>")
    return F.when(c.isNull() | (c == ""), empty).when(has_hangul(c), hangul_terms(c)).otherwise(plain_terms(c))


def words_of(c: Column) -> Column:
    """The words of a text with a blank between two, as `term_of_word` takes them: lower-cased all at once, which blanks keep apart."""
    return F.coalesce(F.lower(F.array_join(F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")), F.lit(""))


def term_of_word(word: str) -> str | None:
    """What `terms_of` makes of a word of `words_of`, but for single letters, which only texts with Hangul keep: it without its particle, None for a stop word."""
    if "가" <= word[-1] <= "힣":
        for n in _PARTICLE_LENGTHS:  # the longest first, which begins leftmost
            if len(word) >= n + 2 and word[-n:] in _PARTICLES and "가" <= word[-n - 1] <= "힣" and "가" <= word[-n - 2] <= "힣":
                word = word[:-n]
                break
        return None if word in _STOP else word
    return word


def analyzed_terms(df: DataFrame, text: str, make: Callable[[], Analyzer], name: str = "terms") -> DataFrame:
    """`df` with the terms of `text`, where Hangul texts pass through an analyzer and the others stay in the JVM."""
    from pyspark.sql.functions import pandas_udf

    stop = frozenset(STOP_WORDS)

    @pandas_udf("array<string>")
    def by_analyzer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        analyzer = make()

        def one(t: str) -> list[str]:
            kept = (w if any("ㄱ" <= c <= "ㆎ" or "가" <= c <= "힣" for c in w) else w.lower() for w, pos in analyzer.analyze(t) if pos in KEPT_POS)
            return [w for w in kept if w and w not in stop]

        for s in batches:
            yield s.map(one)

    korean = F.coalesce(has_hangul(F.col(text)), F.lit(False))
    return df.where(korean).withColumn(name, by_analyzer(text)).unionAll(df.where(~korean).withColumn(name, terms_of(F.col(text))))


def timed(spark: SparkSession, text: str, runs: int = 50) -> dict[str, float]:
    """Milliseconds that splitting one text into words, and these into terms, takes, as the mean of `runs` copies in one task."""
    copies = spark.range(runs * 20).coalesce(1).select(F.concat(F.lit(text), F.lit(" "), F.col("id").cast("string")).alias("text"))
    steps = {"words": F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), "terms": F.size(terms_of(F.col("text")))}
    took = {}
    for name, n in steps.items():
        for _ in range(2):  # the first run compiles
            began = time.perf_counter()
            copies.select(F.sum(n)).collect()
            took[name] = (time.perf_counter() - began) * 1000 / (runs * 20)
    return took
