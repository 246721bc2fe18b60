"""Embeddings and synonyms from outside, through small interfaces; offline defaults; batching and retries."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_symbols
from ..operators.index import missing_embeddings, upsert

#: Texts to a request, keys to a synonym request, tries, and the first pause in seconds.
TEXTS_AT_ONCE, KEYS_AT_ONCE, TRIES, FIRST_PAUSE = 100, 25, 3, 0.5


class MissingCredentialError(RuntimeError):
    """A service was to be asked without a credential."""


class EmbedError(RuntimeError):
    """A service refused or answered wrongly; `detail` has at most 200 characters."""

    def __init__(self, status: int, detail: str = ""):
        super().__init__(f"{status}: {detail[:200]}")
        self.status, self.detail = status, detail[:200]


class Embedder(Protocol):
    model: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class SynonymProvider(Protocol):
    def synonyms(self, keys: list[str]) -> dict[str, Any]: ...


def with_retries(call: Callable[[], Any], tries: int = TRIES, pause: float = FIRST_PAUSE, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Repeats a failed call after doubling pauses; an EmbedError only for status 429 and from 500 on."""
    for n in range(tries):
        try:
            return call()
        except Exception as e:  # noqa: BLE001
            fatal = isinstance(e, MissingCredentialError) or (isinstance(e, EmbedError) and e.status != 429 and e.status < 500)
            if fatal or n == tries - 1:
                raise
            sleep(pause * 2**n)


@dataclass(frozen=True)
class HashEmbedder:
    """Offline default: signed feature hashing of character trigrams, unit length. The same everywhere."""

    model: str = "hash-trigram"
    dim: int = 64

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dim, np.float32)
            t = f" {t.lower()} "
            for i in range(len(t) - 2):
                h = int.from_bytes(hashlib.blake2b(t[i : i + 3].encode(), digest_size=8).digest(), "little")
                v[h % self.dim] += 1.0 if h >> 63 else -1.0
            n = float(np.linalg.norm(v))
            out.append((v / n if n else v).tolist())
        return out


def _post(url: str, credential: str, body: dict, timeout: float) -> Any:
    if not credential.strip():
        raise MissingCredentialError(f"no credential for {url}")
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {credential}"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return json.load(r)
    except urllib.error.HTTPError as e:
        raise EmbedError(e.code, e.read().decode(errors="replace")) from e


@dataclass(frozen=True)
class HttpEmbedder:
    """Asks an HTTP service for vectors: sends ``{model, input, dimensions}``, takes ``data`` in the order of ``index``."""

    url: str
    credential: str
    model: str
    dim: int
    timeout: float = 30.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        def call() -> list[list[float]]:
            data = _post(self.url, self.credential, {"model": self.model, "input": texts, "dimensions": self.dim}, self.timeout)["data"]
            if len(data) != len(texts):
                raise EmbedError(200, f"{len(data)} vectors for {len(texts)} texts")
            return [d["embedding"] for d in sorted(data, key=lambda d: d["index"])]

        return with_retries(call)


@dataclass(frozen=True)
class HttpSynonyms:
    """Asks an HTTP chat service for the synonyms of keys: ``{model, messages, ...}`` out, a JSON object of lists in the first choice back.

    An answer that is no such object counts as none; what is in it is sorted out by `sane_synonyms`.
    """

    url: str
    credential: str
    model: str
    task: str = "For each keyword, one to a line, give words and short phrases that mean the same. Answer with a JSON object from keyword to list of strings."
    temperature: float = 0.3
    timeout: float = 60.0

    def synonyms(self, keys: list[str]) -> dict[str, Any]:
        said = [{"role": "system", "content": self.task}, {"role": "user", "content": "\n".join(keys)}]
        body = {"model": self.model, "temperature": self.temperature, "response_format": {"type": "json_object"}, "messages": said}
        answer = _post(self.url, self.credential, body, self.timeout)
        try:
            found = json.loads(answer["choices"][0]["message"]["content"])
        except (KeyError, IndexError, TypeError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}


def _embed(embedder: Embedder, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, at_once):
                part = b.slice(i, at_once)
                vectors = embedder.embed(part.column("text").to_pylist())
                if len(vectors) != part.num_rows:
                    raise EmbedError(200, f"{len(vectors)} vectors for {part.num_rows} texts")
                keys = [c for n, c in zip(part.schema.names, part.columns) if n != "text"]
                names = [n for n in part.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(vectors, pa.list_(pa.float32()))], names=[*names, "vector"])

    return run


def embed(rows: DataFrame, embedder: Embedder, at_once: int = TEXTS_AT_ONCE, requests_at_a_time: int | None = None) -> DataFrame:
    """`rows` (some keys and ``text``) with ``vector`` in place of the text."""
    keys = [f for f in rows.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keys) + ", vector array<float>"
    rows = rows.select(*[f.name for f in keys], "text")
    return (rows.repartition(requests_at_a_time) if requests_at_a_time else rows).mapInArrow(_embed(embedder, at_once), schema)


def embed_missing(chunks: DataFrame, embeddings: DataFrame, embedder: Embedder) -> DataFrame:
    """`embeddings` with vectors of the embedder's model for all chunks that have text and had none; one vector per chunk stays."""
    new = embed(missing_embeddings(chunks, embeddings, embedder.model), embedder)
    new = new.select("chunk_id", F.lit(embedder.model).alias("model"), F.lit(embedder.dim).alias("dim"), "vector")
    return upsert(embeddings, new, ["chunk_id"])


def key_texts(keys: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """``key, text``: what is embedded for a key: itself, its synonyms (``key, synonym``) after it, without emoji; empty ones left out."""
    if synonyms is None:
        rows = keys.select("key", F.col("key").alias("text"))
    else:
        words = synonyms.groupBy("key").agg(F.array_sort(F.collect_list("synonym")).alias("words"))
        rows = keys.join(words, "key", "left").select("key", F.concat_ws(" ", F.col("key"), F.col("words")).alias("text"))
    return rows.select("key", strip_symbols(F.col("text")).alias("text")).where("text <> ''")


def embed_keys(keys: DataFrame, key_embeddings: DataFrame, kind: str, embedder: Embedder, now: int, *, synonyms: DataFrame | None = None, rebuild: bool = False) -> DataFrame:
    """`key_embeddings` with vectors of the keys of a kind: of all with `rebuild`, else of those that have none of the model."""
    texts = key_texts(keys.select("key").where("key <> ''").distinct(), synonyms)
    if not rebuild:
        have = key_embeddings.where((F.col("kind") == kind) & (F.col("model") == embedder.model))
        texts = texts.join(have.select("key"), "key", "left_anti")
    new = embed(texts, embedder).select(F.lit(kind).alias("kind"), "key", F.lit(embedder.model).alias("model"), F.lit(embedder.dim).alias("dim"), "vector", F.lit(now).cast("long").alias("embedded_at"))
    return upsert(key_embeddings, new, ["kind", "key"])


def sane_synonyms(found: dict[str, Any], asked: list[str]) -> dict[str, list[str]]:
    """Of an answer what can be used: for keys asked, trimmed strings of two characters or more that differ from the key."""
    out = {}
    for k in asked:
        words = found.get(k)
        if isinstance(words, list):
            out[k] = [w.strip() for w in words if isinstance(w, str) and len(w.strip()) >= 2 and w.strip() != k]
    return out


def _ask(provider: SynonymProvider, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(0).to_pylist()
            for i in range(0, len(keys), at_once):
                asked = keys[i : i + at_once]
                found = sane_synonyms(with_retries(lambda: provider.synonyms(asked)), asked)
                pairs = [(k, w) for k, words in found.items() for w in dict.fromkeys(words)]
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["key", "synonym"])

    return run


def generate_synonyms(keys: DataFrame, provider: SynonymProvider, existing: DataFrame, at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """``key, synonym``: the existing ones and, for keys that have none, new ones from the provider."""
    new = keys.select("key").distinct().join(existing.select("key"), "key", "left_anti").mapInArrow(_ask(provider, at_once), "key string, synonym string")
    return existing.select("key", "synonym").unionAll(new)
