"""Embeddings: a protocol, a deterministic provider, and a cache."""

from __future__ import annotations

import hashlib
import json
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retrospark.functions.text import text_hash
from retrospark.storage import materialize


class Provider(Protocol):
    model: str
    dimensions: int

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        """One row for each text. kind: query or document."""


class HashingProvider:
    """Words hashed to signed components, with unit length; texts that share words are near."""

    def __init__(self, dimensions: int = 64, model: str = "hashing"):
        self.dimensions, self.model = dimensions, model

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimensions] += 1 if h >> 63 else -1
            out[i] /= np.linalg.norm(out[i]) or 1
        return out


class FunctionProvider:
    """An adapter for any service: a function from texts and kind to vectors."""

    def __init__(self, function, dimensions: int, model: str, instruction: str = ""):
        self.function, self.dimensions, self.model, self.instruction = function, dimensions, model, instruction

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        asked = [f"{self.instruction}{t}" if kind == "query" and self.instruction else t for t in texts]
        out = np.asarray(self.function(asked), np.float32)
        if out.shape != (len(texts), self.dimensions):
            raise ValueError(f"vectors of {out.shape[1:]} components; {self.dimensions} are set")
        return out


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"} | headers)
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.loads(answer.read())


class LocalServerProvider:
    """A server of one's own that takes {model, input: texts} at /api/embed and answers {embeddings}.

    Queries go with an instruction, documents as they are; longer vectors are cut to the dimensions asked for.
    """

    def __init__(self, dimensions: int, model: str, base_url: str = "http://localhost:11434", instruction: str = "", timeout: float = 60.0):
        self.dimensions, self.model, self.base_url, self.instruction, self.timeout = dimensions, model, base_url.rstrip("/"), instruction, timeout

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        asked = [f"Instruct: {self.instruction}\nQuery: {t}" if kind == "query" and self.instruction else t for t in texts]
        rows = _post(f"{self.base_url}/api/embed", {"model": self.model, "input": asked}, {}, self.timeout)["embeddings"] if asked else []
        return _vectors([r[: self.dimensions] for r in rows], len(texts), self.dimensions)


class PaidApiProvider:
    """A service that takes {model, input: texts} at /embeddings with a key and answers {data: [{embedding}]}."""

    def __init__(self, key: str, model: str, base_url: str, dimensions: int = 1536, timeout: float = 60.0):
        if not key:
            raise ValueError("the service asks for a key")
        self.key, self.model, self.base_url, self.dimensions, self.timeout = key, model, base_url.rstrip("/"), dimensions, timeout

    def embed(self, texts: list[str], kind: str) -> np.ndarray:
        data = _post(f"{self.base_url}/embeddings", {"model": self.model, "input": texts}, {"Authorization": f"Bearer {self.key}"}, self.timeout)["data"] if texts else []
        return _vectors([r["embedding"] for r in data], len(texts), self.dimensions)


def _vectors(rows: list, n: int, dimensions: int) -> np.ndarray:
    out = np.asarray(rows, np.float32).reshape(len(rows), -1) if rows else np.zeros((0, dimensions), np.float32)
    if out.shape != (n, dimensions):
        raise ValueError(f"{out.shape[0]} vectors of {out.shape[1]} components; {n} of {dimensions} are asked for")
    return out


def provider(name: str = "hashing", dimensions: int | None = None, **settings) -> Provider | None:
    """A provider by name (hashing, local, api); None (keyword search only) if there is none or its trial fails.

    The local server is tried with one text; the paid service isn't asked before it is needed.
    """
    try:
        if name == "api":
            return PaidApiProvider(**settings, **({"dimensions": dimensions} if dimensions else {}))
        dimensions = dimensions or 64
        found = HashingProvider(dimensions) if name == "hashing" else LocalServerProvider(dimensions, **settings) if name == "local" else None
        return found if found is not None and found.embed(["test"], "document").shape == (1, dimensions) else None
    except Exception:
        return None


def embed(df: DataFrame, provider: Provider, text_col: str, kind: str = "document", out_col: str = "embedding") -> DataFrame:
    """df with vectors, in Arrow batches."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(list(provider.embed(["" if t is None else t for t in b], kind)))

    return df.withColumn(out_col, F.pandas_udf(run, "array<float>")(F.col(text_col)))


def embed_with_cache(chunks: DataFrame, cache: DataFrame | None, provider: Provider, text_col: str = "content") -> tuple[DataFrame, DataFrame]:
    """(chunk_id, embedding) and the rows new to the cache: only texts that it lacks are embedded, each once."""
    keyed = chunks.select("chunk_id", F.col(text_col).alias("t"), text_hash(F.concat(F.lit("document:"), F.col(text_col)), provider.model, provider.dimensions).alias("text_hash"))
    texts = keyed.groupBy("text_hash").agg(F.first("t").alias("t"))
    missing = texts if cache is None else texts.join(cache.select("text_hash"), "text_hash", "left_anti")
    fresh = embed(missing, provider, "t").select("text_hash", "embedding", F.lit(provider.model).alias("model"), F.current_timestamp().alias("created_at"))
    fresh = materialize(fresh, "embeddings")  # a provider is asked once for each text
    known = fresh if cache is None else cache.unionByName(fresh)
    return keyed.join(known.select("text_hash", "embedding"), "text_hash").select("chunk_id", "embedding"), fresh
