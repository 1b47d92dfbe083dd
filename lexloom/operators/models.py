"""Models behind protocols: embedding of texts and generation of answers, run in batches on the executors with retries.

The fakes at the end are deterministic stand-ins for tests and offline runs; they are not models.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> list[list[float] | None]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str | None]: ...


def retried(call: Callable, tries: int = 3, wait: float = 2.0) -> Callable:
    """``call`` again after an OSError, with a doubling wait; the last error is raised."""

    def run(*args):
        for n in range(tries):
            try:
                return call(*args)
            except OSError:
                if n == tries - 1:
                    raise
                time.sleep(wait * 2**n)

    return run


def _batches(lengths: list[int], items: int, tokens: int) -> Iterator[tuple[int, int]]:
    start, n = 0, 0
    for at, length in enumerate(lengths):
        t = length // 4 + 1
        if at > start and (n + t > tokens or at - start >= items):
            yield start, at
            start, n = at, 0
        n += t
    if lengths:
        yield start, len(lengths)


def embedded(df: DataFrame, embedder: Embedder, text: str = "text", out: str = "embedding", longest: int = 7168, items: int = 32, tokens: int = 1024, wait: float = 2.0) -> DataFrame:
    """``df`` with vectors, null where the model gave none; texts are cut to ``longest`` characters and sent in batches by tokens."""
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out] + [f"`{out}` array<float>"])
    df = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = retried(embedder.embed, wait=wait)
        for batch in batches:
            texts = [(t or "")[:longest] for t in batch.column(text).to_pylist()]
            vectors = []
            for a, b in _batches([len(t) for t in texts], items, tokens):
                vectors += call(texts[a:b])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], [*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def without_failed(df: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    from lexloom.functions.vectors import valid_vector

    return df.where(valid_vector(F.col(vector), dim))


def generated(df: DataFrame, generator: Generator, prompt: str = "prompt", out: str = "response", wait: float = 2.0) -> DataFrame:
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out] + [f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = retried(generator.generate, wait=wait)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(call(batch.column(prompt).to_pylist()), pa.string())], [*batch.schema.names, out])

    return df.drop(out).mapInArrow(run, schema)


class HashEmbedder:
    """A fake: words hashed to signs, summed and normed."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for t in texts:
            v = np.zeros(self.dim)
            for w in t.lower().split():
                h = int.from_bytes(hashlib.md5(w.encode()).digest()[:8], "little")
                v[h % self.dim] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n).astype(np.float32).tolist() if n else None)
        return out


class TemplateGenerator:
    """A fake: a question and an answer from the prompt's last line."""

    def generate(self, prompts: list[str | None]) -> list[str | None]:
        import json

        lines = [(p or "").strip().split("\n")[-1] for p in prompts]
        return [json.dumps([{"question": f"What is said about {x[:40]}?", "answer": x[:300]}]) for x in lines]
