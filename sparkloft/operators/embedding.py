"""Embeddings by content: a cache by hash, a provider for what it lacks, checks and recovery."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a provider is: texts to vectors, called with batches.
Provider = Callable[[list[str]], Iterable[Iterable[float]]]


def content_hash(column: str = "text"):
    return F.sha2(F.col(column).cast("binary"), 256)


def embed(texts: DataFrame, cache: DataFrame, provider: Provider, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """(texts with embedding, new cache rows): cached vectors by content hash, the provider for each different text that has none.

    texts: (..., text); cache: (content_hash, embedding). Vectors of another length are not taken from the cache. A null text has no
    embedding. Equal texts are sent once.
    """
    rows = texts.withColumn("content_hash", content_hash())
    good = cache.where(F.size("embedding") == dimensions).dropDuplicates(["content_hash"]).select("content_hash", "embedding")
    wanted = rows.where("text is not null").select("content_hash", "text").dropDuplicates(["content_hash"])
    missing = wanted.join(good.select("content_hash"), "content_hash", "left_anti")

    def run(batches):
        for pdf in batches:
            vectors = [list(map(float, v)) for v in provider(pdf["text"].tolist())] if len(pdf) else []
            if bad := {len(v) for v in vectors} - {dimensions}:
                raise ValueError(f"the provider gave vectors of {bad} components, not {dimensions}")
            yield pd.DataFrame({"content_hash": pdf["content_hash"], "embedding": vectors})

    new = missing.mapInPandas(run, "content_hash string, embedding array<float>")
    known = good.select("content_hash", F.col("embedding").cast("array<float>").alias("embedding")).unionByName(new)
    return rows.join(known, "content_hash", "left"), new


def check_compatible(stored: dict, provider: str, model: str, dimensions: int) -> None:
    """Refuses an index that was made with another model: vectors of two models cannot be compared. No stored facts fit anything."""
    mine = {"provider": provider, "model": model, "dimensions": dimensions}
    differ = {k: (stored[k], v) for k, v in mine.items() if stored.get(k) not in (None, v)}
    if differ:
        told = ", ".join(f"{k} {a!r} is not {b!r}" for k, (a, b) in differ.items())
        raise ValueError(f"the index was made otherwise: {told}; build it anew")


def recoverable(missing: DataFrame, rows: DataFrame, cache: DataFrame, dimensions: int) -> DataFrame:
    """Lost chunks that can be put back without a provider: their stored rows with cached vectors of the right length.

    missing: (chunk_id); rows: (chunk_id, text, ...) that an old store still has, the last of an id counting; cache: (content_hash, embedding).
    """
    wanted = rows.join(
        missing.select("chunk_id").distinct(), "chunk_id", "left_semi"
    ).dropDuplicates(["chunk_id"]).withColumn("content_hash", content_hash())
    good = cache.where(F.size("embedding") == dimensions).dropDuplicates(["content_hash"]).select("content_hash", "embedding")
    return wanted.join(good, "content_hash").drop("content_hash")
