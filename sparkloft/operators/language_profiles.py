"""Telling languages by letter trigrams: profiles are counted from labelled texts, a text gets the likeliest of the allowed languages."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

GRAMS = 20_000  # trigrams of a profile: the most frequent ones
CONFIDENCE = 0.6
HELD = 200_000  # different trigrams that a task counts before it sends them
_WORD = re.compile(r"[^\W\d_]+")


def grams(text: str | None) -> Counter[str]:
    """Trigrams of the words of a text, each word with a mark before and after it."""
    return _grams(_words(text))


def _words(text: str | None) -> Counter[str]:
    return Counter(_WORD.findall(text.lower())) if text else Counter()


def _grams(words: Counter[str]) -> Counter[str]:
    out: Counter[str] = Counter()
    for w, n in words.items():
        w = f"_{w}_"
        for i in range(len(w) - 2):
            out[w[i : i + 3]] += n
    return out


def counts(docs: DataFrame, text: str = "text", language: str = "lang") -> DataFrame:
    """(language, gram, n, place): trigrams of all labelled texts by language, most frequent first. Rows without a label or text count for nothing."""

    def run(batches):
        held: Counter[tuple[str, str]] = Counter()

        def send():
            keys = list(held)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([held[k] for k in keys], pa.int64())], names=["language", "gram", "n"])
            held.clear()

        for b in batches:
            words: dict[str, Counter[str]] = {}  # a word of a batch is taken apart once for a language
            for lang, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(_words(said))
            for lang, said in words.items():
                for gram, n in _grams(said).items():
                    held[lang, gram] += n
            if len(held) > HELD:
                yield from send()
        yield from send()

    rows = docs.where(F.col(language).isNotNull()).select(language, text).mapInArrow(run, "language string, gram string, n long")
    found = rows.groupBy("language", "gram").agg(F.sum("n").alias("n"))
    order = W.Window.partitionBy("language").orderBy(F.desc("n"), "gram")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= GRAMS)


@dataclass(frozen=True)
class Profiles:
    """Logarithms of trigrams' add-one shares by language; ``rest`` is for those that a language's texts lack."""

    languages: tuple[str, ...]
    shares: dict[str, np.ndarray]
    rest: np.ndarray

    @classmethod
    def of(cls, counted: DataFrame) -> Profiles:
        """From ``counts``: at most GRAMS rows a language come to the driver."""
        rows = counted.select("language", "gram", "n").collect()
        languages = tuple(sorted({r["language"] for r in rows}))
        at = {x: i for i, x in enumerate(languages)}
        table: dict[str, np.ndarray] = {}
        for r in rows:
            table.setdefault(r["gram"], np.zeros(len(languages)))[at[r["language"]]] = r["n"]
        total = sum(table.values(), np.zeros(len(languages))) + len(table)
        return cls(languages, {g: np.log((n + 1) / total) for g, n in table.items()}, np.log(1 / total) if len(languages) else np.zeros(0))

    def posterior(self, text: str | None, allowed: list[int], known: KnownWords | None = None) -> np.ndarray | None:
        """Probabilities of the allowed languages, all equally likely before; None for a text without a known trigram.

        ``known``: what words of earlier texts add up to, so that each is taken apart once.
        """
        words = _words(text)
        if not words:
            return None
        sums = (known or KnownWords(self)).of(words)
        score = np.fromiter(words.values(), float, len(words)) @ sums
        if not score[-1]:
            return None
        p = np.exp(score[allowed] - score[allowed].max())
        return p / p.sum()


class KnownWords:
    """Of words that were seen: the sum of their trigrams' shares by language and, last, the number of known trigrams. At most HELD are kept."""

    def __init__(self, profiles: Profiles):
        self.profiles, self.place = profiles, {}
        self.sums = np.zeros((64, len(profiles.languages) + 1))

    def of(self, words: Counter[str]) -> np.ndarray:
        if len(self.place) > HELD:
            self.place.clear()
        places = [p if (p := self.place.get(w)) is not None else self._add(w) for w in words]
        return self.sums[places]

    def _add(self, word: str) -> int:
        at = self.place[word] = len(self.place)
        if at == len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        row = self.sums[at]
        row[:] = 0
        marked = f"_{word}_"
        for i in range(len(marked) - 2):
            share = self.profiles.shares.get(marked[i : i + 3])
            row[:-1] += self.profiles.rest if share is None else share
            row[-1] += share is not None
        return at


def detected(text: Column, profiles: Profiles, allowed: Iterable[str] | None = None, default: str = "en", confidence: float = CONFIDENCE) -> Column:
    """The likeliest of the allowed languages, ``default`` where its probability is below ``confidence`` or the text says nothing."""
    wanted = [i for i, x in enumerate(profiles.languages) if allowed is None or x in set(allowed)]
    if not wanted:
        return F.lit(default)

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        out, known = [], KnownWords(profiles)
        for t in texts:
            p = profiles.posterior(t, wanted, known)
            out.append(default if p is None or p.max() < confidence else profiles.languages[wanted[int(p.argmax())]])
        return pd.Series(out, dtype=object)

    return run(text)
