"""Natural-language analysis: composed form, stop words, stemmers, and telling a text's language.

Stemming is a small function a word, run in Arrow batches; everything else is Column expressions.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloft.functions import stemmers
from sparkloft.functions.text import token_estimate, tokens

# Function words by language. They are dropped before indexing, and tell a language.
STOPWORDS = {
    "en": {
        "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "in", "is", "it", "its",
        "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "were", "which", "will", "with", "you",
    },
    "de": {
        "als", "am", "an", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "des", "die", "ein", "eine", "einer", "er", "es", "für", "im", "in",
        "ist", "mit", "nach", "nicht", "oder", "sich", "sie", "sind", "und", "von", "war", "wie", "wird", "zu", "zum", "zur",
    },
    "fr": {
        "au", "aux", "avec", "ce", "cette", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "ils", "la", "le", "les", "mais", "ne", "nous",
        "ou", "par", "pas", "plus", "pour", "que", "qui", "sa", "se", "ses", "son", "sont", "sur", "un", "une", "vous",
    },
    "es": {
        "al", "como", "con", "de", "del", "el", "ella", "en", "entre", "es", "esta", "este", "ha", "la", "las", "lo", "los", "más", "no", "o", "para",
        "pero", "por", "que", "se", "ser", "sin", "sobre", "son", "su", "sus", "también", "un", "una", "y", "ya",
    },
}


@F.pandas_udf(T.StringType())
def composed(text: pd.Series) -> pd.Series:
    """Text in composed form (NFC), so that one letter with an accent is one character; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


# Fixed values of the English Snowball ("Porter 2") stemmer: its special words and suffix tables.
_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli",
    "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_DONE_AFTER_PLURALS = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate",
    "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive",
    "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less", "ogi": "og", "li": "",
}
_STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
_REGION = re.compile(r"[aeiouy][^aeiouy]")
_SHORT_END = re.compile(r"(?:^[aeiouy][^aeiouy]|[^aeiouy][aeiouy][^aeiouywxY])$")


def _longest(word: str, suffixes: Iterable[str]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(w: str) -> tuple[int, int]:
    """Where the parts begin that most suffixes must lie in: after the first consonant behind a vowel, and the same again."""
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    if first is None:
        m = _REGION.search(w)
        first = m.end() if m else len(w)
    m = _REGION.search(w, first)
    return first, m.end() if m else len(w)


@functools.lru_cache(maxsize=100_000)
def stem_english(word: str) -> str:
    """Stem of a lower-cased word by the published Snowball English algorithm; tokens hold no apostrophes, so its rules for them are left out."""
    if len(word) <= 2 or word in _SPECIAL:
        return _SPECIAL.get(word, word)
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word)  # a consonant y
    r1, r2 = _regions(w)

    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _DONE_AFTER_PLURALS:
        return w.lower()

    ending = _longest(w, ("eed", "eedly", "ed", "edly", "ing", "ingly"))
    if ending in ("eed", "eedly"):
        if len(w) - len(ending) >= r1:
            w = w[: -len(ending)] + "ee"
    elif ending and re.search("[aeiouy]", w[: -len(ending)]):
        w = w[: -len(ending)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif len(w) <= r1 and _SHORT_END.search(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    for table in (_STEP_2, _STEP_3):
        ending = _longest(w, table)
        at = len(w) - len(ending or "")
        if ending and at >= r1:
            allowed = {"ogi": w[at - 1 : at] == "l", "li": w[at - 1 : at] in set("cdeghkmnrt"), "ative": at >= r2}.get(ending, True)
            if allowed:
                w = w[:at] + table[ending]
    ending = _longest(w, _STEP_4)
    at = len(w) - len(ending or "")
    if ending and at >= r2 and (ending != "ion" or w[at - 1 : at] in ("s", "t")):
        w = w[:at]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _SHORT_END.search(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


STEMMERS = {"en": stem_english, "de": stemmers.stem_german, "fr": stemmers.stem_french, "es": stemmers.stem_spanish}


def stems(words: Column, language: str = "en") -> Column:
    """Stems of arrays of words in a language that has a stemmer."""
    stem = STEMMERS[language]

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(words: pd.Series) -> pd.Series:
        return words.map(lambda ws: None if ws is None else [stem(w) for w in ws])

    return run(words)


def analyzed(text: Column, language: str = "en", stem: bool | None = None) -> Column:
    """Index terms of a text: composed, lower-cased words without stop words; stemmed if ``stem``, which unless given holds for English.

    An unknown language counts as English. Code is not analysed: it keeps its plain tokens.
    """
    known = language if language in STOPWORDS else "en"
    words = F.filter(tokens(composed(text)), lambda w: ~w.isin(*sorted(STOPWORDS[known])))
    return stems(words, known) if (known == "en" if stem is None else stem and known in STEMMERS) else words


def language_of(text: Column, allowed: Iterable[str] = tuple(STOPWORDS), default: str = "en", confidence: float = 0.6) -> Column:
    """The allowed language whose function words a text holds most of, if it has that share of all allowed ones' hits; else ``default``."""
    allowed = [x for x in allowed if x in STOPWORDS]
    if not allowed:
        return F.lit(default)
    words = tokens(text)
    hits = [
        F.struct(F.size(F.filter(words, _among(STOPWORDS[x]))).alias("n"), F.lit(-k).alias("k"), F.lit(x).alias("language")) for k,
        x in enumerate(allowed)
    ]
    best = F.array_max(F.array(*hits))
    total = F.aggregate(F.array(*[h["n"] for h in hits]), F.lit(0), lambda a, b: a + b)
    return F.when((total > 0) & (best["n"] >= confidence * total), best["language"]).otherwise(default)


def _among(words: set[str]):
    return lambda w: w.isin(*sorted(words))


def token_count(text: Column, vocabulary: str | None = None) -> Column:
    """Tokens of a text by a tokenizer file, run in Arrow batches; without one, a quarter of its characters, rounded up."""
    if vocabulary is None:
        return F.coalesce(token_estimate(text), F.lit(0)).cast("long")

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        found = _tokenizer(vocabulary).encode_batch(texts.fillna("").tolist(), add_special_tokens=False)
        return pd.Series([len(e.ids) for e in found])

    return count(text)


@functools.cache
def _tokenizer(vocabulary: str):
    import tokenizers

    out = tokenizers.Tokenizer.from_file(vocabulary)
    out.no_truncation()
    out.no_padding()
    return out
