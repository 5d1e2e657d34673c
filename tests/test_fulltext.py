"""Phrases, alternatives and exclusions against a plain evaluation."""

import random
import re

import pytest

from sparkloft.operators import fulltext
from sparkloft.operators.fulltext import FulltextIndex, clauses

FIELDS = {"title": 1.0, "text": 0.4}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(f"c{i:03d}", " ".join(rng.choices("abcd", k=rng.randrange(4))), " ".join(rng.choices("abcdefgh", k=rng.randrange(14)))) for i in range(300)]
    return [*out, ("null", None, None), ("only", "", None)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    df = spark.createDataFrame(rows, "chunk_id string, title string, text string")
    return FulltextIndex(spark, str(tmp_path_factory.mktemp("f") / "i"), FIELDS).build(df)


def plain(rows, groups, k):
    """groups: lists of (words, excluded)."""
    wanted = {w for g in groups for ws, excluded in g if not excluded for w in ws}
    out = []
    for chunk, *texts in rows:
        words = [re.findall(r"\w+", (t or "").lower()) for t in texts]
        has = lambda ws: any(f[i : i + len(ws)] == list(ws) for f in words for i in range(len(f)))  # noqa: B023, E731
        if any(all(has(ws) != excluded for ws, excluded in g) for g in groups):
            out.append((-sum(w * f.count(x) / (f.count(x) + 1) for w, f in zip(FIELDS.values(), words, strict=True) for x in wanted), chunk))
    out = sorted(out)[:k]
    most = -out[0][0] if out else 0
    return [(c, round(-s / most if most else -s, 9)) for s, c in out]


@pytest.mark.parametrize("query,groups", [
    ("a b", [[("a", False), ("b", False)]]),
    ('"a b"', [[("ab", False)]]),
    ('"a b c" -d', [[("abc", False), ("d", True)]]),
    ('a -"b a" OR "h h"', [[("a", False), ("ba", True)], [("hh", False)]]),
    ("-a", [[("a", True)]]),
    ('-"a b" or or g-h "', [[("ab", True)], [("gh", False)]]),
    ('"a a a"', [[("aaa", False)]]),
    ("A or zzz", [[("a", False)], [("zzz", False)]]),
])
def test_search(rows, index, query, groups):
    groups = [[(tuple(ws) if ws != "zzz" else (ws,), x) for ws, x in g] for g in groups]
    got = [(r["chunk_id"], round(r["score"], 9)) for r in index.search(query, 25).orderBy(fulltext.F.desc("score"), "chunk_id").collect()]
    assert got == plain(rows, groups, 25)


def test_no_words(index):
    for query in ("", "   ", '""', "or", "... -!"):
        assert index.search(query, 5).count() == 0


def test_clauses():
    assert clauses('one "two three" -four OR -"five six') == [[("one", False), ("two three", False), ("four", True)], [("five six", True)]]
