"""Ranked search against scores of every document, in memory."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sparkloft.llm import threshold_search as ts

DOCS = "doc_id long, text string, n long, terms string, item string, score string"
ITEMS = "item_id long, text string, rank int"


def terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def brute(docs, items, k=50):
    found = [(d, Counter(terms(t))) for d, t in docs]
    sizes = [sum(c.values()) for _, c in found if c]
    n, length = len(sizes), sum(sizes)
    df = Counter(t for _, c in found for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, mine in asked.items():
        scored = []
        for doc, c in found:
            m = 50 + 50 * sum(c.values()) * n // max(length, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in mine if t in c)
            if score > 0:
                scored.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def frames(spark, docs, items):
    return spark.createDataFrame([(d, t, 1, "x", "y", "z") for d, t in docs], DOCS), spark.createDataFrame([(i, t, 3) for i, t in items], ITEMS)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "... ---"), (4, "Été École été"), (5, "École ÉCOLE x9"), (5, "École ÉCOLE x9"), (None, "École ÉCOLE x9"), (None, "été")]
    docs += [(6, "long " * 60000 + "needle"), (7, "needle\x00in\tA\nhay")] + [(i, "same words here again") for i in range(100, 180)]
    docs += [(i, f"filler{i} more") for i in range(200, 400)]
    items = [(1, "école x9!"), (2, None), (3, "needle LONG"), (4, "absent"), (5, "same again"), (6, "été"), (6, "hay"), (None, "needle needle"), (7, "")]
    assert found(ts.search(*frames(spark, docs, items))) == brute(docs, items)


def test_no_rows(spark):
    docs, items = frames(spark, [(1, "a b")], [(1, "a")])
    for d, i in ((docs.limit(0), items), (docs, items.limit(0))):
        got = ts.search(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def corpus(n, words=300, seed=1):
    rng = np.random.default_rng(seed)
    size = 1 + rng.zipf(1.3, n) % 80
    return [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, s) % words)) for i, s in enumerate(size)]


def test_shards_and_blocks_of_any_size(spark, monkeypatch):
    docs = corpus(1500)
    items = [(i, t) for i, t in corpus(9, seed=2)]
    want = brute(docs, items)
    d, i = frames(spark, docs, items)
    assert found(ts.search(d, i)) == want
    monkeypatch.setattr(ts, "ITEMS", 2)
    monkeypatch.setattr(ts, "FLOOR_ROWS", 10)
    assert found(ts.search(d.repartition(7), i)) == want


def shard(docs, vocabulary, cells=None):
    counts = [Counter(terms(t)) for _, t in docs]
    held = [sorted((vocabulary[t], c) for t, c in x.items() if t in vocabulary) for x in counts]
    n = np.array([sum(c.values()) for c in counts])
    df = Counter(i for x in held for i, _ in x)
    weights = np.array([math.floor(1000 * math.log((2 * len(docs) + 2) / (2 * df[i] + 1))) for i in range(len(vocabulary))], np.int64)
    flat = [p for x in held for p in x]
    ends = np.concatenate([[0], np.cumsum([len(x) for x in held])])
    known = ts.Statistics(len(docs), int(n.sum()), weights)
    return ts.Shard(pa.array([d for d, _ in docs], pa.int64()), n, np.array([i for i, _ in flat]), ends, np.array([c for _, c in flat]), known)


@pytest.mark.parametrize("k", [1, 5, 50])
def test_stops_early_with_whole_results(k):
    docs = corpus(4000, 40)
    vocabulary = {f"w{i}": i for i in range(40)}
    s = shard(docs, vocabulary)
    fewer = False
    for item, text in corpus(12, 40, seed=3):
        want = brute(docs, [(item, text)], k)
        mine = np.array(sorted({vocabulary[t] for t in terms(text)}))
        doc, score, looked = s.best(mine, k, 1)
        assert sorted((item, r, int(d), int(x)) for r, (d, x) in enumerate(zip(doc, score, strict=True), 1)) == sorted(want)
        fewer |= looked < 2000
        floor = want[0][3] if k == 1 else min(w[3] for w in want)
        again = s.best(mine, k, floor)
        assert again[0].tolist() == doc.tolist() and again[2] <= looked
    assert fewer


def test_ties_at_the_threshold_all_come_up():
    """Every document scores the same: the k smallest ids must come back, wherever they are in the lists."""
    docs = [(i, "one two") for i in range(999, -1, -1)] + [(2000 + i, "other") for i in range(1500)]
    s = shard(docs, {"one": 0, "two": 1})
    assert s.best(np.array([0, 1]), 50, 1)[0].tolist() == list(range(999, 949, -1))
    assert [docs[i][0] for i in s.best(np.array([0, 1]), 50, 1)[0]] == list(range(50))


def test_words():
    text = "".join(map(chr, range(0x250))) + "\U0001f600 x"
    assert [w.decode() for w in ts.words(text)] == terms(text)
