"""Plain versions of the corpus operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash


def lines(docs, ratio, least):
    """docs: [(id, source, text)] -> {id: text}."""
    pages, seen = Counter(s or "" for _, s, _ in docs), Counter()
    for _, s, t in docs:
        seen.update((s or "", x) for x in {x.strip(" ") for x in (t or "").split("\n")} if x)
    gone = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return {i: None if t is None else "\n".join(x for x in t.split("\n") if (s or "", x.strip(" ")) not in gone) for i, s, t in docs}


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    """ids: distinct; linked(i, j) of places."""
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if linked(a, b):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_duplicates(docs):
    """docs: [(id, text)] -> {id: component}."""
    fp = [fingerprint(t) for _, t in docs]
    return components([i for i, _ in docs], lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 3)


def passages(docs, span=50):
    """docs: [(id, text)] -> {id: removed byte mask}."""
    first: dict[bytes, int] = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - span + 1):
            w = b[k : k + span]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if first[b[k : k + span]] < i:
                m[k : k + span] = True
        out[i] = m
    return out


def cosine_links(rows, least=0.98):
    """rows: [(id, label, vector)] -> {id: (links, component)}."""
    ok = [x is not None and y is not None and all(v is not None and np.isfinite(v) for v in y) and any(y) for _, x, y in rows]
    vec = [np.array(y, float) if k else None for k, (_, _, y) in zip(ok, rows, strict=True)]

    def linked(a, b):
        return ok[a] and ok[b] and rows[a][1] == rows[b][1] and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] / np.sqrt(
            (vec[a] @ vec[a]) * (vec[b] @ vec[b])
        ) >= least

    n = defaultdict(int)
    for a in range(len(rows)):
        n[rows[a][0]] = sum(linked(a, b) for b in range(len(rows)) if b != a)
    comp = components([r[0] for r in rows], linked)
    return {i: (n[i], comp[i]) for i in comp}
