"""The manifest against one built in memory."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloft.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, g int, idx string"
UPPER = {c: c + 32 for c in range(65, 91)}


def digest(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text) -> str:
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes: list[str]):
    """Root of the nodes, and for each of them the (before, after) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, i in zip(paths, at, strict=True):
            run = i // 8 * 8
            path.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
        nodes = [digest("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        at = [i // 8 for i in at]
    return nodes[0], paths


def brute(rows) -> list[tuple]:
    langs = {}
    for doc_id, text, lang, source, n_chars in rows:
        own = leaf(doc_id, source, lang, n_chars, text)
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        other = leaf(doc_id, source, lang, n_chars, None if text is None else text.translate(UPPER)) if hit else own
        langs.setdefault(lang, []).append(((doc_id is not None, doc_id or 0, own), doc_id, own, other))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    parts = [(sorted(langs[x]), *tree([row[2] for row in sorted(langs[x])])) for x in order]
    root, tops = tree([subroot for _, subroot, _ in parts])
    out = []
    for (leaves, subroot, paths), top in zip(parts, tops, strict=True):
        for (_, doc_id, own, other), path in zip(leaves, paths, strict=True):
            node = other
            for before, after in path + top:
                node = digest(before + node + after)
            out.append((doc_id, own, subroot, root, digest("".join(b + a for b, a in path + top)), node, node == root))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    got = found(merkle.manifest(docs))
    assert got == brute(rows)
    assert {True, False} == {r[-1] for r in got}


def test_a_deep_tree_and_wide_ids(spark):
    """More than 512 leaves of one language: two rounds; ids over the whole range: all digits."""
    rows = [((i * 0x9E3779B97F4A7C15 + 5) % (1 << 64) - (1 << 63), f"Text {i}", "en", "a", i) for i in range(700)]
    rows += [(i, "no capitals", "de", None, None) for i in range(9)]
    assert found(merkle.manifest(frame(spark, rows))) == brute(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (3, "", None, "é", 0), (3, "X", "en", "s", 1), (3, "X", "en", "s", 1), (3, "A", "en", "s", 1)]
    rows += [(-5, "Long " * 50000, "en", "s", 2), (7, "lone", "zz", "s", 4), (None, "B", "en", None, None), (-(1 << 63), "least", "en", None, 1)]
    rows += [(i, "Q", f"l{i:03d}", "s", 1) for i in range(10)]  # more than eight languages: two levels above the subroots
    got = found(merkle.manifest(frame(spark, rows)))
    assert got == brute(rows)


def test_one_leaf_is_the_root(spark):
    ((doc_id, own, subroot, root, proof, folded, verified),) = found(merkle.manifest(frame(spark, [(4, "plain", "en", "s", 5)])))
    assert own == subroot == root and proof == digest("") and verified


def test_no_documents(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0


def test_ranks_are_exact(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 10007 - 4000).alias("doc_id"), (F.col("id") % 3).cast("string").alias("lang"))
    rows = rows.select("*", F.encode("lang", "utf-8").alias("digest"), F.lit(None).cast("binary").alias("tampered"))
    got = merkle.ranked(rows).select("lang", "doc_id", "g", "idx").collect()
    for lang in "012":
        mine = sorted((r["doc_id"], r["idx"], r["g"]) for r in got if r["lang"] == lang)
        assert [r[1:] for r in mine] == [(i, int(lang)) for i in range(len(mine))]


@pytest.mark.parametrize("n,depth", [(1, 0), (2, 1), (8, 1), (9, 2), (64, 2), (65, 3), (8**13, 13), (8**13 + 1, 14)])
def test_depth(spark, n, depth):
    assert spark.range(1).select(merkle._depth(F.lit(n))).first()[0] == depth
