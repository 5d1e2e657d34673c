"""Corpus operators on small rows against plain versions: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkloft.llm import ann, bpe, chat, html_extract, line_dedup, packing, pq_dedup, simhash, suffix_dedup, toxicity
from sparkloft.llm.common import connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, host string, line string, fp long, component string"


def table(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "h", "l", 7, "c") for i, s, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    body = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(30)]
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate(body)]
    rows += [(100 + i, "s0", f"common line\n{t}\n  common line\n") for i, t in enumerate(body[:8])]
    rows += [
        (200, None, None), (201, None, ""), (202, "s1", "   \n\t"), (203, "s1", body[0]), (204, "s1", body[0]), (205, "s0", body[1] + " tail"),
        (206, "s0", " ".join(body) * 3), (207, "s1", "x" * 3000), (208, "s1", "y" + "x" * 2000)
    ]
    return rows


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 150: 100, 200: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_line_dedup(spark, odd):
    df = table(spark, odd)
    out = line_dedup.line_dedup(df, 0.2, 3)
    assert out.columns[:-2] == df.columns
    got = {r["doc_id"]: r for r in out.collect()}
    want = brute.lines(odd, 0.2, 3)
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in got.values())
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def test_simhash(spark, odd):
    got = simhash.simhash_groups(table(spark, odd)).collect()
    want = brute.near_duplicates([(i, t) for i, _, t in odd])
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{brute.fingerprint(t):016x}" for i, _, t in odd}
    kept = simhash.keep_first(table(spark, odd))
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())
    repeats = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "q r s"), (9, "a b c d")], "doc_id long, text string")
    rows = sorted(((r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(repeats).collect()), key=repr)
    assert rows == sorted([(5, 5), (5, 5), (None, 5), (None, None), (9, 5)], key=repr)
    assert simhash.simhash_groups(repeats.limit(0)).count() == 0


def test_vantage_shards_find_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    near = base[:600].copy()
    for k in range(len(near)):
        for b in rng.choice(64, rng.integers(1, 5), replace=False):
            near[k] ^= np.uint64(1 << int(b))
    fp = np.unique(np.concatenate([base, near]))
    i, j = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None]) <= simhash.RADIUS)
    label = np.arange(len(fp))
    simhash._merge(label, i, j)
    row, shard, visits = simhash.route(fp, 4, simhash.thresholds(fp[::3]))
    found = np.arange(len(fp))
    for s in np.unique(shard):
        at = np.flatnonzero(shard == s)
        at = at[np.argsort(row[at], kind="stable")]
        part = simhash.search(fp[row[at]], visits[at])
        simhash._merge(found, row[at], row[at[part]])
    assert (found == label).all()


def test_simhash_overfull_shards(spark, monkeypatch):
    """Texts whose fingerprints lie close together: no vantage point parts them, pairs of blocks do."""
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(300)] = f"x{rng.randint(0, 50)}"
        rows.append((i, "s", " ".join(w)))
    want = brute.near_duplicates([(i, t) for i, _, t in rows])
    monkeypatch.setattr(simhash, "SHARD", 12)
    got = simhash.simhash_groups(table(spark, rows)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) < 160


def test_suffix_dedup(spark, odd, monkeypatch):
    rng = random.Random(9)
    rows = [(i, s, t) for i, s, t in odd]
    passage = "The same passage of more than fifty bytes, été et là, stands in several documents."
    rows += [
        (
            300 + i, "s",
            "".join(
                rng.choice("ab ") for _ in range(rng.randint(0, 80))
            ) + passage[rng.randint(0, 20) :] + "".join(rng.choice("ab ") for _ in range(80))
        ) for i in range(25)
    ]
    want = brute.passages([(i, t) for i, _, t in rows])
    texts = {i: (t or "").encode() for i, _, t in rows}
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 4000)  # several shards of documents
    got = {r["doc_id"]: r for r in suffix_dedup.passage_digests(table(spark, rows)).collect()}
    for i, m in want.items():
        kept = np.frombuffer(texts[i], np.uint8)[~m].tobytes()
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        assert (
            got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]
        ) == (len(m), int(m.sum()), runs, hashlib.sha256(kept).hexdigest()), i
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)  # buckets are decided between groups of shards
    again = {r["doc_id"]: r for r in suffix_dedup.passage_digests(table(spark, rows)).collect()}
    assert again == got
    cut = suffix_dedup.cut_repeats(table(spark, rows))
    assert cut.columns == table(spark, rows).columns
    for r in cut.collect():
        i = r["doc_id"]
        whole = dict((a, c) for a, _, c in rows)[i]
        assert r["text"] == (whole if not want[i].any() else np.frombuffer(texts[i], np.uint8)[~want[i]].tobytes().decode("utf-8", "ignore"))
    nulls = spark.createDataFrame([(None, "z" * 60), (None, "z" * 60), (4, "z" * 60), (4, "z" * 60)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_removed"]) for r in suffix_dedup.passage_digests(nulls).collect()) == [(0, 60), (0, 60), (4, 0), (4, 0)]
    assert suffix_dedup.passage_digests(nulls.limit(0)).count() == 0


def test_suffix_dedup_spreads_hot_footers(spark, monkeypatch):
    """A footer between other words in each document: its edges make as many runs as there are documents, and no bucket gets them all."""
    rng = random.Random(5)
    footer = "All rights reserved by the publisher of this page, whoever it may be and wherever they are read today."
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    rows = [(i, noise(120) + footer + noise(120), 0) for i in range(400)]
    want = brute.passages([(i, t) for i, t, _ in rows])
    texts = pa.table({"doc_id": [i for i, _, _ in rows], "text": [t for _, t, _ in rows]})
    for shard_bytes, group, hot in ((4 << 20, 4096, 256), (20_000, 4096, 5), (20_000, 2, 5), (20_000, 2, 1000)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard_bytes)
        monkeypatch.setattr(suffix_dedup, "GROUP", group)
        docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
        got = {r["doc_id"]: r for r in suffix_dedup.passage_digests(docs).collect()}
        for i, t, _ in rows:
            kept = np.frombuffer(t.encode(), np.uint8)[~want[i]].tobytes()
            assert (got[i]["kept_sha256"], got[i]["n_removed"]) == (hashlib.sha256(kept).hexdigest(), int(want[i].sum()))
    first, last, value, row, mark = suffix_dedup.Text(texts).runs()
    _, hot = suffix_dedup._sets_of_runs(value, mark, 256)
    assert 2 <= len(hot) < 12  # the minimisers of the edges; those of the middle have one run
    found = suffix_dedup._candidates(4)(
        texts.append_column("__shard", pa.array([0] * 400, pa.int32())),
        pa.table({"data": [b""], "hot": [suffix_dedup._packed(hot)], "windows": [suffix_dedup._packed(hot[:0])]})
    )
    runs_of_hot = [int((last - first + suffix_dedup.SPAN)[value == x].sum()) for x in hot]
    assert max(runs_of_hot) > 25_000  # went to one bucket
    assert max(len(x) for x in found.column("data").to_pylist()) < 10_000


def test_suffix_arrays_merge_across_shards(monkeypatch):
    rng = random.Random(2)
    texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 70))) for _ in range(60)}) + [b"a" * 90, b"b" + b"a" * 80]
    ids = np.array([rng.randint(0, 30) for _ in texts])
    least: dict[bytes, int] = {}
    for t, i in zip(texts, ids.tolist(), strict=True):
        for k in range(len(t) - 49):
            least[t[k : k + 50]] = min(least.get(t[k : k + 50], i), i)
    want = [[least[t[k : k + 50]] for k in range(len(t) - 49)] for t in texts]
    for size in (200, 1000, 1 << 20):
        monkeypatch.setattr(suffix_dedup, "SUFFIX_BYTES", size)
        assert [w.tolist() for w in suffix_dedup.first_holders(texts, ids)] == want
    t = np.frombuffer(b"banana\x00banana\x00\x00", np.uint8)
    assert suffix_dedup.suffix_array(t).tolist() == sorted(range(len(t)), key=lambda i: t.tobytes()[i:])


def test_packing(spark, odd, monkeypatch):
    df = table(spark, odd).repartition(3)
    got = packing.pack(df, length=64, window=4).collect()
    t = bpe.tokenizer()
    whole = {i: np.append(t.encode(x), np.uint32(0)).astype("<u4") for i, _, x in odd}
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        ids = whole[r["doc_id"]]
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for i, ids in whole.items():
        parts = sorted((r["start"], r["length"]) for r in got if r["doc_id"] == i)
        assert sum(n for _, n in parts) == len(ids) and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0
    full = []
    for s in sorted(by):
        parts = sorted(by[s])
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        full.append(sum(n for _, n in parts))
    assert set(full[:-1]) == {64} and list(sorted(by)) == list(range(len(by)))
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_is_a_round_robin(spark, odd):
    """Every token's place against queues that are served in turn, window by window, with their deficits carried on."""
    rows = [(i, f"s{i % 3}" if i % 4 else None, t) for i, _, t in odd] + [
        (0, None, "repeated row"), (0, None, "repeated row"), (900, "s1", "very long " * 3000)
    ]
    t, length, window = bpe.tokenizer(), 64, 4
    queues: dict[str, list] = {}
    for row, (_, source, text) in enumerate(rows):
        n = len(t.encode(text)) + 1
        queues.setdefault(source or "", []).extend((row, k) for k in range(n))
    total = sum(map(len, queues.values()))
    deficit, at, out = dict.fromkeys(queues, 0.0), dict.fromkeys(queues, 0), []
    while len(out) < total:
        for q in sorted(queues):
            deficit[q] += length * window * len(queues[q]) / total
            n = min(int(deficit[q] + 0.5), len(queues[q]) - at[q])
            deficit[q] -= n
            out += queues[q][at[q] : at[q] + n]
            at[q] += n
    want = [(rows[r][0], k, p // length, p % length) for p, (r, k) in enumerate(out)]
    got = packing.pack(table(spark, rows).coalesce(1), length=length, window=window).collect()
    tokens = [(r["doc_id"], r["start"] + k, r["sequence_id"], r["offset"] + k) for r in got for k in range(r["length"])]
    assert sorted(tokens) == sorted(want)
    with pytest.raises(ValueError, match="sources"):
        many = spark.range(packing.QUEUES + 1).selectExpr("id AS doc_id", "'x' AS text", "concat('s', id) AS source")
        packing.pack(many, target={"s1": 1.0})


def test_packing_many_sources(spark, odd, monkeypatch):
    df = table(spark, [(i, f"s{i % 23}" if i % 5 else None, t) for i, _, t in odd]).repartition(3, "doc_id")
    want = sorted(tuple(r) for r in packing.pack(df, length=64, window=4).collect())
    monkeypatch.setattr(packing, "QUEUES", 4)
    monkeypatch.setattr(packing, "BLOCK", 3)
    assert sorted(tuple(r) for r in packing.pack(df, length=64, window=4).collect()) == want
    assert {r[-1] for r in want} == {"", *(f"s{i}" for i in range(23))} and packing.pack(df.limit(0)).count() == 0


def test_packing_plan():
    p = packing.Plan({"a": 1000, "b": 300, "c": 7, "d": 0}, 64)
    for k in range(p.windows + 1):  # at most half a token off the share
        assert all(abs(v - min(n, k * 64 * n / 1307)) <= 0.5 for (q, v), n in zip(p.served(k).items(), p.totals.values(), strict=True))
    assert p.served(p.windows) == p.totals
    q = packing.Plan({"a": 1000, "b": 300}, 100, {"a": 0.5, "b": 0.5})
    assert q.served(6) == {"a": 300, "b": 300} and q.served(8) == {"a": 500, "b": 300} and q.served(q.windows) == q.totals
    where = sorted((at, n) for name, n0 in q.totals.items() for _, n, at in q.pieces(name, 0, n0)[0])
    assert where[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(where, where[1:], strict=False))


def t_library(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_bpe(spark, odd, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t = bpe.Tokenizer()
    rng = random.Random(4)
    texts = [x for _, _, x in odd] + [
        "<|endoftext|>x<|endoftext|>", "½² \u0085\x1c a", "日本語" * 900, "\U0001f600" * 700, " " * 2000 + "x",
        "".join(rng.choice("thequickbrown") for _ in range(5000)), "don't've"
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.round_trip(df).collect()}
    for i, x in enumerate(texts):
        ids = library.encode(x or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), x
        assert got[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars > 4096").select("text").collect()]
    for x in docs:  # the long documents of a table are trees
        assert t_library(library, x) == t.encode(x).tolist()
    assert len(docs) > 100 and t.trees == len(docs) and t.joins >= len(docs)
    halves = bpe.Tokenizer(long=16)
    for _ in range(1500):
        x = "".join(rng.choice("ab  \n\t .,'sre' \u3000é日\U0001f6421½") for _ in range(rng.randint(0, 200)))
        assert halves.encode(x).tolist() == t_library(library, x), x
    for x in [x for x in texts if x]:
        assert halves.encode(x).tolist() == t_library(library, x)
    twice = spark.createDataFrame(
        [(1, "a b", 1, "x"), (1, "a b", 2, "y"), (None, None, 3, "z")], "doc_id long, text string, ids int, n_tokens string"
    )
    assert sorted(
        tuple(r)[:2] for r in bpe.round_trip(twice).where("doc_id = 1").collect()
    ) == [(1, 2), (1, 2)] and bpe.round_trip(twice).count() == 3
    small = bpe.Tokenizer(leaf=5)  # every word goes through the tree
    for x in texts[-2:] + [x for x in texts if x][:10]:
        for w in x.split():
            assert small.unsplit(w.encode()) == small.piece(w.encode())
    back = bpe.decode_texts(bpe.encode_texts(df))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: x or "" for i, x in enumerate(texts)}
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_embedding_links(spark, monkeypatch):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(150):
        v = rng.normal(size=8)
        rows.append((3 * i, int(i % 2), v.tolist()))
        if i % 3 == 0:
            rows.append((3 * i + 1, int(i % 2), (v + rng.normal(size=8) * rng.choice([0.05, 0.2])).tolist()))
        if i % 10 == 0:
            rows += [(1000 + i, int(i % 2), (2 * v).tolist()), (2000 + i, int(i % 2), v.tolist())]
    rows += [
        (5000, None, [1.0] * 8), (5001, 1, None), (5002, 1, [0.0] * 8), (5003, 1, [float("nan")] * 8), (5004, 1, [None] + [1.0] * 7),
        (5005, 1, [float("inf")] * 8), (5006, 0, [1.0, 2.0])
    ]
    monkeypatch.setattr(pq_dedup, "BLOCK", 16)  # long lists are split
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, rep string, cell int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_dedup.embedding_links(df).collect()}
    assert got == brute.cosine_links(rows)
    monkeypatch.setattr(pq_dedup, "COPY_COST", 0.0)  # as many lists as the sample allows, all of them looked into by many
    monkeypatch.setattr(pq_dedup, "A_LIST", 4)
    monkeypatch.setattr(pq_dedup, "BLOCK", 5)
    again = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pq_dedup.embedding_links(df).collect()}
    assert again == got
    assert pq_dedup.embedding_links(df.limit(0)).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 12)) * rng.uniform(0.5, 2, size=(400, 1))
    x[50:60] = x[40]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [
        (900, None), (920, [0.0] * 12), (940, [float("nan")] * 12), (None, [1.0] * 12), (3, x[3].tolist())
    ]
    df = spark.createDataFrame([(*r, 0, 0.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = ann.nearest_neighbours(df, F.col("vec_id") % 20 == 0)
    by: dict = {}
    for r in got.collect():
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 400, 20))
    hits = 0
    for q, found in by.items():
        found.sort()
        s = x @ x[q]
        want = sorted((-(x[i] * x[q]).sum(), i) for i in range(400) if i != q)[:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and np.allclose([v for _, _, v in found], s[[i for _, i, _ in found]])
        assert [(-v, i) for _, i, v in found] == sorted((-v, i) for _, i, v in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want})
    assert hits >= 0.9 * 20 * len(by)
    assert ann.nearest_neighbours(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_neighbours_ties(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full((300, 1), 1.0), rng.choice([-1.0, 1.0], size=(300, 11)) * 0.001], 1)
    x[:, 1:] -= 0  # different vectors that all have the same product with the query
    rows = [(1000, [1.0] + [0.0] * 11)] + [(i + 1, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest_neighbours(df, F.col("vec_id") == 1000).orderBy("rank").collect()
    codes = ann.buckets(ann.lift(np.array([v for _, v in rows]), float(np.sqrt((x * x).sum(1).max()))))
    assert [r["score"] for r in got] == [1.0] * 20 and (len(np.unique(codes)) > 2 or [r["vec_id"] for r in got] == list(range(1, 21)))
    assert [r["vec_id"] for r in got] == sorted(r["vec_id"] for r in got)


def test_nearest_neighbours_fill_up(spark):
    rng = np.random.default_rng(5)
    tables = [rng.normal(size=(n, 64)) for n in (*range(5, 22), 400)]
    tables[-1][1] *= 30  # pushes all others to one pole
    for x in tables:
        n, longest = len(x), float(np.sqrt((x * x).sum(1).max()))
        code = ann.buckets(ann.lift(x, longest)) - np.arange(ann.TABLES) * ann._SIDE**ann.FUNCTIONS
        held = np.stack([np.bincount(c, minlength=ann._SIDE**ann.FUNCTIONS) for c in code.T])
        q = ann.lift_query(x[:100])
        for i, visits in enumerate(ann.probes(q, max(0.05, ann._distance(ann.lift(x, longest), q, n, 20)), held, 20)):
            seen = np.isin(code + np.arange(ann.TABLES) * ann._SIDE**ann.FUNCTIONS, visits).any(1)
            assert np.delete(seen, i).sum() >= min(20, n - 1)
    for x in (tables[1], tables[-1]):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        counts = ann.nearest_neighbours(df, F.col("vec_id") < 40).groupBy("query_id").count().collect()
        assert {r["query_id"]: r["count"] for r in counts} == dict.fromkeys(range(min(40, len(x))), min(20, len(x) - 1))


def test_chat(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    models = chat.train(turns)  # each conversation is decoded by the model that has not seen it
    truth = turns.select("conv_id", "turn", F.col("role").alias("truth"))
    got = chat.format_turns(turns.withColumn("part", F.lit(1)), models).join(truth, ["conv_id", "turn"])
    n, right, parts = got.agg(F.count("*"), F.count_if(F.col("role") == F.col("truth")), F.max("part")).first()
    assert n == turns.count() and right >= 0.9 * n and parts == 0
    # whole transcripts, markers and all: the lines alone tell the turns
    words = {"system": "System", "user": "User", "assistant": "Assistant"}
    said = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    raw = spark.createDataFrame([(i, "\n".join(f"{words[r]}: {t}" for r, t in x)) for i, x in said.items()], "conv_id long, text string")
    found = {}
    for r in chat.parse_transcripts(raw, models).orderBy("conv_id", "turn").collect():
        found.setdefault(r["conv_id"], []).append(r["rendered"])
    assert found == {i: [chat.render(r, t) for r, t in x] for i, x in said.items()}
    text = "System: be brief\nUser: hi\nhow are you?\nAssistant: fine\n### Human: and now\n**Bot:** bye\n<|im_start|>user\nlast<|im_end|>"
    rows = chat.parse_transcripts(
        spark.createDataFrame([(1, text), (2, None), (3, "")], "conv_id long, text string"), models
    ).orderBy("conv_id", "turn").collect()
    assert [r["role"] for r in rows if r["conv_id"] == 1] == ["system", "user", "assistant", "user", "assistant", "user"]
    assert rows[1]["rendered"] == "<|user|>\nhi\nhow are you?\n<|end|>" and rows[5]["rendered"] == "<|user|>\nlast\n<|end|>"
    assert [(r["conv_id"], r["turn"]) for r in rows[6:]] == [(2, 0), (3, 0)] and rows[6]["rendered"].endswith("|>\n\n<|end|>")
    long = spark.createDataFrame([(1, 0, "word " * 200_000 + "\n" * 1000), (1, 1, "User: " + "x" * 500_000)], "conv_id long, turn long, text string")
    assert [r["role"] for r in chat.format_turns(long, models).orderBy("turn").collect()][1] == "user"


def test_chat_viterbi():
    """The best path of short runs against all paths."""
    import itertools

    model = chat.Model.fit([[(1, chat.features("abc?\nx", True)), (2, chat.features("a" * 300, False))] * 4])
    f = np.array([line for i, t in enumerate(["hi?", "User: a\nBot: b"]) for line in chat.features(t, i == 0)])
    scores = model.scores(f)
    value = lambda p: model.start[p[0]] + sum(
        model.step[a, b] for a, b in zip(p, p[1:], strict=False)
    ) + sum(scores[i, s] for i, s in enumerate(p))
    want = max(itertools.product(range(chat.STATES), repeat=len(f)), key=value)
    assert np.isclose(value(chat.viterbi(model, scores, True)), value(want))
    assert np.isclose(chat.product(model, scores, True)[0].max(), value(want))


def test_chat_borders(spark, monkeypatch):
    """A conversation that many tasks share is decoded as if one task had it."""
    rng = np.random.default_rng(8)
    rows = [
        (1, i, "".join(rng.choice(list("ab ?\n"), rng.integers(1, 400)))) for i in range(200)
    ] + [(2, None, None), (2, 0, "q"), (2, 0, "q"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string").repartition(4)
    model = chat.Model.fit([[(1, chat.features("abc?", True)), (2, chat.features("a" * 300, False))] * 4])
    monkeypatch.setattr(chat, "ROWS_A_TASK", 13)
    got = [r["role"] for r in chat.format_turns(df, [model]).where("conv_id = 1").orderBy("turn", "part").collect()]
    f = [chat.features(t, i == 0) for i, (_, _, t) in enumerate(rows[:200])]
    states = chat.viterbi(model, model.scores(np.array([line for x in f for line in x])), True)
    assert got == [chat.ROLES[s] for s in states if s < 3] and len(got) == 200
    assert chat.format_turns(df, [model]).count() == len(rows) and chat.format_turns(df.limit(0), [model]).count() == 0


PAGE = """<html><body class="has-sidebar"><div class="menu"><a href=x>Home</a> <a href=y>About</a></div>{}<div class="sidebar"><p>Side text, with words, and more, and more text.</p></div>
<div id="comments"><p>Great post, I liked it, really, a lot, of, commas.</p></div><form><p>Subscribe</p></form><footer>&copy; me</footer><script>var a="<p>no</p>"</script></body></html>"""


def test_html(spark):
    body = "<div id=content><h2>Head</h2><p>First paragraph, with commas &amp; more, long enough to be one.<p>Second&nbsp;one <em>ends</em>\n here.<ul><li>item</ul></div>"
    pages = {
        0: PAGE.format(body), 1: None, 2: "", 3: "just text", 4: "<p>a<p>b", 5: "<div>" * 2000 + "deep" + "</div>" * 2000,
        6: PAGE.format("<article><h1>T</h1><p>Short.</p><br>tail</article>"), 7: "<p>" + "long, " * 20000 + "</p>", 8: "<nav>only</nav>"
    }
    df = spark.createDataFrame([(i, f"u{i}", h, "x") for i, h in pages.items()], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert got[0]["text"] == "Head First paragraph, with commas & more, long enough to be one. Second one ends here. item"
    assert [got[i]["text"] for i in (1, 2, 3, 4, 5, 6, 8)] == ["", "", "just text", "a b", "deep", "T Short. tail", ""]
    assert got[7]["text"] == ("long, " * 20000).strip() and all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_of_a_table(spark):
    """All pages of a table against the plain text of their articles."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = pages.select("page_id", "html").collect()

    def plain(page):
        inner = re.search(r"(?s)<article>(.*)</article>", page)[1]
        blocks = re.split(r"</?(?:p|h1|br|ul|li|div)\b[^>]*>", inner)
        return " ".join(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in blocks)))

    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert got == {r["page_id"]: plain(r["html"]) for r in rows}
    twice = pages.limit(3)
    assert html_extract.extract(twice.union(twice)).count() == 6


def test_html_class_words_only_lower():
    text = "The first paragraph of the story has commas, and it is long enough to count as one of them."
    more = "The second paragraph goes on, with more commas, so that the container gets its points."
    for links in ('<a href="/hidden-gems">gems</a>', '<a title="Hidden figures" data-hidden>gems</a>', "<em class=popular>gems</em>"):
        assert html_extract.main_text(
            f"<article><p title='not hidden'>{text}</p><p data-id=hidden>{more} {links}</p></article>"
        ) == f"{text} {more} gems"
    ad = "<div class=ad><p>Buy now.</p></div>"
    for name in ("content has-sidebar", "site no-comments", "layout with-header", "sidebar-layout", "newsletter"):
        page = f"<body><div class='{name}'><article><h1>T</h1><p>{text}</p>{ad}<p>{more}</p></article></div><div class=footer>About us</div></body>"
        assert html_extract.main_text(page) == f"T {text} {more}"
        assert html_extract.main_text(page.replace("article", "div")) == f"T {text} {more}"
    assert html_extract.main_text(
        f"<article><p>{text}</p><div hidden>x</div><div style='display: none'>y</div><div class=share>Share</div></article>"
    ) == text


def test_html_siblings_of_an_article():
    text = "The first paragraph of the story has commas, and it is long enough to count as one of them."
    parts = [" ".join([text] * n) for n in (6, 3)]
    page = "<body><main>" + "".join(
        f"<article>{f'<p>{p}</p>' * n}</article>" for p, n in zip(parts, (4, 2), strict=True)
    ) + "<article><a href=x>Read next</a></article></main></body>"
    assert html_extract.main_text(page) == " ".join([parts[0]] * 4 + [parts[1]] * 2)


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.score_documents(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = [r for r in got if r["predicted"] == r["toxic"]]
    assert len(right) >= 0.95 * len(got) and not any(r["predicted"] and not r["toxic"] for r in got)
    texts = [None, "", "you stupid idiot, you worthless scum", "a calm sentence", "calm " * 50_000 + "idiot"]
    odd = spark.createDataFrame(
        [(i, t, 0.5, 1) for i, t in enumerate(texts)] + [(None, "x", 0.0, 0)], "doc_id long, text string, score double, toxic int"
    )
    rows = {r["doc_id"]: r for r in toxicity.score_documents(odd, model).collect()}
    assert rows[0]["score"] == rows[1]["score"] and rows[None]["held_out"] is None and all(0 <= r["score"] <= 1 for r in rows.values())
    assert rows[2]["predicted"] == 1 and rows[3]["predicted"] == 0
    said = [texts[2][s["start"] : s["end"]] for s in rows[2]["spans"]]
    assert "idiot" in said and set(said) <= set(texts[2].replace(",", "").split())
    wide = "İİİ you stupid idiot, you worthless scum"  # lower-casing makes this text longer
    again = toxicity.score_documents(spark.createDataFrame([(1, wide), (1, wide)], "doc_id long, text string"), model).collect()
    assert len(again) == 2 and again[0] == again[1] and [wide[s["start"] : s["end"]] for s in again[0]["spans"]] == said
    assert [texts[4][s["start"] : s["end"]] for s in rows[4]["spans"]] == ["idiot"]
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["score"] < 0.7}
    assert toxicity.score_documents(odd.limit(0), model).count() == 0
    none = toxicity.train(docs.limit(0), labels)
    assert 0 <= toxicity.score_texts(none, ["x"], {})[0] <= 1


def test_toxicity_scores_are_those_of_single_texts(spark):
    """Scores and spans of a batch against a plain forward-backward over each text by itself."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"), lambda fold: True)
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()] + [None, "", "idiot", "x " * 500 + "you stupid idiot"]
    scores, spans = toxicity.score_texts(model, texts, {}, spans=True)

    def chain(words):
        e = [model.emission(w) for w in words]
        tag = lambda i, t: e[i] * t
        f = [[model.start[t] + tag(0, t) for t in (0, 1)]]
        for i in range(1, len(e)):
            f.append([np.logaddexp(f[-1][0] + model.trans[0, t], f[-1][1] + model.trans[1, t]) + tag(i, t) for t in (0, 1)])
        b = [[0.0, 0.0]]
        for i in range(len(e) - 1, 0, -1):
            b.insert(0, [np.logaddexp(*(model.trans[s, t] + tag(i, t) + b[0][t] for t in (0, 1))) for s in (0, 1)])
        z = np.logaddexp(*f[-1])
        return [float(np.exp(f[i][1] + b[i][1] - z)) for i in range(len(e))]

    for text, score, found in zip(texts, scores, spans, strict=True):
        words = toxicity.words_of(text or "")
        p = [x for k in range(0, len(words), toxicity.CHAIN) for x in chain(words[k : k + toxicity.CHAIN])]
        x = np.array([1.0, np.log1p(sum(p)), max(p, default=0.0), sum(p) / max(1, len(p))])
        assert np.isclose(score, 1 / (1 + np.exp(-np.clip(x @ model.calibration, -30, 30))), atol=1e-6)
        assert [m for _, _, m in found] == pytest.approx([v for v in p if v > 0.5])


def test_crf_marginals():
    """Forward-backward against the sum over all taggings."""
    import itertools

    rng = np.random.default_rng(0)
    trans, start, emit = rng.normal(size=(2, 2)), rng.normal(size=2), rng.normal(size=(1, 5))
    p, z = np.zeros(5), 0.0
    for tags in itertools.product((0, 1), repeat=5):
        w = np.exp(start[tags[0]] + sum(emit[0, i] * t for i, t in enumerate(tags)) + sum(trans[a, b] for a, b in zip(tags, tags[1:], strict=False)))
        z += w
        p += w * np.array(tags)
    assert np.allclose(toxicity.marginals(emit, np.array([5]), trans, start)[0], p / z)
