"""Path search from both ends against plain enumeration."""

import random

import pytest

from sparkloft.operators import graph


def frames(spark, pairs):
    names = sorted({x for p in pairs for x in p})
    nodes = spark.createDataFrame([(n, "d") for n in names], "id string, domain string")
    edges = spark.createDataFrame([(f"{a}>{b}", a, b, "x", None) for a, b in pairs], "id string, source_id string, target_id string, label string, valid_until string")
    return nodes, edges


def plain(pairs, src, dst, depth):
    """All shortest paths as (nodes, edges), in order."""
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, []).append((b, f"{a}>{b}"))
            near.setdefault(b, []).append((a, f"{a}>{b}"))
    paths = [([src], [])]
    for _ in range(depth):
        paths = [(ns + [b], es + [e]) for ns, es in paths for b, e in near.get(ns[-1], []) if b not in ns]
        done = [p for p in paths if p[0][-1] == dst]
        if done:
            return sorted(done, key=lambda p: (p[0][::-1], p[1][::-1]))
    return []


@pytest.mark.parametrize("seed,dst,depth", [(1, "n09", 6), (2, "n17", 6), (3, "n25", 3), (4, "n30", 6)])
def test_paths_of_random_graphs(spark, seed, dst, depth):
    rng = random.Random(seed)
    pairs = sorted({(f"n{rng.randrange(32):02d}", f"n{rng.randrange(32):02d}") for _ in range(44)})
    nodes, edges = frames(spark, pairs + [("n00", "n00"), (dst, dst)])
    got = [(r["nodes"], r["edges"]) for r in graph.shortest_paths(nodes, edges, "n00", dst, depth, limit=4).orderBy("path").collect()]
    assert got == plain(pairs, "n00", dst, depth)[:4]


def test_a_hub_on_one_side_is_not_walked_through(spark):
    pairs = [("hub", f"leaf{i:04d}") for i in range(3000)] + [("hub", "a"), ("a", "b"), ("b", "c"), ("c", "d")]
    nodes, edges = frames(spark, pairs)
    steps, sizes = graph._walk(edges, "hub", "d", 6)
    assert len(steps) == 4 and max(sizes) < 10, sizes  # from the hub alone the first frontier would have 3001 nodes
    assert graph.shortest_paths(nodes, edges, "d", "leaf0007").first()["nodes"] == ["d", "c", "b", "a", "hub", "leaf0007"]
    assert graph.shortest_path_length(edges, "leaf0001", "leaf0002", guard=5000) == 2
    assert graph.shortest_path_length(edges, "d", "leaf0002", max_depth=4) is None
    assert graph.shortest_path_length(edges, "leaf0001", "nobody", guard=5000) is None
    assert graph.shortest_path_length(edges, "a", "nobody", guard=0) is None
