"""Temporal knowledge graph: nodes (id, name, label, domain, sensitivity), edges (id, source_id, target_id, label, valid_from, valid_until)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from sparkloft.functions.text import prefix_swap
from sparkloft.operators.ordered import KEYED_OF_A_TASK, newest, spread
from sparkloft.storage import checkpointed, written

# Fixed vocabulary: the predicates along which a change has an impact.
IMPACT_PREDICATES = ("calls", "imports", "references", "depends_on", "handled_by", "extends", "implements", "decorated_by", "defined_in")
# Words of over three letters that a question is put together with; they name nothing.
FUNCTION_WORDS = frozenset(
    {"whose", "which", "what", "when", "where", "does", "have", "will", "would", "could", "should", "this", "that", "these", "those"}
    | {"them", "they", "then", "than", "there", "with", "from", "into", "onto", "over", "about", "between", "some", "your"}
)
MAX_NODES = 25
FEW_NODES = 10_000  # nodes whose ids are broadcast to the edges; beyond that, edges are shuffled


def valid(as_of: str | None = None, include_invalid: bool = False) -> Column:
    """Open edges, or those of the half-open interval that holds ``as_of``; times compare as text."""
    if include_invalid:
        return F.lit(True)
    if as_of is None:
        return F.col("valid_until").isNull()
    return (F.col("valid_from") <= as_of) & (F.col("valid_until").isNull() | (F.col("valid_until") > as_of))


def visible(nodes: DataFrame, include_sensitive: bool = False) -> DataFrame:
    return nodes if include_sensitive else nodes.where(F.coalesce("sensitivity", F.lit("normal")) == "normal")


def endpoints(edges: DataFrame) -> DataFrame:
    """(node, edge): each edge once for each of its different ends."""
    ends = F.array_distinct(F.array("source_id", "target_id"))
    return edges.select(F.col("id").alias("edge"), F.explode(ends).alias("node"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree): open edges at a node, a loop counted once."""
    return endpoints(edges.where(valid())).groupBy("node").agg(F.count("*").alias("degree"))


def touching(edges: DataFrame, ids: DataFrame, few: bool = False) -> DataFrame:
    """Edges with an end among ``ids`` (id), each once: two equi-joins, the second without what the first has found.

    ``few``: the ids are known to be few; they are broadcast, so that edges are dropped where they are read and not shuffled.
    """
    ends = ids.select(F.col("id").alias("__end")).distinct()
    ends = F.broadcast(ends) if few else ends
    from_them = edges.join(ends, edges["source_id"] == ends["__end"], "left_semi")
    to_them = edges.join(ends, edges["target_id"] == ends["__end"], "left_semi").join(ends, edges["source_id"] == ends["__end"], "left_anti")
    return from_them.unionByName(to_them)


def named_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with subject, subject_type, object and object_type; those with an end that is not among the nodes go."""
    s = nodes.select(F.col("id").alias("source_id"), F.col("name").alias("subject"), F.col("label").alias("subject_type"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("name").alias("object"), F.col("label").alias("object_type"))
    return edges.withColumnRenamed("label", "predicate").join(s, "source_id").join(t, "target_id")


def triplets(
    nodes: DataFrame, edges: DataFrame, names=None, labels=None, as_of: str | None = None, include_invalid: bool = False, include_sensitive: bool = False
) -> DataFrame:
    """(subject, predicate, object, valid_from, valid_until, source_id, target_id) of edges whose ends are both there and visible.

    ``names``: a list, or a DataFrame (name); edges with an end of such a name. They are found before the nodes are joined.
    """
    e = edges.where(valid(as_of, include_invalid))
    if labels:
        e = e.where(F.col("label").isin(*labels))
    n = visible(nodes, include_sensitive)
    if isinstance(names, DataFrame):
        e = touching(e, n.join(names.select("name").distinct(), "name", "left_semi").select("id"))
    elif names is not None:
        e = touching(e, n.where(F.col("name").isin(*names)).select("id"))
    columns = ("subject", "subject_type", "predicate", "object", "object_type", "valid_from", "valid_until", "source_id", "target_id")
    return named_ends(e, n).select(*columns)


def search_nodes(nodes: DataFrame, edges: DataFrame, text: str, limit: int = 25, domains=(), include_sensitive: bool = False) -> DataFrame:
    """(id, name, label, degree): nodes whose name holds the text, case ignored, by degree then name."""
    n = visible(nodes, include_sensitive).where(F.contains(F.lower("name"), F.lit(text.lower())))
    if domains:
        n = n.where(F.col("domain").isin(*domains))
    out = n.join(degrees(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return out.select("id", "name", "label", "degree").orderBy(F.desc("degree"), "name", "id").limit(limit)


def top_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 50, domains=()) -> DataFrame:
    n = nodes.where(F.col("domain").isin(*domains)) if domains else nodes
    out = degrees(edges).withColumnRenamed("node", "id").join(n, "id")
    return out.select("id", "name", "label", "degree").orderBy(F.desc("degree"), "name", "id").limit(limit)


def _at(edges: DataFrame, ids) -> DataFrame:
    """Open edges at listed nodes. Each end has a filter of its own, which, unlike an OR of both, holds below a join that makes the edges."""
    e, leaves, arrives = edges.where(valid()), F.col("source_id").isin(*ids), F.col("target_id").isin(*ids)
    return e.where(leaves).unionByName(e.where(arrives & ~F.coalesce(leaves, F.lit(False))))


def neighbors(nodes: DataFrame, edges: DataFrame, ids, limit: int = 200) -> DataFrame:
    """Open edges at the given nodes, by id."""
    e = _at(edges, ids)
    return e.select("id", "source_id", "label", "target_id").orderBy("id").limit(limit)


def neighborhood(nodes: DataFrame, edges: DataFrame, ids, limit: int = 200, domains=()) -> tuple[DataFrame, DataFrame]:
    """The given nodes' open edges, ``limit`` at most, and the nodes at them (id, name, label, degree).

    With ``domains`` both ends of an edge must lie in one of them; a degree counts all open edges. The edges found and
    their nodes are checkpointed, as all else starts from them.
    """
    e = _at(edges, ids)
    if domains:
        inside = nodes.where(F.col("domain").isin(*domains)).select("id")
        for end in ("source_id", "target_id"):
            e = e.join(inside.withColumnRenamed("id", end), end, "left_semi")
    e = checkpointed(e.select("id", "source_id", "label", "target_id").orderBy("id").limit(limit))
    near = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()  # twice the limit at most
    return e, with_degrees(checkpointed(nodes.join(F.broadcast(near), "id", "left_semi")), edges, few=True)


def with_degrees(nodes: DataFrame, edges: DataFrame, few: bool = False) -> DataFrame:
    """(id, name, label, degree) of some nodes; only edges at them are counted. ``few``: the nodes are known to be few."""
    found = degrees(touching(edges.where(valid()), nodes.select("id"), few)).withColumnRenamed("node", "id")
    if few:  # not the degrees of nodes at the other ends
        found = F.broadcast(found.join(F.broadcast(nodes.select("id")), "id", "left_semi"))
    return nodes.join(found, "id", "left").select("id", "name", "label", F.coalesce("degree", F.lit(0)).alias("degree"))


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)


def nodes_by_name(nodes: DataFrame, name: str, domains=(), limit: int = 25) -> DataFrame:
    """Nodes of just that name, by id."""
    found = nodes.where(F.col("name") == name)
    return (found.where(F.col("domain").isin(*domains)) if domains else found).orderBy("id").limit(limit)


def nodes_by_label(nodes: DataFrame, label: str, contains: str | None = None, limit: int = 100) -> DataFrame:
    """Nodes of a label whose name holds a text, case ignored, by name."""
    found = nodes.where(F.col("label") == label)
    if contains:
        found = found.where(F.contains(F.lower("name"), F.lit(contains.lower())))
    return found.orderBy("name", "id").limit(limit)


def decision_nodes(nodes: DataFrame, text: str) -> DataFrame:
    """Decisions of just that text, white space at the ends and case ignored."""
    return nodes.where((F.col("label") == "Decision") & (F.lower(F.trim("name")) == text.strip().lower()))


def timeline(nodes: DataFrame, edges: DataFrame, name: str, include_sensitive: bool = False) -> DataFrame:
    """(subject, predicate, object, valid_from, valid_until, valid): all edges of the nodes of that name, oldest first."""
    n = visible(nodes, include_sensitive)
    out = named_ends(touching(edges, n.where(F.col("name") == name).select("id")), n)
    columns = ("subject", "predicate", "object", "valid_from", "valid_until", F.col("valid_until").isNull().alias("valid"))
    return out.select(*columns).orderBy("valid_from", "subject", "predicate", "object")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no open edge touches."""
    used = edges.where(valid()).select(F.col("source_id").alias("id")).union(edges.where(valid()).select("target_id")).distinct()
    return nodes.join(used, "id", "left_anti")


def co_changed(edges: DataFrame, file_id: str, min_shared: int = 2, limit: int = 20, label: str = "modifies") -> DataFrame:
    """(file, shared): other files that the same commits changed."""
    e = edges.where((F.col("label") == label) & valid()).select("source_id", "target_id")
    commits = e.where(F.col("target_id") == file_id).select("source_id").distinct()
    other = e.join(commits, "source_id", "left_semi").where(F.col("target_id") != file_id)
    out = other.groupBy(F.col("target_id").alias("file")).agg(F.countDistinct("source_id").alias("shared")).where(F.col("shared") >= min_shared)
    return out.orderBy(F.desc("shared"), "file").limit(limit)


def impact(edges: DataFrame, node_id: str, max_depth: int = 3, predicates=IMPACT_PREDICATES, limit: int = 200) -> DataFrame:
    """(id, depth, via): what depends on a node, at the depth it is first reached; via is the least predicate of that step.

    One join for each level; the levels are few and the frontier alone is joined. Each is checkpointed, so that none repeats the ones before.
    """
    e = edges.where(valid() & F.col("label").isin(*predicates)).select("source_id", "target_id", "label")
    seen = edges.sparkSession.createDataFrame([(node_id, 0, None)], "id string, depth int, via string")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = e.join(
            frontier.select(F.col("id").alias("target_id")), "target_id"
        ).groupBy(F.col("source_id").alias("id")).agg(F.min("label").alias("via"))
        frontier = checkpointed(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth"), "via"))
        seen = seen.unionByName(frontier)
    return seen.where("depth > 0").orderBy("depth", "id").limit(limit)


def _both_ways(edges: DataFrame) -> DataFrame:
    """(a, b, edge): open edges, walked either way. They are written once, as every level reads them."""
    e = written(edges.where(valid()).select("id", "source_id", "target_id"), "open-edges")
    there = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("id").alias("edge"))
    return there.unionByName(e.select(F.col("target_id").alias("a"), F.col("source_id").alias("b"), F.col("id").alias("edge"))).where("a <> b")


def _walk(edges: DataFrame, src: str, dst: str, max_depth: int, guard: int | None = None) -> tuple[list[DataFrame] | None, list[int]]:
    """(by level from ``src``, the steps (a, b, edge) of shortest paths; sizes of the frontiers). No steps if ``dst`` is not within reach.

    Both ends grow, whichever frontier has fewer edges to follow, until one comes upon a node of the other's: a hub on one side is not walked through
    where the other side gets there first. A level is one join of a frontier with the edges, and is checkpointed, so that the next one
    neither repeats nor depends on it. The search gives up when it has visited more than ``guard`` nodes.
    """
    both = _both_ways(edges)
    sides = []
    for end in (src, dst):
        start = edges.sparkSession.createDataFrame([(end,)], "id string")
        sides.append({"frontier": start, "seen": start, "steps": [], "ways": None})
    sizes: list[int] = []
    for _ in range(max_depth):
        if guard is not None and sum(sizes) > guard:
            return None, sizes
        for side in sides:
            if side["ways"] is None:  # edges to follow: a hub is one node
                side["ways"] = both.join(side["frontier"].select(F.col("id").alias("a")), "a", "left_semi").count()
        near, far = sorted(sides, key=lambda x: x["ways"])
        step = both.join(near["frontier"].select(F.col("id").alias("a")), "a").join(near["seen"].select(F.col("id").alias("b")), "b", "left_anti")
        near["steps"].append(checkpointed(step.select("a", "b", "edge")))
        near["frontier"] = near["steps"][-1].select(F.col("b").alias("id")).distinct()
        near["ways"] = None
        sizes.append(near["frontier"].count())
        if not sizes[-1]:
            return None, sizes
        near["seen"] = near["seen"].unionByName(near["frontier"])
        met = near["frontier"].join(far["frontier"], "id", "left_semi")
        if not met.isEmpty():
            break
    else:
        return None, sizes
    steps = list(sides[0]["steps"])
    for step in reversed(sides[1]["steps"]):  # of the far side only what leads from where they met to the target
        used = step.join(met.select(F.col("id").alias("b")), "b", "left_semi")
        steps.append(checkpointed(used.select(F.col("b").alias("a"), F.col("a").alias("b"), "edge")))
        met = steps[-1].select(F.col("b").alias("id")).distinct()
    return steps, sizes


def shortest_path_length(edges: DataFrame, src: str, dst: str, max_depth: int = 6, guard: int | None = None) -> int | None:
    """Hops between two nodes over open edges, either way; stops where the two ends meet."""
    if src == dst:
        return 0
    steps, _ = _walk(edges, src, dst, max_depth, guard)
    return None if steps is None else len(steps)


def shortest_paths(
    nodes: DataFrame, edges: DataFrame, src: str, dst: str, max_depth: int = 6, limit: int = 5, domains=(), guard: int | None = None
) -> DataFrame:
    """(path, nodes, edges, length): up to ``limit`` shortest paths between two nodes over open edges, either way.

    nodes and edges list ids from ``src`` on. Parallel edges make paths of their own. Which paths stay, and their numbers, go by the
    ids of nodes and edges, read from the target back. With ``domains`` both ends of an edge must lie in one of them. No path, or an
    end that is no node, or more than ``guard`` nodes on the way: no rows.
    """
    spark = edges.sparkSession
    none = "path int, nodes array<string>, edges array<string>, length int"
    ends = nodes.where(F.col("id").isin(src, dst)).select("id").distinct().count()
    if ends < len({src, dst}):
        return spark.createDataFrame([], none)
    if src == dst:
        return spark.createDataFrame([(1, [src], [], 0)], none)
    if domains:
        inside = nodes.where(F.col("domain").isin(*domains)).select("id")
        for end in ("source_id", "target_id"):
            edges = edges.join(inside.withColumnRenamed("id", end), end, "left_semi")
    steps, _ = _walk(edges, src, dst, max_depth, guard)
    if steps is None:
        return spark.createDataFrame([], none)
    back = spark.createDataFrame([(dst, [dst], [])], "at string, back array<string>, over array<string>")
    for step in reversed(steps):  # every node that is come by leads back to the source, so a cut to ``limit`` loses none of the first ones
        back = back.join(step, back["at"] == step["b"]).select(
            F.col("a").alias("at"), F.concat("back", F.array("a")).alias("back"), F.concat("over", F.array("edge")).alias("over")
        )
        back = back.orderBy("back", "over").limit(max(1, limit))
    place = F.row_number().over(W.Window.orderBy("back", "over"))  # of at most ``limit`` rows
    return back.select(place.alias("path"), F.reverse("back").alias("nodes"), F.reverse("over").alias("edges"), F.lit(len(steps)).alias("length"))


def levels(edges: DataFrame, src: str, max_depth: int = 3) -> DataFrame:
    """(id, depth) of the nodes within ``max_depth`` hops, either way, at their first depth."""
    e = edges.where(valid())
    both = e.select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).union(e.select("target_id", "source_id"))
    seen = edges.sparkSession.createDataFrame([(src, 0)], "id string, depth int")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = both.join(frontier.select(F.col("id").alias("a")), "a").select(F.col("b").alias("id")).distinct()
        frontier = checkpointed(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")))
        seen = seen.unionByName(frontier)
    return seen


def query_entities(text: str) -> list[str]:
    """Names in a question: words written as names (capitals or underscores) first, then other words of over three letters. Ten at most."""
    words = re.findall(r"\w+", text)
    named = [w for w in words if "_" in w or len(w) > 2 and w != w.lower()]
    taken = {w.lower() for w in named}
    plain = [w for w in map(str.lower, words) if len(w) > 3 and w not in taken and w not in FUNCTION_WORDS]
    return list(dict.fromkeys(named + plain))[:10]


def _matches(nodes: DataFrame, edges: DataFrame, text: str, include_sensitive: bool) -> DataFrame | None:
    """(pos, entity, low, subject, ..., edge columns): open edges of the nodes that a question's names match, for each name.

    A name stands for the MAX_NODES nodes of highest degree whose names hold it. All names are matched in one pass: they are ten at most.
    If the nodes that hold a name are few, which is counted first, the edges at them are found by a broadcast and written; degrees
    and matches both come from those. One end of a match is such a node, so only the other one is looked up.
    """
    names = query_entities(text)
    if not names:
        return None
    spark, n, open_edges = nodes.sparkSession, visible(nodes, include_sensitive), edges.where(valid())
    asked = spark.createDataFrame([(i, x, x.lower()) for i, x in enumerate(names)], "pos int, entity string, low string")
    hit = n.join(F.broadcast(asked), F.contains(F.lower("name"), F.col("low"))).select("pos", "entity", "low", "id", "name", "label")
    some = checkpointed(hit.limit(FEW_NODES + 1))
    few = some.count() <= FEW_NODES
    if few:
        hit, edges = some, written(touching(open_edges, some, few=True), "edges-at-names")
        open_edges = edges
    hit = hit.join(degrees(edges).withColumnRenamed("node", "id"), "id", "left")
    best = F.row_number().over(W.Window.partitionBy("pos").orderBy(F.coalesce("degree", F.lit(0)).desc(), "name", "id"))
    found = hit.withColumn("__best", best).where(F.col("__best") <= MAX_NODES).select("pos", "entity", "low", "name").distinct()
    found = checkpointed(found)  # at most ten times MAX_NODES names
    if few:
        known = F.broadcast(some.join(F.broadcast(found), ["pos", "entity", "low", "name"], "left_semi"))
    else:
        known = n.select("id", "name", "label").join(F.broadcast(found), "name")
    known = known.select("pos", "entity", "low", F.col("id").alias("__end"), F.col("name").alias("__name"), F.col("label").alias("__label"))
    open_edges = open_edges.withColumnRenamed("label", "predicate")
    sides = [
        open_edges.join(known, F.col(end) == F.col("__end")).withColumns({"__out": F.lit(end == "source_id"), "__far": F.col(far)}).drop("__end")
        for end, far in (("source_id", "target_id"), ("target_id", "source_id"))
    ]
    other = n.select(F.col("id").alias("__far"), F.col("name").alias("__far_name"), F.col("label").alias("__far_label"))
    rows = sides[0].unionByName(sides[1]).join(other, "__far")
    rows = rows.withColumns({
        c: F.when(F.col("__out") == out, F.col(near)).otherwise(F.col(far))
        for c, out, near, far in (
            ("subject", True, "__name", "__far_name"), ("subject_type", True, "__label", "__far_label"),
            ("object", False, "__name", "__far_name"), ("object_type", False, "__label", "__far_label"),
        )
    }).drop("__out", "__far", "__name", "__label", "__far_name", "__far_label")
    return rows.where(F.contains(F.lower("subject"), F.col("low")) | F.contains(F.lower("object"), F.col("low")))


def graph_query(nodes: DataFrame, edges: DataFrame, text: str, k: int = 10, include_sensitive: bool = False) -> DataFrame:
    """(entity, subject, predicate, object): edges of the nodes that a question's names match, one hop, at most k a name and k in all."""
    rows = _matches(nodes, edges, text, include_sensitive)
    if rows is None:
        return nodes.sparkSession.createDataFrame([], "entity string, subject string, predicate string, object string")
    triple = ("subject", "predicate", "object")
    rows = rows.select("pos", "entity", *triple).distinct()
    rows = rows.withColumn("n", F.row_number().over(W.Window.partitionBy("pos").orderBy(*triple))).where(F.col("n") <= k)
    rows = rows.withColumn("n", F.row_number().over(W.Window.partitionBy(*triple).orderBy("pos"))).where("n = 1")
    return rows.orderBy("pos", *triple).limit(k).select("entity", *triple)


def graph_chunks(
    nodes: DataFrame, edges: DataFrame, chunks: DataFrame, text: str, k: int = 10, include_sensitive: bool = False, entity_types=(), relations=()
) -> DataFrame:
    """Chunks behind the edges that a question's names match: all columns of chunks, score, entity, subject, predicate, object, path.

    edges: (..., chunk_id, weight); a missing weight is 1. A name keeps its k heaviest different triples; a chunk (or, without one, a
    path) counts once, at the first name that has it; the heaviest k follow, and those whose chunk exists are the result.
    With entity_types or relations three times as many are drawn first, and those of an asked type and relation stay.
    """
    rows = _matches(nodes, edges, text, include_sensitive)
    extra = "score double, entity string, subject string, predicate string, object string, path string"
    if rows is None:
        return chunks.limit(0).select("*", *[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in extra.split(", ")])
    drawn = 3 * k if entity_types or relations else k
    triple = ("subject", "predicate", "object")
    rows = rows.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    order = [F.desc("weight"), *triple, "chunk_id"]
    once = F.row_number().over(W.Window.partitionBy("pos", *triple).orderBy(*order))
    rows = rows.withColumn("n", once).where("n = 1")
    rows = rows.withColumn("n", F.row_number().over(W.Window.partitionBy("pos").orderBy(*order))).where(F.col("n") <= drawn)
    rows = rows.withColumn("path", F.concat_ws(" -> ", *triple)).withColumn("key", F.coalesce("chunk_id", "path"))
    first = F.row_number().over(W.Window.partitionBy("key").orderBy("pos", "n"))
    rows = rows.withColumn("first", first).where("first = 1").orderBy(F.desc("weight"), "pos", "n").limit(drawn)
    kept = F.lit(True)
    if entity_types:
        kept &= F.col("subject_type").isin(*entity_types) | F.col("object_type").isin(*entity_types)
    if relations:
        kept &= F.lower("predicate").isin(*[r.lower() for r in relations])
    hits = rows.where(kept).orderBy(F.desc("weight"), "pos", "n").limit(k)
    hits = hits.select("chunk_id", F.col("weight").alias("score"), "entity", *triple, "path")
    return chunks.join(F.broadcast(hits), "chunk_id")  # at most k rows


def supersede(edges: DataFrame, superseded: DataFrame, at: str, history: tuple[str, ...] = ("superseded-by",)) -> DataFrame:
    """Closes at ``at`` the open edges of superseded nodes, but for those that record history. superseded: (node)."""
    gone = superseded.select(F.col("node").alias("__gone")).distinct()
    hit = edges.join(gone, edges["source_id"] == gone["__gone"], "left")
    close = F.col("__gone").isNotNull() & F.col("valid_until").isNull() & ~F.col("label").isin(*history)
    return hit.withColumn("valid_until", F.when(close, F.lit(at)).otherwise(F.col("valid_until"))).drop("__gone")


def invalidate_file(edges: DataFrame, source_file: str, at: str) -> DataFrame:
    return edges.withColumn(
        "valid_until", F.when((F.col("source_file") == source_file) & F.col("valid_until").isNull(), F.lit(at)).otherwise(F.col("valid_until"))
    )


def link_entities(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mention, node_id): by node id (path:name), else by the file of that path, else by a name that only one node has."""
    by_id = nodes.select(F.col("id").alias("mention"), F.col("id").alias("m1"))
    of_file = nodes.where("label = 'File'").groupBy(F.col("id").alias("__path")).agg(F.min("id").alias("m2"))
    unique = nodes.groupBy(F.col("name").alias("mention")).agg(F.count("*").alias("n"), F.min("id").alias("m3")).where("n = 1").drop("n")
    path = F.regexp_replace("mention", r":[^:/]*$", "")
    out = mentions.join(by_id, "mention", "left").withColumn("__path", path).join(of_file, "__path", "left").join(unique, "mention", "left")
    return out.select("mention", F.coalesce("m1", "m2", "m3").alias("node_id"))


def upsert_nodes(old: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """New nodes replace old ones of their id; empty incoming properties keep the old ones. Of new rows with one id the last in the order counts."""
    last = newest(new, ("id",), order)
    names = old.columns
    merged = old.alias("o").join(last.alias("n"), "id", "full_outer")
    cols = []
    for c in names:
        if c == "id":
            cols.append(F.col("id"))
        elif c == "properties":
            cols.append(F.when(F.col(f"n.{c}").isNull() | (F.size(f"n.{c}") == 0), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            cols.append(F.coalesce(f"n.{c}", f"o.{c}").alias(c))
    return merged.select(*cols)


def edge_id(source: Column, label: Column, target: Column) -> Column:
    return F.concat_ws("␟", source, label, target)


def upsert_edges(old: DataFrame, new: DataFrame, now: str, order: str | None = None) -> DataFrame:
    """Writing an edge again opens it: valid_from is ``now`` unless given, valid_until is null unless given. Of new rows with one id the last in the order counts."""
    fresh = newest(new.withColumn("valid_from", F.coalesce("valid_from", F.lit(now))), ("id",), order)
    return old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def sweep_empty_folders(nodes: DataFrame, edges: DataFrame, label: str = "Folder", inside: str = "in_folder", max_depth: int = 100) -> DataFrame:
    """Nodes without the folders that hold nothing any more; repeated until no folder goes, as often as folders are nested at most."""
    links = edges.where(valid() & (F.col("label") == inside)).select("source_id", "target_id")
    for _ in range(max_depth):
        held = links.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("id")).distinct()
        empty = nodes.where(F.col("label") == label).join(held, "id", "left_anti").select("id")
        if empty.isEmpty():
            break
        nodes = checkpointed(nodes.join(empty, "id", "left_anti"))
    return nodes


def commit_edges(commits: DataFrame, files: DataFrame, most: int = 50) -> DataFrame:
    """(source_id, label, target_id): every commit's author; its files too if it has at most ``most``, those that are known."""
    author = commits.select(
        F.concat(F.lit("commit:"), "sha").alias("source_id"), F.lit("authored_by").alias("label"),
        F.concat(F.lit("person:"), "email").alias("target_id")
    )
    changed = commits.where(F.size("files_changed") <= most).select(
        F.concat(F.lit("commit:"), "sha").alias("source_id"), F.explode("files_changed").alias("target_id")
    )
    changed = changed.join(
        files.select(F.col("id").alias("target_id")), "target_id", "left_semi"
    ).select("source_id", F.lit("modifies").alias("label"), "target_id")
    return author.unionByName(changed).distinct()


def by_type(rows: DataFrame, entity_types=(), relations=(), k: int = 10) -> DataFrame:
    """Of the first 3 k triplets (in order), k whose subject or object type, and whose predicate in lower case, is asked for."""
    first = rows.orderBy("subject", "predicate", "object").limit(3 * k)
    c = F.lit(True)
    if entity_types:
        c &= F.col("subject_type").isin(*entity_types) | F.col("object_type").isin(*entity_types)
    if relations:
        c &= F.lower("predicate").isin(*[r.lower() for r in relations])
    return first.where(c).orderBy("subject", "predicate", "object").limit(k)


def context(hits: DataFrame) -> DataFrame:
    """entities, paths and mean score (at most 1) of graph hits (subject, predicate, object, score)."""
    names = hits.select(F.explode(F.array("subject", "object")).alias("name")).agg(F.countDistinct("name").alias("entities"))
    rest = hits.agg(F.countDistinct("subject", "predicate", "object").alias("paths"), F.least(F.avg("score"), F.lit(1.0)).alias("score"))
    return names.crossJoin(rest)  # one row each


def metadata_triples(chunks: DataFrame) -> DataFrame:
    """(subject, predicate, object, chunk_id) that a chunk's own columns tell: its file's folder and language, and its author if any."""
    parts = F.array(
        F.struct(F.col("source").alias("s"), F.lit("defined_in").alias("p"), F.col("folder").alias("o")),
        F.struct(F.col("chunk_id").alias("s"), F.lit("contains").alias("p"), F.col("source").alias("o")),
        F.struct(F.col("source").alias("s"), F.lit("references").alias("p"), F.when(F.col("source_type") == "code", F.col("language")).alias("o"))
    )
    return chunks.select("chunk_id", F.explode(parts).alias("t")).where("t.s is not null and t.o is not null").select(
        F.col("t.s").alias("subject"), F.col("t.p").alias("predicate"), F.col("t.o").alias("object"), "chunk_id"
    )


def set_properties(nodes: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Merges properties (id, properties) into nodes that exist; the new value of a key wins. Of changes to one id the last in the order counts."""
    new = newest(changes, ("id",), order).select("id", F.col("properties").alias("__new"))
    old = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    fresh = F.coalesce("__new", F.create_map().cast("map<string,string>"))
    return nodes.join(new, "id", "left").withColumn(
        "properties", F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(fresh, k)), fresh)
    ).drop("__new")


def project_people(people: DataFrame) -> DataFrame:
    """Nodes of people (id, name, kind, domain, sensitivity)."""
    return people.select(
        F.concat(F.lit("person:"), "id").alias("id"), F.coalesce("name", "id").alias("name"), F.lit("Author").alias("label"), "domain", "sensitivity"
    )


# Properties that the graph sets itself; those of a triple may not.
RESERVED_PROPERTIES = ("id", "name", "label", "domain", "sensitivity", "valid_from", "valid_until")


def triple_edges(triples: DataFrame, now: str) -> DataFrame:
    """Edges (id, source_id, target_id, label, source_file, valid_from, valid_until, chunk_id, properties) of triples.

    triples: (subject, predicate, object, source_file, chunk_id, properties map<string,string>). A triple that a chunk of a file states
    twice is one edge; reserved properties are dropped; triples without a subject, predicate or object are none.
    """
    rows = triples.where("trim(subject) <> '' and trim(predicate) <> '' and trim(object) <> ''")
    key = ["chunk_id", "source_file", "subject", "predicate", "object"]
    rows = spread(rows.withColumn("__key", F.xxhash64(*key)), "__key", of_a_task=KEYED_OF_A_TASK)
    rows = rows.dropDuplicates(["__key", *key]).drop("__key")  # also by what they are dealt out by, so that they meet where they are
    own = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(*RESERVED_PROPERTIES))
    ends = (F.col("subject").alias("source_id"), F.col("object").alias("target_id"), F.col("predicate").alias("label"))
    until = F.lit(None).cast("string").alias("valid_until")
    made = (
        edge_id(F.col("subject"), F.col("predicate"), F.col("object")).alias("id"), *ends, "source_file", F.lit(now).alias("valid_from"), until,
        "chunk_id", own.alias("properties")
    )
    return rows.select(*made)


def replace_files(edges: DataFrame, new: DataFrame, now: str) -> DataFrame:
    """Purge then write: the edges of the files that ``new`` has edges of give way to the new ones."""
    files = new.select("source_file").where("source_file is not null").distinct()
    return upsert_edges(edges.join(files, "source_file", "left_anti").select(*edges.columns), new, now)


def rehome(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a project has moved: paths under the old root in ids, ends and source files; edge ids follow their ends."""
    moved = lambda c: prefix_swap(F.col(c), old, new)
    e = edges.withColumns({c: moved(c) for c in ("source_id", "target_id", "source_file") if c in edges.columns})
    return nodes.withColumn("id", moved("id")), e.withColumn("id", edge_id(F.col("source_id"), F.col("label"), F.col("target_id")))


def timeline_entity(nodes: DataFrame, edges: DataFrame, text: str, include_sensitive: bool = False) -> str | None:
    """The node name that a phrase means: an exact match first, else the one of highest degree among five that hold it."""
    found = search_nodes(nodes, edges, text, 5, include_sensitive=include_sensitive)
    row = found.orderBy(F.desc(F.lower("name") == text.lower()), F.desc("degree"), "name").first()
    return row["name"] if row else None
