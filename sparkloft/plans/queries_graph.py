"""Graph search, paths, impact, timelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloft.operators import graph as g
from sparkloft.plans.catalog import query

AT = "1998-06-01T00:00:00"
_DEG = "deg AS (SELECT node, count(*) AS degree FROM (SELECT id, source_id AS node FROM edges WHERE valid_until IS NULL UNION SELECT id, target_id FROM edges WHERE valid_until IS NULL) AS x GROUP BY 1)"
_TRI = "SELECT s.name AS subject, e.label AS predicate, t.name AS object, e.valid_from, e.valid_until FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE s.sensitivity = 'normal' AND t.sensitivity = 'normal'"


@query("graph_triplets", f"{_TRI} AND e.valid_until IS NULL AND e.label IN ('in', 'authored_by')", "nodes", "edges")
def _triplets(t, spark, sf):
    return g.triplets(t("nodes"), t("edges"), labels=("in", "authored_by")).select("subject", "predicate", "object", "valid_from", "valid_until")


@query(
    "graph_as_of", f"{_TRI} AND e.valid_from <= '{AT}' AND (e.valid_until IS NULL OR e.valid_until > '{AT}') AND e.label = 'authored_by'", "nodes",
    "edges"
)
def _as_of(t, spark, sf):
    return g.triplets(t("nodes"), t("edges"), labels=("authored_by",), as_of=AT).select("subject", "predicate", "object", "valid_from", "valid_until")


@query(
    "graph_search_nodes",
    f", {_DEG} SELECT n.id, n.name, n.label, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg ON deg.node = n.id WHERE contains(lower(name), 'an') AND sensitivity = 'normal' ORDER BY 4 DESC, 2, 1 LIMIT 25",
    "nodes", "edges"
)
def _search(t, spark, sf):
    return g.search_nodes(t("nodes"), t("edges"), "AN", 25)


@query(
    "graph_top_nodes",
    f", {_DEG} SELECT n.id, n.name, n.label, degree FROM nodes n JOIN deg ON deg.node = n.id WHERE n.domain IN ('geo', 'sales') ORDER BY 4 DESC, 2, 1 LIMIT 40",
    "nodes", "edges"
)
def _top(t, spark, sf):
    return g.top_nodes(t("nodes"), t("edges"), 40, ("geo", "sales"))


@query(
    "graph_neighbors",
    "SELECT id, source_id, label, target_id FROM edges WHERE valid_until IS NULL AND (source_id IN ('nation:3', 'customer:10') OR target_id IN ('nation:3', 'customer:10')) ORDER BY id LIMIT 200",
    "edges"
)
def _neighbors(t, spark, sf):
    return g.neighbors(t("nodes"), t("edges"), ("nation:3", "customer:10"))


_NAME = "(SELECT min(name) FROM nodes WHERE label = 'Person' AND sensitivity = 'normal')"


@query(
    "timeline_named",
    f"SELECT s.name AS subject, e.label AS predicate, t.name AS object, e.valid_from, e.valid_until, e.valid_until IS NULL AS valid FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id WHERE s.sensitivity = 'normal' AND t.sensitivity = 'normal' AND (s.name = {_NAME} OR t.name = {_NAME})",
    "nodes", "edges"
)
def _timeline(t, spark, sf):
    name = t("nodes").where("label = 'Person' AND sensitivity = 'normal'").agg(F.min("name")).first()[0]
    return g.timeline(t("nodes"), t("edges"), name)


@query(
    "graph_orphans",
    "SELECT id, name FROM nodes WHERE id NOT IN (SELECT source_id FROM edges WHERE valid_until IS NULL UNION SELECT target_id FROM edges WHERE valid_until IS NULL)",
    "nodes", "edges"
)
def _orphans(t, spark, sf):
    return g.orphans(t("nodes"), t("edges")).select("id", "name")


@query(
    "graph_cochange",
    ", m AS (SELECT source_id, target_id FROM edges WHERE label = 'modifies' AND valid_until IS NULL) SELECT b.target_id AS file, count(DISTINCT b.source_id) AS shared FROM m a JOIN m b ON a.source_id = b.source_id AND b.target_id <> a.target_id WHERE a.target_id = 'part:7' GROUP BY 1 HAVING count(DISTINCT b.source_id) >= 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "edges"
)
def _cochange(t, spark, sf):
    return g.co_changed(t("edges"), "part:7", 1, 20)


@query(
    "graph_supersession",
    f"SELECT id, CASE WHEN valid_until IS NULL AND label <> 'superseded-by' AND source_id IN (SELECT id FROM nodes WHERE label = 'Person' AND sensitivity = 'private') THEN '{AT}' ELSE valid_until END AS valid_until FROM edges",
    "nodes", "edges"
)
def _supersession(t, spark, sf):
    gone = t("nodes").where("label = 'Person' AND sensitivity = 'private'").select(F.col("id").alias("node"))
    return g.supersede(t("edges"), gone, AT).select("id", "valid_until")


@query(
    "graph_entity_link",
    ", u AS (SELECT name, min(id) AS id FROM nodes GROUP BY 1 HAVING count(*) = 1), men AS (SELECT DISTINCT name AS mention FROM nodes WHERE label IN ('Person', 'File', 'Nation') UNION SELECT id FROM nodes WHERE label = 'Region' UNION SELECT 'nobody') SELECT mention, coalesce(n.id, u.id) AS node_id FROM men LEFT JOIN nodes n ON n.id = mention LEFT JOIN u ON u.name = mention",
    "nodes"
)
def _link(t, spark, sf):
    n = t("nodes")
    mentions = n.where("label in ('Person', 'File', 'Nation')").select(F.col("name").alias("mention")).union(
        n.where("label = 'Region'").select("id")
    ).union(spark.sql("SELECT 'nobody' AS mention")).distinct()
    return g.link_entities(mentions, n)


@query("graph_impact", """, d AS (SELECT source_id, target_id, label FROM edges WHERE valid_until IS NULL AND label IN ('calls', 'depends_on')),
    l1 AS (SELECT source_id AS id, min(label) AS via FROM d WHERE target_id = 'part:5' AND source_id <> 'part:5' GROUP BY 1),
    l2 AS (SELECT source_id AS id, min(label) AS via FROM d JOIN l1 ON d.target_id = l1.id WHERE source_id <> 'part:5' AND source_id NOT IN (SELECT id FROM l1) GROUP BY 1),
    l3 AS (SELECT source_id AS id, min(label) AS via FROM d JOIN l2 ON d.target_id = l2.id WHERE source_id <> 'part:5' AND source_id NOT IN (SELECT id FROM l1 UNION SELECT id FROM l2) GROUP BY 1)
    SELECT id, depth, via FROM (SELECT id, 1 AS depth, via FROM l1 UNION ALL SELECT id, 2, via FROM l2 UNION ALL SELECT id, 3, via FROM l3) AS x ORDER BY depth, id LIMIT 200""", "edges")
def _impact(t, spark, sf):
    return g.impact(t("edges"), "part:5")


@query("graph_shortest_path", """, b AS (SELECT source_id AS x, target_id AS y FROM edges WHERE valid_until IS NULL AND label = 'in' UNION SELECT target_id, source_id FROM edges WHERE valid_until IS NULL AND label = 'in'),
    p AS (SELECT 'region:1' AS id, 0 AS depth UNION SELECT b.y, p.depth + 1 FROM p JOIN b ON b.x = p.id WHERE p.depth < 2)
    SELECT id, CAST(min(depth) AS INT) AS depth FROM p GROUP BY 1""", "edges")
def _path(t, spark, sf):
    return g.levels(t("edges").where("label = 'in'"), "region:1", 2)


@query("graph_query", f""", {_DEG},
    f AS (SELECT DISTINCT name FROM (SELECT n.name, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg ON deg.node = n.id WHERE contains(lower(name), 'commit') AND sensitivity = 'normal' ORDER BY 2 DESC, 1, n.id LIMIT 25) AS x)
    SELECT DISTINCT 'commit' AS entity, s.name AS subject, e.label AS predicate, t.name AS object FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id
    WHERE e.valid_until IS NULL AND s.sensitivity = 'normal' AND t.sensitivity = 'normal' AND (s.name IN (SELECT name FROM f) OR t.name IN (SELECT name FROM f)) AND (contains(lower(s.name), 'commit') OR contains(lower(t.name), 'commit'))
    ORDER BY 2, 3, 4 LIMIT 10""", "nodes", "edges")
def _graph_query(t, spark, sf):
    return g.graph_query(t("nodes"), t("edges"), "what does a commit do", 10)
