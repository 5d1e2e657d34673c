"""Graph retrieval, paths, lookups and writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloft.operators import graph as g
from sparkloft.operators import records, sessions
from sparkloft.plans.catalog import query, rounded
from sparkloft.plans.queries_graph import _DEG

_LOW = "CASE {}.pos WHEN 0 THEN 'nation_1' ELSE 'asia' END".format


@query(
    "graph_chunks",
    f""", {_DEG}, asked AS (SELECT unnest([0, 1]) AS pos),
    hit AS (SELECT a.pos, n.id, n.name, row_number() OVER (PARTITION BY a.pos ORDER BY coalesce(deg.degree, 0) DESC, n.name, n.id) AS rk
        FROM nodes n JOIN asked a ON contains(lower(n.name), {_LOW('a')}) LEFT JOIN deg ON deg.node = n.id WHERE n.sensitivity = 'normal'),
    names AS (SELECT pos, name FROM hit WHERE rk <= 25 GROUP BY 1, 2),
    src AS (SELECT concat('nation:', CAST(n_nationkey AS STRING), '|in|region:', CAST(n_regionkey AS STRING)) AS id, c.chunk_id,
            CAST(1.0 - (c.doc_id % 10) / 20.0 AS DOUBLE) AS weight
        FROM chunks c JOIN nation ON n_nationkey = c.doc_id % 25),
    open_edges AS (SELECT e.id, e.source_id, e.target_id, e.label FROM edges e WHERE e.valid_until IS NULL),
    ends AS (SELECT f.pos, e.id, a.name AS subject, b.name AS object, e.label AS predicate
        FROM open_edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id JOIN names f ON f.name = a.name OR f.name = b.name
        WHERE a.sensitivity = 'normal' AND b.sensitivity = 'normal' AND (contains(lower(a.name), {_LOW('f')}) OR contains(lower(b.name), {_LOW('f')}))),
    weighed AS (SELECT n.pos, n.subject, n.predicate, n.object, s.chunk_id, coalesce(s.weight, 1.0) AS weight FROM ends n LEFT JOIN src s ON s.id = n.id),
    one AS (SELECT *, row_number() OVER (PARTITION BY pos, subject, predicate, object ORDER BY weight DESC, chunk_id) AS r1 FROM weighed),
    per AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY weight DESC, subject, predicate, object, chunk_id) AS n FROM one WHERE r1 = 1),
    fst AS (SELECT *, row_number() OVER (PARTITION BY coalesce(chunk_id, concat_ws(' -> ', subject, predicate, object)) ORDER BY pos, n) AS f FROM per WHERE n <= 10),
    best AS (SELECT * FROM fst WHERE f = 1 ORDER BY weight DESC, pos, n LIMIT 10)
    SELECT c.chunk_id, round(b.weight, 6) AS score, CASE b.pos WHEN 0 THEN 'NATION_1' ELSE 'ASIA' END AS entity, b.subject, b.predicate, b.object
    FROM best b JOIN chunks c ON c.chunk_id = b.chunk_id""",
    "nodes",
    "edges",
    "chunks",
)
def _chunks(t, spark, sf):
    key = F.col("n_nationkey").cast("string")
    source = t("chunks").join(t("nation"), F.col("n_nationkey") == F.col("doc_id") % 25).select(
        F.concat(
            F.lit("nation:"), key, F.lit("|in|region:"), F.col("n_regionkey").cast("string")
        ).alias("id"), "chunk_id", (1.0 - (F.col("doc_id") % 10) / 20.0).alias("weight")
    )
    edges = t("edges").join(source, "id", "left")
    out = g.graph_chunks(t("nodes"), edges, t("chunks"), "which NATION_1 has ASIA", 10)
    return rounded(out.select("chunk_id", "score", "entity", "subject", "predicate", "object"), "score")


@query(
    "graph_paths",
    """, b AS (SELECT source_id AS x, target_id AS y, id FROM edges WHERE valid_until IS NULL AND label = 'in' UNION ALL SELECT target_id, source_id, id FROM edges WHERE valid_until IS NULL AND label = 'in'),
    p AS (SELECT ['customer:1'] AS ns, CAST([] AS VARCHAR[]) AS es, 'customer:1' AS here, 0 AS depth
        UNION ALL SELECT list_append(ns, y), list_append(es, b.id), y, depth + 1 FROM p JOIN b ON b.x = p.here WHERE depth < 4 AND NOT list_contains(ns, y)),
    f AS (SELECT ns, es, depth FROM p WHERE here = 'supplier:3')
    SELECT array_to_string(ns, ' ') AS nodes, array_to_string(es, ' ') AS edges, CAST(depth AS INT) AS length FROM f WHERE depth = (SELECT min(depth) FROM f) ORDER BY list_reverse(ns), list_reverse(es) LIMIT 5""",
    "edges",
)
def _paths(t, spark, sf):
    out = g.shortest_paths(t("nodes"), t("edges").where("label = 'in'"), "customer:1", "supplier:3", 4)
    return out.select(F.array_join("nodes", " ").alias("nodes"), F.array_join("edges", " ").alias("edges"), "length")


@query(
    "graph_parallel_paths",
    """, m AS (SELECT source_id AS x, target_id AS y, id FROM edges WHERE valid_until IS NULL AND label IN ('authored_by', 'in')),
    b AS (SELECT x, y, id FROM m UNION ALL SELECT y, x, id FROM m),
    p AS (SELECT ['region:0'] AS ns, CAST([] AS VARCHAR[]) AS es, 'region:0' AS here, 0 AS depth
        UNION ALL SELECT list_append(ns, y), list_append(es, b.id), y, depth + 1 FROM p JOIN b ON b.x = p.here WHERE depth < 3 AND NOT list_contains(ns, y)),
    f AS (SELECT ns, es, depth FROM p WHERE here = (SELECT min(source_id) FROM m WHERE x LIKE 'order:%' AND y IN (SELECT source_id FROM edges WHERE label = 'in' AND target_id IN (SELECT source_id FROM edges WHERE target_id = 'region:0'))))
    SELECT array_to_string(ns, ' ') AS nodes, CAST(depth AS INT) AS length FROM f WHERE depth = (SELECT min(depth) FROM f) ORDER BY list_reverse(ns), list_reverse(es) LIMIT 5""".replace("min(source_id) FROM m", "min(x) FROM m"),
    "edges",
)
def _parallel(t, spark, sf):
    e = t("edges").where("label in ('authored_by', 'in')")
    nations = e.where("target_id = 'region:0'").select(F.col("source_id").alias("target_id"))
    people = e.where("label = 'in'").join(nations, "target_id", "left_semi").select(F.col("source_id").alias("target_id"))
    order = e.where("valid_until is null and source_id like 'order:%'").join(people, "target_id", "left_semi").agg(F.min("source_id")).first()[0]
    return g.shortest_paths(t("nodes"), e, "region:0", order, 3).select(F.array_join("nodes", " ").alias("nodes"), "length")


@query(
    "graph_neighborhood",
    f""", {_DEG}, e AS (SELECT * FROM edges WHERE valid_until IS NULL AND (source_id IN ('nation:3', 'region:1') OR target_id IN ('nation:3', 'region:1'))
        AND source_id IN (SELECT id FROM nodes WHERE domain = 'geo') AND target_id IN (SELECT id FROM nodes WHERE domain = 'geo') ORDER BY id LIMIT 200)
    SELECT n.id, n.name, n.label, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg ON deg.node = n.id WHERE n.id IN (SELECT source_id FROM e UNION SELECT target_id FROM e)""",
    "nodes",
    "edges",
)
def _neighborhood(t, spark, sf):
    return g.neighborhood(t("nodes"), t("edges"), ("nation:3", "region:1"), 200, ("geo",))[1]


@query("graph_lookup_name", "SELECT id, label FROM nodes WHERE name = 'NATION_7' AND domain = 'geo' ORDER BY id LIMIT 25", "nodes")
def _by_name(t, spark, sf):
    return g.nodes_by_name(t("nodes"), "NATION_7", ("geo",)).select("id", "label")


@query(
    "graph_lookup_label", "SELECT id, name FROM nodes WHERE label = 'File' AND contains(lower(name), 'widget') ORDER BY name, id LIMIT 30", "nodes"
)
def _by_label(t, spark, sf):
    return g.nodes_by_label(t("nodes"), "File", "WIDGET", 30).select("id", "name")


@query("graph_decisions", "SELECT id FROM nodes WHERE label = 'Nation' AND lower(trim(name)) = 'nation_9'", "nodes")
def _decisions(t, spark, sf):
    as_decisions = t("nodes").withColumn("label", F.when(F.col("label") == "Nation", "Decision").otherwise(F.col("label")))
    return g.decision_nodes(as_decisions, "  Nation_9 ").select("id")


@query(
    "graph_empty_folders",
    "WITH RECURSIVE f AS (SELECT p_partkey AS k, p_partkey // 3 AS up FROM part WHERE p_partkey > 0), full_ AS (SELECT up AS k FROM f WHERE k % 17 = 5 UNION SELECT f.up FROM f JOIN full_ ON full_.k = f.k) "
    "SELECT concat('dir:', CAST(k AS STRING)) AS id FROM (SELECT DISTINCT k FROM full_) AS x WHERE k >= 0",
)
def _folders(t, spark, sf):
    k = F.col("p_partkey")
    name = lambda x: F.concat(F.lit("dir:"), x.cast("string"))
    nodes = t("part").select(name(k).alias("id"), F.lit("Folder").alias("label")).union(
        t("part").where("p_partkey > 0 and p_partkey % 17 = 5").select(F.concat(F.lit("file:"), k.cast("string")), F.lit("File"))
    )
    up = name(F.floor(k / 3))
    open_ = (F.lit("in_folder").alias("label"), F.lit(None).cast("string").alias("valid_until"))
    edges = t("part").where("p_partkey > 0").select(name(k).alias("source_id"), up.alias("target_id"), *open_)
    files = t("part").where("p_partkey > 0 and p_partkey % 17 = 5").select(
        F.concat(F.lit("file:"), k.cast("string")).alias("source_id"), up.alias("target_id"), *open_
    )
    return g.sweep_empty_folders(nodes, edges.union(files)).where("label = 'Folder'").select("id")


_TRIPLES = "SELECT concat('part:', CAST(l_partkey AS STRING)) AS subject, concat('supplier:', CAST(l_suppkey AS STRING)) AS object, concat('f', CAST(l_partkey % 9 AS STRING)) AS source_file FROM lineitem"


@query(
    "graph_triple_edges",
    f"SELECT DISTINCT concat(subject, chr(9247), 'made_by', chr(9247), object) AS id, source_file, 'y' AS kept, CAST(1 AS INT) AS n_properties FROM ({_TRIPLES}) AS t"
)
def _triple_edges(t, spark, sf):
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    made = F.create_map(F.lit("id"), F.lit("x"), F.lit("note"), F.lit("y"), F.lit("valid_from"), F.lit("z"))
    rows = t("lineitem").select(
        name("part:", "l_partkey").alias("subject"), F.lit("made_by").alias("predicate"), name("supplier:", "l_suppkey").alias("object"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 9).cast("string")).alias("source_file"), F.lit("c").alias("chunk_id"), made.alias("properties"),
    )
    out = g.triple_edges(rows, "2024")
    return out.select("id", "source_file", F.col("properties")["note"].alias("kept"), F.size("properties").alias("n_properties"))


@query(
    "graph_replace_files",
    "SELECT id, '2001' AS valid_from FROM edges WHERE source_file IN ('log3', 'log4') AND label = 'authored_by' UNION ALL SELECT id, valid_from FROM edges WHERE source_file NOT IN ('log3', 'log4')",
    "edges"
)
def _replace(t, spark, sf):
    e = t("edges")
    new = e.where("source_file in ('log3', 'log4') and label = 'authored_by'").withColumn("valid_from", F.lit(None).cast("string"))
    return g.replace_files(e, new, "2001").select("id", "valid_from")


@query(
    "graph_upsert_nodes",
    "SELECT id, CASE WHEN label = 'Nation' THEN upper(concat(name, '!')) ELSE name END AS name, CASE WHEN label = 'Nation' AND domain = 'geo' THEN 'old' WHEN label = 'Region' THEN 'new' ELSE 'old' END AS note FROM nodes UNION ALL SELECT 'added:1', 'ADDED', 'new'",
    "nodes"
)
def _nodes(t, spark, sf):
    old = t("nodes").withColumn("properties", F.create_map(F.lit("note"), F.lit("old")))
    none = F.create_map().cast("map<string,string>")
    changed = old.where("label in ('Nation', 'Region')").withColumn(
        "name", F.when(F.col("label") == "Nation", F.upper(F.concat("name", F.lit("!")))).otherwise(F.col("name"))
    )
    changed = changed.withColumn("properties", F.when(F.col("label") == "Region", F.create_map(F.lit("note"), F.lit("new"))).otherwise(none))
    added = changed.limit(1).select(
        F.lit("added:1").alias("id"), F.lit("ADDED").alias("name"), F.lit("Region").alias("label"), "domain", "sensitivity",
        F.create_map(F.lit("note"), F.lit("new")).alias("properties")
    )
    return g.upsert_nodes(old, changed.unionByName(added)).select("id", "name", F.col("properties")["note"].alias("note"))


@query(
    "graph_set_properties",
    "SELECT id, CASE WHEN label = 'Region' THEN 'new' ELSE 'old' END AS note, CASE WHEN label = 'Region' THEN 'more' END AS extra FROM nodes", "nodes"
)
def _properties(t, spark, sf):
    nodes = t("nodes").withColumn("properties", F.create_map(F.lit("note"), F.lit("old")))
    both = F.create_map(F.lit("note"), F.lit("new"), F.lit("extra"), F.lit("more"))
    changes = nodes.where("label = 'Region'").select("id").union(spark.sql("SELECT 'nobody' AS id")).withColumn("properties", both)
    return g.set_properties(nodes, changes).select(
        "id", F.col("properties")["note"].alias("note"), F.try_element_at("properties", F.lit("extra")).alias("extra")
    )


@query(
    "graph_rehome",
    "SELECT replace(id, 'part:', 'moved/part:') AS id, CASE WHEN source_file LIKE 'mod%' THEN concat('new/', source_file) ELSE source_file END AS source_file FROM (SELECT concat(source_id, chr(9247), label, chr(9247), target_id) AS id, source_file FROM edges) AS e",
    "edges"
)
def _rehome(t, spark, sf):
    placed = lambda c: F.when(F.col(c).startswith("part:"), F.concat(F.lit("old/"), c)).otherwise(F.col(c))
    e = t("edges").withColumns({"source_id": placed("source_id"), "target_id": placed("target_id")})
    moved = g.rehome(t("nodes"), e, "old", "moved")[1]
    e2 = moved.withColumn(
        "source_file", F.when(F.col("source_file").startswith("mod"), F.concat(F.lit("old/"), "source_file")).otherwise(F.col("source_file"))
    )
    return g.rehome(t("nodes"), e2, "old", "new")[1].select("id", "source_file")


@query(
    "graph_commit_edges",
    "WITH c AS (SELECT o_orderkey AS k, concat('person:', CAST(o_custkey AS STRING)) AS p FROM orders), f AS (SELECT l_orderkey AS k, l_partkey AS f FROM lineitem) SELECT concat('commit:', CAST(k AS STRING)) AS source_id, 'authored_by' AS label, p AS target_id FROM c UNION SELECT concat('commit:', CAST(k AS STRING)), 'modifies', concat('part:', CAST(f AS STRING)) FROM f WHERE f % 2 = 0 AND k IN (SELECT k FROM f GROUP BY k HAVING count(*) <= 4)"
)
def _commits(t, spark, sf):
    changed = t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("sha")).agg(
        F.collect_list(F.concat(F.lit("part:"), F.col("l_partkey").cast("string"))).alias("files_changed")
    )
    commits = t("orders").select(
        F.col("o_orderkey").cast("string").alias("sha"), F.col("o_custkey").cast("string").alias("email")
    ).join(changed, "sha", "left")
    files = t("part").where("p_partkey % 2 = 0").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("id"))
    return g.commit_edges(commits, files, 4)


@query(
    "graph_people",
    "SELECT concat('person:', CAST(c_custkey AS STRING)) AS id, coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END, CAST(c_custkey AS STRING)) AS name, 'Author' AS label FROM customer"
)
def _people(t, spark, sf):
    people = t("customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"),
        F.lit("human").alias("kind"), F.lit("code").alias("domain"), F.lit("normal").alias("sensitivity")
    )
    return g.project_people(people).select("id", "name", "label")


@query(
    "graph_timeline_entity",
    f", {_DEG} SELECT name FROM (SELECT n.id, n.name, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN deg ON deg.node = n.id WHERE contains(lower(name), 'nation_1') AND sensitivity = 'normal' ORDER BY 3 DESC, 2, 1 LIMIT 5) AS x ORDER BY lower(name) = 'nation_1' DESC, degree DESC, name LIMIT 1",
    "nodes", "edges"
)
def _entity(t, spark, sf):
    return spark.createDataFrame([(g.timeline_entity(t("nodes"), t("edges"), "nation_1"),)], "name string")


@query(
    "stats_counts",
    "SELECT 'records' AS kind, count(*) AS n FROM records UNION ALL SELECT 'unverified', count(*) FROM records WHERE confidence < 0.7 UNION ALL SELECT 'edges_all', count(*) FROM edges "
    "UNION ALL SELECT 'edges', count(*) FROM edges WHERE valid_until IS NULL UNION ALL SELECT 'nodes', count(*) FROM nodes UNION ALL SELECT 'people', count(*) FROM customer UNION ALL SELECT 'references', count(*) FROM benchmark",
    "records",
    "edges",
    "nodes",
)
def _counts(t, spark, sf):
    return records.counts(t("records"), t("nodes"), t("edges"), t("customer"), t("benchmark"))


@query(
    "records_upsert",
    "SELECT id, CASE WHEN id % 5 = 0 THEN 'changed' ELSE subject END AS subject, CASE WHEN id % 5 = 0 THEN '2026-W53' ELSE iso_week END AS iso_week, CASE WHEN id % 5 = 0 THEN '2027-01' ELSE ym END AS ym FROM records",
    "records"
)
def _upsert(t, spark, sf):
    new = t("records").where("id % 5 = 0").withColumn("ts", F.lit("2027-01-01T00:00:00"))
    twice = new.withColumn("subject", F.lit("changed")).withColumn("v", F.lit(2)).unionByName(
        new.withColumn("subject", F.lit("first")).withColumn("v", F.lit(1))
    )
    return records.upsert_records(t("records"), twice, "v").select("id", "subject", "iso_week", "ym")


@query(
    "session_digest",
    "SELECT session_id, concat('## Session ', CAST(session_id AS STRING), chr(10), string_agg(concat('- ', role), chr(10) ORDER BY role)) AS block FROM (SELECT DISTINCT session_id, role FROM turns) AS x GROUP BY session_id",
    "turns"
)
def _digest(t, spark, sf):
    return sessions.digest(t("turns").select("session_id", F.col("role").alias("text")))
