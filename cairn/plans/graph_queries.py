"""Queries of joins, graph aggregates, graph algorithms and snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import components as CC
from cairn.operators import graph as G
from cairn.operators import upsert as U
from cairn.plans import adapters as A
from cairn.plans.catalog import query
from cairn.session import by_key, materialise, table

#: The node that breadth-first queries start from: the smallest key has a deep neighbourhood.
START = "n0"


@query("SELECT target_id, id, name, type FROM edges JOIN nodes ON source_id = id WHERE relation = 'calls'")
def c1_callers(spark, sf):
    return G.callers(A.edges(spark, sf), A.nodes(spark, sf))


@query("SELECT source_id, id, name, type FROM edges JOIN nodes ON target_id = id WHERE relation = 'calls'")
def c2_callees(spark, sf):
    return G.callees(A.edges(spark, sf), A.nodes(spark, sf))


@query("""SELECT source_id AS node, 'out' AS direction, relation, id, name FROM edges JOIN nodes ON target_id = id
UNION ALL SELECT target_id, 'in', relation, id, name FROM edges JOIN nodes ON source_id = id""")
def c3_neighbours(spark, sf):
    return G.neighbours(A.edges(spark, sf), A.nodes(spark, sf))


@query("""SELECT source_id, target_id, weight FROM edges WHERE source_id IN (SELECT id FROM nodes WHERE type <> 'Field') AND target_id IN (SELECT id FROM nodes WHERE type <> 'Field')""")
def c4_dangling(spark, sf):
    return G.drop_dangling(A.edges(spark, sf), A.nodes(spark, sf).where("type <> 'Field'")).select("source_id", "target_id", "weight")


@query("""SELECT DISTINCT id, 'Module' AS type FROM (SELECT source_id AS id FROM edges UNION SELECT target_id FROM edges) WHERE id NOT IN (SELECT id FROM nodes WHERE type <> 'Field')""")
def c5_placeholders(spark, sf):
    return G.dangling(A.edges(spark, sf), A.nodes(spark, sf).where("type <> 'Field'"))


@query("""WITH d AS (SELECT id, name, file_path, split_part(file_path, '/', 1) AS package FROM nodes WHERE type IN ('Class', 'Method')),
c AS (SELECT id AS call_id, name || CASE WHEN line_start > 45 THEN '?' ELSE '' END AS name, file_path, split_part(file_path, '/', 1) AS package FROM nodes WHERE type = 'Field'),
f AS (SELECT c.*, (SELECT min(d.id) FROM d WHERE d.name = c.name AND d.file_path = c.file_path) AS s, (SELECT min(d.id) FROM d WHERE d.name = c.name) AS g FROM c)
SELECT call_id, name, coalesce(s, g) AS target_id, CASE WHEN s IS NOT NULL THEN 1.0 WHEN g IS NOT NULL THEN 0.5 ELSE 0.0 END AS confidence, g IS NULL AS unresolved FROM f""")
def c6_resolution(spark, sf):
    nodes = A.nodes(spark, sf).withColumn("package", F.split("file_path", "/")[0])
    asked = F.concat("name", F.when(F.col("line_start") > 45, "?").otherwise(""))
    calls = nodes.where("type = 'Field'").select(F.col("id").alias("call_id"), asked.alias("name"), "file_path", "package")
    found = G.resolve_calls(calls, nodes.where("type in ('Class', 'Method')").select("id", "name", "file_path", "package"))
    return found.select("call_id", "name", "target_id", "confidence", "unresolved")


@query("""SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted' WHEN o.hash <> n.hash THEN 'modified' ELSE 'unchanged' END AS status
FROM old_files o FULL JOIN new_files n ON o.path = n.path""")
def c8_snapshot_diff(spark, sf):
    return U.diff(A.old_files(spark, sf), A.new_files(spark, sf))


@query("""SELECT split_part(path, '/', 1) AS source, count(*) AS total, count(*) FILTER (lang <> 'de') AS covered, round(100.0 * count(*) FILTER (lang <> 'de') / greatest(count(*), 1), 1) AS pct FROM files GROUP BY 1""")
def c9_coverage(spark, sf):
    from cairn.operators.quality import coverage

    files = A.files(spark, sf)
    docs = files.where("lang <> 'de'").select(F.concat(F.lit("codex_"), F.regexp_replace("path", r"[/\\.]", "_"), F.lit(".md")).alias("doc"))
    return coverage(files.withColumn("source", F.split("path", "/")[0]), docs, "source")


@query("""WITH m AS (SELECT split_part(path, '/', 2) AS module, max(date) AS mtime FROM changes JOIN commits USING (sha) GROUP BY 1),
d AS (SELECT split_part(path, '/', 2) AS module, max(date) AS doc FROM changes JOIN commits USING (sha) WHERE intent = 'docs' GROUP BY 1)
SELECT m.module, coalesce(d.doc < m.mtime, TRUE) AS stale FROM m LEFT JOIN d USING (module)""")
def c10_stale_groups(spark, sf):
    from cairn.operators.quality import stale_groups

    docs = F.when(F.col("intent") == "docs", F.col("date"))
    last = A.dated_folders(spark, sf).groupBy("module").agg(F.max("date").alias("mtime"), F.max(docs).alias("doc"))
    last = materialise(last, "modules")
    return stale_groups(last, last.where("doc is not null").select("module", F.col("doc").alias("mtime")))


@query("SELECT DISTINCT part_doc AS doc FROM (SELECT unnest(source_docs) AS part_doc FROM kg_edges WHERE source = 'nation:1')")
def c16_provenance(spark, sf):
    return A.kg_edges(spark, sf).where("source = 'nation:1'").select(F.explode("source_docs").alias("doc")).distinct()


@query("""SELECT e.source_id, e.relation, s.type, e.relation NOT IN ('calls') AND s.type = 'Field' OR s.type = 'Module' AS bad FROM edges e JOIN nodes s ON e.source_id = s.id
WHERE NOT ((s.type = 'Field' AND e.relation = 'calls') OR s.type IN ('Class', 'Method'))""")
def c18_allowed_relations(spark, sf):
    allowed = spark.createDataFrame([("Field", "calls"), ("Class", "calls"), ("Class", "imports"), ("Method", "calls"), ("Method", "imports")], "type string, relation string")
    typed = A.edges(spark, sf).join(by_key(A.nodes(spark, sf)), F.col("source_id") == F.col("id"))
    return typed.join(F.broadcast(allowed), ["type", "relation"], "left_anti").select("source_id", "relation", "type", F.lit(True).alias("bad"))


@query("SELECT o.path FROM old_files o WHERE o.path NOT IN (SELECT path FROM new_files)")
def c19_removed_files(spark, sf):
    return A.old_files(spark, sf).join(A.new_files(spark, sf), "path", "left_anti").select("path")


@query("""SELECT 'node' AS kind, type AS value, count(*) AS n FROM nodes GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY 2
UNION ALL SELECT 'nodes', 'all', count(*) FROM nodes UNION ALL SELECT 'edges', 'all', count(*) FROM edges UNION ALL SELECT 'files', 'all', count(DISTINCT file_path) FROM nodes""")
def d1_graph_stats(spark, sf):
    return G.graph_stats(A.nodes(spark, sf), A.edges(spark, sf))


@query("""SELECT id, count(*) AS degree, any_value(name) AS name FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) JOIN nodes USING (id)
GROUP BY id HAVING count(*) > 3 ORDER BY degree DESC, id LIMIT 100""")
def d2_hubs(spark, sf):
    return G.hubs(A.edges(spark, sf), A.nodes(spark, sf), 3)


@query("""WITH t AS (SELECT DISTINCT sha, path FROM changes) SELECT a.path AS file_a, b.path AS file_b, count(*) AS weight FROM t a JOIN t b ON a.sha = b.sha AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 2""")
def d3_co_change(spark, sf):
    rows, files = A.touched(spark, sf)
    return G.named(G.co_change(rows), files)


@query("SELECT count(*) AS missing FROM edges WHERE target_id NOT IN (SELECT id FROM nodes WHERE line_start > 10)")
def d4_referential_check(spark, sf):
    known = by_key(A.nodes(spark, sf).where("line_start > 10").select("id"))
    return A.edges(spark, sf).join(known, F.col("target_id") == F.col("id"), "left_anti").agg(F.count("*").alias("missing"))


BFS = """WITH RECURSIVE way AS (SELECT source_id AS s, target_id AS t FROM edges UNION SELECT target_id, source_id FROM edges),
r AS (SELECT 'n0' AS id, 0 AS hop UNION SELECT t, hop + 1 FROM r JOIN way ON s = id WHERE hop < {n})
SELECT id, min(hop) AS hop FROM r GROUP BY id"""


@query(BFS.format(n=2))
def h1_neighbourhood(spark, sf):
    seeds = spark.createDataFrame([(START,)], "seed string")
    return G.hops(seeds, A.edges(spark, sf), 2).select("id", "hop")


@query("""WITH RECURSIVE way AS (SELECT source_id AS s, target_id AS t FROM edges UNION SELECT target_id, source_id FROM edges),
seeds AS (SELECT id FROM nodes WHERE type = 'Class' AND line_start = 1),
r AS (SELECT id, 0 AS hop FROM seeds UNION SELECT t, hop + 1 FROM r JOIN way ON s = id WHERE hop < 2)
SELECT id, min(hop) AS hop FROM r GROUP BY id""")
def h2_nearest_hop(spark, sf):
    seeds = A.nodes(spark, sf).where("type = 'Class' and line_start = 1").select(F.col("id").alias("seed"))
    return G.nearest_hop(seeds, A.edges(spark, sf), 2)


@query("""WITH RECURSIVE q AS (SELECT source_id AS id FROM edges WHERE source_id IN (SELECT target_id FROM edges) GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), r AS (SELECT id FROM q UNION SELECT target_id FROM r JOIN edges ON source_id = id), u AS (SELECT id FROM q UNION SELECT source_id FROM u JOIN edges ON target_id = id),
own AS (SELECT DISTINCT source_id, target_id FROM edges, q WHERE source_id = id OR target_id = id)
SELECT (SELECT count(DISTINCT source_id) FROM edges JOIN q ON target_id = id WHERE relation = 'calls') AS callers, (SELECT count(DISTINCT target_id) FROM edges JOIN q ON source_id = id WHERE relation = 'calls') AS callees,
  (SELECT count(*) FROM own) AS degree, (SELECT count(*) - 1 FROM r) AS reachable, (SELECT count(*) - 1 FROM u) AS dependents, (SELECT count(*) FROM own) > 20 AS is_hub""")
def h4_impact(spark, sf):
    """Of the node with the most edges out of it, of those with edges into them."""
    edges = materialise(A.edges(spark, sf), "edges")
    between = edges.join(edges.select(F.col("target_id").alias("source_id")), "source_id", "left_semi")
    node = between.groupBy("source_id").count().orderBy(F.desc("count"), "source_id").first()[0]
    return G.impact(edges, node)


@query("""WITH RECURSIVE way AS (SELECT source_id AS s, target_id AS t FROM edges UNION SELECT target_id, source_id FROM edges),
r AS (SELECT DISTINCT s AS id, s AS c FROM way UNION SELECT t, c FROM r JOIN way ON s = id)
SELECT id, min(c) AS component FROM r GROUP BY id""")
def h5_components(spark, sf):
    return CC.connected_components(A.edges(spark, sf), "source_id", "target_id")


@query("""WITH o AS (SELECT source_id, count(*) AS n FROM edges GROUP BY 1) SELECT e.source_id, target_id, relation, CASE WHEN n > floor(0.002 * (SELECT count(*) FROM nodes)) THEN weight * 0.3 ELSE weight END AS weight,
n > floor(0.002 * (SELECT count(*) FROM nodes)) AS dampened FROM edges e JOIN o ON e.source_id = o.source_id""")
def h6_dampening(spark, sf):
    return G.dampen_hubs(A.edges(spark, sf), A.nodes(spark, sf).count(), 0.002, 0.3).select("source_id", "target_id", "relation", "weight", "dampened")


@query("""WITH p AS (SELECT path, split_part(path, '/', 1) AS a, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS b FROM files)
SELECT b AS parent, path AS child, 'File' AS kind FROM p UNION SELECT '.', a, 'Module' FROM p UNION SELECT a, b, 'Module' FROM p""")
def h7_containment(spark, sf):
    return G.containment(A.files(spark, sf))


@query("""WITH j AS (SELECT c.id AS child, p.id AS parent, row_number() OVER (PARTITION BY c.id ORDER BY p.line_end - p.line_start, -p.line_start, p.id) AS r
  FROM nodes p JOIN nodes c ON p.file_path = c.file_path AND p.line_start <= c.line_start AND p.line_end >= c.line_end
  AND (p.line_end - p.line_start > c.line_end - c.line_start OR (p.line_start = c.line_start AND p.line_end = c.line_end AND p.id < c.id)))
SELECT parent, child FROM j WHERE r = 1""")
def h8_nesting(spark, sf):
    return G.nesting(A.nodes(spark, sf))


@query("""WITH x AS (SELECT target_id AS id, string_agg(name, ', ' ORDER BY name) AS s FROM edges JOIN nodes ON source_id = id WHERE relation = 'calls' GROUP BY 1),
y AS (SELECT source_id AS id, string_agg(name, ', ' ORDER BY name) AS s FROM edges JOIN nodes ON target_id = id WHERE relation = 'calls' GROUP BY 1)
SELECT n.id, concat_ws(chr(10), type || ' ' || name, 'File: ' || file_path, 'Callers: ' || x.s, 'Callees: ' || y.s) AS text FROM nodes n LEFT JOIN x ON n.id = x.id LEFT JOIN y ON n.id = y.id""")
def h10_neighbourhood_text(spark, sf):
    return G.neighbourhood_text(A.edges(spark, sf), A.nodes(spark, sf))


@query("""SELECT id, name, type FROM nodes WHERE type <> 'Field' UNION ALL SELECT id, upper(name), 'Class' FROM nodes WHERE type = 'Field'""")
def i1_upsert(spark, sf):
    nodes = A.nodes(spark, sf).select("id", "name", "type")
    return U.upsert(nodes, nodes.where("type = 'Field'").select("id", F.upper("name").alias("name"), F.lit("Class").alias("type")), ["id"])


@query("""WITH r AS (SELECT l_suppkey % 10 AS source, l_partkey AS target, l_discount AS weight, l_returnflag || l_linestatus AS relation, l_orderkey::VARCHAR AS doc, l_orderkey * 1000000 + l_suppkey * 10 + l_linenumber AS seq FROM lineitem)
SELECT source, target, max(weight) AS weight, min(doc) AS first_doc, count(DISTINCT doc) AS n_docs FROM r GROUP BY 1, 2""")
def i2_merge_edges(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("source"), F.col("l_partkey").alias("target"), F.col("l_discount").alias("weight"), F.concat("l_returnflag", "l_linestatus").alias("relation"),
        F.array(F.col("l_orderkey").cast("string")).alias("source_docs"), (F.col("l_orderkey") * 1000000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return U.merge_provenance(rows).select("source", "target", "weight", F.col("source_docs")[0].alias("first_doc"), F.size("source_docs").cast("long").alias("n_docs"))


@query("""SELECT source_id, target_id, relation FROM edges WHERE source_id NOT IN (SELECT id FROM nodes WHERE file_path LIKE 'economy/%') AND target_id NOT IN (SELECT id FROM nodes WHERE file_path LIKE 'economy/%')""")
def i3_delete_files(spark, sf):
    nodes = A.nodes(spark, sf)
    gone = nodes.where(F.col("file_path").startswith("economy/")).select("file_path").distinct()
    return U.delete_file(nodes, A.edges(spark, sf), gone)[1].select("source_id", "target_id", "relation")


@query("""SELECT source, target, len(list_filter(source_docs, lambda d: d <> '1')) AS n FROM kg_edges WHERE len(list_filter(source_docs, lambda d: d <> '1')) > 0""")
def i4_retract(spark, sf):
    return U.retract(A.kg_edges(spark, sf), F.lit("1")).select("source", "target", F.size("source_docs").cast("long").alias("n"))


@query("SELECT source_id, target_id FROM edges WHERE source_id <> 'n1' AND target_id <> 'n1' AND source_id <> 'n2' AND target_id <> 'n2'")
def i5_delete_nodes(spark, sf):
    ids = spark.createDataFrame([("n1",), ("n2",)], "id string")
    return U.delete_nodes(A.nodes(spark, sf), A.edges(spark, sf), ids)[1].select("source_id", "target_id")


@query("""SELECT n.path, o.hash IS NULL OR o.hash <> n.hash AS todo FROM new_files n LEFT JOIN old_files o ON n.path = o.path""")
def i8_to_process(spark, sf):
    return U.to_process(A.new_files(spark, sf), A.old_files(spark, sf)).select("path", "todo")


@query("""WITH e AS (SELECT file_path, count(*) AS n FROM edges JOIN nodes ON source_id = id GROUP BY 1)
SELECT n.file_path, count(*) AS n_nodes, coalesce(any_value(e.n), 0) AS n_edges FROM nodes n LEFT JOIN e ON n.file_path = e.file_path GROUP BY 1""")
def i9_file_state(spark, sf):
    return U.file_state(A.nodes(spark, sf), A.edges(spark, sf))


@query("""SELECT sha, CASE WHEN intent IN ('fix', 'docs') THEN upper(subject) ELSE subject END AS subject, CASE WHEN intent = 'docs' THEN 'new' ELSE intent END AS intent FROM commits""")
def i10_keep_enrichment(spark, sf):
    every = A.commits(spark, sf).select("sha", "subject", "intent")
    old = every.where("intent <> 'docs'")
    new = every.where("intent in ('fix', 'docs')").select("sha", F.upper("subject").alias("subject"), F.lit("new").alias("intent"))
    return U.merge_columns(old, new, "sha", ["subject"], ["intent"])


@query("SELECT sha FROM commits WHERE (date, sha) > (SELECT (date, sha) FROM commits WHERE sha = md5('77'))")
def i11_after_cursor(spark, sf):
    import hashlib

    return U.after_cursor(A.commits(spark, sf).select("date", "sha"), ["date", "sha"], "sha", hashlib.md5(b"77").hexdigest()).select("sha")


@query("SELECT sha FROM commits WHERE date >= TIMESTAMP '1997-01-01'")
def i12_retention(spark, sf):
    return U.drop_before(A.commits(spark, sf), "date", "1997-01-01").select("sha")


@query("""WITH RECURSIVE r AS (SELECT 'n0' AS id, 0 AS hop UNION SELECT target_id, hop + 1 FROM r JOIN edges ON source_id = id WHERE hop < 3 AND relation = 'calls'),
m AS (SELECT id, min(hop) AS hop FROM r GROUP BY id) SELECT source_id, target_id FROM edges WHERE relation = 'calls' AND source_id IN (SELECT id FROM m WHERE hop < 3)""")
def p1_call_graph(spark, sf):
    calls = A.edges(spark, sf).where("relation = 'calls'")
    near = G.hops(spark.createDataFrame([(START,)], "seed string"), calls, 3, directed=True).where("hop < 3").select("id")
    return calls.join(near, F.col("source_id") == F.col("id"), "left_semi").select("source_id", "target_id")


@query("""WITH RECURSIVE s AS (SELECT id FROM nodes WHERE line_start = 50), r AS (SELECT id AS seed, id, 0 AS hop FROM s UNION SELECT seed, source_id, hop + 1 FROM r JOIN edges ON target_id = id WHERE hop < 2),
m AS (SELECT seed, id, min(hop) AS hop FROM r GROUP BY 1, 2), n AS (SELECT id, min(hop) AS hop FROM m WHERE hop > 0 GROUP BY 1)
SELECT file_path AS module, round(sum(1.0 / hop), 6) AS impact FROM n JOIN nodes USING (id) GROUP BY 1""")
def p2_change_impact(spark, sf):
    nodes = A.nodes(spark, sf)
    changed = nodes.where("line_start = 50").select(F.col("id").alias("seed"))
    return G.change_impact(changed, A.edges(spark, sf), nodes, 2).select("module", F.round("impact", 6).alias("impact"))


@query("""SELECT s.file_path AS source_module, t.file_path AS target_module, count(*) AS n FROM edges JOIN nodes s ON source_id = s.id JOIN nodes t ON target_id = t.id WHERE s.file_path <> t.file_path GROUP BY 1, 2""")
def p3_module_dependencies(spark, sf):
    return G.module_dependencies(A.edges(spark, sf), A.nodes(spark, sf))


@query("SELECT regexp_extract(name, '([^ ]+)$', 1) AS family, count(*) AS n FROM nodes GROUP BY 1 HAVING count(*) >= 3")
def p4_naming_families(spark, sf):
    return G.naming_families(A.nodes(spark, sf))


@query("""WITH o AS (SELECT source_id, target_id, sum(weight) AS calls FROM edges WHERE relation = 'calls' GROUP BY 1, 2)
SELECT e.source_id, e.target_id, round(0.3 * least(weight, 1.0) + 0.7 * coalesce(calls / (SELECT max(calls) FROM o), 0), 6) AS blended FROM edges e LEFT JOIN o ON e.source_id = o.source_id AND e.target_id = o.target_id""")
def p5_runtime_weights(spark, sf):
    edges = A.edges(spark, sf)
    seen = edges.where("relation = 'calls'").groupBy("source_id", "target_id").agg(F.sum("weight").alias("calls"))
    return G.runtime_weights(edges, seen).select("source_id", "target_id", F.round("blended", 6).alias("blended"))


@query("""WITH b AS (SELECT p_partkey, 'Class:' || p_brand || ':' || p_size AS base, p_size, row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) - 1 AS k FROM part)
SELECT p_partkey AS col, base || CASE WHEN k > 0 THEN '#' || k ELSE '' END AS id FROM b""")
def e1_overloads(spark, sf):
    rows = table(spark, sf, "part").select(F.lit("Class").alias("type"), F.col("p_brand").alias("file_path"), F.col("p_size").alias("line"), F.col("p_partkey").alias("col"))
    return G.add_ordinals(rows).select("col", "id")


@query("""WITH RECURSIVE r AS (SELECT 'n0' AS id, ['n0'] AS path, 0 AS hop UNION ALL SELECT target_id, min(list_append(path, target_id)), hop + 1 FROM r JOIN (SELECT DISTINCT source_id, target_id FROM edges) ON source_id = id GROUP BY target_id, hop),
f AS (SELECT id, min(hop) AS hop FROM r GROUP BY 1)
SELECT array_to_string(path, ' ') AS path FROM r WHERE (id, hop) = (SELECT (id, hop) FROM f ORDER BY hop DESC, id LIMIT 1)""")
def h3_shortest_path(spark, sf):
    """From the first node to one of those farthest from it."""
    edges = materialise(A.edges(spark, sf), "edges")
    far = G.hops(spark.createDataFrame([(START,)], "seed string"), edges, directed=True).orderBy(F.desc("hop"), "id").first().id
    return G.shortest_path(edges, START, far).select(F.array_join("path", " ").alias("path"))


@query("""WITH t AS (SELECT DISTINCT sha, path FROM changes), live AS (SELECT DISTINCT path FROM changes WHERE path NOT LIKE 'Brand1/%'),
c AS (SELECT a.path AS x, b.path AS y, count(*) AS n FROM t a JOIN t b ON a.sha = b.sha AND a.path < b.path GROUP BY 1, 2 HAVING count(*) >= 2),
d AS (SELECT split_part(path, '/', 1) AS a, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS b, path FROM live)
SELECT 'contains' AS relation, x AS source_id, y AS target_id, 1.0::DOUBLE AS weight FROM (SELECT '.' AS x, a AS y FROM d UNION SELECT a, b FROM d UNION SELECT b, path FROM d)
UNION ALL SELECT 'co_changes', x, y, n::DOUBLE FROM c WHERE x IN (SELECT path FROM live) AND y IN (SELECT path FROM live)
UNION ALL SELECT 'node', x, y, NULL FROM (SELECT '.' AS x, 'Module' AS y UNION SELECT a, 'Module' FROM d UNION SELECT b, 'Module' FROM d UNION SELECT path, 'File' FROM d)""")
def h9_topology(spark, sf):
    rows, files = A.touched(spark, sf)
    rows = materialise(rows, "changes")
    live = files.where(~F.col("name").startswith("Brand1/")).join(by_key(rows.select("path").distinct()), "path", "left_semi").select(F.col("name").alias("path"))
    nodes, edges = G.build_topology(live, rows, files)
    own = nodes.select(F.lit("node").alias("relation"), F.col("id").alias("source_id"), F.col("type").alias("target_id"), F.lit(None).cast("double").alias("weight"))
    return edges.select(*own.columns).unionByName(own)
