"""Queries of aggregates, ranking, retrieval, history, model rows and streams."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import extraction as X
from cairn.operators import grounding as GR
from cairn.operators import model_rows as M
from cairn.operators import quality as Q
from cairn.operators import retrieval as R
from cairn.operators import temporal as TP
from cairn.operators import vector_index as V
from cairn.operators.upsert import last_writes
from cairn.plans import adapters as A
from cairn.plans.catalog import query
from cairn.session import by_key, materialise, scratch, spread, table
from cairn.streaming import live


@query("""SELECT ext, dir, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM (SELECT regexp_extract(path, '\\.[a-z]+$') AS ext, split_part(path, '/', 1) AS dir, size_bytes FROM files) GROUP BY GROUPING SETS ((ext), (dir), ())""")
def d6_inventory(spark, sf):
    rows = A.files(spark, sf).select(T.extension(F.col("path")).alias("ext"), F.split("path", "/")[0].alias("dir"), "size_bytes")
    return rows.groupingSets([["ext"], ["dir"], []], "ext", "dir").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("""WITH g AS (SELECT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS module, status, list_sort(list(DISTINCT split_part(path, '/', 3))) AS names FROM changes GROUP BY 1, 2)
SELECT module, status AS action, len(names)::INT AS n, array_to_string(names[1:5], ', ') || CASE WHEN len(names) > 5 THEN ' and ' || (len(names) - 5) || ' more' ELSE '' END AS text FROM g""")
def d7_change_summary(spark, sf):
    rows = A.changes(spark, sf).select(T.module_path(F.col("path")).alias("module"), F.col("status").alias("action"), F.split("path", "/")[2].alias("path"))
    return TP.change_entry(rows, "module", 5)


@query("""SELECT source, count(*) AS total, count(*) FILTER (abstained) AS abstained, count(*) FILTER (NOT abstained AND passed) AS passed, count(*) FILTER (NOT abstained AND NOT passed) AS failed
FROM checks JOIN documents USING (doc_id) GROUP BY 1""")
def d8_check_counters(spark, sf):
    return Q.check_counters(A.checks(spark, sf).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id"), "source")


@query("""SELECT o_custkey AS path, arg_max(o_totalprice, o_orderkey) AS price, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1""")
def d9_merge_reports(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("path"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), "o_orderkey")
    return Q.merge_reports(rows, ["path"], "o_orderkey")


@query("""WITH c AS (SELECT lang, count(*) AS total, count(*) FILTER (NOT abstained AND passed) AS passed FROM checks JOIN documents USING (doc_id) GROUP BY 1)
SELECT lang, total, passed, round((total - passed) * 100.0 / greatest(total, 1), 1) AS failure_pct FROM c""")
def d10_failure_rates(spark, sf):
    rows = A.checks(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return Q.failure_rates(Q.check_counters(rows, "lang")).select("lang", "total", "passed", "failure_pct")


@query("""SELECT ts::DATE AS day, count(*) AS n, sum((length(props) + duration_ms::INT) // 3)::BIGINT AS tokens, count(*) FILTER (NOT success) AS errors FROM tool_calls GROUP BY ROLLUP (1)""")
def d11_usage(spark, sf):
    log = A.tool_calls(spark, sf).select("ts", F.col("props").alias("query"), F.rint("duration_ms").cast("int").alias("response_length"), F.when(~F.col("success"), "error").alias("error"))
    return Q.usage_by_day(log)


@query("SELECT count(*) AS commits, count(enriched_at) AS enriched FROM commits")
def d12_commit_counters(spark, sf):
    return A.commits(spark, sf).agg(F.count("*").alias("commits"), F.count("enriched_at").alias("enriched"))


@query("SELECT lang AS kind, count(*) AS n, max(size_bytes) AS modified FROM files GROUP BY 1")
def d13_doc_stats(spark, sf):
    return A.files(spark, sf).groupBy(F.col("lang").alias("kind")).agg(F.count("*").alias("n"), F.max("size_bytes").alias("modified"))


@query("SELECT intent, count(*) AS total, count(enriched_at) AS enriched, count(*) FILTER (enriched_at IS NULL) AS skipped FROM commits GROUP BY 1")
def d16_enrichment_stats(spark, sf):
    return A.commits(spark, sf).groupBy("intent").agg(F.count("*").alias("total"), F.count("enriched_at").alias("enriched"), F.count_if(F.col("enriched_at").isNull()).alias("skipped"))


@query("SELECT date::DATE AS day, count(DISTINCT author) AS authors, count(*) FILTER (risk_score >= 0.5) AS high_risk FROM commits GROUP BY 1")
def d17_author_counts(spark, sf):
    return A.commits(spark, sf).groupBy(F.to_date("date").alias("day")).agg(F.count_distinct("author").alias("authors"), F.count_if(F.col("risk_score") >= 0.5).alias("high_risk"))


@query("""WITH p AS (SELECT path, size_bytes, unnest(['.', split_part(path, '/', 1), split_part(path, '/', 1) || '/' || split_part(path, '/', 2)]) AS dir FROM files) SELECT dir, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM p GROUP BY 1""")
def d18_directories(spark, sf):
    from cairn.operators.graph import ancestors

    rows = A.files(spark, sf).select(F.explode(ancestors(F.col("path"))).alias("dir"), "size_bytes")
    return rows.groupBy("dir").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("""WITH r AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents) SELECT source, doc_id, CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS text FROM r WHERE k <= 3""")
def e5_recent_reports(spark, sf):
    rows = table(spark, sf, "documents").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))).where("k <= 3")
    return rows.select("source", "doc_id", F.when(F.length("text") > 2000, F.concat(F.left("text", F.lit(2000)), F.lit("..."))).otherwise(F.col("text")).alias("text"))


@query("SELECT conv_id, turn FROM conversations c WHERE turn <> (SELECT max(turn) FROM conversations d WHERE c.conv_id = d.conv_id)")
def e6_undo_latest(spark, sf):
    rows = table(spark, sf, "conversations")
    last = last_writes(rows.select("conv_id", "turn"), ["conv_id"], "turn")
    return rows.select("conv_id", "turn").join(last, ["conv_id", "turn"], "left_anti")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 2")
def e9_history(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn"))))
    return rows.where("k <= 2").select("conv_id", "turn", "role")


@query("SELECT doc_id, path FROM files ORDER BY NOT ends_with(path, '.md'), lower(path), doc_id LIMIT 200")
def f4_composite_order(spark, sf):
    return A.files(spark, sf).orderBy(~F.col("path").endswith(".md"), F.lower("path"), "doc_id").limit(200).select("doc_id", "path")


@query("""SELECT path FROM old_files EXCEPT SELECT path FROM new_files UNION ALL (SELECT path FROM new_files INTERSECT SELECT path FROM old_files)""")
def g2_path_sets(spark, sf):
    old, new = A.old_files(spark, sf).select("path"), A.new_files(spark, sf).select("path")
    return old.subtract(new).unionByName(new.intersect(old))


@query("""SELECT n_nationkey, len(list_distinct(list_concat(a.source_docs, b.source_docs))) AS n FROM nation JOIN (SELECT source, list_distinct(flatten(list(source_docs))) AS source_docs FROM kg_edges GROUP BY 1) a ON a.source = 'nation:' || n_nationkey
JOIN (SELECT source, list_distinct(flatten(list(source_docs))) AS source_docs FROM kg_edges GROUP BY 1) b ON b.source = 'nation:' || ((n_nationkey + 1) % 25)""")
def g3_provenance_union(spark, sf):
    docs = A.kg_edges(spark, sf).select("source", F.explode("source_docs").alias("doc")).distinct()
    own = docs.select(F.substring_index("source", ":", -1).cast("int").alias("n"), "doc")
    both = own.select(F.col("n").alias("n_nationkey"), "doc").unionByName(own.select(((F.col("n") + 24) % 25).alias("n_nationkey"), "doc"))
    sides = own.select("n").distinct()
    kept = sides.join(sides.select(((F.col("n") + 24) % 25).alias("n")), "n").select(F.col("n").alias("n_nationkey"))
    return both.distinct().join(kept, "n_nationkey", "left_semi").groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT lower(unnest(string_split_regex(text, '[^a-zA-Z]+'))) AS word FROM benchmark UNION SELECT DISTINCT lower(p_name) FROM part UNION SELECT 'the'""")
def g4_allow_list(spark, sf):
    known = table(spark, sf, "benchmark").select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("word"))
    noise = table(spark, sf, "part").select(F.col("p_name").alias("word"))
    return known.unionByName(noise).unionByName(spark.createDataFrame([("the",)], "word string")).select(F.lower("word").alias("word")).distinct()


@query("""SELECT 'context' AS label, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'workspace', count(*), sum(length(html))::BIGINT FROM pages UNION ALL SELECT 'reports', count(*), sum(length(text))::BIGINT FROM conversations""")
def g5_corpus_union(spark, sf):
    own = lambda name, col, label: table(spark, sf, name).select(F.lit(label).alias("label"), F.col(col).alias("text"))
    rows = own("documents", "text", "context").unionByName(own("pages", "html", "workspace")).unionByName(own("conversations", "text", "reports"))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT sha, least(1.0::DOUBLE, round(score::VARCHAR::DECIMAL(30, 20), 2)::DOUBLE) AS risk_score FROM (SELECT sha, CASE WHEN n > 5 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN hub THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN config THEN 0.2::DOUBLE ELSE 0 END + least(0.4::DOUBLE, greatest(net, 0)::DOUBLE / 100 * 0.1::DOUBLE) AS score FROM
(SELECT sha, count(*) AS n, bool_or(path LIKE '%.yaml') AS config, bool_or(path LIKE 'Brand1/economy/%') AS hub, sum(insertions) - sum(deletions) AS net FROM changes GROUP BY 1))""")
def k1_risk_scores(spark, sf):
    hubs = spark.createDataFrame([("Brand1/economy",)], "module string")
    return TP.risk_scores(A.changes(spark, sf), hubs)


@query("SELECT DISTINCT module FROM (SELECT file_path AS module, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) JOIN nodes USING (id) GROUP BY 1) WHERE n > 10")
def k2_hub_modules(spark, sf):
    from cairn.operators.graph import degrees

    own = degrees(A.edges(spark, sf)).join(by_key(A.nodes(spark, sf)), "id").select(F.col("file_path").alias("module"), "degree")
    return TP.hub_modules(own)


def _vectors(spark, sf):
    """Queries are the vectors whose id is divisible by 50; the index is all vectors."""
    every = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return every.where("id % 50 = 0").select(F.col("id").alias("query_id"), "embedding"), every


def _index(spark, sf):
    docs = A.files(spark, sf).select(F.col("doc_id").alias("id"), F.col("path").alias("source"), F.col("content").alias("text"), "doc_level")
    return _vectors(spark, sf)[0], _vectors(spark, sf)[1].join(docs, "id")


SCORES = """s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0)"""
INDEXED = """x AS (SELECT s.*, path AS source, content AS text, doc_level FROM s JOIN files ON id = doc_id)"""


@query(f"WITH {SCORES} SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def l1_cosine_top_k(spark, sf):
    return R.cosine_top_k(*_vectors(spark, sf), 10)


@query(f"WITH {SCORES}, {INDEXED} SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x WHERE doc_level IN ('L1', 'code')) WHERE rank <= 5")
def l2_filtered_search(spark, sf):
    queries, index = _index(spark, sf)
    return R.cosine_top_k(queries, R.filtered(index, ["L1", "code"]), 5).select("query_id", "id", "score")


@query(f"WITH {SCORES} SELECT query_id, id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10")
def l1_pruned_top_k(spark, sf):
    """The same search by way of the index of cells."""
    queries, every = _vectors(spark, sf)
    return V.search(queries, V.build(every), 10)[0]


@query(f"WITH {SCORES}, {INDEXED} SELECT query_id, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x WHERE doc_level IN ('L1', 'code')) WHERE rank <= 5")
def l2_pruned_filtered_search(spark, sf):
    queries, index = _index(spark, sf)
    built = V.build(index.select("id", "embedding", "doc_level"))
    return V.search(queries, built.where(F.col("doc_level").isin("L1", "code")), 5)[0].select("query_id", "id", "score")


@query("SELECT DISTINCT doc_level FROM files WHERE doc_level LIKE 'L%' AND doc_level <> 'L3'")
def l3_levels(spark, sf):
    return R.synthesis_levels(A.files(spark, sf))


HIERARCHY = f"""{SCORES}, {INDEXED}, h AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_level IN ('L0', 'L1', 'L2') ORDER BY score DESC, id) AS half FROM x),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id, source, left(text, 100) ORDER BY score DESC, id) AS same FROM h WHERE half <= 4),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM m WHERE same = 1)"""


@query(f"WITH {HIERARCHY} SELECT query_id, id, score, rank FROM k WHERE rank <= 8")
def l4_hierarchical(spark, sf):
    return R.hierarchical(*_index(spark, sf), 8).select("query_id", "id", "score", "rank")


ENDS = """e AS (SELECT source_id AS s, target_id AS t FROM edges UNION SELECT target_id, source_id FROM edges)"""


def _questions(spark, sf, words: str):
    """(doc_id, text): a question a query, made of the names ($0, $1, $2) of the parts numbered from the query's on."""
    name = lambda k: table(spark, sf, "part").select((F.col("p_partkey") - k).alias("doc_id"), F.col("p_name").alias(f"n{k}"))
    asked = _vectors(spark, sf)[0].select(F.col("query_id").alias("doc_id"))
    for k in range(3):
        asked = asked.join(name(k), "doc_id")
    text = F.lit(words)
    for k in range(3):
        text = F.replace(text, F.lit(f"${k}"), F.col(f"n{k}"))
    return asked.select("doc_id", text.alias("text"))


@query(f"""WITH {HIERARCHY}, {ENDS}, q AS (SELECT a.p_partkey AS q, 'How does the ' || a.p_name || ' fit ' || b.p_name || 's, or (' || c.p_name || ')?' AS text FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 JOIN part c ON c.p_partkey = a.p_partkey + 2 JOIN embeddings ON vec_id = a.p_partkey WHERE vec_id % 50 = 0),
mm AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY id) AS n FROM q JOIN nodes ON contains(lower(text), lower(name))),
near AS (SELECT q, id, 0 AS hop FROM mm WHERE n <= 5 UNION ALL SELECT q, t, 1 FROM mm JOIN e ON s = id WHERE n <= 5),
b AS (SELECT q, path AS source, min(hop) AS hop FROM near JOIN files ON id = 'n' || doc_id JOIN embeddings ON vec_id = doc_id GROUP BY 1, 2)
SELECT k.query_id, k.id, hop IS NOT NULL AS graph_boosted, round(score * (1 + CASE WHEN hop IS NULL THEN 0 ELSE 0.3 / greatest(hop, 1) END), 6) AS score FROM k LEFT JOIN b ON q = k.query_id AND b.source = k.source WHERE rank <= 8""")
def l5_hybrid(spark, sf):
    """Questions in words, whose entities are found in them; their vectors are the search's."""
    queries, index = _index(spark, sf)
    asked = _questions(spark, sf, "How does the $0 fit $1s, or ($2)?")
    labels, classes = GR.label_classes(A.nodes(spark, sf).select("id", F.col("name").alias("label")), 5)
    found = GR.find_entities(asked, labels, 0.75, classes=classes)
    sources = index.select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), "source")
    hits = R.hybrid(queries, index, found.withColumnRenamed("doc_id", "query_id"), A.edges(spark, sf), sources, 8, max_hops=1, classes=classes)
    return hits.where("source <> 'knowledge_graph'").select("query_id", "id", "graph_boosted", F.round("score", 6).alias("score"))


@query(f"""WITH {ENDS}, q AS (SELECT vec_id AS q, 'where are ' || replace(p_name, ' ', '') || ', ' || left(p_name, 4) || 's and ' || replace(p_name, ' ', '_') || ' kept' AS text FROM embeddings JOIN part ON p_partkey = vec_id WHERE vec_id % 50 = 0),
w AS (SELECT q, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM q), v AS (SELECT q, pos, trim(w, '.,;:!?()') AS w FROM w),
f AS (SELECT q, name, 1 - levenshtein(w, name) / greatest(length(w), length(name)) AS ratio, pos FROM v, (SELECT DISTINCT lower(name) AS name FROM nodes) WHERE length(w) >= 3 AND 2.0 * least(length(w), length(name)) / (length(w) + length(name)) >= 0.6),
b AS (SELECT q, name, arg_min(ratio, pos) AS c FROM f WHERE ratio >= 0.6 GROUP BY 1, 2), m AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY c DESC, id) AS n FROM b JOIN nodes ON lower(nodes.name) = b.name),
t AS (SELECT q, count(*) AS matches FROM m GROUP BY 1), h AS (SELECT q, count(DISTINCT e.t) AS n FROM m JOIN e ON s = id WHERE n <= 3 GROUP BY 1)
SELECT t.q AS query_id, matches, coalesce(h.n, 0) AS neighbours FROM t LEFT JOIN h ON t.q = h.q""")
def l6_entity_search(spark, sf):
    """Questions with names that are no label's own, found by similarity; words and labels differ in blanks and letters."""
    name = F.col("p_name")
    text = F.concat(F.lit("where are "), F.replace(name, F.lit(" "), F.lit("")), F.lit(", "), F.left(name, F.lit(4)), F.lit("s and "), F.replace(name, F.lit(" "), F.lit("_")), F.lit(" kept"))
    asked = table(spark, sf, "part").join(_vectors(spark, sf)[0], F.col("p_partkey") == F.col("query_id")).select(F.col("query_id").alias("doc_id"), text.alias("text"))
    labels, classes = GR.label_classes(A.nodes(spark, sf).select("id", F.col("name").alias("label")), 3)
    found = GR.find_entities(asked, labels, 0.6, native=True, classes=classes)
    return R.entity_search(found.withColumnRenamed("doc_id", "query_id"), A.edges(spark, sf), classes=classes)


@query(f"WITH {SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s), c AS (SELECT *, CASE WHEN label = 3 THEN 2.0 - score ELSE score END AS final FROM r JOIN embeddings ON vec_id = id WHERE rank <= 10), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id)::INT AS place FROM c) SELECT query_id, id, place AS rank, round(final, 4) AS score FROM f WHERE place <= 5")
def k7_rerank(spark, sf):
    hits = materialise(R.cosine_top_k(*_vectors(spark, sf), 10), "hits")
    labels = table(spark, sf, "embeddings").where("label = 3").select(F.col("vec_id").alias("id"))
    scores = hits.join(labels, "id").select("query_id", "id", (2.0 - F.col("score")).alias("rerank_score"))
    return R.projected(R.rerank(hits, scores, 5)).select("query_id", "id", "rank", "score")


@query(f"""WITH {HIERARCHY} SELECT query_id, string_agg('[Source ' || rank || '] ' || source || ' (' || doc_level || ', score ' || printf('%.2f', score) || ')' || CASE WHEN id % 2 = 0 THEN ' +graph' ELSE '' END || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS text FROM k WHERE rank <= 8 GROUP BY 1""")
def j15_context_blocks(spark, sf):
    queries, index = _index(spark, sf)
    hits = R.with_texts(R.hierarchical(queries, index, 8), index)
    return R.context_blocks(hits.withColumn("graph_boosted", F.col("id") % 2 == 0))


@query("""WITH n AS (SELECT id, line_start AS q, CASE type WHEN 'Class' THEN 0 ELSE 1 END AS hop FROM nodes), r AS (SELECT DISTINCT s.q, s.hop, source_id, relation, target_id FROM edges JOIN n s ON source_id = s.id JOIN n t ON target_id = t.id AND s.q = t.q),
w AS (SELECT *, row_number() OVER (PARTITION BY q, source_id ORDER BY relation, target_id) AS k FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hop, source_id, k) AS place FROM w WHERE k <= 3)
SELECT q AS query_id, string_agg(source_id || ' --' || relation || '--> ' || target_id, chr(10) ORDER BY place) AS text FROM p WHERE place <= 50 GROUP BY 1""")
def e7_subgraph_lines(spark, sf):
    """The nodes that begin on one line of their files are near a query each; classes are closest."""
    near = A.nodes(spark, sf).select(F.col("line_start").alias("query_id"), "id", F.when(F.col("type") == "Class", 0).otherwise(1).alias("hop"))
    return R.subgraph_lines(A.edges(spark, sf), near)


@query("""WITH r AS (SELECT event_id AS key, event_type, value, repeat(props || ' ', CASE WHEN event_id % 3 = 0 THEN 30 ELSE 1 END) AS d, event_id % 5 = 4 AS broken FROM events)
SELECT key, CASE WHEN broken THEN '[INSUFFICIENT_EVIDENCE]' WHEN length(d) > 200 THEN left(d, 197) || '...' ELSE d END AS description, CASE WHEN NOT broken AND event_type IN ('click', 'view') THEN event_type ELSE 'unknown' END AS intent,
CASE WHEN broken THEN 0 ELSE least(greatest(value / 50 - 0.5, 0), 1) END AS confidence FROM r""")
def m2_enrichment(spark, sf):
    """Descriptions of nodes: long ones, unknown intents, confidences out of range, and answers that can't be read."""
    d = F.repeat(F.concat("props", F.lit(" ")), F.when(F.col("event_id") % 3 == 0, 30).otherwise(1))
    raw = F.to_json(F.struct(d.alias("description"), F.col("event_type").alias("intent"), (F.col("value") / 50 - 0.5).alias("confidence")))
    raw = F.when(F.col("event_id") % 5 == 4, F.left(raw, F.lit(20))).otherwise(F.concat(F.lit("Here it is:\n"), raw))
    return M.parse_enrichment(table(spark, sf, "events").select(F.col("event_id").alias("key"), raw.alias("raw")), ["click", "view"])


@query("""SELECT event_id AS key, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (regexp_extract(raw, '"k": (\\d+)', 1))::INT END AS k FROM responses""")
def m2_json_answers(spark, sf):
    own = F.from_json(M.json_object(F.col("raw")), "k int")
    return A.responses(spark, sf).select(F.col("event_id").alias("key"), own["k"].alias("k"))


@query("""SELECT event_id AS key, 'part:' || (event_id % 100) AS source, 'module:k_' || regexp_extract(props, '(\\d+)', 1) AS target, CASE WHEN event_type = 'click' THEN 'calls' ELSE 'uses' END AS relation, least(value / 10, 1.0) AS weight FROM events""")
def m1_triplets(spark, sf):
    raw = F.concat(
        F.lit('```json\n{"nodes": [], "edges": [{"source": "Part:'), (F.col("event_id") % 100).cast("string"), F.lit('", "target": "K '), F.regexp_extract("props", r"(\d+)", 1),
        F.lit('", "relation": "'), F.when(F.col("event_type") == "click", "calls").otherwise("odd"), F.lit('", "weight": '), (F.col("value") / 10).cast("string"), F.lit('}, {"source": "x"}]}\n```'),
    )
    answers = table(spark, sf, "events").select(F.col("event_id").alias("key"), raw.alias("raw"))
    return M.parse_triplets(answers, ["Module"], ["calls", "uses"])[1]


@query("""SELECT sha AS key, CASE WHEN intent IN ('fix', 'docs') THEN intent ELSE 'unknown' END AS intent, subject AS summary, len(modules)::INT AS n FROM commits""")
def m3_commit_answers(spark, sf):
    raw = F.to_json(F.struct("intent", F.col("subject").alias("summary"), F.concat("modules", F.array(F.lit(""))).alias("modules_affected")))
    found = M.parse_commit_answers(A.commits(spark, sf).select(F.col("sha").alias("key"), F.concat(F.lit("```json\n"), raw, F.lit("\n```")).alias("raw")), ["fix", "docs"])
    return found.select("key", "intent", "summary", F.size("modules").alias("n"))


@query("""SELECT sha AS key, path AS filepath, CASE status WHEN 'M' THEN 'modify' ELSE lower(status) END AS action, count(*) AS n FROM changes GROUP BY 1, 2, 3""")
def m5_tasks(spark, sf):
    task = F.struct(F.col("path").alias("filepath"), F.when(F.col("status") != "M", F.lower("status")).alias("action"))
    own = A.changes(spark, sf).groupBy("sha").agg(F.to_json(F.collect_list(task)).alias("j"))
    answers = own.select(F.col("sha").alias("key"), F.concat(F.lit("Tasks: "), "j", F.lit(" done")).alias("raw"))
    return M.parse_tasks(answers).groupBy("key", "filepath", "action").agg(F.count("*").alias("n"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '[^a-zA-Z0-9_\\x{80}-\\x{10FFFF}]', ' ', 'g'), ' +')) AS w FROM documents),
n AS (SELECT DISTINCT doc_id FROM w WHERE regexp_full_match(w, '[A-Z][A-Z0-9]{2,}(_[A-Z0-9]+)*'))
SELECT d.doc_id AS key, CASE WHEN n.doc_id IS NULL THEN 1 ELSE 2 END AS attempts, FALSE AS abstained FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id""")
def m4_retries(spark, sf):
    """A stand-in model repeats its prompt; names in capitals are rejected until told to avoid them."""
    def model(texts):
        return [t.split("\nDo not mention")[0].lower() if "Do not mention" in t else t for t in texts]

    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("prompt"))
    issues = lambda answers: answers.select("key", F.explode(T.candidates(F.col("answer"))).alias("c")).where("c.kind = 'all_caps'").select("key", F.col("c.name").alias("name"))
    return M.retry_until_grounded(rows, model, issues).select("key", "attempts", "abstained")


#: A commit's lines, intents with their headings, and a digest of rows (key, title, commits of a summary each).
DIGEST = """i AS (SELECT * FROM (VALUES (0, 'feature', 'Features'), (1, 'fix', 'Fixes'), (2, 'refactor', 'Refactors'), (3, 'chore', 'Chore'), (4, 'docs', 'Documentation'), (5, 'test', 'Tests'), (6, 'unknown', 'Unknown')) v(place, intent, label)),
l AS (SELECT *, '- `' || intent || '`: ' || subject || CASE WHEN risk_score >= 0.5 THEN ' ⚠️ Risk: ' || printf('%.1f', risk_score) ELSE '' END || ' → (`' || left(sha, 7) || '`)'
  || CASE WHEN len(modules) > 0 THEN chr(10) || '  Modules: `' || array_to_string(modules, ', ') || '`' ELSE '' END
  || CASE WHEN starts_with(summary, '[INSUFFICIENT_EVIDENCE]') THEN chr(10) || '  _Summary unavailable_' WHEN summary <> '' AND summary <> subject THEN chr(10) || '  _' || left(summary, 200) || '_' ELSE '' END AS line FROM k),
p AS (SELECT key, place, label, count(*) AS n, string_agg(line, chr(10) ORDER BY date, sha) AS lines FROM l JOIN i USING (intent) GROUP BY ALL),
b AS (SELECT key, string_agg('## ' || label || ' (' || n || ')' || chr(10) || chr(10) || lines || chr(10) || chr(10), '' ORDER BY place) AS sections FROM p GROUP BY 1),
c AS (SELECT key, title, count(*) AS commits, count(DISTINCT author) AS authors, count(*) FILTER (risk_score >= 0.5) AS high_risk FROM k GROUP BY 1, 2)
SELECT key, commits, authors, high_risk, '# ' || title || chr(10) || chr(10) || '**' || commits || CASE commits WHEN 1 THEN ' commit**' ELSE ' commits**' END || chr(10) || 'by ' || authors || CASE authors WHEN 1 THEN ' author.' ELSE ' authors.' END || chr(10)
  || CASE WHEN high_risk > 0 THEN '**' || high_risk || CASE high_risk WHEN 1 THEN ' high-risk** change.' ELSE ' high-risk** changes.' END || chr(10) ELSE '' END || chr(10) || sections
  || '---' || chr(10) || chr(10) || '*Generated from the change history.*' || chr(10) AS body FROM c JOIN b USING (key)"""
#: Summaries that repeat the subject, abstain, say more, or are missing.
SUMMARY = """CASE ascii(sha) % 4 WHEN 0 THEN subject WHEN 1 THEN '[INSUFFICIENT_EVIDENCE] of ' || subject WHEN 2 THEN repeat(subject || '. ', 30) ELSE '' END"""


def _summarised(spark, sf):
    kind = F.ascii("sha") % 4
    summary = F.when(kind == 0, F.col("subject")).when(kind == 1, F.concat(F.lit(T.ABSTAIN + " of "), "subject")).when(kind == 2, F.repeat(F.concat("subject", F.lit(". ")), F.lit(30))).otherwise("")
    return A.commits(spark, sf).withColumn("summary", summary)


def _digest(found):
    return found.select(F.col("key").cast("string").alias("key"), "commits", "authors", "high_risk", "body")


@query(f"""WITH k AS (SELECT date::DATE::VARCHAR AS key, 'Changelog — ' || date::DATE::VARCHAR AS title, *, {SUMMARY} AS summary FROM commits WHERE enriched_at IS NOT NULL), {DIGEST}""")
def n2_daily_digest(spark, sf):
    return _digest(TP.daily(_summarised(spark, sf)))


@query(f"""WITH k AS (SELECT '1997-03-07' AS key, 'Weekly Changelog — 1997-03-01 to 1997-03-07' AS title, *, {SUMMARY} AS summary FROM commits WHERE enriched_at IS NOT NULL AND date::DATE BETWEEN DATE '1997-03-01' AND DATE '1997-03-07'), {DIGEST}""")
def n3_weekly_digest(spark, sf):
    return _digest(TP.weekly(_summarised(spark, sf), "1997-03-07"))


@query(f"""WITH m AS (SELECT unnest(modules) AS key, *, {SUMMARY} AS summary FROM commits WHERE enriched_at IS NOT NULL),
k AS (SELECT * FROM (SELECT *, 'Changelog — Module: ' || key AS title, row_number() OVER (PARTITION BY key ORDER BY date DESC, sha DESC) AS n FROM m) WHERE n <= 100), {DIGEST}""")
def n4_module_digest(spark, sf):
    """The newest hundred commits of each module."""
    return _digest(TP.by_module(_summarised(spark, sf)))


#: The same as (file, body).
DIGEST_FILES = DIGEST.replace("SELECT key, commits, authors, high_risk, '# '", "SELECT replace(key, '-', '/') || '.md' AS file, '# '")


@query(f"""WITH k AS (SELECT date::DATE::VARCHAR AS key, 'Changelog — ' || date::DATE::VARCHAR AS title, *, {SUMMARY} AS summary FROM commits WHERE enriched_at IS NOT NULL), {DIGEST_FILES}""")
def a15_digest_files(spark, sf):
    """Daily digests written to a file each, and read back."""
    from cairn.sources import readers

    root = scratch(spark, "digests")
    readers.write_digests(TP.daily(_summarised(spark, sf)).select(F.col("key").alias("day"), "body"), root)
    return readers.read_digests(spark, root).select(F.regexp_extract("path", r"(\d+/\d+/\d+\.md)$", 1).alias("file"), "body")


@query("""SELECT type AS kind, count(*) AS n, min(id) AS first FROM nodes GROUP BY 1 UNION ALL SELECT relation, count(*), min(source_id || '>' || target_id) FROM edges GROUP BY 1""")
def a14_graph_store(spark, sf):
    """The graph written down and loaded again."""
    from cairn.sources import readers

    root = scratch(spark, "graph")
    readers.save_graph(A.nodes(spark, sf), A.edges(spark, sf), root)
    nodes, edges = readers.load_graph(spark, root)
    first = edges.select(F.col("relation").alias("kind"), F.concat("source_id", F.lit(">"), "target_id").alias("id"))
    count = lambda df: df.groupBy("kind").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    return count(nodes.select(F.col("type").alias("kind"), "id")).unionByName(count(first))


RISK = """SELECT sha, least(1.0::DOUBLE, round(score::VARCHAR::DECIMAL(30, 20), 2)::DOUBLE) AS risk, n AS files FROM (SELECT sha, n, CASE WHEN n > 5 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN config THEN 0.2::DOUBLE ELSE 0 END
  + least(0.4::DOUBLE, greatest(net, 0)::DOUBLE / 100 * 0.1::DOUBLE) AS score FROM (SELECT sha, count(*) AS n, bool_or(path LIKE '%.yaml') AS config, sum(insertions) - sum(deletions) AS net FROM changes GROUP BY 1))"""


#: Commits that a file of the log holds.
LOG_ROWS = 1 << 16


@query(f"""WITH r AS ({RISK}), k AS (SELECT date::DATE::VARCHAR AS key, 'Changelog — ' || date::DATE::VARCHAR AS title, c.sha, author, date, subject, intent, modules, coalesce(risk, 0) AS risk_score,
  'Touches ' || len(modules) || ' modules' AS summary FROM commits c LEFT JOIN r ON c.sha = r.sha), {DIGEST_FILES}""")
def n1_changelog(spark, sf):
    """The history as a stream of log lines in several batches; digests as written at its end."""
    from cairn.sources import readers
    from cairn.streaming import changelog

    path = scratch(spark, "changelog")
    stat = F.concat("path", F.lit(" | "), (F.col("insertions") + F.col("deletions")).cast("string"), F.lit(" "), F.repeat(F.lit("+"), F.col("insertions")), F.repeat(F.lit("-"), F.col("deletions")))
    stats = A.changes(spark, sf).groupBy("sha").agg(F.collect_list(stat).alias("stat"))
    line = F.concat_ws("\x1f", "sha", "author", F.col("date").cast("string"), "subject", F.lit(""))
    log = A.commits(spark, sf).join(stats, "sha", "left").select(line.alias("value"), F.coalesce("stat", F.array().cast("array<string>")).alias("stat"))
    files = max(3, -(-table(spark, sf, "orders").count() // LOG_ROWS))
    log.repartition(files, F.col("value")).write.parquet(f"{path}/log")

    def model(prompts):
        import json

        kinds, out = {"1": "fix", "2": "feature", "3": "refactor", "5": "docs"}, []
        for p in prompts:
            subject, *files = p.split("\n")
            modules = sorted({"/".join(f.split("/")[:2]) for f in files if f})
            out.append(json.dumps({"intent": kinds.get(subject[:1], "none"), "summary": f"Touches {len(modules)} modules", "modules_affected": modules}))
        return out

    stream = live.read_files(spark, f"{path}/log", "value string, stat array<string>", -(-files * 2 // 3))
    changelog.changelog_stream(stream, f"{path}/out", f"{path}/checkpoint", model).awaitTermination()
    return readers.read_digests(spark, f"{path}/out/digests").select(F.regexp_extract("path", r"(\d+/\d+/\d+\.md)$", 1).alias("file"), "body")


@query("""WITH d AS (SELECT date::DATE AS day, count(*) AS n FROM commits GROUP BY 1), c AS (SELECT unnest(generate_series((SELECT min(day) FROM d)::TIMESTAMP, (SELECT max(day) FROM d)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day)
SELECT c.day, coalesce(n, 0) AS n FROM c LEFT JOIN d ON c.day = d.day""")
def n5_timeline(spark, sf):
    return TP.timeline(A.commits(spark, sf), gaps=True)


@query("""SELECT date_trunc('hour', ts) AS start, tool, count(*) AS n, round(avg(duration_ms), 6) AS mean_ms, count(*) FILTER (NOT success) AS failures FROM tool_calls GROUP BY 1, 2""")
def n9_call_metrics(spark, sf):
    return Q.call_metrics(A.tool_calls(spark, sf)).withColumn("mean_ms", F.round("mean_ms", 6))


@query("""WITH RECURSIVE o AS (SELECT event_id, tool, epoch(ts) AS sec, row_number() OVER (PARTITION BY tool ORDER BY ts, event_id) AS k FROM tool_calls),
r AS (SELECT event_id, tool, k, sec AS st, 1 AS c, TRUE AS allowed FROM o WHERE k = 1
  UNION ALL SELECT o.event_id, o.tool, o.k, CASE WHEN sec - st >= 3600 THEN sec ELSE st END, CASE WHEN sec - st >= 3600 THEN 1 WHEN c < 3 THEN c + 1 ELSE c END, sec - st >= 3600 OR c < 3 FROM r JOIN o ON o.tool = r.tool AND o.k = r.k + 1)
SELECT event_id, tool, allowed FROM r""")
def n8_rate_limit(spark, sf):
    return live.rate_limit(A.tool_calls(spark, sf), 3600.0, 3)


@query("""SELECT event_type AS tool, count(*) AS n FROM events GROUP BY 1""")
def n1_stream_counts(spark, sf):
    """The events as a stream, each batch added to a table once; then counted."""
    path = scratch(spark, "stream")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    live.upsert_stream(stream, lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/out/batch={n}"), f"{path}/log").awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy(F.col("event_type").alias("tool")).agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE o AS (SELECT tool, CASE WHEN success THEN 1.0::DOUBLE ELSE -2.0 END - CASE WHEN duration_ms > 50 THEN 1.5::DOUBLE ELSE 0 END AS delta, row_number() OVER (PARTITION BY tool ORDER BY ts::DATE, event_id) AS k FROM tool_calls),
r AS (SELECT DISTINCT tool, 0 AS k, 50.0::DOUBLE AS score FROM o UNION ALL SELECT o.tool, o.k, least(greatest(score + delta, 0), 100) FROM r JOIN o ON o.tool = r.tool AND o.k = r.k + 1)
SELECT tool, arg_max(score, k) AS score, arg_max(score, k) < 30 AS quarantined FROM r GROUP BY 1""")
def p6_credit_scores(spark, sf):
    calls = A.tool_calls(spark, sf)
    delta = F.when(F.col("success"), F.lit(1.0)).otherwise(F.lit(-2.0)) - F.when(F.col("duration_ms") > 50, F.lit(1.5)).otherwise(F.lit(0.0))
    return Q.clamped_scores(calls.select("tool", F.to_date("ts").alias("day"), F.col("event_id").alias("n"), delta.alias("delta")))


#: What a line (its first word $1, its last $2) becomes, by extension; the line itself is kept.
DEFINITIONS = {
    ".py": "from $2 import $1\nclass $1($2):\n    def $2():\n        $0\n        $2($1)",
    ".java": "import $2.$1;\npublic class $1 extends $2 implements $1 {\n    private String $1;\n    public void $2() {\n        $0\n        $2($1);\n    }\n}",
    ".js": "import $1 from '$2'\nclass $1 extends $2 {\n    $2() {\n        $0\n        $2($1)\n    }\n}",
    ".ts": "import $1 from '$2'\nclass $1 extends $2 implements $1 {\n    public $2(): string {\n        $0\n        $2($1)\n    }\n}",
    ".go": "import \"$2/$1\"\ntype $1 struct {\n}\nfunc $2() {\n    $0\n    $2($1)\n}",
}


def structured(files):
    """(path, content): definitions around the lines of texts, as their languages have them; Markdown and YAML turn to TypeScript and Go."""
    path = F.regexp_replace(F.regexp_replace("path", r"\.md$", ".ts"), r"\.yaml$", ".go")
    made = F.col("content")
    for ext, lines in DEFINITIONS.items():
        made = F.when(path.endswith(ext), F.regexp_replace("content", r"(?m)^(\p{L}+)[^\n]*?(\p{L}+)\W*?$", lines)).otherwise(made)
    return files.select(path.alias("path"), made.alias("content"))


LINE_HITS = " UNION ALL ".join(
    f"SELECT path, lang, n, ind, '{what}' AS what, regexp_extract(line, '{re.sub(r"[(][?]![^)]*[)]", "", X.of_any_script(pattern)).replace("'", "''")}', 1) AS name FROM li WHERE lang = '{lang}'" for lang, what, pattern in X.PATTERNS
)
MADE = " ".join(f"WHEN ends_with(p, '{ext}') THEN regexp_replace(content, '(?m)^(\\p{{L}}+)[^\\n]*?(\\p{{L}}+)\\W*?$', '{re.sub(r"[$]([0-9])", lambda m: chr(92) + m[1], lines).replace("'", "''")}', 'g')" for ext, lines in DEFINITIONS.items())


@query(f"""WITH p AS (SELECT replace(replace(path, '.md', '.ts'), '.yaml', '.go') AS p, content FROM files), m AS (SELECT p AS path, CASE {MADE} ELSE content END AS c FROM p),
a AS (SELECT path, string_split_regex(c, '\r?\n') AS ls FROM m), u AS (SELECT path, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM a),
li AS MATERIALIZED (SELECT path, CASE regexp_extract(path, '\\.[a-z]+$') WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' ELSE 'go' END AS lang, line, n,
  length(line) - length(regexp_replace(line, '^\\s+', '')) AS ind, left(trim(line, ' '), 1) IN (')', '}}', ']') AS closing FROM u WHERE trim(line, ' ') <> ''),
z AS (SELECT path, max(n) AS z FROM li GROUP BY 1),
h AS MATERIALIZED (SELECT * FROM ({LINE_HITS}) WHERE name <> '' AND NOT (lang IN ('javascript', 'typescript') AND what = 'Method' AND name IN ('if', 'for', 'while', 'switch', 'catch'))),
d AS (SELECT path, n, ind, name, min(what) AS type FROM h WHERE what IN ('Class', 'Method', 'Field') GROUP BY ALL),
x AS (SELECT d.path, d.n, d.ind, min(li.n) AS nxt FROM (SELECT DISTINCT path, n, ind FROM d) d LEFT JOIN li ON li.path = d.path AND li.n > d.n AND li.ind <= d.ind AND NOT closing GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY path, type, n ORDER BY name) - 1 AS k FROM d),
nd AS MATERIALIZED (SELECT type || ':' || k.path || ':' || k.n || CASE WHEN k > 0 THEN '#' || k ELSE '' END AS id, type, name, k.path AS file_path, k.n::INT AS line_start, coalesce(nxt - 1, z)::INT AS line_end FROM k JOIN x ON x.path = k.path AND x.n = k.n JOIN z ON z.path = k.path),
c AS (SELECT DISTINCT path, n, unnest(regexp_extract_all(line, '{X.of_any_script(X.CALL)}', 1)) AS callee FROM li),
o AS (SELECT c.path, c.n, callee, arg_min(id, (line_end - line_start, id)) AS id FROM c JOIN nd ON file_path = c.path AND c.n BETWEEN line_start AND line_end
  WHERE callee NOT IN ({", ".join(f"'{w}'" for w in X.NOT_CALLS)}) AND (c.path, c.n, callee) NOT IN (SELECT file_path, line_start, name FROM nd) GROUP BY ALL),
ct AS (SELECT ch.id AS child, arg_min(pa.id, (pa.line_end - pa.line_start, -pa.line_start, pa.id)) AS parent FROM nd pa JOIN nd ch ON pa.file_path = ch.file_path AND pa.line_start <= ch.line_start AND pa.line_end >= ch.line_end
  AND (pa.line_end - pa.line_start > ch.line_end - ch.line_start OR (pa.line_start = ch.line_start AND pa.line_end = ch.line_end AND pa.id < ch.id)) GROUP BY 1),
e AS (SELECT id AS s, 'UnresolvedCall:' || callee AS t, 'calls' AS r, 0.5::DOUBLE AS w FROM o UNION SELECT 'Module:' || path, 'Module:' || name, 'imports', 1.0 FROM h WHERE what = 'imports'
  UNION SELECT id, 'UnresolvedClass:' || h.name, what, 0.5 FROM h JOIN nd ON file_path = path AND line_start = n AND type = 'Class' WHERE what IN ('extends', 'implements') UNION ALL SELECT parent, child, 'contains', 1.0 FROM ct)
SELECT id AS source_id, type AS kind, name AS target, line_start, line_end, NULL::DOUBLE AS confidence FROM nd UNION ALL SELECT s, r, t, NULL, NULL, w FROM e""")
def j7_structure(spark, sf):
    """All nodes and edges of all texts, in which every line stands within a definition of its own words."""
    nodes, edges = X.extract(structured(spread(A.files(spark, sf))))
    none = F.lit(None)
    own = nodes.select(F.col("id").alias("source_id"), F.col("type").alias("kind"), F.col("name").alias("target"), "line_start", "line_end", none.cast("double").alias("confidence"))
    return own.unionByName(edges.select("source_id", F.col("relation").alias("kind"), F.col("target_id").alias("target"), none.cast("int").alias("line_start"), none.cast("int").alias("line_end"), "confidence"))
