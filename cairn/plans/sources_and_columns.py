"""Queries of readers and column expressions (sources, projections, filters)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.plans import adapters as A
from cairn.plans.catalog import query
from cairn.session import scratch, table
from cairn.sources import history
from cairn.sources import readers as R

EXTENSIONS = [".py", ".java", ".md"]


@query("""SELECT path, size_bytes FROM files WHERE regexp_extract(path, '\\.[^./]+$') IN ('.py', '.java', '.md') AND source <> 'src9' AND size_bytes <= 10000""")
def a1_scan_files(spark, sf):
    found = A.files(spark, sf)
    return found.where(R.kept_paths(F.col("path"), F.col("size_bytes"), EXTENSIONS, ["src9"], 10_000)).select("path", "size_bytes")


@query("""SELECT page_id, ends_with(p, '.html') IS FALSE OR octet_length(encode(html)) > 5000 AS skipped FROM (SELECT page_id, html, lower(regexp_replace(url, '[?#].*$', '')) AS p FROM pages)""")
def a2_skipped_files(spark, sf):
    p = table(spark, sf, "pages").withColumn("p", F.regexp_replace("url", "[?#].*$", ""))
    return p.select("page_id", R.skipped_file(F.col("p"), F.octet_length("html"), [".html"], 5000).alias("skipped"))


@query("""SELECT doc_id, length(text) - length(replace(text, chr(65533), '')) > length(text) * 0.1 AS likely_binary FROM documents""")
def a3_likely_binary(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.likely_binary(F.col("text")).alias("likely_binary"))


@query("""SELECT doc_id, sha256(text) AS sha, md5(regexp_replace(text, '\r\n?', chr(10), 'g')) AS normalised FROM documents""")
def a4_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), R.normalised_hash(F.col("text")).alias("normalised"))


@query("""SELECT sha, author, strftime(date, '%Y-%m-%d') AS date, subject, '' AS body FROM commits""")
def a5_commit_log(spark, sf):
    line = F.concat_ws("\x1f", "sha", F.concat(F.lit(" "), "author"), F.date_format("date", "yyyy-MM-dd"), "subject", F.lit(""))
    lines = A.commits(spark, sf).select(line.alias("value")).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("value")))
    return R.parse_commit_log(lines)


@query("""SELECT DISTINCT sha || '00000000' AS sha, path FROM changes""")
def a6_name_log(spark, sf):
    own = A.changes(spark, sf).groupBy("sha").agg(F.array_join(F.array_sort(F.collect_set(F.replace("path", F.lit("/"), F.lit("\\")))), "\n").alias("names"))
    texts = own.select(F.col("sha").alias("key"), F.concat("sha", F.lit("00000000\n"), "names", F.lit("\n")).alias("text"))
    return R.parse_name_log(texts)


@query("""WITH s AS (SELECT sha, path, min(status) AS status FROM changes WHERE status <> 'M' GROUP BY sha, path)
SELECT c.sha, c.path, insertions, deletions, coalesce(s.status, 'M') AS status FROM changes c LEFT JOIN s ON c.sha = s.sha AND c.path = s.path""")
def a7_diff_stat(spark, sf):
    c = A.changes(spark, sf)
    line = F.concat(F.lit(" "), "path", F.lit(" | "), (F.col("insertions") + F.col("deletions")).cast("string"), F.lit(" "), F.expr("repeat('+', insertions)"), F.expr("repeat('-', deletions)"))
    statuses = c.where("status <> 'M'").groupBy("sha", "path").agg(F.min("status").alias("status"))
    return R.parse_diff_stat(c.select("sha", line.alias("line")), statuses)


@query("""SELECT 'a' || o_custkey AS author, sha1(o_orderkey::VARCHAR) AS sha, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS line, 'c' || o_custkey AS key FROM orders""")
def a8_blame(spark, sf):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("string")
    one = F.concat(F.sha1(F.col("o_orderkey").cast("string")), F.lit(" 1 "), n, F.lit(" 1\nauthor a"), F.col("o_custkey").cast("string"), F.lit("\nsummary x\n\tcode"))
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", one.alias("one"))
    texts = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "one"))).alias("all"))
    return R.parse_blame(texts.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("key"), F.array_join("all.one", "\n").alias("text")))


def _exported(texts, kind):
    """The rows of texts that are first written to files, as they are exported."""
    spark, path = texts.sparkSession, scratch(texts.sparkSession, kind)
    texts.write.text(path)
    history.register(spark)
    return spark.read.format(kind).load(path)


@query("""SELECT sha, author, strftime(date, '%Y-%m-%d') AS date, subject, 'of ' || author AS body FROM commits""")
def a5_commit_log_files(spark, sf):
    line = F.concat_ws("\x1f", "sha", F.concat(F.lit(" "), "author"), F.date_format("date", "yyyy-MM-dd"), "subject", F.concat(F.lit("of "), "author"))
    return _exported(A.commits(spark, sf).select(line), "commit_log").drop("file")


@query("""SELECT DISTINCT sha || '00000000' AS sha, path FROM changes WHERE path LIKE '%.py'""")
def a6_name_log_files(spark, sf):
    own = A.changes(spark, sf).groupBy("sha").agg(F.array_join(F.array_sort(F.collect_set(F.replace("path", F.lit("/"), F.lit("\\")))), "\n").alias("names"))
    return _exported(own.select(F.concat("sha", F.lit("00000000\n\n"), "names")), "name_log").where(F.col("path").endswith(".py")).drop("file")


@query("""SELECT sha || '00000000' AS sha, path, insertions, deletions FROM changes""")
def a7_diff_stat_files(spark, sf):
    c = A.changes(spark, sf)
    line = F.concat(F.lit(" "), "path", F.lit(" | "), (F.col("insertions") + F.col("deletions")).cast("string"), F.lit(" "), F.expr("repeat('+', insertions)"), F.expr("repeat('-', deletions)"))
    own = c.groupBy("sha").agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    return _exported(own.select(F.concat("sha", F.lit("00000000\n"), "lines")), "diff_stat").drop("file")


@query("""SELECT 'a' || o_custkey AS author, sha1(o_orderkey::VARCHAR) AS sha, o_orderkey::INT AS line, o_orderpriority AS code FROM orders""")
def a8_blame_files(spark, sf):
    key = F.col("o_orderkey").cast("string")
    one = F.concat(F.sha1(key), F.lit(" 1 "), key, F.lit(" 1\nauthor a"), F.col("o_custkey").cast("string"), F.lit("\nsummary x\n\t"), "o_orderpriority")
    return _exported(table(spark, sf, "orders").select(one), "blame").drop("file")


@query("""SELECT doc_id, CASE WHEN len(l) > 5 THEN array_to_string(l[1:5], chr(10)) || chr(10) || '... (' || (len(l) - 5) || ' lines omitted)' ELSE text END AS shown
FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)""")
def a9_diff_truncation(spark, sf):
    return table(spark, sf, "documents").select("doc_id", R.truncate_diff(F.col("text"), 5).alias("shown"))


@query("""SELECT event_id, tool FROM tool_calls WHERE ts::DATE = (SELECT max(ts)::DATE FROM tool_calls) ORDER BY ts DESC, event_id LIMIT 50""")
def a10_query_log(spark, sf):
    calls = A.tool_calls(spark, sf)
    last = calls.agg(F.max(F.to_date("ts")).alias("day"))
    return calls.join(F.broadcast(last), F.to_date("ts") == F.col("day")).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "tool")


@query("""SELECT event_id, tool || '_x' AS agent, date_trunc('second', ts) AS at FROM tool_calls""")
def a11_report_names(spark, sf):
    calls = A.tool_calls(spark, sf)
    name = F.concat("tool", F.lit("_x_"), F.date_format("ts", "yyyyMMdd_HHmmss"))
    return calls.select("event_id", R.parse_report_name(name).alias("r")).select("event_id", "r.agent", "r.at")


@query("""SELECT p_partkey, CASE WHEN p_size > 5 THEN p_name ELSE p_name || '_vx' END AS type, CASE WHEN p_size > 5 THEN p_size ELSE 0 END AS version FROM part""")
def a12_version_names(spark, sf):
    stem = F.concat("p_name", F.lit("_v"), F.when(F.col("p_size") > 5, F.col("p_size").cast("string")).otherwise("x"))
    return table(spark, sf, "part").select("p_partkey", R.parse_version_name(stem).alias("r")).select("p_partkey", "r.type", "r.version")


@query("""SELECT doc_id, trim(regexp_replace(l[1], '^#+', '')) AS title, len(list_filter(l, lambda x: starts_with(x, '## '))) AS entries
FROM (SELECT doc_id, string_split('# ' || replace(text, chr(10), chr(10) || '## '), chr(10)) AS l FROM documents)""")
def a13_day_files(spark, sf):
    text = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    return table(spark, sf, "documents").select("doc_id", R.day_file(text).alias("r")).select("doc_id", "r.title", F.col("r.entries").cast("long").alias("entries"))


@query("""WITH n AS (SELECT CASE WHEN doc_level LIKE 'L%' THEN doc_level || '_' || doc_id || '.md' ELSE doc_id || '.md' END AS name FROM files),
l AS (SELECT CASE WHEN regexp_matches(name, '^L\\d+_.+\\.md$') THEN regexp_extract(name, '^(L\\d+)_', 1) ELSE 'L3' END AS level, name FROM n)
SELECT level, count(*) AS n, array_to_string(list_sort(list(name))[1:300], ',') AS names FROM l GROUP BY level""")
def a16_doc_tree(spark, sf):
    name = F.when(F.col("doc_level").startswith("L"), F.concat("doc_level", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".md"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return R.doc_tree(A.files(spark, sf).select(name.alias("name"))).select("level", "n", F.array_join("names", ",").alias("names"))


@query("SELECT id, name, line_start FROM nodes WHERE type = 'Class' AND file_path LIKE 'economy/%' ORDER BY id LIMIT 100 OFFSET 10")
def b1_node_listing(spark, sf):
    return A.nodes(spark, sf).where((F.col("type") == "Class") & F.col("file_path").startswith("economy/")).orderBy("id").offset(10).limit(100).select("id", "name", "line_start")


@query("SELECT source_id, target_id, weight FROM edges WHERE relation = 'imports' ORDER BY source_id, target_id LIMIT 200")
def b2_edge_listing(spark, sf):
    return A.edges(spark, sf).where("relation = 'imports'").orderBy("source_id", "target_id").limit(200).select("source_id", "target_id", "weight")


@query("SELECT p_partkey, 'UnresolvedCall:' || p_name AS target FROM part WHERE p_size > 20")
def b3_unresolved(spark, sf):
    meta = F.create_map(F.lit("unresolved"), F.when(F.col("p_size") > 20, "true").otherwise("false"))
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("UnresolvedCall:"), "p_name").alias("target"), meta.alias("metadata"))
    return rows.where(F.col("metadata")["unresolved"] == "true").select("p_partkey", "target")


@query("SELECT sha, subject FROM commits WHERE intent = 'fix' ORDER BY date DESC, sha LIMIT 100")
def b4_by_intent(spark, sf):
    return A.commits(spark, sf).where("intent = 'fix'").orderBy(F.desc("date"), "sha").limit(100).select("sha", "subject")


@query("SELECT sha, date FROM commits WHERE list_contains(modules, 'Brand2/economy') ORDER BY date DESC, sha LIMIT 100")
def b5_for_module(spark, sf):
    return A.commits(spark, sf).where(F.array_contains("modules", "Brand2/economy")).orderBy(F.desc("date"), "sha").limit(100).select("sha", "date")


@query("SELECT sha, date FROM commits WHERE sha BETWEEN '4' AND '5' AND date >= TIMESTAMP '1996-01-01'")
def b6_in_range(spark, sf):
    return A.commits(spark, sf).where(F.col("sha").between("4", "5") & (F.col("date") >= "1996-01-01")).select("sha", "date")


@query("SELECT sha, enriched_at IS NOT NULL AS enriched FROM commits")
def b7_enriched(spark, sf):
    return A.commits(spark, sf).select("sha", F.col("enriched_at").isNotNull().alias("enriched"))


@query("SELECT path, doc_level FROM files WHERE doc_level IN ('L1', 'code') AND source = 'src1' AND path LIKE '%.java'")
def b8_search_filter(spark, sf):
    return A.files(spark, sf).where(F.col("doc_level").isin("L1", "code") & (F.col("source") == "src1") & F.col("path").endswith(".java")).select("path", "doc_level")


@query("""WITH f AS (SELECT doc_id, CASE source WHEN 'src1' THEN 'reports' WHEN 'src2' THEN 'workspace' WHEN 'src3' THEN 'other' ELSE 'context' END AS label,
  CASE WHEN lang = 'fr' THEN 'a/synthesis/L' || doc_id % 4 || '_x.md' WHEN lang = 'de' THEN 'a/codex_' || path ELSE path END AS p FROM files)
SELECT doc_id, CASE WHEN label = 'reports' THEN 'report' WHEN label = 'workspace' THEN 'code' WHEN label <> 'context' THEN 'context'
  WHEN p LIKE 'a/synthesis/%' THEN regexp_extract(p, '(L\\d)_', 1) ELSE 'context' END AS level FROM f""")
def b9_doc_level(spark, sf):
    label = F.create_map(*map(F.lit, ("src1", "reports", "src2", "workspace", "src3", "other")))
    path = F.when(F.col("lang") == "fr", F.concat(F.lit("a/synthesis/L"), (F.col("doc_id") % 4).cast("string"), F.lit("_x.md"))).when(F.col("lang") == "de", F.concat(F.lit("a/codex_"), "path")).otherwise(F.col("path"))
    return A.files(spark, sf).select("doc_id", T.doc_level(path, F.coalesce(F.try_element_at(label, F.col("source")), F.lit("context"))).alias("level"))


@query("""SELECT path, CASE WHEN regexp_matches(path, '\\.(java|py)$') THEN 'backend' WHEN path LIKE '%.js' THEN 'frontend' ELSE 'other' END AS block,
  CASE WHEN path LIKE '%.yaml' THEN 'config' ELSE 'context' END AS content_type, split_part(path, '/', 1) AS module FROM files""")
def b10_block(spark, sf):
    p = F.col("path")
    return A.files(spark, sf).select("path", T.block(p).alias("block"), T.content_type(p, F.lit("context")).alias("content_type"), F.split(p, "/")[0].alias("module"))


@query("""SELECT path, CASE regexp_extract(path, '\\.[a-z]+$') WHEN '.py' THEN 'python' WHEN '.java' THEN 'java' WHEN '.js' THEN 'javascript' ELSE 'unknown' END AS language,
  regexp_matches(path, '\\.(java|py)$') AS validatable FROM files""")
def b11_language(spark, sf):
    return A.files(spark, sf).select("path", T.language(F.col("path")).alias("language"), T.validatable(F.col("path")).alias("validatable"))


@query("SELECT DISTINCT path, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) AS module FROM changes")
def b13_module_path(spark, sf):
    return A.changes(spark, sf).select("path", T.module_path(F.col("path")).alias("module")).distinct()


@query("""SELECT id, regexp_replace(file_path, '/[^/]*$', '') AS package, file_path AS file, TRUE AS is_id, name AS simple FROM nodes""")
def b14_ids(spark, sf):
    whole = F.concat("type", F.lit(":"), "file_path", F.lit(":"), F.col("line_start").cast("string"))
    return A.nodes(spark, sf).select(
        "id", T.package_of(F.col("file_path")).alias("package"), T.file_of_id(whole).alias("file"), T.is_node_id(whole).alias("is_id"),
        T.simple_name(F.concat(F.lit("UnresolvedCall:"), "name")).alias("simple"),
    )


@query("""SELECT sha, CASE WHEN intent = 'fix' THEN 'https://gitlab.example.com/' || author || '/r/-/commit/' ELSE 'https://git.example.com/' || author || '/r/commit/' END || sha AS url FROM commits""")
def b16_commit_url(spark, sf):
    remote = F.when(F.col("intent") == "fix", F.concat(F.lit("git@gitlab.example.com:"), "author", F.lit("/r.git"))).otherwise(F.concat(F.lit("https://git.example.com/"), "author", F.lit("/r")))
    return A.commits(spark, sf).select("sha", T.commit_url(remote, F.col("sha")).alias("url"))


@query("SELECT path, 'codex_' || replace(replace(path, '/', '_'), '.', '_') || '.md' AS doc FROM files")
def b17_doc_name(spark, sf):
    return A.files(spark, sf).select("path", T.doc_name(F.col("path")).alias("doc"))


@query("SELECT doc_id, left('[code] ' || text, 500) AS shown FROM documents")
def b18_redaction(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.redact_code(F.concat(F.lit("```\nx = 1\n``` "), "text")).alias("shown"))
