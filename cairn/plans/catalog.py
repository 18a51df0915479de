"""The registry of queries: each is a function of (spark, sf_dir), most with SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

#: Entities derived from the tables, in SQL; `adapters` derives the same ones in Spark.
ENTITIES: dict[str, str] = {
    "files": """SELECT doc_id, source || '/' || lang || '/' || doc_id || ['.py', '.java', '.js', '.md', '.yaml'][doc_id % 5 + 1] AS path,
        text AS content, source, lang, octet_length(encode(text))::BIGINT AS size_bytes,
        ['L0', 'L1', 'L2', 'L3', 'code', 'context'][doc_id % 6 + 1] AS doc_level FROM documents""",
    "old_files": """SELECT path, CASE WHEN lang = 'de' THEN md5(content || '!') ELSE md5(content) END AS hash FROM files WHERE source <> 'src3'
        UNION ALL SELECT 'gone/' || item_id || '.md', md5(text) FROM benchmark""",
    "new_files": "SELECT path, md5(content) AS hash FROM files",
    "nodes": """SELECT 'n' || p_partkey AS id, ['Module', 'Class', 'Method', 'Field'][p_size % 4 + 1] AS type, p_name AS name,
        lower(p_type) || '/' || replace(p_brand, '#', '') || '.py' AS file_path, p_size AS line_start, (p_size + p_partkey % 7)::INT AS line_end FROM part""",
    "bought": "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem",
    "edges": """SELECT 'n' || a.l_partkey AS source_id, 'n' || b.l_partkey AS target_id,
        CASE WHEN (a.l_partkey + b.l_partkey) % 4 = 0 THEN 'imports' ELSE 'calls' END AS relation, count(*)::DOUBLE AS weight
        FROM bought a JOIN bought b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2, 3 HAVING count(*) >= 2""",
    "changes": """SELECT md5(l_orderkey::VARCHAR) AS sha, replace(p_brand, '#', '') || '/' || lower(p_type) || '/' || p_partkey ||
        CASE WHEN p_size <= 3 THEN '.yaml' ELSE '.py' END AS path, ['A', 'M', 'D', 'R'][l_linenumber % 4 + 1] AS status,
        l_quantity::INT AS insertions, round(l_discount * 100)::INT AS deletions FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "touched": "SELECT sha, list_sort(list(DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2))) AS modules FROM changes GROUP BY sha",
    "commits": """SELECT md5(o_orderkey::VARCHAR) AS sha, 'a' || o_custkey AS author, o_orderdate AS date, o_orderpriority || ' ' || o_orderkey AS subject,
        CASE left(o_orderpriority, 1) WHEN '1' THEN 'fix' WHEN '2' THEN 'feature' WHEN '3' THEN 'refactor' WHEN '5' THEN 'docs' ELSE 'unknown' END AS intent,
        CASE WHEN o_orderstatus = 'O' THEN NULL ELSE o_orderdate + INTERVAL 1 DAY END AS enriched_at,
        round(o_totalprice / 600000, 2) AS risk_score, coalesce(modules, []) AS modules FROM orders LEFT JOIN touched ON touched.sha = md5(o_orderkey::VARCHAR)""",
    "kg_nodes": """SELECT 'nation:' || n_nationkey AS id, lower(n_name) AS label, 'System' AS type FROM nation
        UNION ALL SELECT 'part:' || p_partkey, p_name, 'Module' FROM part""",
    "kg_edges": """SELECT 'nation:' || s_nationkey AS source, 'part:' || l_partkey AS target, 'uses' AS relation, max(l_discount * 10) AS weight,
        list_sort(list(DISTINCT l_orderkey::VARCHAR)) AS source_docs FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""",
    "tool_calls": "SELECT event_id, ts, event_type AS tool, user_id AS client, value AS duration_ms, event_type <> 'error' AS success, props FROM events",
    "checks": "SELECT doc_id, toxic = 1 AS abstained, quality = 1 AND toxic = 0 AS passed FROM labels",
    "responses": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN 'Result: ' || props ELSE left(props, 4) END AS raw FROM events""",
    "citations": "SELECT doc_id, (doc_id % 50 + 1)::INT AS line_start, (doc_id % 50 + 1 + doc_id % 250)::INT AS line_end FROM documents",
}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name; entities that `sql` mentions are put before it."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_entities(sql)
        return f

    return add


def with_entities(sql: str) -> str:
    wanted: list[str] = []

    def visit(text: str) -> None:
        for name, body in ENTITIES.items():
            if name not in wanted and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                visit(body)
                wanted.append(name)

    visit(sql)
    if not wanted:
        return sql
    head, recursive = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I), ""
    if head:
        recursive, sql = head[1] or "", "," + sql[head.end() :]
    return f"WITH {recursive}" + ",\n".join(f"{n} AS ({ENTITIES[n]})" for n in wanted) + ("\n" if not sql.startswith(",") else "") + sql
