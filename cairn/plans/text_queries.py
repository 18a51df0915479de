"""Queries of chunking, extraction, grounding and the document hierarchy."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import chunks as CH
from cairn.operators import grounding as GR
from cairn.operators import hierarchy as H
from cairn.operators import upsert as U
from cairn.plans import adapters as A
from cairn.plans.catalog import query
from cairn.session import materialise, spread, table

#: Chunks of files of 1500 characters with an overlap of 200, as a recursive walk over starts.
WALK = """RECURSIVE t AS (SELECT path, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS c FROM files WHERE trim(content) <> ''),
r AS (SELECT path, c, 0 AS k, 0::BIGINT AS st, CASE WHEN 1500 < length(c) AND instr(c[1:1500], chr(10)) > 0 AND length(c[1:1500]) - instr(reverse(c[1:1500]), chr(10)) > 750
    THEN length(c[1:1500]) - instr(reverse(c[1:1500]), chr(10)) + 1 ELSE 1500 END AS en FROM t
  UNION ALL SELECT path, c, k + 1, en - 200, CASE WHEN en - 200 + 1500 < length(c) AND instr(substr(c, en - 199, 1500), chr(10)) > 0 AND length(substr(c, en - 199, 1500)) - instr(reverse(substr(c, en - 199, 1500)), chr(10)) > 750
    THEN en - 200 + length(substr(c, en - 199, 1500)) - instr(reverse(substr(c, en - 199, 1500)), chr(10)) + 1 ELSE en - 200 + 1500 END FROM r WHERE en - 200 < length(c)),
ch AS (SELECT path AS source, k AS chunk_index, trim(substr(c, st + 1, least(en, length(c)) - st), ' ' || chr(10) || chr(9)) AS text,
  length(substr(c, 1, st)) - length(replace(substr(c, 1, st), chr(10), '')) + 1 AS line_start FROM r)"""


def _chunks(spark, sf):
    return CH.chunk(A.files(spark, sf).select("path", "content"))


@query(f"WITH {WALK} SELECT source, chunk_index, md5(text) AS id, line_start FROM ch WHERE text <> ''")
def j1_chunks(spark, sf):
    return _chunks(spark, sf).select("source", "chunk_index", F.md5("text").alias("id"), F.col("line_start").cast("long").alias("line_start"))


@query(f"""WITH {WALK} SELECT split_part(source, '/', 1) AS module, count(*) AS n, sum(length(text) + length('Context: Block= | Module= | Level=context | Type=' || chr(10))
  + length(CASE WHEN regexp_matches(source, '\\.(java|py)$') THEN 'backend' WHEN source LIKE '%.js' THEN 'frontend' ELSE 'other' END) + length(split_part(source, '/', 1))
  + length(CASE WHEN source LIKE '%.yaml' THEN 'config' ELSE 'context' END))::BIGINT AS chars FROM ch WHERE text <> '' GROUP BY 1""")
def j2_breadcrumbs(spark, sf):
    rows = CH.with_breadcrumbs(_chunks(spark, sf), "context")
    return rows.groupBy("module").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query(f"""WITH {WALK}, u AS (SELECT md5(text) AS id, min((source, chunk_index)) AS f FROM ch WHERE text <> '' GROUP BY 1),
s AS (SELECT md5(text) AS id FROM ch WHERE source LIKE 'src1/%') SELECT id, f[1] AS source, f[2] AS chunk_index FROM u WHERE id NOT IN (SELECT id FROM s)""")
def c7_new_chunks(spark, sf):
    every = materialise(_chunks(spark, sf), "chunks")  # read twice below
    stored = every.where(F.col("source").startswith("src1/")).select(F.md5("text").alias("id"))
    return CH.new_chunks(every, stored).select("id", "source", "chunk_index")


@query(f"WITH {WALK} SELECT split_part(source, '/', 2) AS lang, count(DISTINCT md5(text)) AS n FROM ch WHERE text <> '' GROUP BY 1")
def d5_level_counts(spark, sf):
    return _chunks(spark, sf).groupBy(F.split("source", "/")[1].alias("lang")).agg(F.count_distinct(F.md5("text")).alias("n"))


@query("""SELECT doc_id, len(s) AS n_lines, length(text) + 1 AS chars FROM (SELECT doc_id, text, string_split(text, chr(10)) AS s FROM documents)""")
def j4_packed_lines(spark, sf):
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.col("source").alias("module"), "doc_id")
    packed = CH.pack_lines(files, 400)
    banner = F.length(F.concat(F.lit("=== "), "path", F.lit(" ===\n")))
    sums = packed.groupBy("path").agg((F.sum(F.length("text"))).alias("chars"), F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("lines"))
    return sums.select(F.col("path").cast("long").alias("doc_id"), (F.col("lines") - 1).alias("n_lines"), (F.col("chars") - banner).alias("chars"))


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '[^a-zA-Z0-9_\\x{{80}}-\\x{{10FFFF}}]', ' ', 'g'), ' +')) AS w FROM documents)
SELECT DISTINCT doc_id, w AS name FROM w WHERE length(w) >= 4 AND lower(w) NOT IN {T.STOPWORDS} AND regexp_full_match(w, '[a-z][a-z0-9_]{{3,}}|[A-Z][a-z]+([A-Z][a-z]+)+')""")
def j5_identifiers(spark, sf):
    """Words and compounds that aren't English; dotted paths and definitions have queries of their own."""
    found = table(spark, sf, "documents").select("doc_id", F.explode(T.identifiers(F.col("text"))).alias("name"))
    return found.where(F.col("name").rlike("^([a-z][a-z0-9_]{3,}|[A-Z][a-z]+([A-Z][a-z]+)+)$") & ~F.lower("name").isin(*T.STOPWORDS))


@query("""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(replace(text, '(', ' '), '([a-z]+) ([a-z]+) ([a-z]+)[.]', '\\1 \\2 \\3(', 'g'), '([a-z]+), ([a-z]+)', 'class K\\1 def m\\2 (', 'g') AS t FROM documents),
n AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(t, '[a-z]+ [a-z]+ ([a-z]+)[(]', 1), list_concat(regexp_extract_all(t, '(?:^|[^a-zA-Z0-9_\\x{80}-\\x{10FFFF}])class (K[a-z]+)', 1), regexp_extract_all(t, 'def (m[a-z]+) [(]', 1)))) AS name FROM t)
SELECT DISTINCT doc_id, name FROM n WHERE length(name) >= 4""")
def j5_definitions(spark, sf):
    """Classes, functions and methods in texts whose sentences and enumerations are turned into definitions."""
    text = F.regexp_replace(F.replace("text", F.lit("("), F.lit(" ")), "([a-z]+) ([a-z]+) ([a-z]+)[.]", "$1 $2 $3(")
    text = F.regexp_replace(text, "([a-z]+), ([a-z]+)", "class K$1 def m$2 (")
    named = F.array_distinct(F.concat(T.methods(text), *[F.regexp_extract_all(text, F.lit("(?U)" + p), 1) for p in T.DEFINITIONS]))
    return table(spark, sf, "documents").select("doc_id", F.explode(named).alias("name")).where(F.length("name") >= 4)


@query("""WITH t AS (SELECT doc_id, regexp_replace(text, '([A-Z][a-z]+) ([a-z]+)', '@\\1("/\\2")', 'g') AS t FROM documents)
SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(t, '@([A-Z][A-Za-z0-9_]*)', 1),
  list_filter(flatten(list_transform(regexp_extract_all(t, '@[A-Z]\\w*\\s*\\(\\s*"([^"]+)"', 1), lambda x: string_split_regex(x, '[/.\\-_]'))), lambda p: length(p) >= 3)))), '|') AS names FROM t""")
def j6_annotations(spark, sf):
    """In texts whose capitalised words are turned into annotations of the next."""
    text = F.regexp_replace("text", "([A-Z][a-z]+) ([a-z]+)", '@$1("/$2")')
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.annotations(text), "|").alias("names"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '[^a-zA-Z0-9_\\x{80}-\\x{10FFFF}]', ' ', 'g'), ' +')) AS w FROM documents)
SELECT doc_id, w AS name, count(*) AS n FROM w WHERE regexp_full_match(w, '[A-Z][A-Z0-9]{2,}(_[A-Z0-9]+)*') GROUP BY 1, 2""")
def j8_candidates(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.explode(T.candidates(F.col("text"))).alias("c"))
    return found.where("c.kind = 'all_caps'").groupBy("doc_id", F.col("c.name").alias("name")).agg(F.count("*").alias("n"))


#: Some words in a row written as one of each kind of name.
NAMED = (("([a-z]+) ([a-z]+)[.]", "Aa{1}Bb{2} {1}_{2}."), ("([a-z]+), ([a-z]+)", "`{1}`, {1}.{2}"))


def _named(text):
    for pattern, to in NAMED:
        text = F.regexp_replace(text, pattern, to.format(None, "$1", "$2"))
    return text


@query("""WITH t AS (SELECT doc_id, doc_id % 3 AS k, regexp_replace(regexp_replace(replace(text, '`', ' '), '([a-z]+) ([a-z]+)[.]', 'Aa\\1Bb\\2 \\1_\\2.', 'g'), '([a-z]+), ([a-z]+)', '`\\1`, \\1.\\2', 'g') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_replace(t, '[^a-zA-Z0-9_\\x{80}-\\x{10FFFF}]', ' ', 'g') AS s FROM t WHERE k < 2), w AS (SELECT DISTINCT doc_id, t, s, unnest(string_split_regex(s, ' +')) AS w FROM s),
n AS (SELECT doc_id, t, w AS name, CASE WHEN regexp_full_match(w, '[A-Z][a-z]+([A-Z][a-z]+)+') THEN 1 WHEN regexp_full_match(w, '[a-z][a-z0-9]*(_[a-z0-9]+)+') THEN 2 WHEN regexp_full_match(w, '[A-Z][A-Z0-9]{2,}(_[A-Z0-9]+)*') THEN 3 END AS k, strpos(' ' || s || ' ', ' ' || w || ' ') AS pos FROM w
  UNION ALL SELECT doc_id, t, name, 5, strpos(t, '`' || name || '`') + 1 FROM (SELECT doc_id, t, unnest(list_distinct(regexp_extract_all(t, '`([^`]+)`', 1))) AS name FROM s)),
o AS (SELECT doc_id, lower(name) AS word, arg_min({'name': name, 'k': k, 'pos': pos, 't': t}, (k, pos)) AS f FROM n WHERE k IS NOT NULL GROUP BY 1, 2),
a AS (SELECT DISTINCT lower(unnest(string_split_regex(text, '[^a-zA-Z]+'))) AS word FROM benchmark)
SELECT o.doc_id, f.name AS name, CASE f.k WHEN 1 THEN 'camelcase' WHEN 2 THEN 'snake_case' WHEN 3 THEN 'all_caps' ELSE 'backticked' END AS kind,
  replace(substring(f.t, greatest(f.pos - 60, 1), f.pos + length(f.name) + 60 - greatest(f.pos - 60, 1)), chr(10), ' ') AS snippet
FROM o JOIN documents d ON o.doc_id = d.doc_id WHERE word NOT IN (SELECT word FROM a) AND NOT contains(lower(left(d.text, 200)), word)""")
def j9_unknown_names(spark, sf):
    """Names of four kinds in two of three texts' languages, supported by the benchmark's words or their text's own beginning."""
    allowed = table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).distinct()
    language = F.element_at(F.array(*map(F.lit, ("java", "python", "go"))), (F.col("doc_id") % 3 + 1).cast("int"))
    prose = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", _named(F.replace("text", F.lit("`"), F.lit(" "))).alias("text"), F.left("text", F.lit(200)).alias("source"), language.alias("language"))
    return GR.unknown_names(prose, allowed).where("kind <> 'dotted'")


@query("""WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[^a-zA-Z0-9_\\x{80}-\\x{10FFFF}]+')) AS name FROM documents),
k AS (SELECT DISTINCT unnest(string_split_regex(text, '[^a-zA-Z]+')) AS word FROM benchmark)
SELECT doc_id, name FROM w WHERE regexp_full_match(name, '[a-z_][a-z0-9_]{3,}') AND name NOT IN (SELECT word FROM k)""")
def j10_strict_unknown(spark, sf):
    allowed = table(spark, sf, "benchmark").select(F.explode(F.split("text", "[^a-zA-Z]+")).alias("word")).distinct()
    return GR.unknown_words(table(spark, sf, "documents").select("doc_id", "text"), allowed, r"(?U)\b([a-z_][a-z0-9_]{3,})\b")


@query(f"""WITH a AS (SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations WHERE role = 'assistant'),
w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(text, '[^a-zA-Z0-9_\\x{{80}}-\\x{{10FFFF}}]+')) AS name FROM a),
k AS (SELECT DISTINCT unnest(string_split_regex(text, '[^a-zA-Z0-9_\\x{{80}}-\\x{{10FFFF}}]+')) AS name FROM benchmark),
c AS (SELECT DISTINCT conv_id * 1000 + turn + 1 AS doc_id, unnest(string_split_regex(text, '[^a-zA-Z0-9_\\x{{80}}-\\x{{10FFFF}}]+')) AS name FROM conversations),
n AS (SELECT doc_id, count(*) AS n, list(name) AS names FROM w WHERE regexp_full_match(name, '[a-z_][a-z0-9_]{{3,}}') AND name NOT IN (SELECT name FROM k) AND (doc_id, name) NOT IN (SELECT doc_id, name FROM c) GROUP BY 1)
SELECT a.doc_id, coalesce(n, 0)::INT AS n_unknown, CASE WHEN coalesce(n, 0) = 0 THEN 'passed' WHEN n > 5 THEN 'abstained' ELSE 'cleaned' END AS verdict,
CASE WHEN coalesce(n, 0) = 0 THEN text WHEN n > 5 THEN '{T.ABSTAIN}' ELSE array_to_string(list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: len(list_filter(names, lambda y: contains(x, y))) = 0), ' ') END AS text
FROM a LEFT JOIN n ON a.doc_id = n.doc_id""")
def j11_responses(spark, sf):
    answers = table(spark, sf, "conversations").where("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    chunks = table(spark, sf, "benchmark").select("text")
    # an answer cites the turn before it
    cited = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("doc_id"), "text")
    return GR.validate_responses(answers, cited, chunks, r"(?U)\b([a-z_][a-z0-9_]{3,})\b").select("doc_id", "n_unknown", "verdict", "text")


@query("""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g'), chr(31)), lambda x: NOT contains(x, 'the') AND NOT contains(x, 'und')) AS s FROM documents)
SELECT doc_id, array_to_string(s, ' ') AS text FROM s""")
def j12_drop_sentences(spark, sf):
    return table(spark, sf, "documents").select("doc_id", GR.drop_sentences(F.col("text"), F.array(F.lit("the"), F.lit("und"))).alias("text"))


@query("SELECT doc_id, doc_id % 7 < 2 AS abstains, CASE doc_id % 7 WHEN 0 THEN text WHEN 1 THEN text || ' (unknown)' ELSE text END AS shown FROM documents")
def j13_abstain(spark, sf):
    k = F.col("doc_id") % 7
    text = F.when(k == 0, F.concat(F.lit(T.ABSTAIN + " \n"), "text")).when(k == 1, F.concat("text", F.lit(" " + T.ABSTAIN))).otherwise(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.abstains(text).alias("abstains"), T.strip_abstain(text).alias("shown"))


@query("SELECT path, array_to_string(list_filter(string_split_regex(path, '[/.]'), lambda x: x <> ''), '|') AS segs FROM files")
def j14_segments(spark, sf):
    stem = F.regexp_replace(T.doc_name(F.col("path")), r"\.md$", "")
    return A.files(spark, sf).select("path", F.array_join(T.segments(F.concat(stem, F.lit("_20240101_000000"))), "|").alias("segs"))


@query("SELECT path, regexp_extract(path, '\\.[a-z]+$') AS ext FROM files")
def j16_extension(spark, sf):
    return A.files(spark, sf).select("path", T.extension(F.col("path")).alias("ext"))


@query("""WITH t AS (SELECT DISTINCT c.doc_id * 1000 + c.line_start AS k, c.doc_id, c.line_start, c.line_end, len(string_split(content, chr(10))) AS n FROM citations c LEFT JOIN files f ON c.doc_id = f.doc_id AND f.lang <> 'es')
SELECT doc_id, CASE WHEN n IS NULL THEN 'path does not exist' WHEN line_end > n THEN 'line range invalid' WHEN line_end - line_start > 200 THEN 'range too large' END AS error FROM t""")
def c12_citations(spark, sf):
    files = A.files(spark, sf).where("lang <> 'es'").select(F.col("doc_id").alias("path"), "content")
    return GR.check_citations(A.citations(spark, sf).withColumnRenamed("doc_id", "path"), files).select(F.col("path").alias("doc_id"), "error")


@query("""SELECT doc_id, array_to_string(l[line_start:line_end], chr(10)) AS cited, NOT contains(array_to_string(l[line_start:line_end], chr(10)), 'the') AS missing
FROM (SELECT doc_id, line_start, line_end, string_split(content, chr(10)) AS l FROM citations JOIN files USING (doc_id))""")
def c13_cited_ranges(spark, sf):
    files = A.files(spark, sf).select(F.col("doc_id").alias("path"), "content")
    cited = GR.read_ranges(A.citations(spark, sf).withColumnRenamed("doc_id", "path"), files)
    return GR.unsupported_mentions(cited, F.array(F.lit("the"))).select(F.col("path").alias("doc_id"), "cited", (F.size("missing") > 0).alias("missing"))


@query("SELECT path, path IN (SELECT path FROM new_files) AS valid FROM old_files")
def c11_source_split(spark, sf):
    return GR.split_sources(A.old_files(spark, sf).select("path"), A.new_files(spark, sf).select("path"))


@query("""WITH l AS (SELECT item_id AS id, array_to_string(string_split(text, ' ')[1:[1, 2, 5, 1000][item_id % 4 + 1]], ' ') AS label FROM benchmark)
SELECT doc_id, id FROM documents JOIN l ON contains(lower(text), lower(label)) WHERE length(label) >= 3""")
def c14_mentions(spark, sf):
    """Labels of one, two and five words, and whole texts, wherever they stand."""
    n = F.element_at(F.array(*map(F.lit, (1, 2, 5, 1000))), (F.col("item_id") % 4 + 1).cast("int"))
    labels = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.array_join(F.slice(F.split("text", " "), F.lit(1), n), " ").alias("label"))
    return GR.mentions(spread(table(spark, sf, "documents").select("doc_id", "text")), labels)


@query("""WITH l AS (SELECT DISTINCT lower(regexp_extract(text, '^[a-zA-Z]+')) AS label FROM benchmark), w AS (SELECT DISTINCT unnest(string_split_regex(lower(html), '[^a-z]+')) AS word FROM pages)
SELECT word, label AS id, round(1 - levenshtein(word, label) / greatest(length(word), length(label)), 6) AS ratio FROM w JOIN l ON length(word) >= 3 AND length(label) >= 3
 AND 2.0 * least(length(word), length(label)) / (length(word) + length(label)) >= 0.75 WHERE 1 - levenshtein(word, label) / greatest(length(word), length(label)) >= 0.75""")
def c15_similar_mentions(spark, sf):
    labels = table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", "^[a-zA-Z]+", 0)).alias("label")).distinct().withColumn("id", F.col("label"))
    words = table(spark, sf, "pages").select(F.explode(F.split(F.lower("html"), "[^a-z]+")).alias("word"))
    return GR.similar_mentions(words, labels, 0.75, native=True).select("word", "id", F.round("ratio", 6).alias("ratio"))


@query()
def c15_matching_blocks(spark, sf):
    """The ratio of matching blocks, which SQL hasn't."""
    labels = table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", "^[a-zA-Z]+", 0)).alias("label")).distinct().withColumn("id", F.col("label"))
    words = table(spark, sf, "pages").select(F.explode(F.split(F.lower("html"), "[^a-z]+")).alias("word"))
    return GR.similar_mentions(words, labels, 0.75).select("word", "id", F.round("ratio", 6).alias("ratio"))


LEAVES = """l AS (SELECT lang AS block, list_filter(string_split_regex(path, '[/.]'), lambda x: x <> '') AS segs, size_bytes FROM files)"""


def _leaves(spark, sf):
    stem = F.regexp_replace(T.doc_name(F.col("path")), r"\.md$", "")
    return A.files(spark, sf).select(F.col("lang").alias("block"), T.segments(stem).alias("segs"), "size_bytes")


@query(f"""WITH {LEAVES} SELECT block, array_to_string(segs[1:n], '_') AS prefix, count(*) AS n FROM (SELECT block, segs, unnest(range(1, len(segs) + 1)) AS n FROM l) GROUP BY 1, 2""")
def c17_descendants(spark, sf):
    return H.descendants(_leaves(spark, sf))


@query("""WITH p AS (SELECT * FROM (VALUES ('code', 1, 'RE '), ('prose', 2, 'licen'), ('prose', 2, 'ouv'), ('late', 3, 'e')) v(block, ord, pattern)),
s AS (SELECT doc_id, lower(doc_id || ' ' || left(text, 500)) AS s FROM documents), m AS (SELECT doc_id, arg_min(block, ord) AS block FROM s JOIN p ON contains(s, lower(pattern)) GROUP BY 1)
SELECT s.doc_id, coalesce(block, 'other') AS block FROM s LEFT JOIN m ON s.doc_id = m.doc_id""")
def e2_classification(spark, sf):
    patterns = spark.createDataFrame([("code", 1, "RE "), ("prose", 2, "licen"), ("prose", 2, "ouv"), ("late", 3, "e")], "block string, ord int, pattern string")
    return H.classify(table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("stem"), "text"), patterns)


@query("""WITH s AS (SELECT doc_id, unnest(string_split(t, chr(31))) AS s, generate_subscripts(string_split(t, chr(31)), 1) AS pos FROM (SELECT doc_id, regexp_replace(text, '([.!?])\\s+', '\\1' || chr(31), 'g') AS t FROM documents)),
f AS (SELECT doc_id, min(pos) AS pos, arg_min(s, pos) AS s FROM s WHERE trim(s, ' ' || chr(10)) <> '' GROUP BY doc_id, lower(trim(s, ' ' || chr(10)))),
j AS (SELECT doc_id, string_agg(s, ' ' ORDER BY pos) AS text FROM f GROUP BY 1)
SELECT doc_id, CASE WHEN regexp_matches(text, '[.!?]$') THEN text ELSE regexp_replace(text, '\\s+$', '') || '...' END AS text FROM j""")
def e4_sentence_dedup(spark, sf):
    return H.dedup_sentences(table(spark, sf, "documents").select("doc_id", "text"))


@query("""SELECT block, key, count(*) AS docs, sum(size_bytes // 1024)::BIGINT AS kb FROM (SELECT lang AS block, source AS key, size_bytes FROM files) GROUP BY ROLLUP (block, key) HAVING block IS NOT NULL""")
def d14_classification_table(spark, sf):
    return H.classification_table(A.files(spark, sf).select(F.col("lang").alias("block"), F.col("source").alias("key"), "size_bytes"))


@query(f"""WITH {LEAVES} SELECT block, count(DISTINCT array_to_string(segs[1:n], '_')) + 1 AS nodes FROM (SELECT block, segs, unnest(range(1, len(segs))) AS n FROM l) GROUP BY 1""")
def d15_plan_size(spark, sf):
    return H.plan_size(_leaves(spark, sf))


@query("""WITH c AS (SELECT lang AS parent, source AS child, count(*) AS leaves, sum(size_bytes) AS b FROM files GROUP BY 1, 2),
s AS (SELECT parent, child, 0.7 * leaves / max(leaves) OVER (PARTITION BY parent) + 0.3 * greatest(b // 1024, 1) / max(greatest(b // 1024, 1)) OVER (PARTITION BY parent) AS score FROM c)
SELECT parent, child, round(score, 6) AS score, CASE WHEN score >= 0.4 THEN 'major' WHEN score >= 0.1 THEN 'normal' ELSE 'minor' END AS weight FROM s""")
def k3_child_weights(spark, sf):
    c = A.files(spark, sf).groupBy(F.col("lang").alias("parent"), F.col("source").alias("child")).agg(F.count("*").alias("leaves"), F.sum("size_bytes").alias("size_bytes"))
    return H.child_weights(c).select("parent", "child", F.round("score", 6).alias("score"), "weight")


@query(f"""WITH {LEAVES}, o AS (SELECT DISTINCT block, segs FROM l), m AS (SELECT block, max(len(segs)) AS longest FROM o GROUP BY 1),
r AS (SELECT o.block, segs, longest, unnest(range(1, longest)) AS round FROM o JOIN m ON o.block = m.block WHERE longest > 1),
p AS (SELECT DISTINCT block, round, longest, array_to_string(segs[1:greatest(len(segs) - round, 0)], '_') AS prefix, array_to_string(segs[1:greatest(len(segs) - round + 1, 0)], '_') AS child FROM r)
SELECT block, round::INT AS round, (longest + 2 - round)::INT AS depth, prefix, count(*) AS children, least(400 + 60 * count(*), 1200) AS least_words FROM p GROUP BY block, round, longest, prefix HAVING NOT (count(*) = 1 AND min(child) = prefix)""")
def k4_rollup(spark, sf):
    return H.rollup(_leaves(spark, sf)).drop("most_words")


@query("""WITH c AS (SELECT lang AS parent, source AS child, count(*) AS score FROM files GROUP BY 1, 2)
SELECT parent, string_agg('## ' || child || ' [normal]' || chr(10) || chr(10) || score, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY -score, child) AS text FROM c GROUP BY 1""")
def k5_assembly(spark, sf):
    c = A.files(spark, sf).groupBy(F.col("lang").alias("parent"), F.col("source").alias("child")).agg(F.count("*").alias("score"))
    return H.assemble(c.select("parent", "child", "score", F.lit("normal").alias("weight"), F.col("score").cast("string").alias("body")))


@query(f"WITH {WALK} SELECT source, chunk_index FROM ch WHERE text <> '' ORDER BY source, chunk_index LIMIT 500")
def f5_global_cap(spark, sf):
    return _chunks(spark, sf).orderBy("source", "chunk_index").limit(500).select("source", "chunk_index")


@query(f"WITH {WALK} SELECT source, count(*) AS n FROM ch WHERE text <> '' AND source NOT IN (SELECT path FROM new_files EXCEPT SELECT path FROM old_files) GROUP BY 1")
def i6_purge(spark, sf):
    gone = A.new_files(spark, sf).select("path").subtract(A.old_files(spark, sf).select("path")).withColumnRenamed("path", "source")
    return U.purge(_chunks(spark, sf), gone).groupBy("source").agg(F.count("*").alias("n"))


@query(f"""WITH {WALK}, x AS (SELECT source, source || ':' || chunk_index AS id, text FROM ch WHERE text <> '')
SELECT id, CASE WHEN source LIKE '%/de/%' THEN 'fresh' ELSE 'kept' END AS state FROM x""")
def i7_refresh(spark, sf):
    """German sources are indexed again over chunks from before."""
    own = _chunks(spark, sf).select("source", F.concat_ws(":", "source", F.col("chunk_index").cast("string")).alias("id"))
    fresh = own.where(F.col("source").contains("/de/")).withColumn("state", F.lit("fresh"))
    sources = fresh.select("source").distinct()
    return U.replace_sources(own.withColumn("state", F.lit("kept")), fresh, sources).select("id", "state")


@query(f"""WITH {WALK}, todo AS (SELECT n.path FROM new_files n LEFT JOIN old_files o ON n.path = o.path WHERE o.hash IS NULL OR o.hash <> n.hash)
SELECT split_part(source, '/', 1) AS module, count(DISTINCT md5(text)) AS n FROM ch WHERE text <> '' AND source IN (SELECT path FROM todo) GROUP BY 1""")
def l8_index_build(spark, sf):
    """Scan, skip what is unchanged, chunk, and keep each chunk of a module once."""
    files = A.files(spark, sf).withColumn("hash", F.md5("content"))
    todo = U.to_process(files, A.old_files(spark, sf)).where("todo").select("path", "content")
    rows = CH.chunk(todo).select(F.split("source", "/")[0].alias("module"), F.md5("text").alias("id")).distinct()
    return rows.groupBy("module").agg(F.count("*").alias("n"))


CORPORA = """corpora AS (SELECT path, '[File: ' || path || ']' || chr(10) || content AS content FROM files LEFT JOIN old_files USING (path) WHERE NOT ends_with(path, '.yaml') AND size_bytes <= 20000 AND trim(content) <> '' AND (hash IS NULL OR hash <> md5(content))
  UNION ALL SELECT 'notes/' || item_id || '.md', '[File: notes/' || item_id || '.md]' || chr(10) || text FROM benchmark WHERE trim(text) <> '')"""


@query(f"""WITH {WALK.replace("FROM files WHERE", "FROM corpora WHERE").replace("RECURSIVE t AS", f"RECURSIVE {CORPORA}, t AS")},
x AS (SELECT source, chunk_index, CASE WHEN source LIKE 'notes/%' THEN 'other' WHEN regexp_matches(source, '\\.(java|py)$') THEN 'backend' WHEN source LIKE '%.js' THEN 'frontend' ELSE 'other' END AS block,
  CASE WHEN source LIKE 'notes/%' THEN 'context' ELSE 'code' END AS level, text FROM ch WHERE text <> ''),
y AS (SELECT *, md5('Context: Block=' || block || ' | Module=' || split_part(source, '/', 1) || ' | Level=' || level || ' | Type=' || level || chr(10) || text) AS id FROM x)
SELECT id, min((source, chunk_index))[1] AS source, min((source, chunk_index))[2] AS chunk_index FROM y WHERE id NOT IN (SELECT id FROM y WHERE source LIKE 'src1/%') GROUP BY 1""")
def l8_build_index(spark, sf):
    """Scan rules, hash state, header, chunks, context line, two corpora, and what is stored already."""
    files = A.files(spark, sf).select("path", "content", "size_bytes")
    notes = table(spark, sf, "benchmark").select(F.concat(F.lit("notes/"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"), F.col("text").alias("content"), F.octet_length("text").cast("long").alias("size_bytes"))
    args = {"workspace": files, "context": notes}, A.old_files(spark, sf)
    # what is stored is told by its lines themselves
    own = files.where("path LIKE 'src1/%'").select("path", F.concat(F.lit("[File: "), "path", F.lit("]\n"), "content").alias("content"))
    block = F.when(F.col("source").rlike(r"\.(java|py)$"), "backend").when(F.col("source").endswith(".js"), "frontend").otherwise("other")
    stored = CH.chunk(own).select(F.md5(F.concat(F.lit("Context: Block="), block, F.lit(" | Module=src1 | Level=code | Type=code\n"), "text")).alias("id"))
    extensions = [".py", ".java", ".js", ".md"]
    return CH.build_index(*args, stored, extensions, most_bytes=20_000).select("id", "source", "chunk_index")


@query("""SELECT source AS module, sum(len(string_split(text, chr(10))) + 3)::BIGINT AS n_lines, sum(length(text) + length(doc_id::VARCHAR) + 132)::BIGINT AS chars, TRUE AS fits, TRUE AS full_parts FROM documents GROUP BY 1""")
def j4_module_parts(spark, sf):
    """Each source's texts as the files of a module; all lines are there, no part of more than one line is too long, and none would hold the next one's first line."""
    files = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.col("source").alias("module"))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    head = F.length(F.substring_index("text", "\n", 1)) + 1
    packed = CH.pack_modules(files, 4000).select("module", "task", "part", lines.alias("lines"), F.length("text").alias("chars"), head.alias("head"))
    next_head = F.lead("head").over(Window.partitionBy("module", "task").orderBy("part"))
    packed = materialise(packed, "parts").withColumn("full", F.coalesce(F.col("chars") + next_head > 4000, F.lit(True)))
    return packed.groupBy("module").agg(F.sum("lines").alias("n_lines"), F.sum("chars").alias("chars"), F.bool_and((F.col("chars") <= 4000) | (F.col("lines") == 1)).alias("fits"), F.bool_and("full").alias("full_parts"))


@query("""SELECT path, CASE WHEN path LIKE '%/de/%' OR path LIKE '%/fr/%' THEN 'continental' WHEN path LIKE '%.js' THEN 'script' ELSE 'other' END AS block, CASE WHEN path LIKE '%.md' THEN 'prose' ELSE 'context' END AS kind,
CASE WHEN path LIKE '%.yaml' THEN 'settings' WHEN path LIKE '%.py' THEN 'python' ELSE 'unknown' END AS language, CASE WHEN contains(lower(path || ' ' || left(content, 500)), 'licen') THEN 'legal' WHEN contains(lower(path || ' ' || left(content, 500)), 'src1') THEN 'first' ELSE 'other' END AS class FROM files""")
def o2_settings(spark, sf):
    """Blocks, content types, languages and classes of a settings file."""
    import json

    from cairn.functions.arrow import filesystem
    from cairn.session import shared_dir
    from cairn.sources import settings

    given = {"blocks": {"continental": ["/de/", "/fr/"], "script": [r"\.js$"]}, "content_types": {"prose": [r"\.md$"]}, "languages": {".yaml": "settings", ".py": "python"}, "classes": {"legal": ["licen"], "first": ["src1"]}}
    path = f"{shared_dir(spark)}/settings-o2.json"
    system, own = filesystem(path)
    system.create_dir(own.rpartition("/")[0], recursive=True)
    with system.open_output_stream(own, compression=None) as f:
        f.write(json.dumps(given).encode())
    own = settings.load(path)
    files = A.files(spark, sf)
    classes = H.classify(files.select(F.col("path").alias("doc_id"), F.col("path").alias("stem"), F.col("content").alias("text")), own.class_table(spark)).select(F.col("doc_id").alias("path"), F.col("block").alias("class"))
    rows = files.select("path", T.block(F.col("path"), own.blocks).alias("block"), T.content_type(F.col("path"), F.lit("context"), own.content_types).alias("kind"), T.language(F.col("path"), own.languages).alias("language"))
    return rows.join(classes, "path")


@query(f"WITH {WALK} SELECT source, count(*) AS n FROM ch WHERE text <> '' GROUP BY 1")
def n7_index_stream(spark, sf):
    """The files as a stream into a table of chunks."""
    from cairn.session import scratch
    from cairn.streaming import live

    path = scratch(spark, "index")
    A.files(spark, sf).select("path", "content").write.parquet(f"{path}/in")
    stream = live.read_files(spark, f"{path}/in", "path string, content string")
    live.index_stream(stream, f"{path}/table", f"{path}/log").awaitTermination()
    return live.read_index(spark, f"{path}/table").groupBy("source").agg(F.count("*").alias("n"))
