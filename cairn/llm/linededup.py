"""Removal of lines that many documents share.

A line's key is the line without white space at its ends, A-Z lower-cased. Keys of enough
characters in enough documents lose all their lines, but for those of the largest doc_id.
Null and empty texts are one empty line. Documents of one doc_id count as one document. A null
doc_id is no document that counts: its lines are neither counted nor dropped. Keys are compared
by 128 bits of hash. Rows, repeated ones too, are all kept, in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space that a key hasn't at its ends.
BLANKS = " \t\n\x0b\x0c\r"


def key(line: Column) -> Column:
    """The key of a line, in time linear in its length whatever blanks it holds."""
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(BLANKS))


def line_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, text_hash, drop): the positions that each document loses; documents that lose none are absent."""
    lines = (
        docs.where("doc_id is not null")
        .withColumn("text_hash", F.xxhash64("text"))  # by itself, or each line would carry its text
        .select("doc_id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .withColumn("key", key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "text_hash", "pos", line_hash(F.col("key")).alias("h"))
        .select("doc_id", "text_hash", "pos", "h.h1", "h.h2")
    )
    # written down, so that the texts are split once
    lines = materialise(lines, "lines")
    common = (
        lines.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("h1", "h2", "keeper")
    )
    # written down, so that the join's sides are both dealt anew and a line of many documents can be split
    lost = lines.join(materialise(common, "common-lines"), ["h1", "h2"]).where("doc_id <> keeper")
    return lost.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("drop"))


def _without(lines: Column, stops: Column) -> Column:
    """The lines between stops: -1, the sorted positions to drop, and the number of lines."""
    between = F.sequence(F.lit(0), F.size(stops) - 2)
    return F.flatten(F.transform(between, lambda i: F.slice(lines, F.get(stops, i) + 2, F.get(stops, i + 1) - F.get(stops, i) - 1)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, keep: tuple = ()) -> DataFrame:
    """(doc_id, *keep, kept_text, n_lines, n_dropped) per row; `keep` names further columns to carry."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    drops = dropped_positions(source, min_chars, min_docs)
    marked = source.withColumn("text_hash", F.xxhash64("text")).join(drops, ["doc_id", "text_hash"], "left")
    own = marked.withColumns({"text": F.coalesce("text", F.lit("")), "lines": F.split(F.coalesce("text", F.lit("")), "\n", -1)})
    ends = F.concat(F.array(F.lit(-1)), F.array_sort("drop"), F.array(F.size("lines")))
    cut = own.withColumn("stops", F.when(F.col("drop").isNotNull(), ends))
    kept = F.when(F.col("stops").isNull(), F.col("text")).otherwise(F.array_join(_without(F.col("lines"), F.col("stops")), "\n"))
    return cut.select(
        "doc_id", *[F.col(f"keep_{c}").alias(c) for c in keep], kept.alias("kept_text"),
        F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op5_linededup(spark, sf_dir: str) -> DataFrame:
    """The contract's query: keys of 20 characters or more in 3 documents or more."""
    done = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
             generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
c AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20
      GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, c.keeper IS NOT NULL AND k.doc_id <> c.keeper AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
