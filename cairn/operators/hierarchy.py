"""Documents in a hierarchy of path segments: classes, weights, roll-up and assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T


def classify(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, block): the first block (by ord) with a pattern in lower(stem + first 500 characters), else other.

    `patterns` (block, ord, pattern) is a table of settings, a few rows.
    """
    searched = docs.select("doc_id", F.lower(F.concat("stem", F.lit(" "), F.left("text", F.lit(500)))).alias("searched"))
    met = searched.join(F.broadcast(patterns), F.contains("searched", F.lower("pattern")))
    first = met.groupBy("doc_id").agg(F.min_by("block", "ord").alias("block"))
    return docs.select("doc_id").join(first, "doc_id", "left").select("doc_id", F.coalesce("block", F.lit("other")).alias("block"))


def prefixes(segs: Column) -> Column:
    """All prefixes of a path's segments, itself included, as joined strings."""
    return F.transform(F.sequence(F.lit(1), F.size(segs)), lambda n: F.array_join(F.slice(segs, 1, n), "_"))


def descendants(leaves: DataFrame) -> DataFrame:
    """(block, prefix, n): leaf documents (block, segs) under each prefix."""
    return leaves.where(F.size("segs") > 0).select("block", F.explode(prefixes(F.col("segs"))).alias("prefix")).groupBy("block", "prefix").agg(F.count("*").alias("n"))


def classification_table(docs: DataFrame) -> DataFrame:
    """(block, key, docs, kb): sizes of each class, and of each block with a null key."""
    kb = F.floor(F.col("size_bytes") / 1024)
    return docs.rollup("block", "key").agg(F.count("*").alias("docs"), F.sum(kb).alias("kb")).where("block is not null")


def plan_size(leaves: DataFrame) -> DataFrame:
    """(block, nodes): distinct proper prefixes of a block's leaves, and one for the block."""
    proper = leaves.select("block", F.explode_outer(F.slice(prefixes(F.col("segs")), 1, F.greatest(F.size("segs") - 1, F.lit(0)))).alias("prefix"))
    return proper.groupBy("block").agg((F.count_distinct("prefix") + 1).alias("nodes"))


def child_weights(children: DataFrame) -> DataFrame:
    """Adds score and weight to children (parent, child, leaves, size_bytes): 0.7 of the leaves' share of the most, 0.3 of the size's."""
    of = Window.partitionBy("parent")
    kb = F.greatest(F.floor(F.col("size_bytes") / 1024), F.lit(1))
    leaves = F.greatest("leaves", F.lit(1))
    score = leaves / F.max(leaves).over(of) * 0.7 + kb / F.max(kb).over(of) * 0.3
    return children.withColumn("score", score).withColumn("weight", F.when(F.col("score") >= 0.4, "major").when(F.col("score") >= 0.1, "normal").otherwise("minor"))


def rollup(leaves: DataFrame) -> DataFrame:
    """(block, round, depth, prefix, children, least_words, most_words): the nodes of every round of roll-up.

    Each round shortens all keys by a segment, until none has more than one; a lone child equal to its parent is carried.
    """
    own = leaves.select("block", "segs").distinct()
    longest = own.groupBy("block").agg(F.max(F.size("segs")).alias("longest"))
    rounds = own.join(longest, "block").where("longest > 1").select("block", "segs", "longest", F.explode(F.sequence(F.lit(1), F.col("longest") - 1)).alias("round"))
    cut = lambda n: F.array_join(F.slice("segs", 1, F.greatest(F.size("segs") - n, F.lit(0))), "_")
    pairs = rounds.select("block", "round", "longest", cut(F.col("round")).alias("prefix"), cut(F.col("round") - 1).alias("child")).distinct()
    nodes = pairs.groupBy("block", "round", "longest", "prefix").agg(F.count("*").alias("children"), F.max(F.col("child") == F.col("prefix")).alias("carried"))
    nodes = nodes.where(~(F.col("carried") & (F.col("children") == 1)))
    n = F.col("children")
    return nodes.select(
        "block", "round", F.greatest(F.col("longest") + 2 - F.col("round"), F.lit(2) - F.col("round")).alias("depth"), "prefix", "children",
        F.least(400 + 60 * n, F.lit(1200)).alias("least_words"), F.least(600 + 80 * n, F.lit(1400)).alias("most_words"),
    )


def assemble(weighted: DataFrame) -> DataFrame:
    """(parent, text): each parent's children (parent, child, score, weight, body), heaviest first."""
    section = F.concat(F.lit("## "), "child", F.lit(" ["), "weight", F.lit("]\n\n"), "body")
    rows = weighted.select("parent", F.struct(F.negative("score").alias("by"), "child", section.alias("s")).alias("x"))
    return rows.groupBy("parent").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["s"]), "\n\n---\n\n").alias("text"))


def dedup_sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of equal sentences the first is kept; `...` ends a text that no full stop ends."""
    rows = docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s")).withColumn("norm", F.lower(T.strip(F.col("s")))).where("norm <> ''")
    first = rows.groupBy("doc_id", "norm").agg(F.min(F.struct("pos", "s")).alias("f"))
    joined = first.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("f"))["s"], " ").alias("text"))
    full = docs.select("doc_id").join(joined, "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    ends = F.col("text").rlike(r"(?s)[.!?]\z") | (F.col("text") == "")
    return full.withColumn("text", F.when(ends, F.col("text")).otherwise(F.concat(T.rstrip(F.col("text")), F.lit("..."))))
