"""Snapshots: differences, upserts, deletions and state, each giving a new snapshot.

Parquet has no row-level MERGE; a snapshot is rewritten to a new path and swapped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import by_key


def diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "hash") -> DataFrame:
    """(key, status): added, deleted, modified or unchanged."""
    o, n = old.select(key, F.col(value).alias("o"), F.lit(True).alias("in_old")), new.select(key, F.col(value).alias("n"), F.lit(True).alias("in_new"))
    both = o.join(n, key, "full_outer")
    status = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(~F.col("o").eqNullSafe(F.col("n")), "modified").otherwise("unchanged")
    return both.select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of both; of one key, the row of `new`."""
    return old.join(new.select(*keys), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def last_writes(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Of each key the row written last."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(seq)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def merge_provenance(rows: DataFrame) -> DataFrame:
    """Knowledge edges by (source, target): largest weight, first relation by seq, all source documents.

    A document that many rows of an edge name is kept once before the shuffle.
    """
    docs = rows.select("source", "target", F.explode("source_docs").alias("doc")).groupBy("source", "target").agg(F.array_sort(F.collect_set("doc")).alias("source_docs"))
    own = rows.groupBy("source", "target").agg(F.max("weight").alias("weight"), F.min_by("relation", "seq").alias("relation"))
    return own.join(docs, ["source", "target"], "left").withColumn("source_docs", F.coalesce("source_docs", F.array().cast("array<string>")))


def delete_file(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of the files (file_path) that are gone."""
    lost = by_key(nodes.join(gone, "file_path", "left_semi").select(F.col("id").alias("lost")))
    kept = edges.join(lost, F.col("source_id") == F.col("lost"), "left_anti").join(lost, F.col("target_id") == F.col("lost"), "left_anti")
    return nodes.join(gone, "file_path", "left_anti"), kept


def delete_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without those of `ids` (id), and edges that don't touch these."""
    lost = ids.select(F.col("id").alias("lost"))
    kept = edges.join(lost, F.col("source_id") == F.col("lost"), "left_anti").join(lost, F.col("target_id") == F.col("lost"), "left_anti")
    return nodes.join(ids, "id", "left_anti"), kept


def retract(edges: DataFrame, doc: Column) -> DataFrame:
    """Edges without a document as their source; those with no other source go."""
    return edges.withColumn("source_docs", F.array_remove("source_docs", doc)).where(F.size("source_docs") > 0)


def purge(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    return chunks.join(sources, "source", "left_anti").select(*chunks.columns)


def replace_sources(chunks: DataFrame, fresh: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of changed sources are replaced by fresh ones; ids that are already there are not added."""
    kept = purge(chunks, sources)
    added = fresh.dropDuplicates(["id"]).join(kept.select("id"), "id", "left_anti")
    return kept.unionByName(added.select(*kept.columns))


def to_process(files: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """Files with `todo`: new, or of another hash than last time."""
    known = state.select("path", F.col("hash").alias("old_hash"))
    return files.join(known, "path", "left").withColumn("todo", F.lit(force) | ~F.col("hash").eqNullSafe(F.col("old_hash"))).drop("old_hash")


def file_state(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file_path, n_nodes, n_edges); an edge counts for the file of its source."""
    n = nodes.groupBy("file_path").agg(F.count("*").alias("n_nodes"))
    own = by_key(nodes.select(F.col("id").alias("source_id"), "file_path"))
    e = edges.join(own, "source_id").groupBy("file_path").agg(F.count("*").alias("n_edges"))
    return n.join(e, "file_path", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def merge_columns(old: DataFrame, new: DataFrame, key: str, base: list[str], kept: list[str]) -> DataFrame:
    """Rows of both: `base` columns of the new row if there is one, `kept` ones of the old if there is one."""
    o, n = old.alias("o"), new.alias("n")
    both = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    has = F.col(f"n.{key}").isNotNull()
    return both.select(
        F.coalesce(f"n.{key}", f"o.{key}").alias(key), *[F.when(has, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in base],
        *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in kept],
    )


def after_cursor(log: DataFrame, order: list[str], key: str, cursor: str) -> DataFrame:
    """Rows later in `order` than the row of the cursor; all rows if it isn't there."""
    at = log.where(F.col(key) == cursor).agg(F.max(F.struct(*order)).alias("at"))
    return log.join(F.broadcast(at)).where(F.col("at").isNull() | (F.struct(*order) > F.col("at"))).drop("at")  # at is one row


def drop_before(rows: DataFrame, column: str, limit) -> DataFrame:
    return rows.where(~(F.col(column) < F.lit(limit)))
