"""Exact cosine search for many queries at once, and the merging, boosting and projection of hits.

Queries are (query_id, embedding), the index is (id, embedding) with any further columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairn.functions.arrow import read_block
from cairn.session import block_files, by_key, materialise

#: Queries in a block, bytes of vectors of the index that meet all blocks at once, and rows of them that are scored at a time.
QUERY_BLOCK, SLAB_BYTES, SCORED = 1024, 64 << 20, 2048
SYNTHESIS = r"^L\d+$"


def _unit(column: pa.Array) -> np.ndarray:
    """Vectors of length 1, null ones of length 0, as rows."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows and len(flat) % rows or len(pc.unique(pc.list_value_length(column))) > 1:
        raise ValueError("vectors differ in length")
    vectors = flat.reshape(rows, -1)
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


@lru_cache(maxsize=2)
def _queries(uri: str) -> tuple[pa.Array, np.ndarray]:
    block = read_block(uri).combine_chunks()
    return block.column("query_id").combine_chunks(), _unit(block.column("embedding").combine_chunks())


def _best(queries: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """For each query the k largest of (score in millionths, first row) as one number each; -1 where there are fewer."""
    best = np.full((len(queries), k), -1, np.int64)
    for a in range(0, len(vectors), SCORED):
        part = vectors[a : a + SCORED]
        score = np.rint(np.round(queries @ part.T, 6) * 1e6).astype(np.int64) + 2_000_000
        keys = np.hstack([best, (score << 32) + ((1 << 32) - 1 - a - np.arange(len(part)))])
        best = np.partition(keys, -k, axis=1)[:, -k:]
    return best


def cosine_top_k(queries: DataFrame, index: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k rows of the index nearest to each query; ties by id.

    With `by`, a column of the index, the k nearest of each of its values, and that column. Queries are written down in
    blocks; every task scans its part of the index once and reads the blocks one after the other, so neither side passes the driver.
    Each task keeps its k best for each query, so only these are shuffled.
    """
    uris = block_files(queries.select("query_id", "embedding").where("embedding is not null"), QUERY_BLOCK, "queries")
    names = ["query_id", "id", "score", *([by] if by else [])]
    kinds = {"query_id": queries.schema["query_id"].dataType, **{c: index.schema[c].dataType for c in names if c in index.columns}}
    arrow = {n: to_arrow_type(t) for n, t in kinds.items()}

    def slab(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        table = table.take(pc.sort_indices(table, [(c, "ascending") for c in [by, "id"] if c])).combine_chunks()
        ids, vectors = table.column("id").combine_chunks(), _unit(table.column("embedding").combine_chunks())
        runs = [(0, len(ids), None)]
        if by:
            value = table.column(by).combine_chunks()
            code = value.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.diff(code, prepend=-1) != 0).tolist()
            runs = [(a, b, value[a].as_py()) for a, b in zip(starts, [*starts[1:], len(ids)])]
        for uri in uris:
            who, wanted = _queries(uri)
            for a, b, group in runs:
                best = _best(wanted, vectors[a:b], k)
                own, at = np.nonzero(best >= 0)
                found = best[own, at]
                row = a + (1 << 32) - 1 - (found & ((1 << 32) - 1))
                columns = {"query_id": who.take(pa.array(own)), "id": ids.take(pa.array(row)), "score": pa.array(((found >> 32) - 2_000_000) / 1e6)}
                if by:
                    columns[by] = pa.array([group] * len(own), arrow[by])
                yield pa.RecordBatch.from_arrays([columns[n].cast(arrow[n]) if n in arrow else columns[n] for n in names], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            step = max(1, SLAB_BYTES * batch.num_rows // max(1, batch.nbytes))
            for a in range(0, batch.num_rows, step):
                held.append(batch.slice(a, step))
                size += held[-1].nbytes
                if size >= SLAB_BYTES:
                    yield from slab(held)
                    held, size = [], 0
        if held:
            yield from slab(held)

    schema = ", ".join(f"`{n}` {kinds[n].simpleString() if n in kinds else 'double'}" for n in names)
    rows = index.where("embedding is not null").select(*[c for c in ["id", "embedding", by] if c])
    rank = F.row_number().over(Window.partitionBy("query_id", *([by] if by else [])).orderBy(F.desc("score"), "id"))
    found = rows.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "id", "score", "rank", *([by] if by else []))


def filtered(index: DataFrame, levels: list[str] | None = None, module: str | None = None, content_type: str | None = None) -> DataFrame:
    """The rows that all given filters let pass; they reach the scan, before any distance."""
    if levels:
        index = index.where(F.col("doc_level").isin(levels))
    if module:
        index = index.where(F.col("module") == module)
    return index.where(F.col("content_type") == content_type) if content_type else index


def synthesis_levels(index: DataFrame) -> DataFrame:
    """(doc_level): the levels L0, L1, ... but L3 that the index has."""
    return index.where(F.col("doc_level").rlike(SYNTHESIS) & (F.col("doc_level") != "L3")).select("doc_level").distinct()


def rerank(hits: DataFrame, scores: DataFrame, k: int, candidates: int = 10) -> DataFrame:
    """The best `candidates` hits, ordered by a supplied score (query_id, id, rerank_score) where there is one."""
    own = hits.where(F.col("rank") <= candidates).join(scores, ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce("rerank_score", "score")), "id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def merge_hits(hits: DataFrame, k: int) -> DataFrame:
    """Of hits of one source and first 100 characters the best; then the k best of each query."""
    score = F.coalesce("rerank_score", "score") if "rerank_score" in hits.columns else F.col("score")
    same = Window.partitionBy("query_id", "source", F.left("text", F.lit(100))).orderBy(F.desc(score), "id")
    best = hits.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "id"))).where(F.col("rank") <= k)


def hierarchical(queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """Half of k from synthesis levels and half from the rest, merged; all levels if both have none.

    One search finds both halves. Hits carry the first 100 characters of their texts (`with_texts` adds the whole).
    """
    half = max(k // 2, 2)
    upper = F.col("doc_level").rlike(SYNTHESIS) & (F.col("doc_level") != "L3")
    lower = F.col("doc_level").isin("L3", "code", "context")
    sides = index.withColumn("upper", F.when(upper, F.lit(True)).when(lower, F.lit(False)))
    known = sides.where("upper is not null")
    found = cosine_top_k(queries, index, k) if known.isEmpty() else cosine_top_k(queries, known, half, "upper")
    heads = index.drop("embedding").withColumn("text", F.left("text", F.lit(100)))
    return merge_hits(found.select("query_id", "id", "score").join(heads, "id"), k)


def with_texts(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Hits with the whole texts of the index (id, text)."""
    return hits.drop("text").join(index.select("id", "text"), "id")


def boost(hits: DataFrame, near: DataFrame, factor: float = 0.3) -> DataFrame:
    """Adds boosted and graph_boosted; `near` (query_id, source, hop) has sources close to a query's entities."""
    base = F.coalesce("rerank_score", "score") if "rerank_score" in hits.columns else F.col("score")
    closest = near.groupBy("query_id", "source").agg(F.min("hop").alias("hop"))
    lifted = base * (1 + factor / F.greatest("hop", F.lit(1)))
    return hits.join(closest, ["query_id", "source"], "left").withColumns({"boosted": F.when(F.col("hop").isNotNull(), lifted).otherwise(base), "graph_boosted": F.col("hop").isNotNull()})


def _top(entities: DataFrame, seeds: int, classes: DataFrame | None) -> DataFrame:
    """(query_id, id, confidence): the best `seeds` entities of each query. With `classes` (id, ids), an entity stands for all ids of its class, of which `ids` are the first."""
    if classes is not None:
        entities = entities.join(classes.select("id", F.slice("ids", 1, seeds).alias("ids")), "id").withColumn("id", F.explode("ids"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("confidence"), "id"))
    return materialise(entities.select("query_id", "id", "confidence").withColumn("n", rank).where(F.col("n") <= seeds).drop("n"), "entities")


def hybrid(queries: DataFrame, index: DataFrame, entities: DataFrame, edges: DataFrame, sources: DataFrame, k: int, max_hops: int = 2, seeds: int = 5, classes: DataFrame | None = None) -> DataFrame:
    """Hierarchical hits, boosted where a source is near the query's entities, best first.

    `entities` (query_id, id, confidence), `edges` (source_id, target_id), `sources` (id, source). Queries
    without a vector hit get one row that stands for the graph, score 0.5. With `classes` (id, n, ids; at least `seeds` ids each), entities are classes of ids.
    """
    from cairn.operators.graph import hops

    top = _top(entities, seeds, classes)
    around = hops(top.select(F.col("id").alias("seed")), edges, max_hops)
    near = top.select("query_id", F.col("id").alias("seed")).join(around, "seed").join(sources, "id").select("query_id", "source", "hop")
    hits = boost(hierarchical(queries, index, k), near)
    order = Window.partitionBy("query_id").orderBy(F.desc("boosted"), "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).select("query_id", "source", "id", F.col("boosted").alias("score"), "graph_boosted", "rank")
    bare = near.select("query_id").distinct().join(ranked.select("query_id"), "query_id", "left_anti")
    kind = index.schema["id"].dataType
    return ranked.unionByName(bare.select("query_id", F.lit("knowledge_graph").alias("source"), F.lit(None).cast(kind).alias("id"), F.lit(0.5).alias("score"), F.lit(False).alias("graph_boosted"), F.lit(1).alias("rank")))


def entity_search(entities: DataFrame, edges: DataFrame, threshold: float = 0.6, seeds: int = 3, classes: DataFrame | None = None) -> DataFrame:
    """(query_id, matches, neighbours): entities above the threshold, and nodes within a hop of the best.

    With `classes` (id, n, ids; at least `seeds` ids each), entities are classes of ids, of which all count.
    """
    from cairn.operators.graph import hops

    own = materialise(entities.where(F.col("confidence") >= threshold), "entities")
    top = _top(own, seeds, classes)
    near = hops(top.select(F.col("id").alias("seed")), edges, 1).where("hop = 1")
    count = top.select("query_id", F.col("id").alias("seed")).join(near, "seed").groupBy("query_id").agg(F.count_distinct("id").alias("neighbours"))
    counted = own.join(classes.select("id", "n"), "id") if classes is not None else own.withColumn("n", F.lit(1))
    return counted.groupBy("query_id").agg(F.sum("n").alias("matches")).join(count, "query_id", "left").withColumn("neighbours", F.coalesce("neighbours", F.lit(0)))


def subgraph_lines(edges: DataFrame, near: DataFrame, per_node: int = 3, most: int = 50) -> DataFrame:
    """(query_id, text): up to `per_node` relations of each node near a query, closest first, in `most` lines."""
    near = by_key(near)
    inside = near.alias("n").join(edges, F.col("n.id") == F.col("source_id")).join(near.alias("m"), (F.col("m.query_id") == F.col("n.query_id")) & (F.col("m.id") == F.col("target_id")))
    rows = inside.select(F.col("n.query_id").alias("query_id"), F.col("n.hop").alias("hop"), "source_id", "relation", "target_id").distinct()
    few = rows.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "source_id").orderBy("relation", "target_id"))).where(F.col("k") <= per_node)
    line = F.concat("source_id", F.lit(" --"), "relation", F.lit("--> "), "target_id")
    ranked = few.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy("hop", "source_id", "k"))).where(F.col("at") <= most)
    return ranked.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))


def context_blocks(hits: DataFrame) -> DataFrame:
    """(query_id, text): numbered sources with level and score, in order of rank."""
    line = F.format_string("[Source %d] %s (%s, score %.2f)%s\n%s", "rank", "source", "doc_level", "score", F.when(F.col("graph_boosted"), " +graph").otherwise(""), "text")
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n\n").alias("text"))


def projected(hits: DataFrame) -> DataFrame:
    score: Column = F.coalesce("rerank_score", "score") if "rerank_score" in hits.columns else F.col("score")
    return hits.withColumn("score", F.round(score, 4))
