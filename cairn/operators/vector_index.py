"""An exact vector index: cells around pivots, and the triangle inequality to leave out what can't be among the best.

Pivots are fitted on a bounded sample; every row of the index lies in the cell of its nearest pivot, with its angle to it, sorted by (cell, angle)
in files dealt by range, so that a cell of any size spans as many as it needs. For a query at angle a from a pivot, no
vector at angle r from that pivot is nearer than |a - r|. A search first scans each query's nearest cells, which gives a k-th best score,
and then of the other cells only what may be better: results are those of a full scan whatever the pivots are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairn.functions.arrow import read_block
from cairn.operators.retrieval import QUERY_BLOCK, SLAB_BYTES, _unit
from cairn.session import block_files, materialise, scratch

#: Vectors that pivots are fitted on at most, pivots at most, and rounds of their fitting.
SAMPLE, PIVOTS, ROUNDS = 16_384, 1024, 6
#: Scores are rounded to millionths; what may be equal after that is not left out.
SLACK = 2e-6
#: The cell of vectors without a direction.
NOWHERE = -1


@dataclass
class VectorIndex:
    """`rows` (cell, angle, id, embedding, ...) and `cells` (cell, pivot, n, radius), one row a pivot, both written below `path`."""

    rows: DataFrame
    cells: DataFrame
    path: str

    def where(self, condition) -> VectorIndex:
        """The index of fewer rows; cells keep their radii."""
        return VectorIndex(self.rows.where(condition), self.cells, self.path)


def fit_pivots(vectors: np.ndarray, pivots: int, seed: int = 0) -> np.ndarray:
    """Unit vectors in the middle of groups of the given ones (spherical k-means)."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.permutation(len(vectors))[:pivots]]
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def build(index: DataFrame, pivots: int | None = None, path: str | None = None) -> VectorIndex:
    """Indexes all rows of (id, embedding, ...) that have a vector. Without `pivots` there are as many as the root of the rows, PIVOTS at most."""
    spark, path = index.sparkSession, path or scratch(index.sparkSession, "vector-index")
    rows = materialise(index.where("embedding is not null"), "index-rows")
    n = rows.count()
    few = rows if n <= SAMPLE else rows.where(F.pmod(F.xxhash64("embedding"), F.lit(n)) < SAMPLE)
    sample = few.select("embedding").toArrow().combine_chunks().column("embedding")
    known = _unit(sample.combine_chunks()) if len(sample) else np.zeros((0, 1))
    known = known[np.abs(known).sum(1) > 0]
    centres = fit_pivots(known, pivots or min(PIVOTS, int(np.sqrt(n)) + 1)) if len(known) else known

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column("embedding"))
            there = np.abs(x).sum(1) > 0
            cell, angle = np.full(len(x), NOWHERE, np.int32), np.zeros(len(x))
            if len(centres) and there.any():
                near = x[there] @ centres.T
                cell[there] = near.argmax(1)
                angle[there] = np.arccos(np.clip(near.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(angle), *batch.columns], ["cell", "angle", *batch.schema.names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    placed = rows.mapInArrow(assign, f"cell int, angle double, {kinds}")
    placed.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle").write.parquet(f"{path}/rows")
    placed = spark.read.schema(f"cell int, angle double, {kinds}").parquet(f"{path}/rows")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius"))
    # a row a pivot
    spark.createDataFrame([(i, c) for i, c in enumerate(centres.tolist())], "cell int, pivot array<double>").join(sizes, "cell", "left").coalesce(1).write.parquet(f"{path}/cells")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/cells"), path)


def _pass(queries: DataFrame, index: VectorIndex, k: int, pivots: np.ndarray, size: np.ndarray, second: bool) -> DataFrame:
    """(query_id, id, score): k best per query and task, of the nearest cells, or of all others that may hold better than `least`.

    Rows without an id say in `score` how many products a task computed.
    """
    uris = block_files(queries, QUERY_BLOCK, "queries")
    kinds = {"query_id": queries.schema["query_id"].dataType, "id": index.rows.schema["id"].dataType}
    arrow = {n: to_arrow_type(t) for n, t in kinds.items()}

    def block(uri: str) -> tuple:
        table = read_block(uri).combine_chunks()
        x = _unit(table.column("embedding").combine_chunks())
        angle = np.arccos(np.clip(x @ pivots.T, -1, 1)) if len(pivots) else np.zeros((len(x), 0))
        order = np.argsort(angle, axis=1, kind="stable")
        # the nearest cells that hold k rows together, one at least
        sums = np.cumsum(size[order], axis=1)
        near = np.zeros(angle.shape, bool)
        np.put_along_axis(near, order, np.concatenate([np.zeros((len(x), 1)), sums[:, :-1]], axis=1)[:, : angle.shape[1]] < k, axis=1)
        least = table.column("least").to_numpy().copy() if second else np.full(len(x), -np.inf)
        least[np.abs(x).sum(1) == 0] = -np.inf  # a query without a direction scores 0 everywhere
        return table.column("query_id").combine_chunks(), x, angle, near, np.arccos(np.clip(least - SLACK, -1, 1))

    def slab(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        table = table.take(pc.sort_indices(table, [("cell", "ascending"), ("angle", "ascending")])).combine_chunks()
        ids, x = table.column("id").combine_chunks(), _unit(table.column("embedding").combine_chunks())
        cell, angle = table.column("cell").to_numpy(), table.column("angle").to_numpy()
        by_id = pc.sort_indices(ids).to_numpy()
        place = np.empty(len(ids), np.int64)
        place[by_id] = np.arange(len(ids))
        starts = np.flatnonzero(np.diff(cell, prepend=NOWHERE - 1) != 0).tolist()
        for uri in uris:
            who, wanted, away, near, reach = block(uri)
            best, scored = np.full((len(wanted), k), -1, np.int64), 0
            for a, b in zip(starts, [*starts[1:], len(cell)]):
                c = cell[a]
                if c == NOWHERE:
                    own = np.arange(len(wanted)) if second else np.zeros(0, int)
                    low, high = a, b
                else:
                    own = np.flatnonzero(near[:, c] != second)
                    if second:
                        # rows between these angles may be near enough
                        low, high = np.searchsorted(angle[a:b], away[own, c] - reach[own]), np.searchsorted(angle[a:b], away[own, c] + reach[own], side="right")
                        own, low, high = own[low < high], low[low < high], high[low < high]
                        low, high = (a + low.min(), a + high.max()) if len(own) else (a, a)
                    else:
                        low, high = a, b
                for s in range(low, high, 2048):
                    if not len(own):
                        break
                    e = min(s + 2048, high)
                    score = np.rint(np.round(wanted[own] @ x[s:e].T, 6) * 1e6).astype(np.int64) + 2_000_000
                    keys = np.concatenate([best[own], (score << 32) + ((1 << 32) - 1 - place[s:e])[None, :]], axis=1)
                    best[own] = np.partition(keys, -k, axis=1)[:, -k:]
                    scored += score.size
            q, at = np.nonzero(best >= 0)
            found = best[q, at]
            row = by_id[(1 << 32) - 1 - (found & ((1 << 32) - 1))]
            columns = [who.take(pa.array(q)).cast(arrow["query_id"]), ids.take(pa.array(row)).cast(arrow["id"]), pa.array(((found >> 32) - 2_000_000) / 1e6)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, arrow["query_id"]), pa.nulls(1, arrow["id"]), pa.array([float(scored)])], ["query_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, amount = [], 0
        for batch in batches:
            held.append(batch)
            amount += batch.nbytes
            if amount >= SLAB_BYTES:
                yield from slab(held)
                held, amount = [], 0
        if held:
            yield from slab(held)

    rows = index.rows.select("cell", "angle", "id", "embedding")
    return rows.mapInArrow(run, f"query_id {kinds['query_id'].simpleString()}, id {kinds['id'].simpleString()}, score double")


def search(queries: DataFrame, index: VectorIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, id, score, rank), as `retrieval.cosine_top_k` gives them, and (scored, pairs): one row with the products computed, of all there are."""
    cells = index.cells.orderBy("cell").collect()  # bounded: a row a pivot
    pivots = np.array([c.pivot for c in cells]).reshape(len(cells), len(cells[0].pivot) if cells else 0)
    size = np.array([c.n or 0 for c in cells], np.int64)
    asked = materialise(queries.select("query_id", "embedding").where("embedding is not null"), "asked")
    first = materialise(_pass(asked, index, k, pivots, size, False), "index-near")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    kth = first.where("id is not null").withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    bounded = asked.join(kth, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0)))
    both = first.unionByName(materialise(_pass(bounded, index, k, pivots, size, True), "index-rest"))
    hits = both.where("id is not null").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
    pairs = asked.agg(F.count("*").alias("q")).join(index.rows.agg(F.count("*").alias("n")))  # a row each
    return hits, both.where("id is null").agg(F.sum("score").cast("long").alias("scored")).join(pairs.select((F.col("q") * F.col("n")).alias("pairs")))
