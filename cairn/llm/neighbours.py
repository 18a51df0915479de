"""Near copies of vectors by a forest of random-projection trees.

Every tree splits the vectors along random directions, again and again; vectors near a split go to both sides (spill), and
all pairs within a leaf are compared. Trees are fitted on a bounded sample (SAMPLE) of the distinct vectors and then hold every
vector: a task sends its vectors down all trees, so that each row knows all of its leaves. Of a few random directions a node takes
the one with the fewest vectors near the split, which so falls between groups of near copies where it can; a node that no direction
splits well stays a leaf. A leaf of more than BLOCK vectors is compared block against block, in as many tasks.

Links are verified in double precision. A pair is counted in the first leaf that both vectors share, so that
counts add up without any list of pairs; besides its counts a leaf gives a spanning forest of its links. Equal vectors are one class from the start.

Vectors that are null, zero, or hold null or non-finite numbers link with nothing; vectors of different lengths don't either, empty ones
are zero. Rows with a null id count as others do, but never name a component; a component of such rows alone has none, and they are kept. Repeated rows link.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.components import connected_components
from cairn.session import materialise

SEED = 42
TREES, SAMPLE = 8, 1 << 16
#: Vectors of a leaf, as the sample foretells, and the fewest sampled ones that are split on.
LEAF, LEAST = 768, 64
#: A leaf of more vectors is dealt in blocks.
BLOCK = 2048
#: Half the width of the spill, in standard deviations of a projected difference at the least similarity.
SPILL = 0.4
#: Random directions that a node tries, and the share of its vectors that either side may hold at most.
TRIES, WORST = 4, 0.8


def units(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of unit length, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Node:
    """A split: vectors whose projection is at most `high` go left, those at `low` or more go right; or a leaf's number."""

    direction: np.ndarray | None
    low: float = 0.0
    high: float = 0.0
    left: Node | None = None
    right: Node | None = None
    leaf: int = -1


def _fit(x: np.ndarray, share: float, half: float, rng: np.random.Generator, leaf: Iterator[int]) -> Node:
    """A tree over the sample x, each row of which stands for `share` vectors."""
    if len(x) < 2 * LEAST or len(x) * share <= LEAF:
        return Node(None, leaf=next(leaf))
    best = None
    for _ in range(TRIES):
        direction = rng.normal(size=x.shape[1])
        direction /= np.sqrt((direction * direction).sum())
        p = np.sort(x @ direction)
        # of places around the middle, that with the fewest vectors within its spill
        at = (p[int(0.3 * len(p)) : int(0.7 * len(p))] + p[int(0.3 * len(p)) + 1 : int(0.7 * len(p)) + 1]) / 2
        left, right = np.searchsorted(p, at + half, side="right"), len(p) - np.searchsorted(p, at - half, side="left")
        k = int(np.argmin(left + right + np.abs(left - right) / 4))
        if best is None or left[k] + right[k] < best[0]:
            best = (left[k] + right[k], max(left[k], right[k]), direction, at[k])
    _, most, direction, at = best
    if most > WORST * len(x):
        return Node(None, leaf=next(leaf))
    p = x @ direction
    sides = x[p <= at + half], x[p >= at - half]
    return Node(direction, at - half, at + half, *(_fit(s, share, half, rng, leaf) for s in sides))


def _count(numbers: list[int]) -> Iterator[int]:
    while True:
        numbers[0] += 1
        yield numbers[0] - 1


def forest(sample: dict[int, np.ndarray], share: float, similarity: float, trees: int = TREES) -> tuple[dict[int, list[Node]], int]:
    """Trees for each length of vectors, and the number of their leaves."""
    numbers, found = [0], {}
    for length, x in sorted(sample.items()):
        # a projected difference has this deviation where a pair is just similar enough
        half = SPILL * np.sqrt(2 - 2 * similarity) / np.sqrt(length)
        found[length] = [_fit(x, share, half, np.random.default_rng((SEED, length, t)), _count(numbers)) for t in range(trees)]
    return found, numbers[0]


def leaves(x: np.ndarray, trees: list[Node]) -> list[list[int]]:
    """The leaves of every row of x, ascending."""
    own: list[list[int]] = [[] for _ in x]

    def down(node: Node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if node.direction is None:
            for r in rows:
                own[r].append(node.leaf)
            return
        p = x[rows] @ node.direction
        down(node.left, rows[p <= node.high])
        down(node.right, rows[p >= node.low])

    for tree in trees:
        down(tree, np.arange(len(x)))
    return [sorted(o) for o in own]


def _keyed(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, str]:
    """(vec_id, key, vec) per row: the vector's bytes and their hash, null if it links with nothing; the bytes' kind."""
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v"))
    kind = "<f4" if source.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    source = source if kind == "<f4" else source.withColumn("v", F.col("v").cast("array<double>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat, ends = v.values.to_numpy(zero_copy_only=False).astype(kind), v.offsets.to_numpy()
            raw = []
            for there, a, b in zip(v.is_valid().to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                x = flat[a:b]
                raw.append(x.tobytes() if there and np.isfinite(x).all() and x.any() else None)
            keys = [None if r is None else xxhash.xxh3_128_digest(r, SEED) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "key", "vec"])

    return source.mapInArrow(run, f"vec_id {source.schema['vec_id'].dataType.simpleString()}, key binary, vec binary"), kind


def _compare(x: np.ndarray, apart: np.ndarray | None, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of rows of x at the similarity or more, in pieces; where `apart` is given, its values must differ."""
    rough = x.astype(np.float32)
    for a in range(0, len(x), 512):
        i, j = np.nonzero(rough[a : a + 512] @ rough[a:].T >= similarity - 1e-4)
        i, j = i[i < j] + a, j[i < j] + a
        for s in range(0, len(i), 1 << 14):
            u, v = i[s : s + (1 << 14)], j[s : s + (1 << 14)]
            ok = (x[u] * x[v]).sum(1) >= similarity
            if apart is not None:
                ok &= apart[u] != apart[v]
            yield u[ok], v[ok]


def _first(sets: np.ndarray, u: np.ndarray, v: np.ndarray, leaf: int) -> np.ndarray:
    """Whether pairs share no leaf before this one; rows of `sets` are padded with -1 and -2."""
    a, b = sets[u], sets[v]
    return ~((a[:, :, None] == b[:, None, :]) & (a[:, :, None] < leaf) & (a[:, :, None] >= 0)).any((1, 2))


def links(classes: DataFrame, kind: str, similarity: float, trees: int = TREES, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Of classes (c, m, vec), a written table: (c, n, v) rows, whose n add up to each class's links, and whose (c, v) join what is linked."""
    width = int(kind[-1])
    n = classes.count()
    # every class has the same chance, whatever its number of rows
    some = classes.where(F.pmod(F.xxhash64("vec"), F.lit(max(n, 1))) < sample).select("vec") if n > sample else classes.select("vec")
    by_length: dict[int, list[bytes]] = {}
    for raw in some.toArrow().column("vec").to_pylist():
        by_length.setdefault(len(raw) // width, []).append(raw)
    fitted, number = forest({d: units(raw, kind) for d, raw in by_length.items()}, max(1.0, n / sample), similarity, trees)
    sent = classes.sparkSession.sparkContext.broadcast(fitted)  # of the size that SAMPLE allows

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, own = batch.column("vec").to_pylist(), [None] * batch.num_rows
            lengths = np.array([len(r) // width for r in raw])
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                # a length that no sampled vector has is a leaf
                found = leaves(units([raw[r] for r in rows], kind), sent.value[d]) if d in sent.value else [[number + d]] * len(rows)
                for r, o in zip(rows, found):
                    own[r] = o
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.list_(pa.int32()))], [*batch.schema.names, "leaves"])

    placed = materialise(classes.mapInArrow(walk, "c long, m long, vec binary, leaves array<int>"), "neighbours-placed")
    at = placed.withColumn("leaf", F.explode("leaves"))
    # no more rows than the trees have leaves
    crowded = at.groupBy("leaf").count().where(F.col("count") > block)
    parts = F.coalesce(F.ceil(F.col("count") / block).cast("int"), F.lit(1))
    dealt = (
        at.join(F.broadcast(crowded), "leaf", "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "c", "m", "vec", "leaves")
    )

    def run(table: pa.Table) -> pa.Table:
        leaf, cross = table.column("leaf")[0].as_py(), table.column("a")[0].as_py() != table.column("b")[0].as_py()
        c, m = (table.column(x).to_numpy() for x in ("c", "m"))
        x = units(table.column("vec").to_pylist(), kind)
        own = [np.array(o, np.int32) for o in table.column("leaves").to_pylist()]
        sets = np.full((len(c), max(map(len, own))), -1, np.int32)
        for r, o in enumerate(own):
            sets[r, : len(o)] = o
        n, label = np.zeros(len(c), np.int64), np.arange(len(c))
        rest: list[tuple] = []
        for u, v in _compare(x, table.column("own").to_numpy() if cross else None, similarity):
            new = _first(sets, u, v, leaf)
            u, v = u[new], v[new]  # an earlier leaf has joined the others
            np.add.at(n, u, m[v])
            np.add.at(n, v, m[u])
            # a spanning forest: labels fall to the least row of what is joined
            while len(u):
                p, q = label[u], label[v]
                u, v, p, q = u[p != q], v[p != q], p[p != q], q[p != q]
                if len(u):
                    high, low = np.maximum(p, q), np.minimum(p, q)
                    into = np.arange(len(c))
                    np.minimum.at(into, high, low)
                    while (into[into] != into).any():
                        into = into[into]
                    label = into[label]
        there, joined = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(c)))
        rest = [np.concatenate([c[there], c[joined]]), np.concatenate([n[there], np.zeros(len(joined), np.int64)])]
        partner = pa.concat_arrays([pa.nulls(len(there), pa.int64()), pa.array(c[label[joined]], pa.int64())])
        return pa.table({"c": pa.array(rest[0], pa.int64()), "n": pa.array(rest[1], pa.int64()), "v": partner})

    return dealt.groupBy("leaf", "a", "b").applyInArrow(run, "c long, n long, v long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", similarity: float = 0.9, trees: int = TREES, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row; component_id is the smallest vec_id reachable over links."""
    keyed, kind = _keyed(vectors, id_col, vec_col)
    rows = materialise(keyed, "neighbours-rows")
    grouped = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.min("vec").alias("vec"))
    classes = materialise(grouped.withColumn("c", F.monotonically_increasing_id()), "neighbours-classes")
    found = materialise(links(classes.select("c", "m", "vec"), kind, similarity, trees, sample, block), "neighbours-links")
    counts = found.where("v is null").groupBy("c").agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("v is not null"), "c", "v").withColumnRenamed("id", "c")
    whole = materialise(
        classes.select("c", "key", "least", "m").join(counts, "c", "left").join(labels, "c", "left")
        .select("key", "least", (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "c").alias("component")), "neighbours-whole",
    )
    least = materialise(whole.groupBy("component").agg(F.min("least").alias("component_id")), "neighbours-least")
    # written down, so that a vector of many copies can be split in the join below
    named = materialise(whole.join(least, "component").select("key", "n_links", "component_id"), "neighbours-named")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = rows.where("key is not null").join(named, "key").select("vec_id", "n_links", "component_id").unionByName(alone)
    return both.withColumn("kept", F.col("component_id").isNull() | F.col("vec_id").eqNullSafe(F.col("component_id")))


def op13_neighbours(spark, sf_dir: str) -> DataFrame:
    """The contract's query: all rows of embeddings, linked at a cosine of 0.9."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs; the forest finds nearly all of them (the tests measure it), and here there are few.
OP13_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), true)
             AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
r AS (SELECT u, v FROM p UNION SELECT r.u, p.v FROM r JOIN p ON r.v = p.u),
n AS (SELECT u, count(*) AS n FROM p GROUP BY u), c AS (SELECT u, min(v) AS v FROM r GROUP BY u)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(least(c.v, vec_id), vec_id) AS component_id, coalesce(least(c.v, vec_id), vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id
"""
