"""Connected components of an undirected graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import materialise


#: Edges that are few enough to go on with in one task, about a MB.
FEW = 1 << 16


def _both(first: tuple[str, str], second: tuple[str, str]):
    """Two edges of each row."""
    return F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in (first, second)])).alias("e")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the smallest vertex around u."""
    both = edges.select(_both(("u", "v"), ("v", "u"))).select("e.u", "e.v")
    low = materialise(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "cc-least")
    return (
        both.where("v > u").join(low, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    return down.join(low, "u").select(_both(("v", "m"), ("u", "m"))).select("e.u", "e.v").where("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    """Order-free fingerprint of an edge set."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("u", "v")).alias("x"),
        F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF))).alias("s"),
    ).first()
    return row.n, row.x, row.s


def connected_components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """(id, component) for every vertex of `edges`; component is the smallest vertex reachable.

    Null endpoints, self-loops and repeated edges add nothing, but a vertex with only a
    self-loop is its own component. Each round halves what is left of the paths, so the
    number of rounds follows the logarithm of the component's size; per-vertex work is a
    minimum (combined before the shuffle) and an equi-join. The minima are written down, so that
    adaptive execution can split a vertex of many edges in that join. Where few edges are left, rounds take a task each.
    """
    base = materialise(edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct(), "cc-edges")
    vertices = base.select(F.col("u").alias("id")).unionByName(base.select(F.col("v").alias("id"))).distinct()
    current, before = base.where("u <> v"), None
    while (now := _digest(current)) != before and now[0]:
        before = now
        if now[0] <= FEW:
            current = current.coalesce(1)
        current = materialise(_small_star(_large_star(current)), "cc-edges")
    labels = current.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
