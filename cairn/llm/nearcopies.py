"""Near copies by exact similarity: groups of documents linked at a Jaccard similarity of 0.8 or more.

A document is the set of its five-word shingles (64-bit hashes). Rows of equal sets are one class.
Classes are proposed to each other by the SimHash operator, whose groups link fingerprints of few differing bits, and, as
64 bits can't tell similarities near 0.8 apart, by 40 bands of 4 MinHashes: a pair at 0.8 shares none of the bands
with probability (1 - 0.8^4)^40 = 7e-10, a closer one less. Every proposed pair that isn't joined yet is then held
against the sets themselves, so no link is below the threshold.

Null, empty and blank texts have the empty set and link to each other. Null ids never become a group's id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import locators
from cairn.llm.simhash import components, majority, shingle_hashes
from cairn.llm.texts import slices, space_words
from cairn.operators.components import connected_components
from cairn.session import materialise

SEED = 42
#: Least Jaccard similarity of a link, as a fraction.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 4
#: A bucket with more members, or more hashes in their sets, is compared block against block, in as many tasks.
BLOCK, HASHES = 256, 1 << 20
#: Odd multipliers, a MinHash each.
FACTORS = np.random.default_rng(SEED).integers(1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The different hashes of a text's shingles, in order; those of fewer words are one shingle."""
    return np.unique(shingle_hashes(space_words(text), size))


def bands(own: np.ndarray) -> list[int]:
    """A key for each band of MinHashes; none for the empty set, which has its class to itself."""
    if not len(own):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for a in range(0, len(own), 2048):
        np.minimum(least, (FACTORS[:, None] * own[a : a + 2048]).min(1), out=least)
    raw = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), k) - (1 << 63) for k, row in enumerate(raw)]


def similar(sets: list[np.ndarray], first: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(i, j): for each set i, those sets j before it with which it has at least SIMILAR of their union in common.

    Sets are sorted and not empty. With `first`, those from it on are held against the ones before it alone.
    """
    over, under = SIMILAR
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    number, ids = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.zeros(len(number), bool)
    for i in range(max(first, 1), len(sets)):
        n = first or i
        mine = ids[starts[i] : starts[i + 1]]
        own[mine] = True
        common = np.add.reduceat(own[ids[: starts[n]]], starts[:n], dtype=np.int64)
        own[mine] = False
        yield i, np.flatnonzero(common * under >= over * (sizes[:n] + sizes[i] - common))


def _sets(docs: DataFrame, id_col: str, text_col: str, size: int, keep: tuple) -> DataFrame:
    """(doc_id, c, fp, n, bands, text, keep_...) per row; c names the class of equal sets of n hashes, fp is a fingerprint of the text."""
    kept = [F.col(c).alias(f"keep_{c}") for c in keep]
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept)
    more = [f for f in source.schema if f.name.startswith("keep_")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            hashes = [shingle_hashes(space_words(t), size) for t in part.column("text").to_pylist()]
            prints, sets = pa.array(map(majority, hashes), pa.int64()), list(map(np.unique, hashes))
            names = [xxhash.xxh64_intdigest(s.tobytes(), SEED) - (1 << 63) for s in sets]
            keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
            sizes = pa.array(map(len, sets), pa.int64())
            columns = [part.column("doc_id"), pa.array(names, pa.int64()), prints, sizes, keys, part.column("text"), *[part.column(f.name) for f in more]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "c", "fp", "n", "bands", "text", *[f.name for f in more]])

    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in more)
    return source.mapInArrow(run, f"doc_id long, c long, fp long, n long, bands array<long>, text string{kinds}")


def _compare(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) that keep the components within each group (key, a, b) of `rows` (own, c, label).

    Rows of one label are joined already. Where a and b differ, pairs of one `own` are left to the group of that block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        at, held = None, []

        def root(x):
            while (p := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[p]
            return x

        def join(x, y) -> None:
            if (p := root(x)) != (q := root(y)):
                parent[max(p, q)] = min(p, q)

        def links(cross: bool) -> Iterator[tuple]:
            for _, c, label, _ in held:
                join((1, c), (0, label))
            if len({root((1, c)) for _, c, _, _ in held}) == 1:
                return
            held.sort(key=lambda row: row[0])
            first = sum(row[0] == held[0][0] for row in held) if cross else 0
            if first == len(held):
                return
            for i, like in similar([row[3] for row in held], first):
                c = held[i][1]
                for j in like.tolist():
                    d = held[j][1]
                    if root((1, c)) != root((1, d)):
                        join((1, c), (1, d))
                        yield c, d

        def table(found: list) -> pa.RecordBatch:
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for part in slices(batches, "hashes"):
            found = []
            for key, a, b, own, c, label, raw in zip(*(part.column(n).to_pylist() for n in ("key", "a", "b", "own", "c", "label", "hashes"))):
                if (key, a, b) != at:
                    if held:
                        found += links(at[1] != at[2])
                    at, held = (key, a, b), []
                held.append((own, c, label, np.frombuffer(raw, np.uint64)))
            yield table(found)
        if held:
            yield table(list(links(at[1] != at[2])))

    by = ["key", "a", "b"]
    full = rows.join(sets, "c").select("key", "a", "b", "own", "c", "label", "hashes")
    return full.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long")


def links(classes: DataFrame, rows: DataFrame, size: int = 5, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between classes (c, n, bands, row) that keep all components; `rows` (row, c, text) has the numbered row of each.

    A bucket has a block for each `block` members and HASHES hashes. First each block of a bucket is compared, with the bucket's smallest class in every block, so that what is like it
    is joined by rows in proportion to the bucket. Only buckets of several blocks that aren't joined then have their blocks
    compared with each other.
    """
    index = classes.select("c", F.col("n").alias("hashes"), F.explode("bands").alias("key"))
    shared = materialise(index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "copies-shared")
    every = materialise(index.join(shared, "key"), "copies-buckets")
    sizes = every.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("x"), F.min("c").alias("least"), F.max("c").alias("most"), F.sum("hashes").alias("hashes"))
    # one key for each set of members
    parts = F.greatest(F.ceil(F.col("n") / block), F.least(F.ceil(F.col("hashes") / HASHES), F.col("n"))).cast("int")
    kept = materialise(sizes.groupBy("n", "x", "least", "most", "hashes").agg(F.min("key").alias("key")).withColumn("parts", parts), "copies-kept")
    members = materialise(
        every.join(kept.select("key", "parts", "least"), "key").select("key", "c", "least", "parts")
        .withColumn("own", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int")), "copies-members",
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            raw = [shingle_set(t, size).tobytes() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("c"), pa.array(raw, pa.binary())], ["c", "hashes"])

    # the texts stay where they are: a task makes the sets of those of its rows that are listed
    wanted = locators.write(classes.join(members.select("c").distinct(), "c").select("row"), "copies-wanted")
    sets = materialise(locators.pick(rows.select("row", "c", "text"), wanted, then=hashed, schema="c long, hashes binary"), "copies-sets")
    stars = members.select("key", F.col("own").alias("a"), F.col("own").alias("b"), "own", "c", F.col("c").alias("label"))
    hubs = kept.where("parts > 1").select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("a"), F.col("least").alias("c"))
    hubs = hubs.select("key", "a", F.col("a").alias("b"), F.col("a").alias("own"), "c", F.col("c").alias("label"))
    first = materialise(_compare(stars.unionByName(hubs), sets), "copies-links")
    crowded = members.where("parts > 1")
    labels = materialise(connected_components(first).select(F.col("id").alias("c"), F.col("component").alias("label")), "copies-labels")
    named = materialise(crowded.join(labels, "c", "left").withColumn("label", F.coalesce("label", "c")), "copies-crowded")
    apart = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    blocks = (
        named.join(apart, "key").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("other <> own")
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "c", "label")
    )
    return first.unionByName(materialise(_compare(blocks, sets), "copies-links"))


def _classes(docs: DataFrame, id_col: str, text_col: str, size: int, block: int, keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """The rows, numbered and written down with their class c, and (c, component_id)."""
    rows = materialise(locators.with_rows(_sets(docs, id_col, text_col, size, keep)), "copies-rows")
    # rows of one class have the same bands; one of them stands for all
    found = materialise(rows.groupBy("c").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("bands").alias("bands"), F.min("row").alias("row")), "copies-sets-of-rows")
    named = materialise(components(found.select("fp").distinct()), "copies-simhash")
    # a group of fingerprints is a bucket as a band is
    key = F.xxhash64(F.lit("simhash"), F.coalesce("component", "fp"))
    classes = found.join(named, "fp", "left").withColumn("bands", F.when(F.size("bands") > 0, F.concat("bands", F.array(key))).otherwise(F.col("bands")))
    classes = materialise(classes.select("c", "least", "n", "bands", "row"), "copies-classes")
    edges = materialise(links(classes, rows, size, block), "copies-edges")
    labels = connected_components(edges).withColumnRenamed("id", "c")
    whole = materialise(classes.select("c", "least").join(labels, "c", "left").withColumn("component", F.coalesce("component", "c")), "copies-whole")
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    # written down, so that a class of many rows can be split in a join
    return rows, materialise(whole.join(least, "component").select("c", "component_id"), "copies-named")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) per row; component_id is the smallest doc_id reachable over links."""
    rows, named = _classes(docs, id_col, text_col, size, block)
    return rows.select("doc_id", "c").join(named, "c").select("doc_id", "component_id")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, block: int = BLOCK, keep: tuple = ()) -> DataFrame:
    """(doc_id, text, *keep) of the rows whose document has the smallest doc_id of its group; rows without an id stay.

    Rows to leave out are listed by number, so that no text is shuffled, however many there are.
    """
    rows, named = _classes(docs, id_col, text_col, size, block, keep)
    own = rows.where("doc_id is not null").select("row", "doc_id", "c").join(named, "c").select("row", "doc_id", "component_id")
    own = materialise(own, "copies-rows-of-groups")
    copies = materialise(own.groupBy("doc_id").agg(F.bool_and(F.col("doc_id") != F.col("component_id")).alias("copy")).where("copy").select("doc_id"), "copies")
    gone = locators.write(own.join(copies, "doc_id").select("row"), "copies-gone")
    kept = locators.pick(rows.drop("c", "fp", "n", "bands"), gone, listed=False)
    return kept.select("doc_id", "text", *[F.col(f"keep_{c}").alias(c) for c in keep])
