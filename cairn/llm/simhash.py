"""SimHash near-duplicates, found by pigeonring filtering of 64-bit fingerprints.

Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows are
kept, null ids too (they never become a component's id). Long texts are hashed in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.texts import slices, space_words
from cairn.operators.components import connected_components
from cairn.session import materialise

SEED = 42
#: Segment widths of the ring; they add up to 64.
WIDTHS = (13, 13, 13, 13, 12)
SHIFTS = tuple(accumulate(WIDTHS, initial=0))[:-1]
#: A bucket with more members is dealt by longer keys, and if these are crowded too compared block against block, in as many tasks.
BLOCK = 1024
#: Bits of a key that say at which segment its chain starts.
START_SHIFT, START_MASK = 33, 7


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """The hash of each shingle, repeats included; fewer words are one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    ends = [starts[i + size] - 1 if i + size < len(starts) else len(joined) for i in range(n)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, n)


def majority(hashes: np.ndarray) -> int:
    """The bits that are 1 in over half of the hashes, as a signed number; 0 without any."""
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        octets = hashes[a : a + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def fingerprint(words: list[bytes], size: int) -> int:
    """The majority bits of the shingles' hashes; 0 without words."""
    return majority(shingle_hashes(words, size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(doc_id, fp) per row of `docs`, fp as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            fps = [fingerprint(space_words(t), shingle) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, "doc_id long, fp long")


def ring_keys(fp):
    """Bucket keys of a fingerprint: a whole segment and one half of the next in the ring.

    If at most 4 of 64 bits differ, then from some segment on every chain of l segments
    differs in at most l * 4/5 bits: the first not at all, the first two in one bit, so
    that one half of the second is equal as well.
    """
    segment = lambda i: F.shiftrightunsigned(fp, SHIFTS[i]).bitwiseAND(F.lit((1 << WIDTHS[i]) - 1))
    keys = []
    for i in range(len(WIDTHS)):
        j = (i + 1) % len(WIDTHS)
        low = WIDTHS[j] // 2
        for half, value in enumerate(
            (segment(j).bitwiseAND(F.lit((1 << low) - 1)), F.shiftrightunsigned(segment(j), low))
        ):
            keys.append(F.shiftleft(segment(i), 8).bitwiseOR(value) + F.lit((2 * i + half) << 32))
    return F.array(*keys)


def longer_keys(fp, key):
    """Keys of a crowded bucket's member: its key and three more halves of segments.

    Seven halves are outside the key. At most 4 of their bits differ, so that three halves at least are equal.
    """
    halves = []
    for shift, width in zip(SHIFTS, WIDTHS):
        low = width // 2
        halves += [(shift, low), (shift + low, width - low)]
    value = F.array(*[F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) for s, w in halves])
    number = F.shiftright(key, 32).cast("int")
    half = F.pmod(number, F.lit(2))
    # places in the ring from the start segment on: the rest of the second segment, and all of the others
    rest = [F.lit(3) - half, *[F.lit(k) for k in range(4, 2 * len(WIDTHS))]]
    own = [F.get(value, F.pmod(number - half + place, F.lit(2 * len(WIDTHS)))) for place in rest]
    start = key.bitwiseAND(F.lit(START_MASK << START_SHIFT))
    outside = F.lit(~(START_MASK << START_SHIFT))
    return F.array(*[F.xxhash64(key, F.lit(n), *[own[i] for i in some]).bitwiseAND(outside).bitwiseOR(start) for n, some in enumerate(combinations(range(len(rest)), 3))])


def _chains(a: np.ndarray, b: np.ndarray, start: np.ndarray, bits: int) -> np.ndarray:
    """Whether pairs pass the chain from segment `start`, then the full check."""
    x, m = a ^ b, len(WIDTHS)
    shifts, masks = np.array(SHIFTS, np.uint64), np.array([(1 << w) - 1 for w in WIDTHS], np.uint64)
    alive, total = np.arange(len(x)), np.zeros(len(x), np.int64)
    for step in range(m):
        i = (start[alive] + step) % m
        total = total + np.bitwise_count((x[alive] >> shifts[i]) & masks[i])
        ok = total * m <= (step + 1) * bits
        alive, total = alive[ok], total[ok]
    return alive[np.bitwise_count(x[alive]) <= bits]


def _pairs(keys: np.ndarray, cross: np.ndarray, side: np.ndarray, fps: np.ndarray, bits: int) -> Iterator[tuple]:
    """Linked pairs among rows of equal keys; `keys` are sorted. Where `cross` holds, sides must differ."""
    first, gap = np.arange(len(keys) - 1), 1
    while len(first):
        first = first[first + gap < len(keys)]
        first = first[keys[first] == keys[first + gap]]
        use = first[~cross[first] | (side[first] != side[first + gap])]
        hit = use[_chains(fps[use], fps[use + gap], keys[use] >> START_SHIFT & START_MASK, bits)] if len(use) else use
        yield from zip(fps[hit].view(np.int64).tolist(), fps[hit + gap].view(np.int64).tolist())
        gap += 1


def _forest(pairs: Iterator[tuple], parent: dict) -> Iterator[tuple]:
    """Those pairs that join what `parent` (a disjoint-set forest) has apart."""

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in pairs:
        if (p := root(a)) != (q := root(b)):
            parent[max(p, q)] = min(p, q)
            yield a, b


def links(distinct: DataFrame, bits: int = 4, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between different fingerprints of `distinct` (fp) that keep all components.

    Each task yields a spanning forest of the links it sees, never all pairs of a group.
    """
    if not 0 < bits < len(WIDTHS):
        raise ValueError("this ring has one bit less than segments to spend")
    index = distinct.select("fp", F.explode(ring_keys(F.col("fp"))).alias("key"))
    crowded = lambda rows: materialise(rows.groupBy("key").count().where(F.col("count") > block), "simhash-crowded")
    first = index.join(crowded(index), "key", "left")
    refined = materialise(
        first.where("count is not null").select("fp", F.explode(longer_keys(F.col("fp"), F.col("key"))).alias("key")), "simhash-refined"
    )
    parts = F.ceil(F.col("count") / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = (
        first.where("count is null").unionByName(refined.join(crowded(refined), "key", "left"))
        .withColumn("parts", F.coalesce(parts, F.lit(1))).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "fp")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        held = None

        def edges(x: pa.Table) -> pa.RecordBatch:
            key, a, b, own, fp = (x.column(c).to_numpy() for c in ("key", "a", "b", "own", "fp"))
            # a crowded bucket's block pairs are told apart
            _, group = np.unique(np.stack([key, a, b]), axis=1, return_inverse=True) if b.any() else (None, None)
            if group is None:
                found = _pairs(key, np.zeros(len(key), bool), own, fp.view(np.uint64), bits)
                found = list(_forest(found, parent))
            else:
                found = []
                cuts = np.flatnonzero(np.diff(group.ravel())) + 1
                for s, e in zip([0, *cuts], [*cuts, len(key)]):
                    pairs = _pairs(key[s:e], a[s:e] != b[s:e], own[s:e], fp[s:e].view(np.uint64), bits)
                    found += _forest(pairs, parent)
            u, v = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = pa.concat_tables([held, now]).combine_chunks() if held is not None else now
            key, a, b = (now.column(c).to_numpy() for c in ("key", "a", "b"))
            same = (key == key[-1]) & (a == a[-1]) & (b == b[-1]) if len(key) else np.zeros(0, bool)
            cut = int(np.argmax(same)) if len(key) else 0
            if cut:
                yield edges(now.slice(0, cut).combine_chunks())
            held = now.slice(cut)
        if held is not None and held.num_rows:
            yield edges(held.combine_chunks())

    by = ["key", "a", "b"]
    return dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "u long, v long")


def components(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """(fp, component) of those fingerprints of `distinct` (fp) that are linked to another."""
    return connected_components(materialise(links(distinct, bits), "simhash-links")).withColumnRenamed("id", "fp")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 4
) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest doc_id reachable."""
    prints = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = components(classes.select("fp"), bits)
    # written down, as what follows, so that a component of many fingerprints and a fingerprint of many copies can be split in the joins below
    whole = materialise(classes.join(labels, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "simhash-whole")
    least = materialise(whole.groupBy("component").agg(F.min("least").alias("component_id")), "simhash-least")
    named = materialise(whole.join(least, "component").select("fp", "component_id"), "simhash-classes")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """The contract's query: 4-word shingles, links at 4 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs, shingle=4, bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
