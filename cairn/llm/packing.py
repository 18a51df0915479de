"""Packing of token streams into sequences, with source proportions held by deficit round-robin.

Every source is a queue of documents. In each round a queue is credited with its share of one
window and sends the documents that its credit covers; what is left is its deficit, carried to
the next round. A document is therefore sent in round ceil(c / q) - 1, where c is the number of its
queue's ids up to its end, over all partitions, and q the queue's credit a round. So the rounds come
from running totals, without a loop over windows, and the deficits pass from window to window
and from partition to partition. The documents, by round and queue, are one stream that is cut every
`length` ids; only its tail is shorter, and is cut into powers of two. No sequence has padding.

With `by_window`, ids are credited rather than documents: a round is a window, and each document is cut where its
queue's running total crosses a round's credit, so that every window is filled in the shares, however long the documents.
When a queue is empty, the others share its part. Credits are rounded down from running totals and a queue's own
fraction; what they differ from a window by doesn't add up, and moves a few ids over the window's edge.

Null texts are empty, null sources a queue of their own; repeated rows are separate documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import tokens
from cairn.session import materialise

#: Target shares of a window: the hot source is held at a quarter, the other sources share the rest by what they hold.
SHARES = {"src0": 0.25}
#: Rows of running totals in a task, about.
TOTALS_ROWS = 1 << 18


def running_total(rows: DataFrame, order: list[str], value: str, parts: int) -> DataFrame:
    """`rows` with `before`: the sum of `value` over all rows that come earlier in `order`."""
    extra = [f for f in rows.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(value).to_numpy()
            ends = total + np.cumsum(n)
            starts, total = ends - n, int(ends[-1]) if len(n) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), number, np.int64)), pa.array(starts)], [*batch.schema.names, "number", "within"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra) + ", number long, within long"
    summed = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "totals")
    sums = summed.groupBy("number").agg(F.sum(value).alias("own"))
    earlier = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("number", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"))
    # one row for each of the partitions above
    return summed.join(F.broadcast(bases), "number").select(*rows.columns, (F.col("base") + F.col("within")).alias("before"))


#: Queues at most; further sources share some.
QUEUES = 4096


def rounds(coded: DataFrame, length: int, shares: dict[str, float] | None = None) -> DataFrame:
    """(part, row, n, queue, round, upto): the round of each document and its queue's ids up to its end.

    `shares` gives sources' weights; the others, and all by default, weigh what they hold.
    """
    sums = coded.groupBy("queue", "part").agg(F.sum("n").alias("own"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("own").over(earlier), F.lit(0)))
    held = sums.groupBy("queue").agg(F.sum("own").cast("double").alias("weight"))
    if shares:
        given = F.create_map(*[F.lit(x) for k, v in shares.items() for x in (f"={k}", float(v))])
        total = held.agg(F.sum("weight").alias("all"))
        held = held.crossJoin(total).select("queue", F.coalesce(F.try_element_at(given, F.col("queue")), F.col("weight") / F.col("all")).alias("weight"))
    credit = held.join(F.broadcast(held.agg(F.sum("weight").alias("all"))))  # one row
    credit = credit.select("queue", (F.col("weight") / F.col("all") * length).alias("credit"))
    known = bases.join(credit, "queue").select("queue", "part", "base", "credit")
    upto = F.col("base") + F.col("run") + F.col("n")
    return (
        coded.select("queue", "part", "row", "n", "run").join(known, ["queue", "part"])
        .select("part", "row", "n", "queue", (F.ceil(upto / F.col("credit")) - 1).cast("long").alias("round"), upto.alias("upto"))
    )


def cut(start: int, n: int, whole: int, tail: list[int], length: int) -> list[tuple[int, int, int, int]]:
    """(start in the document, length, sequence, offset) of the pieces of n ids from `start` of the stream.

    The first `whole` sequences have `length` ids; `tail` are the ends of the further ones.
    """
    pieces, at = [], start
    while at < start + n:
        if at < whole * length:
            number, begin, end = at // length, at // length * length, (at // length + 1) * length
        else:
            k = int(np.searchsorted(tail, at, side="right"))
            number, begin, end = whole + k, tail[k - 1] if k else whole * length, tail[k]
        stop = min(end, start + n)
        pieces.append((at - start, stop - at, number, at - begin))
        at = stop
    return pieces


def tail_ends(total: int, length: int) -> list[int]:
    """Ends of the sequences after the whole ones: powers of two, falling."""
    at, rest, ends = total // length * length, total % length, []
    for k in reversed(range(length.bit_length())):
        if rest >> k & 1:
            at += 1 << k
            ends.append(at)
    return ends


class Credits:
    """Ids that each queue, of `held` ids and a weight, has been credited with after a number of windows."""

    def __init__(self, held: np.ndarray, weights: np.ndarray, length: int) -> None:
        if not (weights > 0).all():
            raise ValueError("shares must be above zero")
        self.held, self.weights, self.length, self.total = held, weights, length, int(held.sum())
        self.windows = -(-self.total // length)
        self.fraction = (np.arange(len(held)) + 0.5) / max(1, len(held))
        # time runs at weight ids a unit for each queue that isn't empty yet
        ends = held / weights
        order = np.argsort(ends, kind="stable")
        left = weights.sum() - np.cumsum(weights[order])
        self.times = np.concatenate([[0.0], ends[order]])
        self.sent = np.maximum.accumulate(np.concatenate([[0.0], np.cumsum(held[order]) + ends[order] * left.clip(0)]))

    def time(self, sent: np.ndarray) -> np.ndarray:
        """When so many ids have been sent in all; never falls."""
        i = np.clip(np.searchsorted(self.sent, sent, side="right") - 1, 0, max(0, len(self.sent) - 2))
        span = self.sent[i + 1] - self.sent[i]
        part = np.divide(sent - self.sent[i], span, out=np.ones(len(sent)), where=span > 0)
        return np.minimum(self.times[i] + part * (self.times[i + 1] - self.times[i]), self.times[i + 1])

    def after(self, queue: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """The credit of each queue (an index) after each number of windows."""
        sent = np.minimum(windows * self.length, self.total)
        credit = np.floor(self.weights[queue] * self.time(sent) + self.fraction[queue]).astype(np.int64)
        return np.where(sent >= self.total, self.held[queue], np.minimum(credit, self.held[queue]))

    def window(self, queue: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The window in whose credit id `at` of each queue lies."""
        low, high = np.zeros(len(at), np.int64), np.full(len(at), self.windows)
        while (high - low > 1).any():
            middle = (low + high) // 2
            within = self.after(queue, middle) <= at
            low, high = np.where(within, middle, low), np.where(within, high, middle)
        return low

    def before(self, queue: np.ndarray, window: np.ndarray) -> np.ndarray:
        """Ids of the stream before each queue's part of each window; windows hold their queues in order."""
        names, found = np.arange(len(self.held)), np.zeros(len(queue), np.int64)
        known, own = np.unique(window, return_inverse=True)
        step = max(1, (1 << 20) // max(1, len(names)))
        for a in range(0, len(known), step):
            part = known[a : a + step]
            now, then = (self.after(np.tile(names, len(part)), np.repeat(part + i, len(names))).reshape(len(part), -1) for i in (0, 1))
            start = now.sum(1, keepdims=True) + np.cumsum(then - now, axis=1) - (then - now)
            use = (own >= a) & (own < a + step)
            found[use] = start[own[use] - a, queue[use]]
        return found

    def pieces(self, queue: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, start in it, length, start in the stream) of documents of n ids from `start` of their queues."""
        first, last = self.window(queue, start), self.window(queue, start + n - 1)
        spans = last - first + 1
        doc = np.repeat(np.arange(len(n)), spans)
        window = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(spans) - spans, spans)
        base = self.after(queue[doc], window)
        a = np.maximum(base, start[doc])
        b = np.minimum(self.after(queue[doc], window + 1), (start + n)[doc])
        use = b > a
        doc, window, base, a, b = doc[use], window[use], base[use], a[use], b[use]
        return doc, a - start[doc], b - a, self.before(queue[doc], window) + a - base


def credits(coded: DataFrame, length: int, shares: dict[str, float] | None = None) -> tuple[DataFrame, Credits]:
    """(queue, part, base, number): ids of a queue before each part and the queue's number; and what the queues are credited with."""
    sums = materialise(coded.groupBy("queue", "part").agg(F.sum("n").alias("own")), "packing-sums")
    rows = sums.groupBy("queue").agg(F.sum("own").alias("held")).orderBy("queue").collect()  # one row a source
    names, held = [r.queue for r in rows], np.array([r.held for r in rows], np.int64)
    weights = held.astype(float)
    if shares:
        given = {f"={k}": float(v) for k, v in shares.items()}
        others, rest = max(1, sum(h for q, h in zip(names, held) if q not in given)), 1 - sum(v for q, v in given.items() if q in names)
        weights = np.array([given.get(q, h / others * rest if rest > 0 else h / held.sum()) for q, h in zip(names, held)])
    numbers = coded.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "queue string, number long")
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("own").over(earlier), F.lit(0))).join(numbers, "queue")
    # written down, so that it is broadcast if it is small
    return materialise(bases.select("queue", "part", "base", "number"), "packing-bases"), Credits(held, weights, length)


def bounded_queues(docs: DataFrame, column: str, shares: dict[str, float] | None, most: int) -> DataFrame:
    """`docs` with `column` of at most `most` values: sources with a share of their own and the largest of the others stay, the rest share queues by hash.

    Queues without a given share weigh what they hold, so that sources in one queue are sent in the same proportions together.
    """
    name = F.col(column).cast("string")
    sizes = materialise(docs.groupBy(name.alias("source")).agg(F.count("*").alias("n")), "packing-sources")
    if sizes.count() <= most:
        return docs
    given = sorted(shares or {})
    own = sizes.where(F.col("source").isNotNull() & ~F.col("source").isin(given)).orderBy(F.desc("n"), "source").limit(most // 2).select("source")
    own = own.select(F.col("source").alias("_name"), F.lit(True).alias("_own"))
    group = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(name), F.lit(most // 2)).cast("string"))
    kept = docs.join(F.broadcast(own), name == F.col("_name"), "left")  # most // 2 names
    named = F.when(F.col("_own") | F.col(column).isNull() | F.col(column).cast("string").isin(given), F.col(column).cast("string")).otherwise(group)
    return kept.withColumn(column, named).drop("_own", "_name")


def pack(docs: DataFrame, tokenizer: str, end: int, length: int = 2048, shares: dict[str, float] | None = None, with_ids: bool = True, by_window: bool = False, **columns: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids) per piece."""
    spark = docs.sparkSession
    if queue := columns.get("queue_col"):
        docs = docs.select(*{columns.get("id_col", "doc_id"), columns.get("text_col", "text"), queue})
        docs = bounded_queues(docs, queue, shares, QUEUES)
    coded = materialise(tokens.tokenize(docs, tokenizer, end, **columns), "packing-ids")
    size = coded.agg(F.count("*").alias("rows"), F.sum("n").alias("ids")).first()
    total = size.ids or 0
    whole, tail, dtype = total // length, tail_ends(total, length), tokens.id_type(tokenizer).str
    if by_window:
        bases, dealt = credits(coded, length, shares)
        located = coded.join(bases, ["queue", "part"]).select("doc_id", (F.col("base") + F.col("run")).alias("before"), "number", "n", "ids")
    else:
        parts = max(spark.sparkContext.defaultParallelism, -(-size.rows // TOTALS_ROWS))
        placed = running_total(rounds(coded, length, shares), ["round", "queue", "upto"], "n", parts)
        located = coded.select("part", "row", "doc_id", "n", "ids").join(placed.select("part", "row", "before"), ["part", "row"])
        located = located.select("doc_id", "before", F.lit(0).cast("long").alias("number"), "n", "ids")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tokens.slices(batches, "ids"):
            rows = []
            before, n, number = (batch.column(c).to_numpy() for c in ("before", "n", "number"))
            parts = dealt.pieces(number, before, n) if by_window else (np.arange(len(n)), np.zeros(len(n), np.int64), n, before)
            doc_ids, own, last = batch.column("doc_id").to_pylist(), batch.column("ids"), None
            for i, base, some, at in zip(*(c.tolist() for c in parts)):
                if i != last:
                    ids, last = np.frombuffer(own[i].as_py(), dtype).astype("<u4"), i
                for start, size, number, offset in cut(at, some, whole, tail, length):
                    raw = ids[base + start : base + start + size].tobytes()
                    rows.append((doc_ids[i], base + start, size, zlib.crc32(raw), len(ids), number, offset, *[raw] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(zip(*rows))], names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return located.mapInArrow(run, schema)


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's query: byte-level BPE ids with end id 1 in sequences of 2048, sources in SHARES."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, "byte_bpe_50k.json", 1, shares=SHARES, with_ids=False, by_window=True, queue_col="source")
