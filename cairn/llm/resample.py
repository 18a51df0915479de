"""Importance resampling towards a target distribution of hashed word runs.

Features are all runs of 1 to `most` consecutive words, hashed into `buckets`. The log ratio of the target's and the corpus's
smoothed shares of each bucket is an array that tasks score documents with; Gumbel noise, drawn from the id, makes the highest scores a sample
without replacement. The cutoff among the scores is found without sorting them all: a quantile sketch brackets it, exact counts outside the
bracket validate it or widen it, and only the bracket is sorted.

Null and blank texts have no features and weight 0. Rows with a null id are counted as corpus but have no score and are never
drawn. Repeated rows are scored each on its own; of rows alike in score and id as many are drawn as places are left. An empty target is uniform.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.texts import alnum_words, slices
from cairn.operators.ranking import numbered
from cairn.session import materialise

MOST, BUCKETS, SEED, MIN_WORDS, PER_CENT = 1, 10_000, "2024", 20, 10
#: Relative accuracy of the quantile sketch, and how many times its error the bracket is wide on each side at first.
ACCURACY, MARGIN = 10_000, 2


def features(text: str | None, most: int, buckets: int) -> tuple[np.ndarray, int]:
    """The bucket of every run of 1 to `most` words, and the number of words."""
    words = alnum_words(text)
    runs = [words, *([b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, most + 1))]
    return np.concatenate([np.fromiter(map(crc32, r), np.int64, len(r)) for r in runs]) % buckets, len(words)


def bucket_counts(texts: DataFrame, most: int = MOST, buckets: int = BUCKETS, text_col: str = "text") -> np.ndarray:
    """How often each bucket occurs in a table; a row a bucket and task is shuffled, `buckets` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in slices(batches, "text"):
            for text in part.column("text").to_pylist():
                total += np.bincount(features(text, most, buckets)[0], minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    found = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in found.collect():
        counts[row.bucket] = row.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, floored."""
    k, s, t = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + k) / ((a + 1) * (t + k)))) for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(name: str, seed: str) -> int:
    """Thousandths of a Gumbel number drawn from a name, floored."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, most: int = MOST, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight, score) per row; the weight is the floored mean gain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            ids, rows = part.column("doc_id").to_pylist(), []
            for doc, text in zip(ids, part.column("text").to_pylist()):
                own, n = features(text, most, len(gain))
                weight = int(gain[own].sum()) // len(own) if len(own) else 0
                rows.append((len(own), n, weight, None if doc is None else weight + noise(doc, seed)))
            columns = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], names)

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_features", "n_words", "weight", "score"]
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_features long, n_words long, weight long, score long")


def cutoff(rows: DataFrame, n: int, k: int, accuracy: int = ACCURACY, margin: float = MARGIN) -> tuple:
    """(score, doc_id) of the k-th of the n `rows` (score, doc_id; a written table) by descending score, then id; 1 <= k <= n."""
    width = margin / accuracy
    while True:
        at = [max(0.0, 1 - k / n - width), min(1.0, 1 - (k - 1) / n + width)]
        low, high = rows.agg(F.percentile_approx("score", at, accuracy)).first()[0] if width < 1 else rows.agg(F.min("score"), F.max("score")).first()
        above, inside = rows.agg(F.count_if(F.col("score") > high), F.count_if(F.col("score").between(low, high))).first()
        if above < k <= above + inside:
            break
        width *= 8
    bracket = materialise(rows.where(F.col("score").between(low, high)).select("score", "doc_id"), "resample-bracket")
    last = numbered(bracket, [F.desc("score"), "doc_id"], name="resample-sorted").where(F.col("position") == k - above - 1).first()
    return last.score, last.doc_id


def draw(rows: DataFrame, k: int, n: int) -> DataFrame:
    """`rows`, a written table of n candidates (`fit`) among others, with `rank`: 1 to k in descending score, then id; null for the rest."""
    none = F.lit(None).cast("long")
    if not 0 < k:
        return rows.withColumn("rank", none)
    score, doc_id = cutoff(rows.where("fit"), n, k)
    high = F.col("fit") & ((F.col("score") > score) | (F.col("score") == score) & (F.col("doc_id") <= doc_id))
    drawn = numbered(materialise(rows.where(high), "resample-drawn"), [F.desc("score"), "doc_id"], name="resample-ranked")
    # rows alike at the cutoff may be more than places
    ranked = drawn.select(*rows.columns, F.when(F.col("position") < k, F.col("position") + 1).alias("rank"))
    return ranked.unionByName(rows.where(~F.coalesce(high, F.lit(False))).withColumn("rank", none))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, most: int = MOST, buckets: int = BUCKETS, seed: str = SEED, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, fit, rank) per row: `per_cent` of the documents of enough words are drawn like `target`."""
    gain = gains(bucket_counts(docs, most, buckets), bucket_counts(target, most, buckets))
    fit = (F.col("n_words") >= min_words) & F.col("doc_id").isNotNull()
    rows = materialise(scored(docs, gain, most, seed).withColumn("fit", fit), "resample-scored")
    n = rows.where("fit").count()
    return draw(rows, per_cent * n // 100, n)


def op12_resample(spark, sf_dir: str) -> DataFrame:
    """The contract's query: a tenth of the documents, drawn like the benchmark."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return resample(read("documents"), read("benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH words AS (SELECT 's' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
               UNION ALL SELECT 't', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT side, id, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM words),
o AS (SELECT word, range(0, octet_length(encode(word))) AS places, hex(encode(word)) AS hex FROM (SELECT DISTINCT word FROM w)),
b AS (SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(places, lambda k: ('0x' || substr(hex, 2 * k + 1, 2))::BIGINT)), lambda c, b:
          list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 10000 AS bucket FROM o),
f AS (SELECT side, id, bucket FROM w JOIN b USING (word)),
n AS (SELECT bucket, count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM f GROUP BY bucket),
a AS (SELECT count(*) FILTER (WHERE side = 's') AS s, count(*) FILTER (WHERE side = 't') AS t FROM f),
g AS (SELECT bucket, floor(1000 * ln((n.t + 1)::DOUBLE * (a.s + 10000) / ((n.s + 1)::DOUBLE * (a.t + 10000))))::BIGINT AS gain FROM n, a),
d AS (SELECT id AS doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM f JOIN g USING (bucket) WHERE side = 's' GROUP BY id),
h AS (SELECT doc_id, ('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM documents),
r AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM h LEFT JOIN d USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE n_features >= 20)
SELECT r.doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM r LEFT JOIN k USING (doc_id)
"""
