"""Quality rules: exact text statistics with fixed limits, then a calibrated logistic regression.

The regression sees hashed words and character trigrams of whole texts, each as shares of all of a
text. It is fitted on about TRAIN_DOCS labelled documents (chosen by hash of their id), its
probability calibrated on a third of them that it hasn't seen. All texts are scored in Arrow batches.

Null texts have no words. Labels that are null teach nothing; equal labels of an id count once, and of several
texts of one id the smallest teaches. With no labels, or labels of one kind, only the fixed limits decide. Repeated rows are
scored each on its own.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.texts import slices

#: Hashed features: words below, character trigrams above.
HALF = 1 << 15
SCALE = 30.0
TRAIN_DOCS = 2_000
STEPS, RATE, RIDGE = 150, 0.1, 1e-4
#: Texts of a lower probability of quality are dropped.
KEEP = 0.3
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


def repeated_words(ids: np.ndarray, starts: np.ndarray, hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For words of several texts: whether a word lies in a window found twice or more in its text.

    Texts begin at `starts`; ids are equal for equal words, and `hashes` has a hash for each id.
    Equal hashes only propose windows; their words are compared.
    """
    n = len(ids)
    hit = np.zeros(n + 1, np.int64)
    if n < window:
        return hit[:n] > 0
    owner = np.searchsorted(starts, np.arange(n), side="right") - 1
    first = np.flatnonzero(owner[: n - window + 1] == owner[window - 1 :])
    key = (owner[first] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(window):
            key = (key ^ hashes[ids[first + k]]) * np.uint64(0x100000001B3)
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.append(same, False) | np.append(False, same)
    likely = first[order[twice]]
    if len(likely):
        whole = np.column_stack([owner[likely], ids[likely[:, None] + np.arange(window)]])
        _, which, count = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
        likely = likely[count[which.ravel()] > 1]
        np.add.at(hit, likely, 1)
        np.add.at(hit, likely + window, -1)
    return np.cumsum(hit)[:n] > 0


def statistics(texts: list[str | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, and its words' numbers."""
    words = [t.encode().split() if t else [] for t in texts]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for own in words for w in own), np.int64)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    hashes = np.array([hash(w) & 0xFFFFFFFFFFFFFFFF for w in number], np.uint64)
    inside = np.concatenate([[0], np.cumsum(repeated_words(ids, starts[sizes > 0], hashes))])
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] if t else [] for t in texts]
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t) - sum(map(t.count, BLANKS)) if t else 0 for t in texts], np.int64),
        "n_symbols": np.array([sum(map(t.count, SYMBOLS)) if t else 0 for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": inside[starts + sizes] - inside[starts],
        "ids": ids,
        "buckets": np.array([zlib.crc32(w) % HALF for w in number], np.int64),
    }


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all texts in a row, and how many each text has."""
    sizes = np.array([max(0, len(t or "") - 2) for t in texts], np.int64)
    points = np.frombuffer("".join(t for t in texts if t and len(t) > 2).encode("utf-32-le"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64), sizes
    code = points[:-2] * np.uint32(0x9E3779B1) + points[1:-1] * np.uint32(0x85EBCA77) ^ points[2:] * np.uint32(0xC2B2AE3D)
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    ends = np.cumsum(sizes[sizes > 0] + 2)[:-1]
    inside = np.ones(len(code), bool)  # no trigram spans two texts
    inside[np.concatenate([ends - 2, ends - 1])] = False
    return HALF + (code[inside] >> np.uint32(17)).astype(np.int64), sizes


def _means(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    ends = np.cumsum(sizes)
    return (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, quality, at, value): each text's features that aren't zero."""
    for part in slices(batches, "text", 1 << 20):
        at, value = [], []
        for text in part.column("text").to_pylist():
            own = statistics([text])
            chars, _ = trigrams([text])
            found = []
            for codes in (own["buckets"][own["ids"]] if len(own["ids"]) else own["ids"], chars):
                n = np.bincount(codes, minlength=2 * HALF) if len(codes) else np.zeros(2 * HALF)
                found.append(n * (SCALE / max(1, len(codes))))
            x = found[0] + found[1]
            used = np.flatnonzero(x)
            at.append(used.astype(np.int32))
            value.append(x[used].astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("quality"), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], ["doc_id", "quality", "at", "value"]
        )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression, classes weighted alike, by Adam."""
    at, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]).astype(np.float64)
    sizes = np.array([len(r[0]) for r in rows])
    own = np.repeat(np.arange(len(rows)), sizes)
    share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, m, v = (np.zeros(2 * HALF + 1) for _ in range(3))
    for step in range(1, STEPS + 1):
        z = np.bincount(own, value * w[at], len(rows)) + w[-1]
        error = (_sigmoid(z) - y) * share
        g = np.append(np.bincount(at, value * error[own], 2 * HALF) + RIDGE * w[:-1], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], w[-1]


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset (Platt) by Newton steps, on targets drawn a little from 0 and 1."""
    ones = y.sum()
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x, t = np.column_stack([z, np.ones(len(z))]), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ t)
        curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        t = t - np.clip(np.linalg.solve(curve, x.T @ (p - target) + 1e-6 * t), -1, 1)
    return float(max(t[0], 1e-3)), float(t[1])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, float, float, float] | None:
    """Weights, bias, slope, offset; None where labels of both kinds are missing."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") > 0).cast("int").alias("quality")).where("doc_id is not null and quality is not null").distinct()
    n = known.count()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 62))
    sample = known.where(part < int(min(1.0, most / max(n, 1)) * (1 << 62)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(sample, "doc_id")
    # a row an id and label, however often the id recurs
    rows = rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    found = rows.select("doc_id", "quality", "text").mapInArrow(vectors, "doc_id long, quality int, at array<int>, value array<float>").toArrow()
    if not found.num_rows:
        return None
    doc = found.column("doc_id").to_numpy()
    order = np.argsort(doc, kind="stable")
    y = (found.column("quality").to_numpy()[order] > 0).astype(float)
    at, value = found.column("at").combine_chunks(), found.column("value").combine_chunks()
    x = [(at[int(i)].values.to_numpy(), value[int(i)].values.to_numpy()) for i in order]
    unseen = np.array([zlib.crc32(str(d).encode()) % 3 == 0 for d in doc[order]])
    if any(not 0 < y[s].sum() < s.sum() for s in (unseen, ~unseen)):
        unseen = np.zeros(len(y), bool)  # too few to hold any out
    if not 0 < y.sum() < len(y):
        return None
    weights, bias = descend([r for r, u in zip(x, unseen) if not u], y[~unseen])
    judged = unseen if unseen.any() else ~unseen
    z = np.array([value @ weights[at] + bias for (at, value), u in zip(x, judged) if u])
    return weights.astype(np.float32), float(bias), *calibrate(z, y[judged])


def assess(docs: DataFrame, model: tuple | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, probability) per row."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 256 KB of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 21):
            texts = part.column("text").to_pylist()
            own = statistics(texts)
            chance = np.ones(len(texts))
            if shared.value:
                weights, bias, slope, offset = shared.value
                codes, sizes = trigrams(texts)
                words = weights[own["buckets"]][own["ids"]] if len(own["ids"]) else np.zeros(0)
                z = SCALE * (_means(words, own["n_words"]) + _means(weights[codes], sizes)) + bias
                chance = _sigmoid(slope * z + offset)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(own[n], pa.int64()) for n in names], pa.array(chance)], ["doc_id", *names, "probability"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, probability double")


def decide(assessed: DataFrame) -> DataFrame:
    """Adds base_failed and kept."""
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return assessed.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= KEEP))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return decide(assess(docs, model)).drop("probability")
