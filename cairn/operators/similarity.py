"""Words that resemble labels: a prefix-filtered index of letters, and ratios of matching blocks for whole batches."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.arrow import slices
from cairn.session import materialise

#: Cells of the tables that a batch of pairs is compared in at once.
CELLS = 1 << 21
#: From this length on, letters of more than a hundredth of a label start no block (they may lengthen one).
LONG, SHARE = 200, 100


def letters(word: str) -> list[tuple[int, str]]:
    """The letters of a word, numbered by occurrence, in an order that all words share: later occurrences first, as they are rarer."""
    count: Counter = Counter()
    found = []
    for c in word:
        count[c] += 1
        found.append((count[c], c))
    return sorted(found, reverse=True)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points as rows, padded with 0, and lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    rows = np.zeros((len(words), max(int(lengths.max(initial=0)), 1)), np.int64)
    for r, w in enumerate(words):
        rows[r, : len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4")
    return rows, lengths


def _longest(a: np.ndarray, b: np.ndarray, starts: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment (row, alo, ahi, blo, bhi) the longest common block (i, j, size), of equal ones the first in a, then in b.

    `starts` says of b's places whether a block may begin or end there before it is lengthened.
    """
    row, alo, ahi, blo, bhi = seg.T
    height, width = int((ahi - alo).max()), int((bhi - blo).max())
    across = np.minimum(blo[:, None] + np.arange(width), b.shape[1] - 1)
    inside = np.arange(width) < (bhi - blo)[:, None]
    mine = np.where(inside & starts[row[:, None], across], b[row[:, None], across], -1)
    runs = np.zeros((len(seg), width + 1), np.int64)
    i, j, size = alo.copy(), blo.copy(), np.zeros(len(seg), np.int64)
    for k in range(height):
        there = alo + k < ahi
        letter = np.where(there, a[row, np.minimum(alo + k, a.shape[1] - 1)], -2)
        runs[:, 1:] = np.where(mine == letter[:, None], runs[:, :-1] + 1, 0)
        at = runs[:, 1:].argmax(1)
        most = runs[np.arange(len(seg)), at + 1]
        up = most > size
        size[up], i[up], j[up] = most[up], (alo + k - most + 1)[up], (blo + at - most + 1)[up]
    return i, j, size


def matched(words: list[str], labels: list[str]) -> np.ndarray:
    """The letters in matching blocks of each pair: the longest common block, then those left and right of it, and so on."""
    total = np.zeros(len(words), np.int64)
    order = sorted(range(len(words)), key=lambda r: max(len(words[r]), len(labels[r])))
    at = 0
    while at < len(order):
        stop, most = at, 1
        while stop < len(order) and (stop == at or (stop - at + 1) * max(len(words[order[stop]]), len(labels[order[stop]])) * 4 <= CELLS):
            stop += 1
        rows = order[at:stop]
        (a, na), (b, nb) = _codes([words[r] for r in rows]), _codes([labels[r] for r in rows])
        starts = np.ones(b.shape, bool)
        for r in np.flatnonzero(nb >= LONG):
            value, count = np.unique(b[r, : nb[r]], return_counts=True)
            starts[r] = ~np.isin(b[r], value[count > nb[r] // SHARE + 1])
        zero = np.zeros(len(rows), np.int64)
        seg = np.stack([np.arange(len(rows)), zero, na, zero, nb], axis=1)
        while len(seg := seg[(seg[:, 1] < seg[:, 2]) & (seg[:, 3] < seg[:, 4])]):
            i, j, size = _longest(a, b, starts, seg)
            row, alo, ahi, blo, bhi = seg.T
            for di, dj in ((-1, -1), (0, 0)):  # letters that start no block lengthen it, to the left and then to the right
                grow = nb[row] >= LONG
                while grow.any():
                    x, y = (i - 1, j - 1) if di else (i + size, j + size)
                    ok = grow & ((x >= alo) & (y >= blo) if di else (x < ahi) & (y < bhi))
                    ok[ok] = a[row[ok], x[ok]] == b[row[ok], y[ok]]
                    i, j, size, grow = i + di * ok, j + dj * ok, size + ok, ok
            np.add.at(total, [rows[r] for r in row], size)
            hit = size > 0
            left = np.stack([row, alo, i, blo, j], axis=1)[hit]
            right = np.stack([row, i + size, ahi, j + size, bhi], axis=1)[hit]
            seg = np.concatenate([left, right])
        at = stop
    return total


def candidates(words: DataFrame, labels: DataFrame, threshold: float, native: bool) -> DataFrame:
    """(word, id, label) of pairs that may reach the threshold, each once; words (word) and labels (label, id) have no repeated rows.

    Both ratios need a number of common letters, repeats counted: `threshold` of the mean length for blocks, of the longer for `native`. So
    among the rarest letters of either side, as many as it may lack and one more, one is the same. Words meet
    labels on these, within the bounds on length and on what can still be common around the places of the letter.
    """
    slack = 1e-9
    least = (lambda n, m: threshold * max(n, m)) if native else (lambda n, m: threshold * (n + m) / 2)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 18):
            rows = []
            for number, text in zip(part.column("number").to_pylist(), part.column("text").to_pylist()):
                n = len(text)
                need = math.ceil(least(n, max(1, math.ceil(n * threshold / (2 - threshold) - slack))) - slack)
                rows += [(number, n, k, f"{count} {c}") for k, (count, c) in enumerate(letters(text)[: n - need + 1])]
            columns = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32(), pa.string()])], ["number", "n", "place", "letter"])

    def indexed(texts: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(number, text), and (number, n, place, letter): texts stay out of the join on letters."""
        numbered = materialise(texts.toDF("text").withColumn("number", F.monotonically_increasing_id()), name)
        return numbered, materialise(numbered.mapInArrow(index, "number long, n int, place int, letter string"), f"{name}-letters")

    # words of lengths that no label can match are left out first
    low, high = F.ceil(F.col("m") * threshold / (2 - threshold) - slack), F.floor(F.col("m") * (2 - threshold) / threshold + slack)
    fit = labels.select(F.length("label").alias("m")).distinct().select(F.explode(F.sequence(low, high)).alias("length")).distinct()
    near = words.select("word", F.length("word").cast("long").alias("length")).join(materialise(fit, "lengths"), "length", "left_semi").select("word")
    own, spoken = indexed(near, "words")
    theirs, known = indexed(labels.select("label").distinct(), "labels")
    known = known.withColumnsRenamed({"number": "label_number", "n": "m", "place": "spot"})
    need = (threshold * F.greatest("n", "m") if native else threshold * (F.col("n") + F.col("m")) / 2) - slack
    may = F.least("place", "spot") + 1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("spot")) - 1
    near_enough = 2 * F.least("n", "m") >= threshold * (F.col("n") + F.col("m")) - slack
    pairs = spoken.join(known, "letter").where(near_enough & (may >= need)).select("number", "label_number").distinct()
    named = theirs.select(F.col("number").alias("label_number"), F.col("text").alias("label")).join(labels, "label")
    return pairs.join(own.withColumnRenamed("text", "word"), "number").join(named, "label_number").select("word", "id", "label")


def similar(words: DataFrame, labels: DataFrame, threshold: float, native: bool) -> DataFrame:
    """(word, id, ratio) of pairs of the threshold or more."""
    pairs = candidates(words, labels, threshold, native)
    if native:
        scored = pairs.withColumn("ratio", 1 - F.levenshtein("word", "label") / F.greatest(F.length("word"), F.length("label")))
        return scored.where(F.col("ratio") >= threshold).select("word", "id", "ratio")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "word", 1 << 20):
            a, b = part.column("word").to_pylist(), part.column("label").to_pylist()
            ratio = 2.0 * matched(a, b) / np.array([len(x) + len(y) for x, y in zip(a, b)], float)
            whole = pa.RecordBatch.from_arrays([part.column("word"), part.column("id"), pa.array(ratio)], ["word", "id", "ratio"])
            yield whole.filter(pa.array(ratio >= threshold))

    return pairs.mapInArrow(run, f"word string, id {labels.schema['id'].dataType.simpleString()}, ratio double")
