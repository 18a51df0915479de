"""Benchmark decontamination by FM-indexes over shards of the training texts.

A test phrase is a window of `size` consecutive words of a benchmark item, or the whole of a
shorter item. Spark cuts the items into distinct (phrase, item) pairs and writes them down in files of
at most BLOCK_ROWS. Each task turns its documents into shards of about SHARD_WORDS words, numbers all of a shard's words,
sorts its suffixes, and stores the Burrows-Wheeler transform in a wavelet matrix. A shard's index doesn't
depend on the benchmark: it is built once, and the files of phrases are searched in it one after the other, all
phrases of a file backward at once; their occurrences are located by walking to sampled suffix
positions. Hit words, merged, are the spans to remove. No rows of documents are shuffled.

Documents of more words than a shard are indexed in pieces that overlap by a phrase. Words of more than LONGEST bytes
stand for themselves by their SHA-256.

Null texts have no words. Benchmark rows with no words match nothing; rows with a null id hit
words but are not listed. Repeated rows are searched each on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.arrow import trim
from cairn.llm import files
from cairn.llm.texts import alnum, alnum_words, slices
from cairn.session import materialise, scratch

SHARD_WORDS = 1 << 20
#: Rows and bytes that a task holds at most besides, before it gives them on.
SHARD_ROWS, SHARD_BYTES = 1 << 16, 32 << 20
#: Every so many positions of a shard are kept with their suffixes.
SAMPLED = 8
#: (phrase, item) pairs in a file of phrases at most, and bytes of a word in it.
BLOCK_ROWS, LONGEST = 1 << 16, 64
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def short(words: list[bytes], longest: int) -> list[bytes]:
    """Long words replaced by their hashes."""
    return [w if len(w) <= longest else hashlib.sha256(w).hexdigest().encode() for w in words]


def write_phrases(benchmark: DataFrame, size: int, item_col: str, text_col: str, block_rows: int, longest: int) -> list[str]:
    """Writes the distinct (phrase, item) pairs; the URIs of the files."""
    words = alnum(F.col(text_col))
    brief = F.transform(words, lambda w: F.when(F.octet_length(w) > longest, F.sha2(w, 256)).otherwise(w))
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), brief.alias("words")).where(F.size("words") > 0)
    starts = items.select("item", "words", F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - (size - 1), F.lit(1)))).alias("start"))
    pairs = starts.select(F.array_join(F.slice("words", F.col("start"), size), " ").alias("phrase"), "item").distinct()
    pairs = materialise(pairs, "phrases")
    path, spark = scratch(benchmark.sparkSession, "phrase-files"), benchmark.sparkSession
    full = pairs.coalesce(max(1, -(-pairs.count() // block_rows)))
    full.sortWithinPartitions("phrase", "item").write.option("maxRecordsPerFile", block_rows).parquet(path)
    return sorted(spark.read.schema("phrase string, item long").parquet(path).inputFiles())


class Phrases:
    """The distinct phrases of a file as rows of word numbers from 1, aligned at the end, with 0s before them."""

    def __init__(self, pairs: pa.Table) -> None:
        coded = pairs.column("phrase").combine_chunks().dictionary_encode()
        which = coded.indices.to_numpy()
        found = [p.encode().split(b" ") for p in coded.dictionary.to_pylist()]
        number: dict[bytes, int] = {}
        self.lengths = np.array([len(p) for p in found], np.int64)
        self.rows = np.zeros((len(found), int(self.lengths.max(initial=0))), np.int32)
        for row, p in zip(self.rows, found):
            row[len(row) - len(p) :] = [number.setdefault(w, len(number) + 1) for w in p]
        self.words = list(number)
        item = pairs.column("item").combine_chunks()
        known = item.is_valid().to_numpy(zero_copy_only=False)
        order = np.argsort(which[known], kind="stable")
        #: Items of phrase i: items[bounds[i] : bounds[i + 1]].
        self.items = item.drop_null().to_numpy()[order]
        self.bounds = np.searchsorted(which[known][order], np.arange(len(found) + 1))


@lru_cache(maxsize=2)
def read_phrases(uri: str) -> Phrases:
    system, path = files.at(uri)
    with system.open_input_file(path) as f:
        return Phrases(pq.read_table(f))


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros(len(bits) // 64 * 64 + 128, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) > 0


class WaveletMatrix:
    """Rank and access over a sequence of small integers, a bit vector for each of their bits."""

    def __init__(self, values: np.ndarray, symbols: int) -> None:
        self.levels = []
        for bit in reversed(range(max(1, (symbols - 1).bit_length()))):
            ones = (values >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), int(len(values) - ones.sum())))
            values = np.concatenate([values[~ones], values[ones]])
        self.begin = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> bit & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i."""
        return self._down(symbol, i) - self.begin[symbol]

    def get(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros(len(i), np.int64)
        for bit, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            value |= one.astype(np.int64) << bit
            i = np.where(one, zeros + ones, i - ones)
        return value


def sort_suffixes(text: np.ndarray) -> np.ndarray:
    """The suffix array of a text that ends in 0; each 0 is smaller than all symbols and all later 0s."""
    zero = text == 0
    rank = np.where(zero, np.cumsum(zero) - 1, text + int(zero.sum()) - 1).astype(np.int64)
    n, step = len(text), 1
    # by pairs of pairs; then only what still shares its rank is sorted on, with the double depth each time
    place, order = np.arange(n), np.arange(n)
    while len(place):
        own = order[place]
        key = rank[own] * (n + 1) + rank[np.minimum(own + step, n - 1)] if step > 1 else rank[own] * (int(rank.max()) + 1) + rank[np.minimum(own + 1, n - 1)]
        # places of one group stand together, so that the sorted keys stay in the group's places
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[place] = own
        begins = np.diff(key, prepend=-1) != 0
        first = place[np.maximum.accumulate(np.where(begins, np.arange(len(place)), 0))]
        rank[own] = first
        alone = begins & np.append(begins[1:], True)
        place, step = place[~alone], step * 2
    return order


class FMIndex:
    """Counts and locates phrases in a text of symbols 1.. with 0 as separators, the last one included."""

    def __init__(self, text: np.ndarray, symbols: int, sampled: int = SAMPLED) -> None:
        order = sort_suffixes(text)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.transform = WaveletMatrix(text[order - 1].astype(np.int64), symbols)
        # a stretch's first symbol is always sampled, as no walk may pass a separator
        kept = (order % sampled == 0) | (text[order - 1] == 0)
        self.marked, self.samples = Bits(kept), order[kept]

    def search(self, rows: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each phrase; empty where it doesn't occur."""
        last = rows[:, -1]
        low, high = self.first[last], self.first[last + 1]
        for back in range(2, rows.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (low < high))
            symbol = rows[live, -back].astype(np.int64)
            low[live] = self.first[symbol] + self.transform.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.transform.rank(symbol, high[live])
        return low, high

    def locate(self, suffix: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by rank."""
        found, steps, todo, at = np.empty(len(suffix), np.int64), 0, np.arange(len(suffix)), suffix
        while len(todo):
            done = self.marked.get(at)
            found[todo[done]] = self.samples[self.marked.rank(at[done])] + steps
            todo, at = todo[~done], at[~done]
            symbol = self.transform.get(at)
            at = self.first[symbol] + self.transform.rank(symbol, at)
            steps += 1
        return found


class Shard:
    """Pieces of documents under one index: each a document's number, the place of its first word, and its words."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pieces: list[np.ndarray] = []
        self.owners: list[int] = []
        self.bases: list[int] = []
        self.size = 0

    def add(self, owner: int, base: int, words: list[bytes]) -> None:
        number = self.number
        for w in set(words).difference(number):
            number[w] = len(number) + 1
        self.pieces.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        self.owners.append(owner)
        self.bases.append(base)
        self.size += len(words)

    def search(self, uris: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each file of phrases: document, first word and end of all occurrences; (document, item) pairs."""
        sizes = np.array([len(x) for x in self.pieces], np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1  # a separator stands after each piece
        index = FMIndex(np.concatenate([x for own in self.pieces for x in (own, np.zeros(1, np.int32))]), len(self.number) + 1)
        owners, bases = np.array(self.owners), np.array(self.bases, np.int64)
        for phrases in map(read_phrases, uris):
            if not phrases.words:
                continue
            own = np.fromiter((self.number.get(w, -1) for w in phrases.words), np.int64, len(phrases.words))
            rows = np.concatenate([[0], own])[phrases.rows]
            known = np.flatnonzero((rows >= 0).all(1))
            low, high = index.search(rows[known], phrases.lengths[known])
            n = np.maximum(high - low, 0)
            which = np.repeat(known, n)
            at = index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n))
            piece = np.searchsorted(starts, at, side="right") - 1
            first = at - starts[piece] + bases[piece]
            document = owners[piece]
            pair = np.unique(np.stack([document, which]), axis=1) if len(which) else np.zeros((2, 0), np.int64)
            many = phrases.bounds[pair[1] + 1] - phrases.bounds[pair[1]]
            item = phrases.items[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(phrases.bounds[pair[1]], many)]
            yield document, first, first + phrases.lengths[which], np.stack([np.repeat(pair[0], many), item])


def merge(document: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges of each document, those that meet or overlap joined."""
    order = np.lexsort((first, document))
    document, first, end = document[order], first[order], end[order]
    # far enough apart that no range reaches the next document
    shift = document * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + shift) if len(end) else end
    begins = np.flatnonzero(np.append(True, first[1:] + shift[1:] > reach[:-1])) if len(end) else np.zeros(0, np.int64)
    last = np.append(begins[1:] - 1, len(end) - 1) if len(end) else begins
    return document[begins], first[begins], reach[last] - shift[last]


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """`text` without the words of the spans and what stands between them."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw.lower())]
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*parts, raw[at:]]).decode()


def _search(batches: Iterator[pa.RecordBatch], uris: list[str], size: int, shard_words: int, longest: int, cut: bool = False) -> Iterator[pa.RecordBatch]:
    """Adds n_words, n_hit, spans and items to the rows; `cut` takes the spans out of the texts."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    rows: list[pa.RecordBatch] = []
    counts: list[int] = []
    hits: list[tuple] = []
    shard = Shard()

    def search() -> None:
        nonlocal shard
        if shard.size and uris:
            hits.extend(tuple(x) for x in shard.search(uris))
        shard = Shard()

    def done() -> pa.RecordBatch:
        search()
        table = pa.Table.from_batches(rows).combine_chunks()
        spans, items, hit = [[] for _ in counts], [[] for _ in counts], [0] * len(counts)
        if hits:
            document, first, end = merge(*(np.concatenate([h[k] for h in hits]) for k in range(3)))
            for k, a, b in zip(document.tolist(), first.tolist(), end.tolist()):
                spans[k].append({"start": a, "end": b})
                hit[k] += b - a
            for k, item in np.unique(np.concatenate([h[3] for h in hits], axis=1), axis=1).T.tolist():
                items[k].append(item)
        if cut and hits:
            own = zip(table.column("text").to_pylist(), spans)
            texts = [cut_words(t, [(s["start"], s["end"]) for s in x]) if x else t for t, x in own]
            table = table.set_column(table.schema.get_field_index("text"), "text", pa.array(texts, table.schema.field("text").type))
        (batch,) = table.to_batches(max_chunksize=max(1, table.num_rows))
        columns = [pa.array(counts, pa.int64()), pa.array(hit, pa.int64()), pa.array(spans, span), pa.array(items, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n_words", "n_hit", "spans", "items"])

    total = held = 0
    for part in slices(batches, "text"):
        rows.append(part)
        held += part.nbytes
        for text in part.column("text").to_pylist():
            words = short(alnum_words(text), longest)
            for base in range(0, len(words), shard_words):
                shard.add(len(counts), base, words[base : base + shard_words + size - 1])
                if shard.size >= shard_words and len(words) > shard_words:
                    search()
            counts.append(len(words))
            total += len(words)
        # texts without words count by their rows and bytes
        if total >= shard_words or len(counts) >= SHARD_ROWS or held >= SHARD_BYTES:
            yield done()
            rows, counts, hits, total, held = [], [], [], 0, 0
            trim()
    if rows:
        yield done()


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", phrase_col: str = "text", keep: tuple = (), shard_words: int = SHARD_WORDS, block_rows: int = BLOCK_ROWS, longest: int = LONGEST, cut: bool = False) -> DataFrame:
    """(doc_id, text, *keep, n_words, n_hit, spans, items) per row; spans are merged word ranges of the text as it came.

    `cut` takes them out of the text, as `remove` does later, in the worker that found them.
    """
    uris = write_phrases(benchmark, size, item_col, phrase_col, block_rows, longest)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    added = "n_words bigint, n_hit bigint, spans array<struct<start:bigint,end:bigint>>, items array<bigint>"
    found = source.mapInArrow(lambda it: _search(it, uris, size, shard_words, longest, cut), f"{schema}, {added}")
    return found.select("doc_id", "text", *[F.col(f"keep_{c}").alias(c) for c in keep], "n_words", "n_hit", "spans", "items")


def remove(found: DataFrame) -> DataFrame:
    """The rows of `find` with their spans cut out of the text."""

    @F.pandas_udf("string")
    def clean(texts, spans):
        import pandas as pd

        return pd.Series([cut_words(t, [(s["start"], s["end"]) for s in own]) if len(own) else t for t, own in zip(texts, spans)], dtype=object)

    return found.withColumn("text", F.when(F.col("n_hit") > 0, clean("text", "spans")).otherwise(F.col("text")))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """The contract's query: windows of 10 words."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
