"""Token ids on disk: canonical length-limited Huffman codes in independently decodable blocks.

Ids are counted over all documents; codes are at most LIMIT bits (package-merge). Every file
holds a run of documents in ascending doc_id order:

    magic | vocabulary size, longest code, block size (u32) | length of each id's code (zlib)
    | sections: the bits of up to SECTION ids, filled up to a byte
    | footer (zlib): documents (doc_id, is null, ids), bit offset of every block, bytes of bits
    | length of the footer (u64) | magic

Decoding looks up LIMIT bits at a time and walks all blocks of a section side by side.
Null ids come first; rows of one id keep the order of their ids' bytes. Empty tables give no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm import files, tokens
from cairn.session import materialise, scratch

MAGIC = b"CTOKHUF1"
LIMIT = 18
BLOCK = 256
SECTION = 1 << 19
#: Ids in a file, about.
FILE_IDS = 1 << 23


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol's code by package-merge; 0 for symbols that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols don't fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, merged, single = [], weights, np.ones(len(weights), bool)
    for _ in range(limit - 1):
        levels.append(single)
        pairs = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        merged, single = both[by], by < len(weights)
    take = 2 * len(weights) - 2
    for single in [single, *reversed(levels)]:
        own = int(single[:take].sum())
        lengths[order[:own]] += 1
        take = 2 * (take - own)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then symbol."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        own = np.flatnonzero(lengths == n)
        code <<= n - before
        codes[own] = np.arange(code, code + len(own), dtype=np.uint64)
        code, before = code + len(own), n
    return codes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of `ids`, first bit highest, and the bit offset of each block."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts, total = ends - size, int(ends[-1])
    word, room = starts >> 6, 64 - (starts & 63) - size
    left, right = np.maximum(room, 0).astype(np.uint64), np.maximum(-room, 0).astype(np.uint64)
    bits = codes[ids]
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out = np.zeros(total // 64 + 2, np.uint64)
    out[word[first]] = np.bitwise_or.reduceat((bits << left) >> right, first)
    spill = np.flatnonzero(room < 0)
    out[word[spill] + 1] |= bits[spill] << (64 - right[spill])
    return out.astype(">u8").tobytes()[: (total + 7) // 8], starts[::BLOCK]


def decode_table(lengths: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and bits for each value of the next `limit` bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (limit - lengths[order].astype(np.int64))
    symbols = np.zeros(1 << limit, np.uint32)
    taken = np.zeros(1 << limit, np.int64)
    symbols[: spans.sum()], taken[: spans.sum()] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return symbols, taken


def unpack(data: bytes, offsets: np.ndarray, count: int, table: tuple, limit: int, block: int) -> np.ndarray:
    """The `count` ids whose blocks begin at the bit `offsets` of `data`."""
    symbols, taken = table
    words = np.frombuffer(data + bytes(16 + -len(data) % 8), ">u8").astype(np.uint64)
    at, out = offsets.astype(np.int64), np.empty((len(offsets), block), np.uint32)
    last = count - (len(offsets) - 1) * block
    for step in range(min(block, count)):
        if step == last:
            at = at[:-1]
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        window = (words[word] << bit) | (words[word + 1] >> np.uint64(1) >> (np.uint64(63) - bit))
        value = (window >> np.uint64(64 - limit)).astype(np.int64)
        out[: len(at), step] = symbols[value]
        at = at + taken[value]
    return out.ravel()[:count]


def write_file(rows: Iterator[tuple], folder: str, stem: str, lengths: np.ndarray, limit: int) -> tuple[str, int] | None:
    """One file of (doc_id, ids) rows; its URI and number of ids, None without rows."""
    first = next(rows, None)
    if first is None:
        return None
    codes = canonical(lengths)
    uri, out = files.create(folder, stem, ".huf")
    docs, nulls, sizes, offsets, held, waiting, base, total = [], [], [], [], [], 0, 0, 0
    table = zlib.compress(lengths.tobytes())
    with out:
        out.write(MAGIC + struct.pack("<IIII", len(lengths), limit, BLOCK, len(table)) + table)

        def flush(all_of_it: bool) -> None:
            nonlocal held, waiting, base
            if not held:
                return
            ids = np.concatenate(held)
            stop = len(ids) if all_of_it else len(ids) // SECTION * SECTION
            for s in range(0, stop, SECTION):
                bits, starts = pack(ids[s : min(s + SECTION, stop)], codes, lengths)
                out.write(bits)
                offsets.append(starts + 8 * base)
                base += len(bits)
            held, waiting = [ids[stop:]], len(ids) - stop

        for doc, ids in (x for part in ([first], rows) for x in part):
            docs.append(doc or 0)
            nulls.append(doc is None)
            sizes.append(len(ids))
            total += len(ids)
            held.append(ids)
            waiting += len(ids)
            if waiting >= SECTION:
                flush(False)
        flush(True)
        marks = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
        footer = zlib.compress(struct.pack("<QQQ", len(docs), len(marks), base) + np.array(docs, "<i8").tobytes() + np.array(nulls, "u1").tobytes() + np.array(sizes, "<u8").tobytes() + marks.astype("<u8").tobytes())
        out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
    return uri, total


def read_file(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids of all documents before it in the file, ids) in the file's order."""
    if data[:8] != MAGIC or data[-8:] != MAGIC:
        raise ValueError("not a whole token file")
    size, limit, block, packed = struct.unpack_from("<IIII", data, 8)
    lengths = np.frombuffer(zlib.decompress(data[24 : 24 + packed]), np.uint8, size)
    (n,) = struct.unpack_from("<Q", data, len(data) - 16)
    footer = zlib.decompress(data[len(data) - 16 - n : len(data) - 16])
    docs, marks, base = struct.unpack_from("<QQQ", footer)
    own = np.frombuffer(footer, "<i8", docs, 24)
    nulls = np.frombuffer(footer, "u1", docs, 24 + 8 * docs)
    sizes = np.frombuffer(footer, "<u8", docs, 24 + 9 * docs).astype(np.int64)
    offsets = np.frombuffer(footer, "<u8", marks, 24 + 17 * docs).astype(np.int64)
    start, total = 24 + packed, int(sizes.sum())
    table, step = decode_table(lengths, limit), SECTION // block
    held, have, done, k = [], 0, 0, 0
    for s in range(0, marks, step):
        part = offsets[s : s + step]
        stop = int(offsets[s + step]) // 8 if s + step < marks else base
        count = min(SECTION, total - s * block)
        begin = int(part[0]) // 8
        held.append(unpack(data[start + begin : start + stop], part - 8 * begin, count, table, limit, block))
        have += count
        if k < docs and have >= sizes[k]:
            ids, used = np.concatenate(held), 0
            while k < docs and have >= sizes[k]:
                yield (None if nulls[k] else int(own[k])), done, ids[used : used + sizes[k]]
                done, used, have, k = done + int(sizes[k]), used + int(sizes[k]), have - int(sizes[k]), k + 1
            held = [ids[used:]]
    while k < docs:  # documents without ids at the end
        yield (None if nulls[k] else int(own[k])), done, np.zeros(0, np.uint32)
        k += 1


def id_counts(ids: DataFrame, dtype: str, size: int) -> np.ndarray:
    """How often each id occurs in all rows of `ids`; one sum for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for part in tokens.slices(batches, "ids"):
            flat = np.frombuffer(b"".join(part.column("ids").to_pylist()), dtype)
            n += np.bincount(flat, minlength=size)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["id", "n"])

    found = ids.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[found.id.to_numpy(int)] = found.n
    return counts


def write_ids(docs: DataFrame, tokenizer: str, end: int, folder: str, limit: int = LIMIT, file_ids: int = FILE_IDS, **columns: str) -> DataFrame:
    """Encode all documents and write the files; the manifest (file, uri, n_ids, base).

    base is the number of ids in all files before this one.
    """
    coded = materialise(tokens.tokenize(docs, tokenizer, end, **columns).select("doc_id", "n", "ids"), "ids")
    kind = tokens.id_type(tokenizer)
    dtype, size = kind.str, max(tokens.encoder(tokenizer).size, end + 1)
    counts = id_counts(coded, dtype, size)
    lengths = code_lengths(counts, limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        rows = ((d, np.frombuffer(x, dtype)) for b in tokens.slices(batches, "ids") for d, x in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist()))
        if made := write_file(rows, folder, f"ids-{number:06d}", lengths, limit):
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([made[0]]), pa.array([made[1]], pa.int64())], ["file", "uri", "n_ids"])

    parts = max(1, -(-int(counts.sum()) // file_ids))
    # rows of one doc_id, or without any, are told apart by where they stand, so that they can be dealt over files
    keyed = coded.withColumn("row", F.monotonically_increasing_id())
    ordered = keyed.repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    made = materialise(ordered.select("doc_id", "ids").mapInArrow(run, "file long, uri string, n_ids long"), "ids-manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_ids(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) per document of the manifest's files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
        for batch in batches:
            for uri, base in zip(batch.column("uri").to_pylist(), batch.column("base").to_pylist()):
                rows, held = [], 0
                for doc, start, ids in read_file(files.read(uri)):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((doc, base + start, len(ids), zlib.crc32(raw), *[raw] * with_ids))
                    held += len(raw)
                    if len(rows) >= 10_000 or with_ids and held > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows))], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(zip(*rows))], names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return manifest.select("uri", "base", "file").repartition(manifest.sparkSession.sparkContext.defaultParallelism, "file").mapInArrow(lambda it: run(it), schema)


def op6_huffman(spark, sf_dir: str) -> DataFrame:
    """The contract's query: word-end BPE ids with end id 2, written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_ids(write_ids(docs, "word_bpe_49k.json", 2, scratch(spark, "op6")), with_ids=False)
