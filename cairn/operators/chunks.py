"""Cutting texts into overlapping chunks, and keeping each chunk once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.arrow import slices


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """(start, end) of a text's windows.

    A window that more text follows ends after its last line end if that lies beyond the window's middle;
    the next one begins `overlap` before its end.
    """
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text) and (cut := text.rfind("\n", at, end) - at) > size // 2:
            end = at + cut + 1
        yield at, min(end, len(text))
        at = end - overlap


def chunk(files: DataFrame, size: int = 1500, overlap: int = 200) -> DataFrame:
    """(source, chunk_index, text, line_start, line_end) of files (path, content).

    Each window depends on the one before, so a text is cut in one pass, in Arrow batches of whole
    texts; that stays linear for long texts, where substrings of UTF-8 columns would not.
    """
    if size // 2 < overlap:
        raise ValueError("windows must advance: size // 2 >= overlap")
    names = ["source", "chunk_index", "text", "line_start", "line_end"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "content"):
            rows = []
            for path, text in zip(part.column("path").to_pylist(), part.column("content").to_pylist()):
                if not text or not text.strip():
                    continue
                text, line, counted = text.replace("\r\n", "\n").replace("\r", "\n"), 1, 0
                for k, (start, end) in enumerate(windows(text, size, overlap)):
                    line, counted = line + text.count("\n", counted, start), start
                    if own := text[start:end].strip().replace("\x00", ""):
                        last = line + text.count("\n", start, end - (text[end - 1] == "\n"))
                        rows.append((path, k, own, line, last))
            columns = zip(*rows) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names)

    return files.select("path", "content").mapInArrow(run, "source string, chunk_index int, text string, line_start int, line_end int")


def with_breadcrumbs(chunks: DataFrame, label: str) -> DataFrame:
    """Adds doc_level, block, module, content_type, language, id, and a line of context before the text."""
    p = F.col("source")
    rows = chunks.withColumns({
        "doc_level": T.doc_level(p, F.lit(label)), "block": T.block(p), "module": F.split(p, "/")[0], "content_type": T.content_type(p, F.lit(label)), "language": T.language(p),
    })
    head = F.format_string("Context: Block=%s | Module=%s | Level=%s | Type=%s\n", "block", "module", "doc_level", "content_type")
    return rows.withColumn("text", F.concat(head, "text")).withColumn("id", F.md5("text"))


def with_header(files: DataFrame) -> DataFrame:
    return files.withColumn("content", F.concat(F.lit("[File: "), "path", F.lit("]\n"), "content"))


def new_chunks(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose id (MD5 of the text) isn't stored, each id once: that of the first source and index."""
    own = chunks.withColumn("id", F.md5("text"))
    rest = [c for c in own.columns if c != "id"]
    first = own.groupBy("id").agg(F.min(F.struct("source", "chunk_index", *[c for c in rest if c not in ("source", "chunk_index")])).alias("c"))
    return first.join(stored.select("id"), "id", "left_anti").select("id", *[f"c.{c}" for c in rest])


def pack_lines(files: DataFrame, most: int = 24_000) -> DataFrame:
    """(module, path, part, text): files with a banner, cut at lines into parts of up to `most` characters.

    A longer line is a part of its own.
    """
    lines = F.split(F.concat(F.lit("=== "), "path", F.lit(" ===\n"), "content"), "\n")
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def step(s: Column, line: Column) -> Column:
        fits = (s["held"] == "") | (F.length(s["held"]) + F.length(line) + 1 <= most)
        longer = F.struct(s["done"].alias("done"), F.concat(s["held"], line, F.lit("\n")).alias("held"))
        fresh = F.struct(F.concat(s["done"], F.array(s["held"])).alias("done"), F.concat(line, F.lit("\n")).alias("held"))
        return F.when(fits, longer).otherwise(fresh)

    packed = F.aggregate("lines", state, step, lambda s: F.concat(s["done"], F.array(s["held"])))
    return files.select("module", "path", lines.alias("lines")).select("module", "path", F.posexplode(packed).alias("part", "text"))


def pack_modules(files: DataFrame, most: int = 24_000) -> DataFrame:
    """(module, task, part, paths, text): a module's files (module, path, content) in order of their paths, each with a
    banner, cut at lines into parts of up to `most` characters. A longer line is a part of its own.

    Files are dealt in order, so that a module is packed through within a task; one too large for a task goes on in the next,
    with a part of its own.
    """
    banner = F.concat(F.lit("=" * 60 + "\n[FILE: "), "path", F.lit("]\n" + "=" * 60 + "\n"))
    rows = files.select("module", "path", F.concat(banner, F.coalesce("content", F.lit(""))).alias("text")).repartitionByRange("module", "path").sortWithinPartitions("module", "path")
    names, kinds = ["module", "task", "part", "paths", "text"], [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, module, part, held, size, paths = TaskContext.get().partitionId(), None, 0, [], 0, []

        def cut() -> tuple:
            nonlocal part, held, size, paths
            row = (module, task, part, paths, "".join(held))
            part, held, size, paths = part + 1, [], 0, []
            return row

        for batch in slices(batches, "text"):
            done = []
            for own, path, text in zip(*(batch.column(c).to_pylist() for c in ("module", "path", "text"))):
                if own != module:
                    done += [cut()] if held else []
                    module, part = own, 0
                for line in text.split("\n"):
                    if held and size + len(line) + 1 > most:
                        done.append(cut())
                    held.append(line + "\n")
                    size += len(line) + 1
                    if not paths or paths[-1] != path:
                        paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 5, kinds)], names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(cut()), kinds)], names)

    return rows.mapInArrow(run, "module string, task int, part int, paths array<string>, text string")


def build_index(corpora: dict[str, DataFrame], state: DataFrame, stored: DataFrame, extensions: list[str], skip_dirs: list[str] = (), most_bytes: int = 1 << 20, cap: int | None = None) -> DataFrame:
    """Chunks to add to an index, from corpora (path, content, size_bytes) by label.

    Of the files that the scan rules keep, those of another hash than in `state` (path, hash) get a header line, are chunked and get their line of
    context; all corpora together are cut to the first `cap` chunks by source, and each text that isn't `stored` (id) is kept once.
    """
    from cairn.operators.upsert import to_process
    from cairn.sources.readers import kept_paths, likely_binary, normalised_hash, skipped_file

    parts = []
    for label, files in corpora.items():
        path, size = F.col("path"), F.col("size_bytes")
        rows = files.where(kept_paths(path, size, extensions, list(skip_dirs), most_bytes) & ~skipped_file(path, size, extensions, most_bytes) & ~likely_binary(F.col("content")))
        todo = to_process(rows.withColumn("hash", normalised_hash(F.col("content"))), state).where("todo")
        full = todo.where(F.trim("content") != "").select("path", "content")
        parts.append(with_breadcrumbs(chunk(with_header(full)), label))
    every = reduce(DataFrame.unionByName, parts)
    if cap is not None:
        every = every.orderBy("source", "chunk_index").limit(cap)
    return new_chunks(every, stored)
