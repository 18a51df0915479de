"""Exported history as Spark data sources: commits, files of commits, diff statistics and annotations, in batches or as streams.

A folder holds exported text files; `spark.read.format(...).load(folder)` gives their rows, `spark.readStream` those of new files.
Files are read a block of lines at a time and cut into ranges of bytes at lines that begin a record, so that one of any size is many
tasks. Conditions on `sha`, `path` and `file` are tested before a row leaves Python. `register(spark)` names the formats:

- `commit_log` (sha, author, date, subject, body): a line a commit, fields split at 0x1f, shorter lines dropped
- `name_log` (sha, path): a line of 40 hex digits begins a commit, the lines after it are its files
- `diff_stat` (sha, path, insertions, deletions): as name_log, with lines `path | N ++--`
- `blame` (sha, author, line, code): porcelain annotations, in which a line of code begins with a tab

Each row has the `file` it is from, too. Lines end at a line feed, with or without a carriage return, and are read as UTF-8; bytes that aren't become U+FFFD.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from cairn.functions.arrow import filesystem

#: Bytes of a range, bytes read at once, and rows handed over at once.
SPLIT, BLOCK, ROWS = 64 << 20, 1 << 20, 4096
SHA = re.compile(r"[0-9a-f]{40}")
STAT = re.compile(r"(.*?)\s+\|\s+\d+\s*([+-]*)")


def _commits(lines: Iterator[str]) -> Iterator[tuple]:
    for line in lines:
        parts = line.split("\x1f", 4)
        if len(parts) >= 4:
            yield *(p.strip(" ") for p in parts[:4]), parts[4].strip(" ") if len(parts) > 4 else ""


def _names(lines: Iterator[str]) -> Iterator[tuple]:
    sha = None
    for line in lines:
        if SHA.fullmatch(line):
            sha = line
        elif sha and (path := line.strip(" ")):
            yield sha, path.replace("\\", "/")


def _stats(lines: Iterator[str]) -> Iterator[tuple]:
    sha = None
    for line in lines:
        if SHA.fullmatch(line):
            sha = line
        elif sha and (found := STAT.match(line)) and (path := found[1].strip(" ")):
            yield sha, path, found[2].count("+"), found[2].count("-")


def _blame(lines: Iterator[str]) -> Iterator[tuple]:
    sha = number = None
    authors = {}  # a commit's author is named where the commit is first met only
    for line in lines:
        if line.startswith("\t"):
            if sha:
                yield sha, authors.get(sha), number, line[1:]
        elif SHA.match(line) and line[40:41] == " ":
            fields = line.split(" ")
            sha, number = fields[0], int(fields[2]) if len(fields) > 2 and fields[2].isdigit() else None
        elif line.startswith("author "):
            authors[sha] = line[7:]


#: Columns, parser, and what a line that begins a record looks like; None where each line is a record, "" where files aren't cut.
FORMATS = {
    "commit_log": ("sha string, author string, date string, subject string, body string", _commits, None),
    "name_log": ("sha string, path string", _names, SHA),
    "diff_stat": ("sha string, path string, insertions int, deletions int", _stats, SHA),
    "blame": ("sha string, author string, line int, code string", _blame, ""),
}


class Range(InputPartition):
    """Bytes of a file from the first record that begins at or after `start`, up to the first that does at or after `end`."""

    def __init__(self, file: str, start: int, end: int):
        super().__init__((file, start, end))
        self.file, self.start, self.end = file, start, end


def _lines(part: Range, begins: re.Pattern | str | None) -> Iterator[str]:
    """The lines of a range; a record that begins before its end is read whole."""
    system, path = filesystem(part.file)
    with system.open_input_file(path) as f:
        at, inside, held = part.start, part.start == 0, []
        if part.start:
            # the line that holds the byte before the range belongs to the range before
            f.seek(part.start - 1)
            at -= 1
            while (block := f.read(BLOCK)) and (cut := block.find(b"\n")) < 0:
                at += len(block)
            if not block:
                return
            at += cut + 1
            f.seek(at)
        while True:
            block = f.read(BLOCK)
            if block and b"\n" not in block:
                held.append(block)
                continue
            *whole, rest = b"".join([*held, block]).split(b"\n")
            held = [rest]
            for raw in whole if block or not rest else [rest]:
                line = raw.decode("utf-8", "replace").removesuffix("\r")
                first = not begins or begins.fullmatch(line) is not None
                if at >= part.end and (first or not inside):
                    return
                inside = inside or first
                at += len(raw) + 1
                if inside:
                    yield line
            if not block:
                return


def _files(folder: str) -> list[tuple[str, int]]:
    """URIs and sizes of the files below a folder, or of the file itself, in order; hidden ones are left out."""
    system, root = filesystem(folder)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(folder, info.size)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    base, cut = folder.rstrip("/"), len(root.rstrip("/"))
    return sorted((base + f.path[cut:], f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


class _Rows:
    """What batch and stream readers share."""

    def __init__(self, format: str, schema: StructType, folder: str, split: int):
        self.format, self.schema, self.folder, self.split, self.wanted = format, schema, folder, split, {}

    def ranges(self, files: list[tuple[str, int]]) -> list[Range]:
        begins = FORMATS[self.format][2]
        step = self.split if begins != "" else 1 << 62
        keep = self.wanted.get("file")
        return [Range(name, a, min(a + step, size)) for name, size in files if keep is None or name in keep for a in range(0, size, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        columns, parse, begins = FORMATS[self.format]
        names = [c.split()[0] for c in columns.split(", ")]
        tests = [(names.index(c), values) for c, values in self.wanted.items() if c in names]
        kinds = {"string": pa.string(), "int": pa.int32()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")] + [("file", pa.string())])
        held = []
        for row in parse(_lines(partition, begins)):
            if all(row[k] in values for k, values in tests):
                held.append((*row, partition.file))
                if len(held) == ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


class _Batch(_Rows, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes equality and lists of values of whole columns; Spark tests the others."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in ("sha", "path", "file") and f.attribute[0] in self.schema.names:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f

    def partitions(self) -> list[Range]:
        return self.ranges(_files(self.folder)) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.file else iter(())


class _Stream(_Rows, DataSourceStreamReader):
    """New files in order of their names; the offset is the last name taken, so files must come in that order, as dated exports do."""

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"file": max((file for file, _ in _files(self.folder)), default="")}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges([f for f in _files(self.folder) if start["file"] < f[0] <= end["file"]])


class _History(DataSource):
    @classmethod
    def name(cls) -> str:
        return cls.FORMAT

    def schema(self) -> str:
        return f"{FORMATS[self.FORMAT][0]}, file string"

    def _of(self, kind: type, schema: StructType):
        folder = self.options.get("path")
        if not folder:
            raise ValueError("load() needs a folder")
        split = int(self.options.get("split", SPLIT))
        if split < 1:
            raise ValueError("split must be at least 1 byte")
        return kind(self.FORMAT, schema, folder, split)

    def reader(self, schema: StructType) -> DataSourceReader:
        return self._of(_Batch, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return self._of(_Stream, schema)


class CommitLog(_History):
    FORMAT = "commit_log"


class NameLog(_History):
    FORMAT = "name_log"


class DiffStat(_History):
    FORMAT = "diff_stat"


class Blame(_History):
    FORMAT = "blame"


def register(spark: SparkSession) -> None:
    """Names the formats in a session, and lets conditions reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (CommitLog, NameLog, DiffStat, Blame):
        spark.dataSource.register(source)
