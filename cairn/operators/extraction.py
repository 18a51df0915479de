"""Definitions, calls and imports by line patterns, for any language in the pattern table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.session import materialise

#: Language, what a line declares, pattern whose first group is the name.
PATTERNS = (
    ("java", "Class", r"^\s*(?:public |protected |private |abstract |final |static )*(?:class|interface|enum|record)\s+(\w+)"),
    ("java", "Method", r"^\s*(?:public |protected |private |static |final |synchronized )+[\w<>\[\], ]+\s+(\w+)\s*\([^;]*$"),
    ("java", "Field", r"^\s*(?:public |protected |private |static |final )+[\w<>\[\], ]+\s+(\w+)\s*(?:=[^(]*)?;"),
    ("java", "imports", r"^\s*import\s+(?:static\s+)?([\w.]+)"),
    ("java", "extends", r"\bclass\s+\w+.*?\bextends\s+(\w+)"),
    ("java", "implements", r"\bclass\s+\w+.*?\bimplements\s+(\w+)"),
    ("python", "Class", r"^\s*class\s+(\w+)"), ("python", "Method", r"^\s*(?:async\s+)?def\s+(\w+)"),
    ("python", "imports", r"^\s*(?:from|import)\s+([\w.]+)"), ("python", "extends", r"^\s*class\s+\w+\(\s*(\w+)"),
    ("javascript", "Class", r"^\s*(?:export\s+)?(?:default\s+)?class\s+(\w+)"), ("javascript", "Method", r"^\s*(?:async\s+)?(?:function\s+)?(?!if\b|for\b|while\b|switch\b|catch\b)(\w+)\s*\([^)]*\)\s*\{"),
    ("javascript", "imports", r"^\s*import\b.*?from\s+['\"]([^'\"]+)"), ("javascript", "extends", r"\bclass\s+\w+\s+extends\s+(\w+)"),
    ("typescript", "Class", r"^\s*(?:export\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)"), ("typescript", "Method", r"^\s*(?:public |private |protected |static |async )*(?:function\s+)?(?!if\b|for\b|while\b|switch\b|catch\b)(\w+)\s*\([^)]*\)\s*(?::\s*[\w<>\[\]| ]+)?\s*\{"),
    ("typescript", "imports", r"^\s*import\b.*?from\s+['\"]([^'\"]+)"), ("typescript", "extends", r"\bclass\s+\w+\s+extends\s+(\w+)"), ("typescript", "implements", r"\bclass\s+\w+.*?\bimplements\s+(\w+)"),
    ("go", "Class", r"^\s*type\s+(\w+)\s+(?:struct|interface)"), ("go", "Method", r"^\s*func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("), ("go", "imports", r"^\s*(?:import\s+)?\"([\w./-]+)\"$"),
)
DECLARED = ("Class", "Method", "Field")
CALL = r"(\w+)\s*\("
#: What \w stands for in patterns: letters and digits of any script.
WORD = r"\p{L}\p{M}\p{Nd}_"
NOT_CALLS = ("if", "for", "while", "switch", "catch", "return", "def", "class", "func", "function", "print", "super", "new", "and", "or", "not", "in", "elif", "with")


NODE = ["id", "type", "name", "file_path", "line_start", "line_end"]
EDGE = ["source_id", "target_id", "relation", "confidence"]
CLOSING = ")}]"


def of_any_script(pattern: str) -> str:
    return pattern.replace(r"[\w", f"[{WORD}").replace(r"\w", f"[{WORD}]")


def _hits(line: Column, language: Column, patterns: list[tuple]) -> Column:
    """Array of (what, name): what a line declares in its file's language."""
    found = F.array().cast("array<struct<what:string,name:string>>")
    for one in sorted({lang for lang, _, _ in patterns}):
        own = [F.struct(F.lit(what).alias("what"), F.regexp_extract(line, of_any_script(pattern), 1).alias("name")) for lang, what, pattern in patterns if lang == one]
        found = F.when(language == one, F.filter(F.array(*own), lambda x: x["name"] != "")).otherwise(found)
    return found


class _Sweep:
    """One pass over the lines of a file: a stack of the open definitions, by ascending indentation.

    A line of no deeper indentation that doesn't begin with a closing bracket ends a definition.
    """

    def __init__(self, path: str, last: int, rows: list):
        self.path, self.last, self.rows = path, last, rows
        self.stack: list[tuple] = []  # (indent, line, ids, types, names)
        self.seen: set[tuple] = set()
        self.imported: set[tuple] = set()

    def edge(self, *edge) -> None:
        seen = self.imported if edge[2] == "imports" else self.seen
        if edge not in seen:
            seen.add(edge)
            self.rows.append((None,) * len(NODE) + edge)

    def close(self, indent: int, line: int) -> None:
        while self.stack and self.stack[-1][0] >= indent:
            _, start, ids, types, names = self.stack.pop()
            self.rows += [(i, t, n, self.path, start, line - 1, None, None, None, None) for i, t, n in zip(ids, types, names)]
        if not self.stack:
            self.seen.clear()  # their sources are closed

    def line(self, number: int, indent: int, closing: bool, hits: list[dict], calls: list[str]) -> None:
        if not closing:
            self.close(indent, number)
        kind: dict[str, str] = {}
        for h in hits:
            if h["what"] in DECLARED:
                kind[h["name"]] = min(kind.get(h["name"], h["what"]), h["what"])
            elif h["what"] == "imports":
                self.edge(f"Module:{self.path}", f"Module:{h['name']}", "imports", 1.0)
        if kind:
            names, count, own = sorted(kind), {}, []
            for name in names:
                k = count[kind[name]] = count.get(kind[name], -1) + 1
                own.append((f"{kind[name]}:{self.path}:{number}" + (f"#{k}" if k else ""), kind[name], name))
            own.sort(key=lambda n: n[0].encode())
            ids, types, names = zip(*own)
            # of equal extents the smaller id is the outer one
            for i in ids[1:]:
                self.edge(ids[0], i, "contains", 1.0)
            if self.stack:
                self.edge(self.stack[-1][2][0], ids[0], "contains", 1.0)
            self.stack.append((indent, number, ids, types, names))
            for h in hits:
                if h["what"] in ("extends", "implements"):
                    for i, t in zip(ids, types):
                        if t == "Class":
                            self.edge(i, f"UnresolvedClass:{h['name']}", h["what"], 0.5)
        if self.stack:
            for callee in calls:
                if callee not in kind:
                    self.edge(self.stack[-1][2][0], f"UnresolvedCall:{callee}", "calls", 0.5)

    def end(self) -> None:
        self.close(-1, self.last + 1)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, rows = None, []
    for batch in batches:
        for path, last, number, indent, closing, hits, calls in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or path != now.path or number <= before:
                if now:
                    now.end()
                now = _Sweep(path, last, rows)
            now.line(number, indent, closing, hits, calls)
            before = number
        if len(rows) >= 1 << 14:
            yield _table(rows)
            rows.clear()
    if now:
        now.end()
    yield _table(rows)


def _table(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 10
    kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()] * 3 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], NODE + EDGE)


def extract(files: DataFrame, patterns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, name, file_path, line_start, line_end) and edges (source_id, target_id, relation, confidence).

    `patterns` (language, what, pattern), a settings table, may replace the fixed one. A definition ends where the next line of no deeper indentation
    begins; it holds what lies within, and is the source of the calls there. Patterns are built-in expressions on lines; these stay in the order
    of their file, so that one sweep with a stack finds extents, nesting and the owners of calls without a shuffle. Rows that share a path are files of their own.
    """
    table = list(PATTERNS)
    if patterns is not None:
        table = [tuple(r) for r in patterns.select("language", "what", "pattern").collect()]  # bounded: a settings table
    lines = files.select("path", T.language(F.col("path")).alias("language"), F.split("content", "\r?\n").alias("lines"))
    last = F.array_max(F.transform("lines", lambda x, i: F.when(F.trim(x) != "", i + 1)))
    # by itself, or each line would carry all lines of its file
    # the outer form, as the other has its array tested first, by a filter that goes below a repartition and makes the texts there once more
    lines = lines.withColumn("last", last).select("path", "language", "last", F.posexplode_outer("lines").alias("pos", "line")).where(F.trim("line") != "")
    bare = F.regexp_replace("line", "^\\s+", "")
    calls = F.filter(F.array_distinct(F.regexp_extract_all("line", F.lit(of_any_script(CALL)), 1)), lambda c: ~c.isin(*NOT_CALLS))
    events = lines.select(
        "path", "last", (F.col("pos") + 1).alias("number"), (F.length("line") - F.length(bare)).alias("indent"), F.left(F.trim("line"), F.lit(1)).isin(*CLOSING).alias("closing"),
        _hits(F.col("line"), F.col("language"), table).alias("hits"), calls.alias("calls"),
    )
    kinds = "id string, type string, name string, file_path string, line_start int, line_end int, source_id string, target_id string, relation string, confidence double"
    found = materialise(events.mapInArrow(_swept, kinds), "structure")
    return found.where("id is not null").select(*NODE), found.where("source_id is not null").select(*EDGE)
