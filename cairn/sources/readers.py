"""Readers of files, exported history, logs and reports; each gives a DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.arrow import filesystem
from cairn.session import materialise

SHA = "^[0-9a-f]{40}$"


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, size_bytes, content) of all files below a folder; content is read only if used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"))


def kept_paths(path: Column, size: Column, extensions: list[str], skip_dirs: list[str], most_bytes: int) -> Column:
    """Scan rule: no hidden part, no skipped folder, an extension of the list in any case, not too large."""
    folders = F.split(path, "/")
    hidden = F.exists(folders, lambda p: p.startswith(".") & (F.length(p) > 1))
    return ~hidden & ~F.arrays_overlap(folders, F.array(*map(F.lit, skip_dirs))) & F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(extensions) & (size <= most_bytes)


def skipped_file(path: Column, size: Column, allowed: list[str], most_bytes: int, minified: tuple = (".min.js", ".min.css", ".bundle.js")) -> Column:
    """Whether a file isn't indexed: minified, then too large, then not of an allowed extension."""
    low = F.lower(path)
    small = F.lit(False)
    for suffix in minified:
        small = small | low.endswith(suffix)
    return small | (size > most_bytes) | ~F.coalesce(F.regexp_extract(low, r"(\.[^./]+)$", 1).isin(allowed), F.lit(False))


def likely_binary(text: Column, share: float = 0.1) -> Column:
    """Whether replacement characters make up more than `share` of a decoded text."""
    bad = F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit("")))
    return bad > F.length(text) * F.lit(share)


def normalised_hash(text: Column) -> Column:
    """MD5 of a text whose line ends are all line feeds."""
    return F.md5(F.regexp_replace(text, "\r\n?", "\n"))


def parse_commit_log(lines: DataFrame) -> DataFrame:
    """(sha, author, date, subject, body) of lines with fields split at 0x1f; shorter lines are dropped."""
    parts = F.split("value", "\x1f", -1)
    body = F.when(F.size(parts) > 4, F.array_join(F.slice(parts, F.lit(5), F.size(parts)), "\x1f")).otherwise("")
    return lines.where(F.size(parts) >= 4).select(*[F.trim(parts[i]).alias(n) for i, n in enumerate(("sha", "author", "date", "subject"))], F.trim(body).alias("body"))


def _filled(texts: DataFrame, marker: Column) -> DataFrame:
    """Lines of (key, text) with the last marker at or before each."""
    lines = texts.select("key", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("mark", F.last(F.when(marker, F.col("line")), ignorenulls=True).over(Window.partitionBy("key").orderBy("pos")))


def parse_name_log(texts: DataFrame) -> DataFrame:
    """(sha, path): a line of 40 hex digits begins a commit, the lines after it are its files."""
    marker = F.col("line").rlike(SHA)
    named = _filled(texts, marker).where(~marker & (F.trim("line") != "") & F.col("mark").isNotNull())
    return named.select(F.col("mark").alias("sha"), F.replace(F.trim("line"), F.lit("\\"), F.lit("/")).alias("path"))


def parse_diff_stat(lines: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """(sha, path, status, insertions, deletions) from `path | N ++--` lines; glyphs are counted."""
    stat = lines.select(
        "sha", F.trim(F.regexp_extract("line", r"^(.*?)\s+\|\s+\d+", 1)).alias("path"), F.regexp_extract("line", r"\|\s+\d+\s*([+-]*)", 1).alias("marks")
    ).where("path <> ''")
    count = lambda c: F.length("marks") - F.length(F.replace("marks", F.lit(c), F.lit("")))
    out = stat.select("sha", "path", count("+").alias("insertions"), count("-").alias("deletions"))
    if statuses is None:
        return out.withColumn("status", F.lit("M"))
    return out.join(statuses, ["sha", "path"], "left").withColumn("status", F.coalesce("status", F.lit("M")))


def parse_blame(texts: DataFrame) -> DataFrame:
    """(key, sha, author, line): porcelain annotations; a line of code begins with a tab."""
    head = F.col("line").rlike("^[0-9a-f]{40} ")
    lines = _filled(texts, head)
    author = F.last(F.when(F.col("line").startswith("author "), F.regexp_replace("line", "^author ", "")), ignorenulls=True).over(Window.partitionBy("key").orderBy("pos"))
    code = lines.withColumn("author", author).where(F.col("line").startswith("\t"))
    return code.select("key", F.substring("mark", 1, 40).alias("sha"), "author", F.split("mark", " ")[2].cast("int").alias("line"))


def truncate_diff(diff: Column, most_lines: int) -> Column:
    """The first lines of a diff, and a note of how many are left out."""
    lines = F.split(diff, "\n")
    head = F.array_join(F.slice(lines, 1, most_lines), "\n")
    return F.when(F.size(lines) > most_lines, F.concat(head, F.lit("\n... ("), (F.size(lines) - most_lines).cast("string"), F.lit(" lines omitted)"))).otherwise(diff)


def read_query_log(spark: SparkSession, path: str) -> DataFrame:
    """One day's JSON lines; lines that can't be read are dropped."""
    schema = "id string, timestamp timestamp, client_ip string, agent string, query string, response_length int, sources array<string>, duration_ms double, error string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def parse_report_name(name: Column) -> Column:
    """Struct (agent, at) of `{agent}_{yyyyMMdd}_{HHmmss}`; a bad date is null."""
    at = F.try_to_timestamp(F.regexp_extract(name, r"_(\d{8}_\d{6})$", 1), F.lit("yyyyMMdd_HHmmss"))
    return F.struct(F.regexp_replace(name, r"_[^_]*_[^_]*$", "").alias("agent"), at.alias("at"))


def parse_version_name(stem: Column) -> Column:
    """Struct (type, version) of `{type}_v{N}`; other names are their own type, version 0."""
    fits = stem.rlike(r"^.+_v\d+$")
    return F.struct(
        F.when(fits, F.regexp_replace(stem, r"_v\d+$", "")).otherwise(stem).alias("type"),
        F.when(fits, F.regexp_extract(stem, r"_v(\d+)$", 1).cast("int")).otherwise(0).alias("version"),
    )


def day_file(text: Column) -> Column:
    """Struct (title, entries): first line without leading #, number of lines that begin with ##."""
    title = F.trim(F.regexp_replace(F.split(text, "\n")[0], "^#+", ""))
    return F.struct(title.alias("title"), F.size(F.regexp_extract_all(text, F.lit("(?m)^## "), 0)).alias("entries"))


def doc_tree(names: DataFrame, most: int = 300) -> DataFrame:
    """(level, n, names) of documents by the level in their name, L3 if it has none."""
    level = F.when(F.col("name").rlike(r"^L\d+_.+\.md$"), F.regexp_extract("name", r"^(L\d+)_", 1)).otherwise("L3")
    ranked = names.withColumn("level", level).withColumn("rank", F.row_number().over(Window.partitionBy("level").orderBy("name")))
    first = F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.col("name"))))
    return ranked.groupBy("level").agg(F.count("*").alias("n"), first.alias("names"))


def write_digests(digests: DataFrame, root: str, template: str = "{year}/{month}/{day}.md", week: bool = False) -> DataFrame:
    """Writes each digest (day date, body string) to a file of its own below `root`; (day, uri) of the files.

    `template` may name {date}, {year}, {month}, {day}, and {week} where digests are weekly. A file is written under another name
    and then moved, so that readers see it whole and a task that runs twice does no harm.
    """
    known = ("date", "year", "month", "day", *["week"] * week)
    template.format(**dict.fromkeys(known, ""))  # unknown names fail here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(root)
        for batch in batches:
            uris = []
            for day, body in zip(batch.column("day").to_pylist(), batch.column("body").to_pylist()):
                at = day.isoformat()
                name = template.format(**dict(zip(known, (at, at[:4], at[5:7], at[8:], at))))
                path = f"{base}/{name}"
                folder, _, last = path.rpartition("/")
                system.create_dir(folder, recursive=True)
                hidden = f"{folder}/.{last}.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden, compression=None) as f:
                    f.write((body or "").encode())
                system.move(hidden, path)
                uris.append(f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([batch.column("day"), pa.array(uris, pa.string())], ["day", "uri"])

    return materialise(digests.select("day", "body").mapInArrow(run, "day date, uri string"), "digest-files")


def read_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, body) of all digest files below a folder."""
    found = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    return found.select(F.input_file_name().alias("path"), F.col("value").alias("body"))


def save_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def load_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
