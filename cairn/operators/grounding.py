"""Checks of generated prose against known names, sources and cited lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.arrow import slices
from cairn.operators.matching import containing
from cairn.operators.similarity import similar
from cairn.session import materialise


#: Characters of text on each side of a name in its snippet, and products of names and source beyond which an automaton looks for them.
RADIUS, MANY = 60, 1 << 24


def _clean(token: str) -> str:
    """As `functions.text.clean_backticked`."""
    bare = token.strip().lstrip("@")
    cut = re.search(r"[(\[< ]", bare[1:])
    return (bare[: cut.start() + 1] if cut else bare).strip(".,:;\"'`")


def _names(text: str) -> dict[str, tuple[str, str, int]]:
    """The first (name, kind, offset) of each lower-cased name, in order of kinds."""
    found: dict[str, tuple[str, str, int]] = {}
    for kind, pattern in T.CANDIDATES:
        for m in re.finditer(pattern, text):
            name = _clean(m[1]) if kind == "backticked" else m[1]
            if name and name.lower() not in found:
                found[name.lower()] = (name, kind, m.start(1) + (m[1].find(name) if kind == "backticked" else 0))
    return found


def _supported(words: list[str], source: str) -> set[str]:
    """Those words that stand anywhere in the source."""
    if len(words) * len(source) < MANY:
        return {w for w in words if w in source}
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    automaton.make_automaton()
    return {w for _, w in automaton.iter(source)}


def unknown_names(prose: DataFrame, allowed: DataFrame) -> DataFrame:
    """(doc_id, name, kind, snippet) of names in `prose` (doc_id, text, source, language) that nothing supports.

    Names count once a document, whatever their case. They are supported by `allowed` (word, lower case) or
    by standing in the document's source. Only Java and Python documents are checked. Null texts have no names, null sources support none.
    A text is read once: names come with their offsets, from which snippets are cut, and only these rows leave the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            rows = []
            for doc, text, source in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "source"))):
                own = _names(text)
                known = _supported(list(own), (source or "").lower())
                for word, (name, kind, at) in own.items():
                    if word not in known:
                        rows.append((doc, word, name, kind, text[max(0, at - RADIUS) : at + len(name) + RADIUS].replace("\n", " ")))
            columns = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [part.schema.field("doc_id").type, *[pa.string()] * 4])], ["doc_id", "word", "name", "kind", "snippet"])

    checked = prose.where(F.col("language").isin("java", "python") & F.col("text").isNotNull()).select("doc_id", "text", "source")
    left = checked.mapInArrow(run, f"doc_id {checked.schema['doc_id'].dataType.simpleString()}, word string, name string, kind string, snippet string")
    return left.join(allowed, "word", "left_anti").select("doc_id", "name", "kind", "snippet")


def unknown_words(prose: DataFrame, allowed: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, name): distinct matches of `pattern` that `allowed` (word) hasn't, in this very case."""
    names = prose.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("name"))
    return names.join(allowed.select(F.col("word").alias("name")), "name", "left_anti").select("doc_id", "name")


def drop_sentences(text: Column, names: Column, lines_too: bool = False) -> Column:
    """Without the sentences that hold any of the names."""
    kept = F.filter(T.sentences(text, lines_too), lambda s: ~F.exists(names, lambda n: F.contains(s, n)))
    return F.array_join(kept, " ")


def validate_responses(answers: DataFrame, cited: DataFrame, chunks: DataFrame, pattern: str, threshold: int = 5) -> DataFrame:
    """(doc_id, n_unknown, verdict, text) of answers (doc_id, text).

    Names are trusted if they stand in a text cited for the answer (`cited`: doc_id, text) or as a word of any chunk.
    Sentences with other names are removed; more than `threshold` names make the answer abstain.
    """
    names = answers.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("name"))
    of = lambda df, *by: df.select(*by, F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), 1))).alias("name")).distinct()
    left = names.join(of(cited, "doc_id"), ["doc_id", "name"], "left_anti").join(of(chunks), "name", "left_anti")
    bad = left.groupBy("doc_id").agg(F.array_sort(F.collect_list("name")).alias("names"))
    both = answers.join(bad, "doc_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    n = F.size("names")
    skip = T.abstains(F.col("text"))
    return both.select(
        "doc_id", n.alias("n_unknown"), F.when(skip | (n == 0), "passed").when(n > threshold, "abstained").otherwise("cleaned").alias("verdict"),
        F.when(skip | (n == 0), F.col("text")).when(n > threshold, T.ABSTAIN).otherwise(drop_sentences(F.col("text"), F.col("names"))).alias("text"),
    )


def check_citations(citations: DataFrame, files: DataFrame, most: int = 200) -> DataFrame:
    """Adds `error`: the first rule that a citation (path, line_start, line_end) breaks, null if none."""
    known = files.select("path", F.size(F.split("content", "\n")).alias("n_lines"))
    start, end, n = F.col("line_start"), F.col("line_end"), F.col("n_lines")
    error = (
        F.when(n.isNull(), "path does not exist").when(~((start >= 1) & (start <= end) & (end <= n)), "line range invalid")
        .when(end - start > most, "range too large")
    )
    return citations.join(known, "path", "left").withColumn("error", error)


def read_ranges(citations: DataFrame, files: DataFrame) -> DataFrame:
    """Adds `cited`: the lines that a citation covers."""
    lines = files.select("path", F.split("content", "\n").alias("lines"))
    cited = F.array_join(F.slice("lines", F.col("line_start"), F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0))), "\n")
    return citations.join(lines, "path").withColumn("cited", cited).drop("lines")


def unsupported_mentions(cited: DataFrame, mentioned: Column) -> DataFrame:
    """Adds `missing`: mentioned names that don't stand in the cited text."""
    return cited.withColumn("missing", F.filter(mentioned, lambda n: ~F.contains(F.col("cited"), n)))


def split_sources(sources: DataFrame, index: DataFrame) -> DataFrame:
    """Adds `valid`: whether the cited path is in the index."""
    return sources.join(index.select("path", F.lit(True).alias("valid")).distinct(), "path", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def mentions(prose: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """(doc_id, id): labels (id, label) of `least` characters or more that stand anywhere in a text, whatever their case."""
    wanted = labels.where(F.length("label") >= least).select("id", F.lower("label").alias("label"))
    return containing(prose.select("doc_id", F.lower("text").alias("text")), wanted)


def similar_mentions(words: DataFrame, labels: DataFrame, threshold: float = 0.75, native: bool = False) -> DataFrame:
    """(word, id, ratio) of words that resemble a label (id, label), both of three letters or more.

    The ratio is that of matching blocks, or with `native` 1 - levenshtein / longer. Null words and labels resemble nothing.
    """
    spoken = words.select("word").where(F.length("word") >= 3).distinct()
    known = labels.where(F.length("label") >= 3).select("id", F.lower("label").alias("label")).distinct()
    return similar(spoken, known, threshold, native)


def label_classes(labels: DataFrame, first: int) -> tuple[DataFrame, DataFrame]:
    """Ids that share all of their labels (id, label) are found by the same texts: one row a label of each such class, and the classes.

    A class is named by its smallest id. The labels are (id, label), the classes (id, n, ids): how many ids it has, and the `first` smallest.
    So texts meet classes, and copies of a label need not be multiplied with the texts that mention it.
    """
    sets = materialise(labels.groupBy("id").agg(F.array_sort(F.collect_set("label")).alias("labels")).where(F.size("labels") > 0), "label-sets")
    smallest = sets.withColumn("k", F.row_number().over(Window.partitionBy("labels").orderBy("id"))).where(F.col("k") <= first)
    ids = smallest.groupBy("labels").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    classes = materialise(sets.groupBy("labels").agg(F.min("id").alias("id"), F.count("*").alias("n")).join(ids, "labels"), "label-classes")
    return classes.select("id", F.explode("labels").alias("label")), classes.select("id", "n", "ids")


def find_entities(prose: DataFrame, labels: DataFrame, threshold: float = 0.75, enough: int = 3, native: bool = False, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, id, confidence): exact mentions at 1.0; texts with fewer than `enough` also get similar ones.

    Of similar words the first in the text counts; `native` as for `similar_mentions`. With `classes` (id, n), an id of `labels` stands for n.
    """
    exact = materialise(mentions(prose, labels), "mentions").withColumn("confidence", F.lit(1.0))
    counted = exact.join(classes.select("id", "n"), "id") if classes is not None else exact.withColumn("n", F.lit(1))
    rich = counted.groupBy("doc_id").agg(F.sum("n").alias("n")).where(F.col("n") >= enough).select("doc_id")
    poor = prose.join(rich, "doc_id", "left_anti")
    bare = F.regexp_replace(F.lower("w"), "^[.,;:!?()]+|[.,;:!?()]+$", "")
    spoken = poor.select("doc_id", F.posexplode(F.split("text", "\\s+")).alias("pos", "w")).select("doc_id", "pos", bare.alias("word")).where(F.length("word") >= 3)
    alike = spoken.join(similar_mentions(spoken, labels, threshold, native), "word")
    first = alike.groupBy("doc_id", "id").agg(F.min_by("ratio", "pos").alias("confidence")).join(exact.select("doc_id", "id"), ["doc_id", "id"], "left_anti")
    return exact.unionByName(first)
