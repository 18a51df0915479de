"""Model answers as rows: parsing them, and calling a user's model over a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.functions.arrow import slices
from cairn.session import materialise

GRAPH = "struct<nodes:array<struct<id:string,label:string,type:string>>,edges:array<struct<source:string,target:string,relation:string,weight:double>>>"


def unfence(raw: Column) -> Column:
    """Without Markdown fences around it."""
    return F.regexp_replace(F.regexp_replace(T.strip(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def json_object(raw: Column) -> Column:
    """From the first brace to the last; empty if there is none."""
    return F.regexp_extract(unfence(raw), r"(?s)\{.*\}", 0)


def node_id(raw: Column) -> Column:
    clean = F.regexp_replace(F.lower(T.strip(raw)), r"(?U)\s+", "_")
    return F.when(F.contains(clean, F.lit(":")), clean).otherwise(F.concat(F.lit("module:"), clean))


def parse_triplets(answers: DataFrame, types: list[str], relations: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, id, label, type) and edges (key, source, target, relation, weight) of answers (key, raw).

    Answers without both arrays, and incomplete items, are dropped. Unknown types are Module, unknown relations uses.
    """
    own = answers.select("key", F.from_json(json_object(F.col("raw")), GRAPH).alias("g")).where("g.nodes is not null and g.edges is not null")
    full = lambda *cols: [F.length(F.coalesce(c, F.lit(""))) > 0 for c in cols]
    nodes = own.select("key", F.inline("g.nodes"))
    for ok in full("id", "label", "type"):
        nodes = nodes.where(ok)
    nodes = nodes.select("key", node_id(F.col("id")).alias("id"), "label", F.when(F.col("type").isin(types), F.col("type")).otherwise("Module").alias("type"))
    edges = own.select("key", F.inline("g.edges"))
    for ok in full("source", "target", "relation"):
        edges = edges.where(ok)
    weight = F.least(F.greatest(F.coalesce("weight", F.lit(0.7)), F.lit(0.0)), F.lit(1.0))
    return nodes, edges.select("key", node_id(F.col("source")).alias("source"), node_id(F.col("target")).alias("target"), F.when(F.col("relation").isin(relations), F.col("relation")).otherwise("uses").alias("relation"), weight.alias("weight"))


def parse_enrichment(answers: DataFrame, intents: list[str]) -> DataFrame:
    """(key, description, intent, confidence): what can't be read abstains."""
    own = F.from_json(json_object(F.col("raw")), "description string, intent string, confidence double")
    d = F.coalesce(F.col("a.description"), F.lit(T.ABSTAIN))
    return answers.withColumn("a", own).select(
        "key", F.when(F.length(d) > 200, F.concat(F.left(d, F.lit(197)), F.lit("..."))).otherwise(d).alias("description"),
        F.when(F.col("a.intent").isin(intents), F.col("a.intent")).otherwise("unknown").alias("intent"),
        F.least(F.greatest(F.coalesce("a.confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("confidence"),
    )


def parse_commit_answers(answers: DataFrame, intents: list[str]) -> DataFrame:
    """(key, intent, summary, modules): modules are the non-empty strings of the list."""
    own = F.from_json(json_object(F.col("raw")), "intent string, summary string, modules_affected array<string>")
    modules = F.filter(F.coalesce("a.modules_affected", F.array().cast("array<string>")), lambda m: m.isNotNull() & (m != ""))
    summary = F.when(F.length(F.coalesce("a.summary", F.lit(""))) > 0, F.col("a.summary")).otherwise(T.ABSTAIN)
    return answers.withColumn("a", own).select("key", F.when(F.col("a.intent").isin(intents), F.col("a.intent")).otherwise("unknown").alias("intent"), summary.alias("summary"), modules.alias("modules"))


def parse_tasks(answers: DataFrame) -> DataFrame:
    """(key, filepath, action, description, details, error): a row a task; one with an error for bad JSON."""
    fenced = F.regexp_extract("raw", r"(?s)```json\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract("raw", r"(?s)\[.*\]", 0))
    tasks = F.from_json(body, "array<struct<filepath:string,action:string,description:string,details:string>>")
    rows = answers.select("key", F.explode_outer(tasks).alias("t"))
    return rows.select("key", "t.filepath", F.when(F.col("t").isNotNull(), F.coalesce("t.action", F.lit("modify"))).alias("action"), "t.description", "t.details", F.when(F.col("t").isNull(), "no tasks in the answer").alias("error"))


def apply_model(rows: DataFrame, column: str, model: Callable[[list[str]], list[str]], out: str = "raw", batch: int = 8, cut: int | None = None) -> DataFrame:
    """Adds a user's answers: `model` gets lists of up to `batch` texts, whole unless `cut` says what it takes (3000 for embeddings)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", `{out}` string"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(parts, column):
            texts = [(t or "")[:cut] for t in part.column(column).to_pylist()]
            answers = [a for i in range(0, len(texts), batch) for a in model(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(answers, pa.string())], [*part.schema.names, out])

    return rows.mapInArrow(run, schema)


def retry_until_grounded(rows: DataFrame, model: Callable[[list[str]], list[str]], issues: Callable[[DataFrame], DataFrame], attempts: int = 3) -> DataFrame:
    """(key, answer, attempts, abstained, names) of rows (key, prompt).

    Answers in which `issues` (of key, answer: key, name) finds no name, and those that abstain, are kept; the rest are asked
    again with the names they must avoid. What is left at the end abstains, with up to ten of its names.
    """
    todo, done = rows.select("key", "prompt", F.array().cast("array<string>").alias("names")), None
    for n in range(1, attempts + 1):
        avoid = F.when(F.size("names") > 0, F.concat("prompt", F.lit("\nDo not mention: "), F.array_join("names", ", "))).otherwise(F.col("prompt"))
        asked = materialise(apply_model(todo.withColumn("asked", avoid), "asked", model, "answer").drop("asked"), "answers")
        found = issues(asked.select("key", "answer")).groupBy("key").agg(F.slice(F.array_sort(F.collect_set("name")), 1, 10).alias("found"))
        judged = asked.drop("names").join(found, "key", "left").withColumn("names", F.coalesce("found", F.array().cast("array<string>"))).drop("found")
        good = (F.size("names") == 0) | T.abstains(F.col("answer"))
        kept = judged.where(good).select("key", "answer", F.lit(n).alias("attempts"), T.abstains(F.col("answer")).alias("abstained"), F.array().cast("array<string>").alias("names"))
        done = kept if done is None else done.unionByName(kept)
        todo = judged.where(~good).select("key", "prompt", "names")
    return done.unionByName(todo.select("key", F.lit(T.ABSTAIN).alias("answer"), F.lit(attempts).alias("attempts"), F.lit(True).alias("abstained"), "names"))
