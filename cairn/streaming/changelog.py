"""The changelog as one job: new commits are merged, described by a model, scored, and their days' digests written again."""

from __future__ import annotations

from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cairn.functions.arrow import filesystem
from cairn.operators import model_rows as M
from cairn.operators import temporal as TP
from cairn.operators.upsert import merge_columns
from cairn.session import materialise
from cairn.sources import readers as R
from cairn.streaming.live import upsert_stream

BASE = "author string, date timestamp, subject string, body string"
KEPT = "intent string, summary string, modules array<string>, risk_score double, enriched_at timestamp"
INTENTS = tuple(k for k, _ in TP.INTENTS if k != "unknown")


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


#: Runs of one size that are merged into one.
FAN = 16


def _runs(path: str) -> list[tuple[int, int]]:
    """First and last batch of each run of commits that is written whole."""
    system, root = filesystem(f"{path}/commits")
    parts = lambda at, name: [(int(f.base_name.removeprefix(name)), f.path) for f in system.get_file_info(fs.FileSelector(at, allow_not_found=True)) if f.base_name.startswith(name)]
    ends = [(low, high, folder) for low, at in parts(root, "run=") for high, folder in parts(at, "batch=")]
    return sorted((low, high) for low, high, folder in ends if system.get_file_info(f"{folder}/_SUCCESS").type == fs.FileType.File)


def _within(run: tuple[int, int], runs: list[tuple[int, int]]) -> bool:
    return any(low <= run[0] and run[1] <= high for low, high in runs if (low, high) != run)


def read_commits(spark: SparkSession, path: str, days: DataFrame | None = None, before: int | None = None, since: int = 0) -> DataFrame:
    """(sha, month, day, ...) as last written, of some days (month, day) or all; `before` leaves out a batch and later ones, `since` earlier ones."""
    runs = [r for r in _runs(path) if r[0] >= since and (before is None or r[1] < before)]
    own = [f"{path}/commits/run={low}/batch={high}" for low, high in runs if not _within((low, high), runs)]
    schema = f"sha string, {BASE}, {KEPT}, day date, run bigint, batch bigint, month string"
    if not own:
        return spark.createDataFrame([], schema).drop("run", "batch")
    rows = spark.read.schema(schema).option("basePath", f"{path}/commits").parquet(*own)
    if days is not None:
        rows = rows.join(days, ["month", "day"], "left_semi")
    names = [c for c in rows.columns if c not in ("sha", "run", "batch")]
    return rows.groupBy("sha").agg(F.max_by(F.struct(*names), "batch").alias("c")).select("sha", *[f"c.{c}" for c in names])


def write_run(rows: DataFrame, path: str, batch: int, fan: int = FAN) -> None:
    """Writes a batch's commits as a run of its own, and after every `fan` runs of one size merges these into one.

    So there are fewer than `fan` runs of each size, and a row is written again as often as the number of batches has digits to the
    base `fan`. Merged runs stay until the next batch, for readers and because a batch that is repeated builds on them.
    """
    put = lambda df, low: df.hint("rebalance", "month").write.mode("overwrite").partitionBy("month").parquet(f"{path}/commits/run={low}/batch={batch}")
    system, root = filesystem(f"{path}/commits")
    runs = _runs(path)
    whole = [r for r in runs if r[1] < batch]
    for low, high in whole:
        if _within((low, high), whole):
            system.delete_dir(f"{root}/run={low}/batch={high}")
    put(rows, batch)
    size = fan
    while (batch + 1) % (size * fan) == 0:
        size *= fan
    if (batch + 1) % size == 0:
        spark, low = rows.sparkSession, batch + 1 - size
        old = read_commits(spark, path, before=batch, since=low)
        now = read_commits(spark, path, since=batch)
        put(old.join(now.select("sha"), "sha", "left_anti").unionByName(now), low)


def changelog_stream(log: DataFrame, path: str, checkpoint: str, model: Callable[[list[str]], list[str]], hubs: DataFrame | None = None, template: str = "{year}/{month}/{day}.md") -> StreamingQuery:
    """Keeps commits and digests below `path` for a stream of (value, stat): a commit's log line and the lines of its diff statistics.

    The checkpoint is the cursor. Commits that come again keep what the model said; `model` gets subjects with their files, and answers in JSON
    (intent, summary, modules_affected). A batch that is repeated writes the same rows. Digests are files below path/digests.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        lines = materialise(batch, "log")
        new = R.parse_commit_log(lines.select("value")).dropDuplicates(["sha"])
        new = new.select("sha", "author", F.try_to_timestamp("date").alias("date"), "subject", "body", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in KEPT.split(", ")])
        days = materialise(new.select(F.date_format("date", "yyyy-MM").alias("month"), F.to_date("date").alias("day")).distinct(), "days")
        old = read_commits(spark, path, days, number).join(new.select("sha"), "sha", "left_semi")
        merged = materialise(merge_columns(old, new, "sha", _names(BASE), _names(KEPT)), "merged")
        pending = merged.where("enriched_at is null").select("sha", *_names(BASE))
        stats = lines.select(F.trim(F.split("value", "\x1f")[0]).alias("sha"), F.explode("stat").alias("line"))
        changes = R.parse_diff_stat(stats.join(pending.select("sha"), "sha", "left_semi"))
        paths = changes.groupBy("sha").agg(F.array_sort(F.collect_set("path")).alias("paths"))
        asked = pending.join(paths, "sha", "left").select(F.col("sha").alias("key"), F.concat("subject", F.lit("\n"), F.coalesce(F.array_join("paths", "\n"), F.lit(""))).alias("prompt"))
        answers = M.parse_commit_answers(M.apply_model(asked, "prompt", model), list(INTENTS)).withColumnRenamed("key", "sha")
        scored = pending.join(answers, "sha").join(TP.risk_scores(changes, hubs), "sha", "left").withColumns({"risk_score": F.coalesce("risk_score", F.lit(0.0)), "enriched_at": F.current_timestamp()})
        done = merged.where("enriched_at is not null").unionByName(scored.select(*merged.columns)).withColumns({"day": F.to_date("date"), "month": F.date_format("date", "yyyy-MM")})
        write_run(done, path, number)
        found = TP.daily(read_commits(spark, path, days))
        R.write_digests(found.select(F.col("key").alias("day"), "body"), f"{path}/digests", template)

    return upsert_stream(log, apply, checkpoint)
