"""Coverage, quality counters and usage statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.text import doc_name


def coverage(files: DataFrame, docs: DataFrame, by: str) -> DataFrame:
    """(by, total, covered, pct): files (path) that have a document (doc) of the derived name."""
    named = files.withColumn("doc", doc_name(F.col("path"))).join(docs.select("doc").distinct().withColumn("has", F.lit(1)), "doc", "left")
    total, covered = F.count("*"), F.count("has")
    return named.groupBy(by).agg(total.alias("total"), covered.alias("covered"), F.round(100 * covered / F.greatest(total, F.lit(1)), 1).alias("pct"))


def stale_groups(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """(module, stale): modules without a document at least as new as their newest source."""
    newest = sources.groupBy("module").agg(F.max("mtime").alias("newest"))
    return newest.join(docs.select("module", "mtime"), "module", "left").select("module", F.coalesce(F.col("mtime") < F.col("newest"), F.lit(True)).alias("stale"))


def check_counters(checks: DataFrame, by: str) -> DataFrame:
    """Counts of abstained, passed and failed checks; a check that abstained is nothing else."""
    gone, passed = F.col("abstained"), F.col("passed")
    return checks.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(gone).alias("abstained"), F.count_if(~gone & passed).alias("passed"), F.count_if(~gone & ~passed).alias("failed"),
    )


def merge_reports(reports: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The latest row of each key over all runs."""
    rest = [c for c in reports.columns if c not in (*keys, seq)]
    return reports.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("last")).select(*keys, "last.*")


def failure_rates(counters: DataFrame) -> DataFrame:
    return counters.withColumn("failure_pct", F.round((F.col("total") - F.col("passed")) / F.greatest("total", F.lit(1)) * 100, 1))


def usage_by_day(log: DataFrame) -> DataFrame:
    """(day, n, tokens, errors) and a row of totals with a null day; a token is three characters."""
    tokens = F.floor((F.length("query") + F.col("response_length")) / 3)
    rolled = log.withColumn("day", F.to_date("ts")).rollup("day")
    return rolled.agg(F.count("*").alias("n"), F.sum(tokens).alias("tokens"), F.count("error").alias("errors"))


def call_metrics(calls: DataFrame, window: str = "1 hour") -> DataFrame:
    """(start, tool, n, mean_ms, failures) of calls in clock windows."""
    own = calls.groupBy(F.window("ts", window).alias("w"), "tool").agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean_ms"), F.count_if(~F.col("success")).alias("failures"))
    return own.select(F.col("w.start").alias("start"), "tool", "n", "mean_ms", "failures")


#: Numbers whose events are folded together.
SLICE = 1 << 12


def clamped_scores(events: DataFrame, low: float = 0.0, high: float = 100.0, start: float = 50.0, quarantine: float = 30.0) -> DataFrame:
    """(tool, score, quarantined): deltas added in order of (day, n), clamped after each.

    A run of steps is itself a clamp and a shift, x -> min(max(x + a, b), c). So slices of SLICE consecutive n fold on their
    own, then their steps in each day, and only a step for each day meets in a tool's row.
    """
    step = lambda s, d: F.struct(
        (s["a"] + d).alias("a"), F.least(F.greatest(s["b"] + d, F.lit(low)), F.lit(high)).alias("b"), F.least(F.greatest(s["c"] + d, F.lit(low)), F.lit(high)).alias("c"),
    )
    identity = F.struct(F.lit(0.0).alias("a"), F.lit(low).alias("b"), F.lit(high).alias("c"))
    # first f, then g
    then = lambda f, g: F.struct(
        (f["a"] + g["a"]).alias("a"), F.least(F.greatest(f["b"] + g["a"], g["b"]), g["c"]).alias("b"), F.least(F.greatest(f["c"] + g["a"], g["b"]), g["c"]).alias("c"),
    )
    sliced = events.groupBy("tool", "day", F.floor(F.col("n") / SLICE).alias("slice")).agg(F.array_sort(F.collect_list(F.struct("n", "delta"))).alias("d"))
    sliced = sliced.select("tool", "day", "slice", F.aggregate("d.delta", identity, step).alias("f"))
    daily = sliced.groupBy("tool", "day").agg(F.array_sort(F.collect_list(F.struct("slice", "f"))).alias("d"))
    daily = daily.select("tool", "day", F.aggregate("d.f", identity, then).alias("f"))
    apply = lambda x, f: F.least(F.greatest(x + f["a"], f["b"]), f["c"])
    whole = daily.groupBy("tool").agg(F.array_sort(F.collect_list(F.struct("day", "f"))).alias("days"))
    score = F.aggregate("days.f", F.lit(start), apply)
    return whole.select("tool", score.alias("score"), (score < quarantine).alias("quarantined"))
