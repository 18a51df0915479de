"""Commit risk, digests of days, weeks and modules, and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import text as T

#: What counts as configuration, and intents with their headings, in order.
CONFIG_EXTENSIONS = (".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".env")
CONFIG_NAMES = ("dockerfile", "docker-compose", ".gitlab-ci", "jenkinsfile")
INTENTS = (("feature", "Features"), ("fix", "Fixes"), ("refactor", "Refactors"), ("chore", "Chore"), ("docs", "Documentation"), ("test", "Tests"), ("unknown", "Unknown"))
#: The last line of a digest; a user's own may replace it.
FOOTER = "*Generated from the change history.*"
#: Commits that a module's digest shows, the newest.
MODULE_COMMITS = 100


def is_config(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return T.extension(low).isin(*CONFIG_EXTENSIONS) | F.element_at(F.split(low, "/"), -1).isin(*CONFIG_NAMES)


def risk_scores(changes: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """(sha, risk_score): 0.3 for more than 5 files, 0.2 for a hub module, 0.2 for configuration, 0.1 a hundred net lines up to 0.4.

    `changes` is (sha, path, insertions, deletions), a row a file; `hubs` is (module).
    """
    rows = changes.withColumn("module", T.module_path(F.col("path")))
    rows = rows.join(hubs.select("module", F.lit(True).alias("hub")).distinct(), "module", "left") if hubs is not None else rows.withColumn("hub", F.lit(None).cast("boolean"))
    net = F.greatest(F.sum("insertions") - F.sum("deletions"), F.lit(0))
    own = rows.groupBy("sha").agg(F.count("*").alias("files"), F.max(F.coalesce("hub", F.lit(False))).alias("hub"), F.max(is_config(F.col("path"))).alias("config"), net.alias("net"))
    part = lambda c, x: F.when(c, x).otherwise(0.0)
    score = part(F.col("files") > 5, 0.3) + part(F.col("hub"), 0.2) + part(F.col("config"), 0.2) + F.least(F.col("net") / 100 * 0.1, F.lit(0.4))
    return own.select("sha", F.least(F.round(score, 2), F.lit(1.0)).alias("risk_score"))


def hub_modules(degrees: DataFrame, threshold: int = 10) -> DataFrame:
    """(module) of nodes (module, degree) with more edges than the threshold."""
    return degrees.groupBy("module").agg(F.sum("degree").alias("degree")).where(F.col("degree") > threshold).select("module")


def tenths(x: Column) -> Column:
    """A number from 0 on with one decimal, rounded by its exact binary value."""
    low = F.floor(x * 10)
    return F.format_string("%.1f", (low + F.when(x - low / 10 > 0.05, 1).otherwise(0)) / 10)


def entry(cut: int = 200) -> Column:
    """A commit's lines in a digest."""
    risk = F.when(F.col("risk_score") >= 0.5, F.concat(F.lit(" ⚠️ Risk: "), tenths(F.col("risk_score")))).otherwise("")
    head = F.concat(F.lit("- `"), "intent", F.lit("`: "), "subject", risk, F.lit(" → (`"), F.left("sha", F.lit(7)), F.lit("`)"))
    modules = F.when(F.size("modules") > 0, F.concat(F.lit("\n  Modules: `"), F.array_join("modules", ", "), F.lit("`"))).otherwise("")
    summary = F.when(F.col("summary").startswith(T.ABSTAIN), F.lit("\n  _Summary unavailable_")).when((F.col("summary") != "") & (F.col("summary") != F.col("subject")), F.concat(F.lit("\n  _"), F.left("summary", F.lit(cut)), F.lit("_")))
    return F.concat(head, modules, F.coalesce(summary, F.lit("")))


def _counted(n: Column, one: str, more: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, one).otherwise(more))


def digests(commits: DataFrame, key: Column, title: Column | None = None, footer: str = FOOTER) -> DataFrame:
    """(key, commits, authors, high_risk, by_intent, body) of enriched commits, grouped by `key` (a day, week or module).

    `title` (an expression on key) heads the body. Sections follow the order of INTENTS, commits their date and sha; other
    intents are counted, but have no section. An intent of a key is put together first, so that the last step gathers a row for each intent only.
    """
    order = F.create_map(*[F.lit(x) for i, (k, _) in enumerate(INTENTS) for x in (k, i)])
    label = F.create_map(*[F.lit(x) for k, v in INTENTS for x in (k, v)])
    own = F.coalesce("intent", F.lit("unknown"))
    rows = commits.where("enriched_at is not null").withColumn("intent", own).withColumns({"key": key, "line": entry(), "at": F.try_element_at(order, own)})
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("date", "sha", "line"))), lambda x: x["line"]), "\n")
    parts = rows.groupBy("key", "at", "intent").agg(F.count("*").alias("n"), lines.alias("lines"), F.count_if(F.col("risk_score") >= 0.5).alias("high"))
    section = F.concat(F.lit("## "), F.try_element_at(label, F.col("intent")), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n"), "lines", F.lit("\n\n"))
    shown = F.filter(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", section.alias("s")))), lambda x: x.isNotNull())
    counts = F.array_sort(F.collect_list(F.struct("intent", "n")))
    whole = parts.groupBy("key").agg(F.sum("n").alias("commits"), F.sum("high").alias("high_risk"), counts.alias("by_intent"), F.array_join(F.transform(F.array_sort(shown), lambda x: x["s"]), "").alias("sections"))
    authors = rows.groupBy("key").agg(F.count_distinct("author").alias("authors"))
    high = F.when(F.col("high_risk") > 0, F.concat(F.lit("**"), _counted(F.col("high_risk"), " high-risk** change", " high-risk** changes"), F.lit(".\n"))).otherwise("")
    head = F.concat(
        F.lit("# "), title if title is not None else F.concat(F.lit("Changelog — "), F.col("key").cast("string")), F.lit("\n\n**"), _counted(F.col("commits"), " commit", " commits"),
        F.lit("**\nby "), _counted(F.col("authors"), " author", " authors"), F.lit(".\n"), high, F.lit("\n"),
    )
    body = F.concat(head, "sections", F.lit(f"---\n\n{footer}\n"))
    return whole.join(authors, "key").select("key", "commits", "authors", "high_risk", "by_intent", body.alias("body"))


def daily(commits: DataFrame, footer: str = FOOTER) -> DataFrame:
    return digests(commits, F.to_date("date"), footer=footer)


def weekly(commits: DataFrame, end: str, footer: str = FOOTER) -> DataFrame:
    """Seven days up to and with `end`, as one digest."""
    day, last = F.to_date("date"), F.lit(end).cast("date")
    title = F.concat(F.lit("Weekly Changelog — "), F.date_sub(last, 6).cast("string"), F.lit(" to "), F.col("key"))
    return digests(commits.where(day.between(F.date_sub(last, 6), last)), F.lit(end), title, footer)


def by_module(commits: DataFrame, since=None, most: int = MODULE_COMMITS, footer: str = FOOTER) -> DataFrame:
    """A digest of each module's newest commits, `most` at most.

    Modules may be hot: what can't be among the newest goes within each day's slice first, so that no task ranks a module's whole history.
    """
    rows = (commits if since is None else commits.where(F.col("date") >= since)).where("enriched_at is not null").withColumn("module", F.explode("modules"))
    newest = lambda *by: F.row_number().over(Window.partitionBy("module", *by).orderBy(F.desc("date"), F.desc("sha")))
    near = rows.withColumn("_n", newest(F.to_date("date"))).where(F.col("_n") <= most)
    kept = near.withColumn("_n", newest()).where(F.col("_n") <= most).drop("_n")
    return digests(kept, F.col("module"), F.concat(F.lit("Changelog — Module: "), "key"), footer)


def as_json(digest: DataFrame) -> DataFrame:
    """(key, json): counts of a digest, whole and by the intents' headings."""
    label = F.create_map(*[F.lit(x) for k, v in INTENTS for x in (k, v)])
    counts = F.transform("by_intent", lambda x: F.struct(F.coalesce(F.try_element_at(label, x["intent"]), x["intent"]), x["n"]))
    return digest.select("key", F.to_json(F.struct("key", "commits", "authors", F.col("high_risk").alias("high_risk_count"), F.map_from_entries(counts).alias("by_intent"))).alias("json"))


def timeline(commits: DataFrame, gaps: bool = False) -> DataFrame:
    """(day, n) commits a day; `gaps` adds days without."""
    found = commits.groupBy(F.to_date("date").alias("day")).agg(F.count("*").alias("n"))
    if not gaps:
        return found
    ends = found.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("day"))
    return days.join(found, "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def change_entry(changes: DataFrame, key: str, most: int = 20) -> DataFrame:
    """(key, action, n, text): names of each action, the first `most` in order, and how many more."""
    # only the names that are shown are gathered
    names = changes.select(key, "action", "path").distinct()
    rank = F.row_number().over(Window.partitionBy(key, "action").orderBy("path"))
    shown = names.withColumn("k", rank).where(F.col("k") <= most).groupBy(key, "action").agg(F.array_sort(F.collect_list("path")).alias("names"))
    own = names.groupBy(key, "action").agg(F.count("*").cast("int").alias("n")).join(shown, [key, "action"])
    more = F.when(F.col("n") > most, F.concat(F.lit(" and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return own.select(key, "action", "n", F.concat(F.array_join("names", ", "), more).alias("text"))
