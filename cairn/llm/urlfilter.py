"""URL verdicts: rules on host and path first, gradient-boosted trees on lexical features for the rest.

URLs that a rule fits are the labelled ones. Trees are fitted on about TRAIN_ROWS different ones of
them, chosen by hash; the counts behind the suffix statistics cover all, and are counted in FOLDS: a labelled URL
gets those of the other folds, so that its own label is never among its features. Where no URL, or only one kind, is labelled, what no rule
fits is allowed, or given that kind. Null URLs and URLs without `://` have an empty host and
path and are judged by the trees like others. All work is DataFrame functions and Spark ML.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labelled URLs that the trees are fitted on, at most.
TRAIN_ROWS = 20_000
FOLDS = 4
ROUNDS, DEPTH = 12, 4
#: URLs above this probability are blocked.
THRESHOLD = 0.5
FEATURES = ("url_length", "host_length", "path_length", "labels", "depth", "digits", "entropy", "parameters", "hyphens", "host_end_rate", "host_end_seen", "path_start_rate")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)\z", 1)
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(own + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def entropy(text: Column) -> Column:
    """Bits a character of the text's own distribution."""
    size = F.length(text).cast("double")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(letters, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need only the URL; `suffix` and `tail` are keys of the statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    count = lambda text, kept: F.length(text) - F.length(F.regexp_replace(text, kept, ""))
    return urls.withColumns({
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"),
        "labels": F.size(F.split("host", "\\.")), "depth": count(F.col("path"), "/"),
        "digits": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)), "entropy": entropy(url),
        "parameters": count(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "=") + 0, "hyphens": count(F.col("host"), "-"),
        "suffix": F.element_at(F.split("host", "\\."), -1), "tail": F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(2)), F.lit("")),
    })


def suffix_statistics(labelled: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): labelled and blocked URLs of each fold."""
    own = [(F.col("fold") == k).cast("double") for k in range(FOLDS)]
    counted = F.struct(F.array(*map(F.sum, own)).alias("n"), F.array(*[F.sum(x * F.col("label")) for x in own]).alias("blocked"))
    return labelled.groupBy(key).agg(counted.alias(name))


def with_statistics(rows: DataFrame, name: str) -> DataFrame:
    """Adds name_rate and name_seen: smoothed share of blocked URLs, and log of their number, in the other folds."""
    total = lambda kind: F.aggregate(F.col(name)[kind], F.lit(0.0), lambda a, x: a + x) - F.coalesce(F.get(F.col(name)[kind], F.col("fold")), F.lit(0.0))
    n, blocked = F.coalesce(total("n"), F.lit(0.0)), F.coalesce(total("blocked"), F.lit(0.0))
    return rows.withColumns({f"{name}_rate": (blocked + 1) / (n + 2), f"{name}_seen": F.log1p(n)})


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS, teach: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, blocked) per row; `blocked` is the trees' probability.

    `teach` (on page_id and url) may keep labelled URLs out of statistics and training.
    """
    host, path = split_url(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"))
    base = lexical(base.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)))
    taught = F.col("fit").isNotNull() & (teach if teach is not None else F.lit(True))
    base = base.withColumn("fold", F.when(taught, F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")))
    labelled = base.where("fold is not null").withColumn("label", (F.col("fit.verdict") == "block").cast("double"))
    n, ones, different = labelled.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0)), F.approx_count_distinct("url", 0.02)).first()
    done = F.col("fit.rule").alias("rule")
    if ones in (0, n):
        fallback = "block" if n and ones == n else "allow"
        return base.select("page_id", "host", "path", done, F.coalesce("fit.verdict", F.lit(fallback)).alias("verdict"), F.lit(float(fallback == "block")).alias("blocked"))
    # written down, so that a suffix of many URLs can be split in the joins below
    by_suffix = materialise(suffix_statistics(labelled, "suffix", "host_end"), "url-suffixes")
    by_tail = materialise(suffix_statistics(labelled, "tail", "path_start"), "url-tails")

    def featured(rows: DataFrame) -> DataFrame:
        joined = rows.join(by_suffix, "suffix", "left").join(by_tail, "tail", "left")
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_statistics(with_statistics(joined, "host_end"), "path_start"))

    # different URLs, so that one of many pages can't fill the sample
    share = min(1.0, train_rows / max(different, 1))
    sample = labelled.where(F.pmod(F.xxhash64(F.lit(1), "url"), F.lit(1 << 62)) < int(share * (1 << 62))).drop("page_id").dropDuplicates(["url"])
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=7, cacheNodeIds=False)
    tasks = pages.sparkSession.sparkContext.defaultParallelism
    model = trees.fit(featured(sample).select("features", "label").coalesce(tasks))
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(featured(base)).withColumn("blocked", vector_to_array("probability")[1])
    verdict = F.coalesce("fit.verdict", F.when(F.col("blocked") > THRESHOLD, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", done, verdict.alias("verdict"), "blocked")


def op8_urlfilter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
