"""The documents' way to training sequences: language, lines, near copies, benchmark, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, langid, linededup, nearcopies, packing
from cairn.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of a document's words in its leading language.
SURE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those without a language for at least half of their words."""
    _, model = langid.train(docs)

    def sure(batches):
        import pyarrow as pa

        for part in langid.slices(batches, "text", 1 << 20):
            share, known = langid.mixtures(part.column("text").to_pylist(), model)
            yield part.filter(pa.array(known & (share.max(1, initial=0) >= SURE)))

    rows = docs.select(*COLUMNS)
    return rows.mapInArrow(sure, rows.schema)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that three or more documents share, but for one."""
    done = linededup.dedup_lines(docs, keep=("lang", "source"))
    return _with_text(done, "kept_text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group linked at similarity 0.8; rows without an id stay."""
    return nearcopies.without_copies(docs, keep=("lang", "source", "n_chars")).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of benchmark items out of the texts."""
    tests = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _with_text(decontaminate.find(docs, tests, keep=("lang", "source"), cut=True), "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, sources in the target shares, with their ids (unsigned 32-bit, little-endian)."""
    return packing.pack(docs, "byte_bpe_50k.json", 1, shares=packing.SHARES, by_window=True, queue_col="source")


def _with_text(rows: DataFrame, text: str) -> DataFrame:
    return rows.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: EM, fingerprints and byte-pair encoding are beyond SQL; tests hold the rows against plain loops.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
