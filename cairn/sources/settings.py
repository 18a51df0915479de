"""Pattern tables from a settings file (JSON): languages, blocks, content types, classes and extraction patterns."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from cairn.functions import text as T
from cairn.functions.arrow import filesystem
from cairn.operators.extraction import PATTERNS


@dataclass
class Settings:
    """What isn't set keeps the engine's own tables."""

    languages: dict[str, str] = field(default_factory=lambda: dict(T.LANGUAGES))
    blocks: tuple = T.BLOCKS
    content_types: tuple = T.CONTENT_TYPES
    #: (block, pattern) of document classes, in order.
    classes: tuple = ()
    #: (language, what, pattern) of definitions, imports and bases.
    patterns: tuple = PATTERNS
    stopwords: tuple = T.STOPWORDS

    def class_table(self, spark: SparkSession) -> DataFrame:
        """(block, ord, pattern) as `hierarchy.classify` takes them."""
        return spark.createDataFrame([(block, i, pattern) for i, (block, pattern) in enumerate(self.classes)], "block string, ord int, pattern string")

    def pattern_table(self, spark: SparkSession) -> DataFrame:
        """(language, what, pattern) as `extraction.extract` takes them."""
        return spark.createDataFrame([tuple(p) for p in self.patterns], "language string, what string, pattern string")


def load(path: str) -> Settings:
    """Reads {"languages": {ext: name}, "blocks": {name: [patterns]}, "content_types": ..., "classes": ..., "patterns": {language: {what: [patterns]}}, "stopwords": [...]}.

    Several patterns of a name are alternatives; classes are plain strings, found in any case.
    """
    system, own = filesystem(path)
    with system.open_input_stream(own, compression=None) as f:
        given = json.loads(f.read())
    if unknown := given.keys() - Settings.__dataclass_fields__.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    rules = lambda table: tuple((name, "|".join(f"(?:{p})" for p in patterns)) for name, patterns in table.items())
    made = {k: rules(given[k]) for k in ("blocks", "content_types") if k in given}
    if "languages" in given:
        made["languages"] = dict(given["languages"])
    if "classes" in given:
        made["classes"] = tuple((name, p) for name, patterns in given["classes"].items() for p in patterns)
    if "patterns" in given:
        made["patterns"] = tuple((language, what, p) for language, table in given["patterns"].items() for what, patterns in table.items() for p in patterns)
    if "stopwords" in given:
        made["stopwords"] = tuple(given["stopwords"])
    return Settings(**made)
