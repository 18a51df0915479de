"""Licence scan by a positional index of licence texts, in SQL functions only.

The index is a table of postings (word, template, position, idf); a word's IDF is that among the
templates, so what is found in a file depends on no other file. A template's postings are live down to the IDF
at which so many of its positions are that any alignment with MATCHED of its words holds AGREEING live ones. Each file looks up its
own words of that rarity, wherever they stand; a word at position p of the file and r of a template
proposes the start p - r, and the postings are intersected: starts on which AGREEING postings agree are aligned word by word.
A label needs MATCHED of its template's words and, in place, all of its mandatory phrases. No alignment that is
enough for a label is missed. The largest share of a template's words in an aligned start is the score.

Base phrases are found by their rarest word, and must stand whole, so none is missed.

Null and empty texts have no words. Repeated rows are scanned each on its own. Words of equal IDF are all live.
The corpus is read once and nothing is shuffled.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.licence_texts import TEXTS
from cairn.llm.texts import alnum

#: Least share of a template's words in place, as a fraction, and live postings that must agree on a start.
MATCHED, AGREEING = (4, 5), 2
#: Phrases whose every place counts.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
BUCKETS = 1 << 10
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Template:
    label: str
    words: list[str]
    #: Positions of the mandatory phrases' words.
    must: list[int]


class Index:
    """Templates and their postings."""

    def __init__(self, texts=TEXTS) -> None:
        split = lambda x: WORD.findall(x.lower())  # noqa: E731  templates are ASCII
        self.templates = []
        for label, phrases, text in texts:
            own = split(text)
            at = [next(i for i in range(len(own)) if own[i : i + len(p)] == p) for p in map(split, phrases)]
            self.templates.append(Template(label, own, sorted({i + k for i, p in zip(at, map(split, phrases)) for k in range(len(p))})))
        held = Counter(w for t in self.templates for w in set(t.words))
        self.idf = {w: math.log((len(self.templates) + 1) / (n + 1)) for w, n in held.items()}
        self.postings = [(w, t, r, self.idf[w]) for t, own in enumerate(self.templates) for r, w in enumerate(own.words) if self.idf[w] >= self.floor(own)]

    def floor(self, template: Template) -> float:
        """The IDF down to which the template's postings are live."""
        over, under = MATCHED
        spare = len(template.words) - -(-len(template.words) * over // under)
        return sorted((self.idf[w] for w in template.words), reverse=True)[: spare + AGREEING][-1]

    def rarest(self, phrase: list[str]) -> int:
        """The position of a phrase's word of the highest IDF, the first of equal ones."""
        return max(range(len(phrase)), key=lambda i: (self.idf.get(phrase[i], math.inf), -i))


def _constant(value: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, texts=TEXTS) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row."""
    index = Index(texts)
    phrases = [(label, p.split(), index.rarest(p.split())) for label, p in base]
    rare = sorted({w for w, *_ in index.postings} | {p[i] for _, p, i in phrases})
    buckets: list[list] = [[] for _ in range(BUCKETS)]
    for w, t, r, _ in index.postings:
        buckets[(xxhash.xxh64_intdigest(w.encode(), 42) - (1 << 64)) % BUCKETS].append({"w": w, "t": t, "r": r})
    table = _constant(buckets, "array<array<struct<w:string,t:bigint,r:int>>>")
    kept = _constant([t.words for t in index.templates], "array<array<string>>")
    must = _constant([t.must for t in index.templates], "array<array<int>>")
    labels = _constant([t.label for t in index.templates], "array<string>")
    longest = max((len(t.words) for t in index.templates), default=0)

    tokens = docs.select(F.col(id_col).alias("doc_id"), alnum(F.col(text_col)).alias("words"))
    # positions are taken only in files that hold a word of the index
    none = F.array().cast("array<struct<i:int,w:string>>")
    places = F.filter(F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(rare))
    found = tokens.select("doc_id", "words", F.when(F.arrays_overlap("words", F.lit(rare)), places).otherwise(none).alias("hits"))

    def postings(hit: Column) -> Column:
        own = F.filter(F.get(table, F.pmod(F.xxhash64(hit["w"]), F.lit(BUCKETS)).cast("int")), lambda p: p["w"] == hit["w"])
        return F.transform(own, lambda p: F.shiftleft(p["t"], 40) + hit["i"] - p["r"] + longest)

    proposed = F.sort_array(F.flatten(F.transform("hits", postings)))
    found = found.withColumn("proposed", F.when(F.size("hits") >= AGREEING, proposed).otherwise(F.array().cast("array<bigint>")))
    agreed = F.array_distinct(F.filter("proposed", lambda x, k: x == F.get("proposed", k - (AGREEING - 1))))
    starts = F.transform(agreed, lambda x: F.struct(F.shiftright(x, 40).cast("int").alias("t"), (x.bitwiseAND(F.lit((1 << 40) - 1)) - longest).cast("int").alias("s")))
    found = found.withColumn("starts", starts)

    def aligned(x: Column) -> Column:
        own = F.get(kept, x["t"])
        same = F.size(F.filter(own, lambda w, k: F.get("words", x["s"] + k) == w))
        verified = F.coalesce(F.forall(F.get(must, x["t"]), lambda k: F.get("words", x["s"] + k) == F.get(F.get(kept, x["t"]), k)), F.lit(False))
        over, under = MATCHED
        label = F.when(verified & (same * under >= F.size(own) * over), F.get(labels, x["t"]))
        return F.struct((same / F.size(own)).alias("share"), label.alias("label"))

    def stands(phrase: list[str], at: int) -> Column:
        """Starts of the phrase."""
        begin = F.transform(F.filter("hits", lambda h: h["w"] == phrase[at]), lambda h: h["i"] - at)
        whole = lambda s: F.forall(F.sequence(F.lit(0), F.lit(len(phrase) - 1)), lambda k: F.coalesce(F.get("words", s + k) == F.get(F.lit(phrase), k), F.lit(False)))
        return F.filter(begin, whole)

    found = found.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.transform("starts", aligned).alias("aligned"),
        *[stands(p, at).alias(f"base_{i}") for i, (_, p, at) in enumerate(phrases)],
    )
    every = F.concat(*[F.col(f"base_{i}") for i in range(len(phrases))])
    base_labels = F.array_compact(F.array(*[F.when(F.size(f"base_{i}") > 0, F.lit(label)) for i, (label, *_) in enumerate(phrases)]))
    joined = lambda x: F.array_join(F.sort_array(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, F.array_compact(F.col("aligned")["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.col("aligned")["share"]), F.lit(0.0)).alias("score"),
    )


def op4_licences(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
