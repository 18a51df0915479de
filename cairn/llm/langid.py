"""Language identification as inference of each document's language mixture.

Character trigrams of all labelled texts give P(trigram | language). A document is a bag of
words, each written in one language; expectation-maximisation estimates the proportions, once
for each nested set of its leading languages, up to the first of more than LEAST that doesn't improve the penalised
likelihood (BIC), and the set of the best is kept. The language of the largest proportion is the prediction, that proportion the score.

Null texts and texts without a letter are `und` with score 0, and so is every text if no labelled
row has a letter. Rows with a null label teach nothing. Ties go to the language first in order.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.texts import slices

BUCKETS = 1 << 15
SMOOTH = 0.5
#: Estimates are final when no share moves by more than this in a round; rounds at most.
SETTLED, ROUNDS = 1e-3, 64
#: Rounds with all languages, which rank them.
FIRST_ROUNDS = 4
#: Stands for likelihoods too small for a 32-bit number.
TINY = np.float32(1e-30)
#: Sets of up to so many languages are tried on every document, larger ones while they improve.
LEAST = 3
UNDETERMINED = "und"


@cache
def _is_letter() -> np.ndarray:
    """Whether a code point is a letter, for all of Unicode."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams, one centred on each letter; the start of each word in them; each word's text.

    What isn't a letter ends a word and stands as a blank beside its first and last letter.
    """
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(["", *low, ""]).encode("utf-32-le"), np.uint32)
    letter = _is_letter()[points]
    at = np.flatnonzero(letter)
    blank = np.where(letter, points, 0)
    code = (blank[at - 1] * np.uint32(0x9E3779B1) + blank[at] * np.uint32(0x85EBCA77)) ^ (blank[at + 1] * np.uint32(0xC2B2AE3D))
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    starts = np.flatnonzero(~letter[at - 1])
    ends = np.cumsum([len(t) + 1 for t in low])
    owner = np.searchsorted(ends, at[starts] - 1, side="right")
    return (code >> np.uint32(17)).astype(np.int64), starts, owner


#: Languages at most, some 270 MB of model.
LANGUAGES = 2048


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, code, n) over a task's rows: at most BUCKETS rows a language."""
    seen: dict[str, np.ndarray] = {}
    for part in slices(batches, "text"):
        langs = np.array(part.column("lang").to_pylist(), object)
        texts = part.column("text").to_pylist()
        for lang in set(langs):
            code, _, _ = trigrams([t for t, own in zip(texts, langs) if own == lang])
            seen[lang] = seen.get(lang, 0) + np.bincount(code, minlength=BUCKETS)
    for lang, n in seen.items():
        code = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code), pa.array(n[code])], ["lang", "code", "n"])


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log P(trigram | language) as an array of BUCKETS x languages.

    All rows count, each language adds at most 2**15 sums; the model takes 128 KB a language.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    # refused before any count is made: the model would take 128 KB for each
    if (n := rows.select("lang").distinct().count()) > LANGUAGES:
        raise ValueError(f"{n} languages to learn, more than {LANGUAGES}: clean the column of labels first")
    sums = rows.mapInArrow(_counts, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums.lang.unique())
    n = np.zeros((BUCKETS, len(langs)))
    n[sums.code.to_numpy(int), [langs.index(x) for x in sums.lang]] = sums.n
    return langs, np.log((n + SMOOTH) / (n.sum(0) + SMOOTH * BUCKETS)).astype(np.float32)


def mixtures(texts: list[str | None], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's proportions of all languages (chosen set only), and whether it has a letter."""
    found, k = np.zeros((len(texts), model.shape[1])), model.shape[1]
    code, starts, owner = trigrams(texts)
    if not len(starts) or not k:
        return found, found.any(1)
    like = np.stack([np.add.reduceat(column[code], starts) for column in np.ascontiguousarray(model.T)])
    like = np.exp(like - like.max(0))
    docs, first, size = np.unique(owner, return_index=True, return_counts=True)
    own = np.repeat(np.arange(len(docs)), size)

    def fit(keep: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Languages x documents: shares when they have settled, and their log-likelihood."""
        done = share = keep / keep.sum(0)
        live, words, begin, many, whose = np.arange(share.shape[1]), like, first, size.astype(np.float32), own
        for step in range(rounds):
            part = share[:, whose] * words
            part /= part.sum(0) + TINY
            before, share = share, np.add.reduceat(part, begin, axis=1) / many
            moving = np.abs(share - before).max(0) > SETTLED
            done[:, live] = share
            if not moving.any():
                break
            if step % 4 == 3 and moving.sum() < 0.7 * len(live):
                # go on with the words of the texts that haven't settled
                words, share, live, n = words[:, moving[whose]], share[:, moving], live[moving], many[moving].astype(np.int64)
                begin, many, whose = np.cumsum(n) - n, many[moving], np.repeat(np.arange(len(n)), n)
        return done, np.add.reduceat(np.log((done[:, own] * like).sum(0) + TINY), first, dtype=np.float64)

    best, _ = fit(np.ones((k, len(docs)), np.float32), FIRST_ROUNDS)
    rank = np.argsort(np.argsort(-best, axis=0, kind="stable"), axis=0)
    top, chosen = np.full(len(docs), -np.inf), np.zeros((k, len(docs)), np.float32)
    left = np.arange(len(docs))
    for n in range(1, k + 1):
        share, fitted = fit((rank < n).astype(np.float32), ROUNDS * (n > 1))
        value = fitted - 0.5 * (n - 1) * np.log(size)
        better = value > top[left]
        top[left[better]], chosen[:, left[better]] = value[better], share[:, better]
        if n >= LEAST and n < k:
            # go on with the words of the texts that this size improved
            like, rank, left = like[:, better[own]], rank[:, better], left[better]
            if not len(left):
                break
            size = size[better]
            first, own = np.cumsum(size) - size, np.repeat(np.arange(len(left)), size)
    found[docs] = chosen.T
    return found, np.isin(np.arange(len(texts)), docs)


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1 << 20):
            share, known = mixtures(part.column("text").to_pylist(), model)
            at = share.argmax(1) if langs else np.zeros(len(share), int)
            names = [langs[i] if ok else UNDETERMINED for i, ok in zip(at, known)]
            score = np.where(known, share.max(1, initial=0), 0.0).clip(0, 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from training; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, predict all: (doc_id, held_out, lang_pred, score)."""
    langs, model = train(docs.where(~held_out()))
    return predict(docs, langs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
