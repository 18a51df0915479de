import math
import random

import numpy as np

from cairn.llm import langid


def corpus():
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "er", "and"], "bb": ["eau", "oui", "lé", "que"], "cc": ["sch", "ung", "öß", "ein"]}
    rows = []
    for i in range(240):
        lang = sorted(parts)[i % 3]
        text = " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(60))
        rows.append((i, text, lang))
    return rows, parts


def test_held_out_accuracy_and_edge_rows(spark):
    rows, _ = corpus()
    extra = [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !!", "bb"), (None, rows[0][1], "aa"), (1003, rows[1][1], None), (1003, rows[1][1], None), (1004, rows[2][1] * 300, "cc")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    got = {(r.doc_id): r for r in langid.identify(docs.withColumn("score", docs.doc_id)).collect()}
    assert len(got) == len(rows) + 6
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert sum(got[i].held_out for i, _, _ in rows) > 20
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert [got[i].score for i in (1000, 1001, 1002)] == [0.0] * 3
    assert got[None].lang_pred == "aa" and not got[None].held_out
    assert got[1003].lang_pred == "bb" and got[1004].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixture_is_recovered(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, model = langid.train(docs)
    first, second = rows[0][1].split(), rows[1][1].split()
    share, known = langid.mixtures([" ".join(first[:45] + second[:15]), "", " ".join(first)], model)
    assert known.tolist() == [True, False, True] and langs == ["aa", "bb", "cc"]
    assert np.allclose(share[0], [0.75, 0.25, 0], atol=0.05)
    assert share[2].tolist() == [1, 0, 0]  # the penalty keeps a single language


def test_trigrams_do_not_depend_on_batching():
    texts = ["Ab, cd", None, "éa", "1 2", "x"]
    code, starts, owner = langid.trigrams(texts)
    assert owner.tolist() == [0, 0, 2, 4]
    for i in (0, 2, 4):
        own, _, _ = langid.trigrams([texts[i]])
        a, b = starts[np.flatnonzero(owner == i)[0]], np.append(starts, len(code))[np.flatnonzero(owner == i)[-1] + 1]
        assert code[a:b].tolist() == own.tolist()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    (row,) = langid.identify(docs).collect()
    assert (row.lang_pred, row.score) == ("und", 0.0)
    assert langid.identify(docs.limit(0)).count() == 0


def test_mixture_of_more_than_three_languages(spark):
    rng = random.Random(5)
    parts = {"aa": ["the", "ing", "er"], "bb": ["eau", "oui", "lé"], "cc": ["sch", "ung", "öß"], "dd": ["ział", "cze", "wy"], "ee": ["mõõ", "kää", "uss"]}
    make = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=rng.randint(2, 3))) for _ in range(n))
    rows = [(i, make(sorted(parts)[i % 5], 60), sorted(parts)[i % 5]) for i in range(200)]
    langs, model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join(make(lang, 30) for lang in langs)
    share, _ = langid.mixtures([rows[0][1], mixed, make("aa", 60) + " " + make("bb", 20), "", mixed], model)
    assert (abs(share[[1, 4]] - 0.2) < 0.05).all()
    assert (share[0] > 0).sum() == 1 and abs(share[2][0] - 0.75) < 0.05 and (share[2] > 0).sum() == 2 and not share[3].any()


def plain_mixture(rows, k):
    """Shares by EM to the end for each nested set of leading languages, the set chosen by BIC; rows are P(word | language)."""
    def em(keep, rounds):
        share = [x / sum(keep) for x in keep]
        for _ in range(rounds):
            new = [0.0] * k
            for row in rows:
                total = sum(s * r for s, r in zip(share, row)) + 1e-30
                for j in range(k):
                    new[j] += share[j] * row[j] / total
            share = [x / len(rows) for x in new]
        return share, sum(math.log(sum(s * r for s, r in zip(share, row)) + 1e-30) for row in rows)

    order = sorted(range(k), key=lambda j: -em([1.0] * k, langid.FIRST_ROUNDS)[0][j])
    best = (-math.inf, None)
    for n in range(1, k + 1):
        share, fitted = em([1.0 if j in order[:n] else 0.0 for j in range(k)], 400 if n > 1 else 1)
        value = fitted - 0.5 * (n - 1) * math.log(len(rows))
        if value > best[0]:
            best = value, share
        elif n >= langid.LEAST:
            break
    return best[1]


def test_mixtures_equal_a_plain_loop(spark):
    rows, _ = corpus()
    langs, model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    rng = random.Random(8)
    texts = [" ".join(rng.choices([w for i in rng.sample(range(240), rng.randint(1, 3)) for w in rows[i][1].split()], k=rng.randint(1, 60))) for _ in range(40)]
    share, _ = langid.mixtures(texts, model)
    for text, own in zip(texts, share):
        code, starts, _ = langid.trigrams([text])
        words = [[sum(float(model[c, j]) for c in code[a:b]) for j in range(len(langs))] for a, b in zip(starts, [*starts[1:], len(code)])]
        like = [[math.exp(x - max(w)) for x in w] for w in words]
        assert np.allclose(own, plain_mixture(like, len(langs)), atol=0.02), text


def test_held_out_accuracy_on_the_table(spark):
    found = langid.op2_langid(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_too_many_labels_are_refused(spark):
    import pytest
    from pyspark.sql import functions as F

    docs = spark.range(10_000).select(F.lit("some words").alias("text"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("lang"))
    with pytest.raises(ValueError, match="10000 languages"):
        langid.train(docs)
