import random

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import quality


def brute(text):
    t = text or ""
    blank = " \t\n\x0b\x0c\r"
    words = [w for w in "".join(" " if c in blank else c for c in t).split(" ") if w]
    wins = {}
    for i in range(len(words) - 7):
        wins.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for own in wins.values() if len(own) > 1 for i in own for k in range(8)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if line.strip(blank):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def rows():
    rng = random.Random(11)
    out = []
    for i in range(160):
        good = i % 3
        words = [("word" if good else "***junk") + rng.choice("abcdefgé") + rng.choice(["", "x", "y\u00a0z"]) for _ in range(rng.randint(0, 80))]
        if i % 7 == 0:
            words[10:10] = words[:12] * 2
        out.append((i, rng.choice([" ", "\n", "\t \n"]).join(words), int(bool(good))))
    return [*out, (200, None, 1), (201, "", 0), (202, " \n \n", None), (203, "a b c d e f g h " * 9000, 0), (None, "x y", 1), (3, out[3][1], 1)]


def test_statistics_match_brute_force_and_model_separates(spark):
    data = rows()
    docs = spark.createDataFrame([(d, t, 1) for d, t, _ in data], "doc_id long, text string, n_words int").repartition(3)
    labels = spark.createDataFrame([(d, q) for d, _, q in data], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.decide(quality.assess(docs, model)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(((d, *brute(t)) for d, t, _ in data), key=repr)
    label = {d: q for d, _, q in data[:160]}
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.kept and r.base_failed)
        if not r.base_failed and r.doc_id in label:
            assert r.kept == bool(label[r.doc_id])


def test_without_labels_only_limits_decide(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30))), (2, "few words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.decide(quality.assess(docs, quality.train(docs, none))).collect()}
    assert got == {1: True, 2: False}
    assert quality.assess(docs.limit(0), None).count() == 0


def test_held_out_accuracy_and_calibration_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    unseen = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(3)) == 0
    model = quality.train(docs, labels.where(~unseen))
    got = quality.assess(docs, model).join(labels.where(unseen), "doc_id").where("quality is not null and n_words > 0").collect()
    truth, chance = np.array([r.quality for r in got]), np.array([r.probability for r in got])
    assert len(got) > 100 and ((chance > 0.5) == (truth > 0)).mean() > max(truth.mean(), 1 - truth.mean())
    assert ((chance - truth) ** 2).mean() < truth.mean() * (1 - truth.mean())  # better than the share of good ones for all
    for low, high in ((0, 0.5), (0.5, 1.01)):
        own = (chance >= low) & (chance < high)
        assert own.sum() < 20 or abs(chance[own].mean() - truth[own].mean()) < 0.15


def test_one_repeated_id_cannot_fill_the_sample(spark):
    docs = spark.createDataFrame([(1, f"text number {i} ") for i in range(300)] + [(2, "another text")] + [(3, None), (4, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (3, 1), (4, 0), (4, None)], "doc_id long, quality int")
    assert quality.train(docs, labels) is not None
    assert quality.train(docs.limit(0), labels) is None and quality.train(docs.where("doc_id = 4"), labels) is None
