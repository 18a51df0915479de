import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from cairn.llm import resample
from cairn.session import materialise


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, most):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, most, buckets, min_words, per_cent):
    s, t = [0] * buckets, [0] * buckets
    own = [[zlib.crc32(f.encode()) % buckets for f in runs(text, most)] for _, text in docs]
    for f in own:
        for b in f:
            s[b] += 1
    for text in target:
        for f in runs(text, most):
            t[zlib.crc32(f.encode()) % buckets] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + buckets) / ((x + 1) * (sum(t) + buckets)))) for x, y in zip(s, t)]
    rows = []
    for (doc, text), f in zip(docs, own):
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        u = None if doc is None else (int(hashlib.sha256(f"2024:{doc}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        rows.append([doc, len(f), weight, None if doc is None else weight + math.floor(-1000 * math.log(-math.log(u))), None, doc is not None and len(words(text)) >= min_words])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(fit[: per_cent * len(fit) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(8)
    pool = ["Alpha", "beta", "gamma", "É", "naïve", "x1", "delta-", "+", "omega"]
    docs = [(rng.choice([None, *range(500)]), " ".join(rng.choices(pool, k=rng.randrange(60)))) for _ in range(300)]
    docs += [(600, None), (601, ""), (602, " \t.,"), (603, "long word " * 60_000)] + docs[:40] + [(700, "beta " * 30)] * 25
    target = [None, "", "alpha beta alpha", "ÉCOLE école omega"]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, fit string").repartition(6)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for most, per_cent, min_words in ((1, 10, 20), (2, 45, 5), (1, 100, 0)):
        got = resample.resample(frame, wanted, per_cent, most, 997, min_words=min_words)
        got = sorted((tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr)
        want = brute(docs, target, most, 997, min_words, per_cent)
        # rows of one id and score may take each other's places
        assert sorted((r[:4] for r in got), key=repr) == sorted((r[:4] for r in want), key=repr)
        assert sorted((r[0], r[3], r[4]) for r in got if r[4]) == sorted((r[0], r[3], r[4]) for r in want if r[4])


def test_cutoff_is_exact_whatever_the_sketch_says(spark):
    rng = random.Random(4)
    # a third of all scores are one
    scores = [5000 if rng.random() < 0.33 else rng.randrange(-3000, 9000) for _ in range(4000)]
    rows = materialise(spark.createDataFrame(list(enumerate(scores)), "doc_id long, score long").repartition(7), "scores")
    order = sorted(enumerate(scores), key=lambda r: (-r[1], r[0]))
    for k in (1, 2, 400, 1500, 3999, 4000):
        for accuracy, margin in ((10_000, 2), (3, 0.01)):
            assert resample.cutoff(rows, 4000, k, accuracy, margin) == tuple(order[k - 1][::-1])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    assert resample.resample(some, none.select("text"), 100, min_words=1).select("rank").collect()[0].rank == 1
    assert resample.resample(some, none.select("text")).where(F.col("rank").isNotNull()).count() == 0
