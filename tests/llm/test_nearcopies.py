import numpy as np
import pytest

from cairn.llm import nearcopies


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (doc, _), k in zip(rows, label):
        if doc is not None:
            least[k] = min(doc, least.get(k, doc))
    return sorted(((d, least.get(k)) for (d, _), k in zip(rows, label)), key=repr)


def texts():
    """Originals and copies, each with up to 30 new words at their ends: similarities from 0.7 to 1."""
    rng = np.random.default_rng(3)
    words = [f"w{i}é" for i in range(3000)]
    rows = [(i, " ".join(rng.choice(words, 100))) for i in range(40)]
    for i in range(40, 160):
        k = int(rng.integers(0, 31))
        rows.append((i, rows[i % 40][1] + " " + " ".join(rng.choice(words, k))))
    rows += [(160, None), (161, ""), (162, " \n\t"), (163, "One Two"), (164, "one  two"), (None, "one two"), (None, rows[3][1]), (3, rows[3][1]), (None, None)]
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_groups_match_brute_force(spark, block):
    rows = texts()
    got = nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == brute(rows)


def test_limits_of_similarity():
    a = np.arange(100, dtype=np.uint64)
    sets = [a, a[:80], a[:79], a[50:]]
    assert {i: j.tolist() for i, j in nearcopies.similar(sets)} == {1: [0], 2: [1], 3: []}
    assert {i: j.tolist() for i, j in nearcopies.similar([a[:80], a[:79], a, a[:79]], 2)} == {2: [0], 3: [0, 1]}


def test_sets_of_many_hashes_are_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "HASHES", 300)
    rows = texts()
    got = nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id) for r in got), key=repr) == brute(rows)


def test_copies_of_a_very_long_text(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(50000)]
    long = " ".join(rng.choice(words, 1_500_000))
    rows = [(1, long), (2, f"{long} more words"), (3, " ".join(rng.choice(words, 200_000))), (4, long[: len(long) // 2])]
    got = nearcopies.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 1), (3, 3), (4, 4)]


def test_pipeline_drops_copies_that_many_bits_tell_apart(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from cairn.llm import simhash

    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(5000)]
    first = [" ".join(rng.choice(words, 100)) for _ in range(30)]
    more = [f"{t} {' '.join(rng.choice(words, 20))}" for t in first]
    far = [f"{t} {' '.join(rng.choice(words, 40))}" for t in first]
    bits = [(simhash.fingerprint(simhash.space_words(a), 5) ^ simhash.fingerprint(simhash.space_words(b), 5)).bit_count() for a, b in zip(first, more)]
    assert sum(b > 4 for b in bits) > 10
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate([*first, *more])] + [(100 + i, t, "en", "a", len(t)) for i, t in enumerate(far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in pipeline.drop_near_copies(spark, docs, None).collect())
    # 96 + 20 shingles against 96: 0.83; 96 + 40: 0.71, but 0.7 or less against the one of 20 more
    assert kept == [*range(30), *range(100, 130)]


def test_kept_rows_are_those_of_the_groups(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, f"k{i}", 7) for i, r in enumerate(rows)], "doc_id long, text string, row string, c int").repartition(5)
    kept = nearcopies.without_copies(docs, keep=("row", "c")).collect()
    least = {}
    for d, g in brute(rows):
        least.setdefault(d, []).append(g)
    want = sorted((d, t, f"k{i}", 7) for i, (d, t) in enumerate(rows) if d is not None and d in least[d])
    assert sorted(tuple(r) for r in kept if r.doc_id is not None) == want
    assert sorted(r.row for r in kept if r.doc_id is None) == sorted(f"k{i}" for i, (d, _) in enumerate(rows) if d is None)
    assert nearcopies.without_copies(docs.limit(0), keep=("row",)).count() == 0
