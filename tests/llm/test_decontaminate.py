import random
import re

import numpy as np

from cairn.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, bench, size):
    out = []
    for doc, text in docs:
        own = words(text)
        hit, items = set(), set()
        for item, phrase in bench:
            p = words(phrase)
            n = min(size, len(p))
            wins = {tuple(p[i : i + n]) for i in range(max(1, len(p) - size + 1))} if p else set()
            for i in range(len(own) - n + 1 if p else 0):
                if tuple(own[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    items |= {item} - {None}
        out.append((doc, len(own), len(hit), sorted(items)))
    return sorted(out, key=repr)


def data(short):
    rng = random.Random(7)
    vocabulary = ["The", "of", "and", "é1", "ab", "cd", "ef", "x9", "Ünd", "it's"]
    bench = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(10, 25)))) for i in range(12)]
    bench += [(50, None), (51, "..."), (None, bench[2][1]), (5, bench[6][1])]
    if short:
        bench += [(60, "ab"), (61, "Cd ef, cd")]
    docs = []
    for i in range(50):
        body = rng.choices([*vocabulary, "noise", "more"], k=rng.randint(0, 60))
        for _ in range(i % 3):
            body[len(body) // 2 : len(body) // 2] = bench[rng.randrange(12)][1].upper().split()[: rng.randint(5, 25)]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(body)))
    docs += [(100, None), (101, ""), (None, bench[0][1]), (102, bench[1][1]), (102, bench[1][1]), (103, (bench[3][1] + " zzz ") * 500)]
    return docs, bench


def test_matches_brute_force(spark):
    for short in (False, True):
        docs, bench = data(short)
        frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int").repartition(2)
        tests = spark.createDataFrame(bench, "item_id long, text string")
        got = dc.find(frame, tests, keep=("spans",) if not short else (), shard_words=300).select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(docs, bench, 10)


def test_blocks_of_phrases_give_the_same(spark):
    docs, bench = data(True)
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    # nearly all words are hashed
    got = dc.find(frame, tests, block_rows=7, longest=2).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(docs, bench, 10)


def test_removal_leaves_no_hit(spark):
    docs, bench = data(False)
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    found = dc.find(frame, tests)
    clean = dc.remove(found).collect()
    row = lambda r: (repr(r.doc_id), r.n_words, repr(r.text))
    assert sorted(map(row, dc.find(frame, tests, cut=True).collect())) == sorted(map(row, clean))
    for r, (_, text) in zip(sorted(clean, key=lambda r: (repr(r.doc_id), r.n_words)), sorted(docs, key=lambda d: (repr(d[0]), len(words(d[1]))))):
        assert (r.text == text) if not r.n_hit else len(words(r.text)) == r.n_words - r.n_hit


def test_long_documents_are_cut_into_pieces(spark):
    docs, bench = data(True)
    docs += [(200, " ".join(["noise"] * 95 + bench[0][1].split() + ["more"] * 90 + bench[1][1].split()[:11]))]
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for words in (1, 10, 100):
        got = dc.find(frame, tests, shard_words=words).select("doc_id", "n_words", "n_hit", "items").collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(docs, bench, 10)


def test_suffixes_in_order():
    rng = np.random.default_rng(6)
    for text in ([0], [1, 0], [1, 1, 1, 1, 1, 0], [1, 2, 0] * 50, rng.integers(0, 3, 400).tolist() + [0], ([3] * 40 + [0]) * 5):
        zeros = iter(range(len(text)))
        plain = [(0, next(zeros)) if x == 0 else (1, x) for x in text]
        assert dc.sort_suffixes(np.array(text, np.int32)).tolist() == sorted(range(len(text)), key=lambda i: plain[i:])


def test_suffixes_and_search():
    rng = np.random.default_rng(4)
    text = np.append(rng.integers(0, 4, 600), 0).astype(np.int32)
    index = dc.FMIndex(text, 4)
    whole = text.tolist()
    for n in (1, 2, 5):
        for _ in range(40):
            p = rng.integers(1, 4, n)
            low, high = index.search(p[None].astype(np.int32), np.array([n]))
            want = [i for i in range(len(whole) - n + 1) if whole[i : i + n] == p.tolist()]
            found = index.locate(np.arange(low[0], max(low[0], high[0])))
            assert sorted(found.tolist()) == want


def test_empty_tables(spark):
    docs, tests = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert dc.find(docs, tests).count() == 0
    (row,) = dc.find(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), tests).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (2, 0, [])


def test_texts_without_words_leave_the_task(monkeypatch):
    import pyarrow as pa

    from cairn.llm import decontaminate

    monkeypatch.setattr(decontaminate, "SHARD_ROWS", 10)
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": ["... !!"] * 40})
    given = []

    def batches():
        for i in range(40):
            given.append(i)
            yield batch.slice(i, 1)

    seen, rows = [], 0
    for out in decontaminate._search(batches(), [], 10, 1 << 20, 64):
        seen.append(len(given))
        rows += out.num_rows
    assert rows == 40 and seen[0] <= 11
    monkeypatch.setattr(decontaminate, "SHARD_ROWS", 1 << 16)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 100)
    assert len(list(decontaminate._search(batches(), [], 10, 1 << 20, 64))) > 5
