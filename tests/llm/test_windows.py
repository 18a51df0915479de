import numpy as np
import pytest

from cairn.llm import packing, tokens

NAME = "byte_bpe_50k.json"


def packed(spark, rows, length, **more):
    """The pieces, by sequence and offset, once they are found to hold all documents whole."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted(packing.pack(frame, NAME, 1, length=length, by_window=True, queue_col="source", **more).collect(), key=lambda r: (r.sequence_id, r.offset))
    ends, built = {}, {}
    for r in got:
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
        built.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    ids = tokens.encoder(NAME).tokenizer
    for doc, text, _ in rows:
        pieces = sorted(built[doc])
        assert [s for s, _ in pieces] == np.cumsum([0, *(len(x) for _, x in pieces)])[:-1].tolist()
        assert sum((x for _, x in pieces), []) == ids.encode(text, add_special_tokens=False).ids + [1]
    assert all(n <= length and (n == length or n & (n - 1) == 0) for n in ends.values())
    return got


def counts(got, rows, length):
    by, windows = {d: s for d, _, s in rows}, {}
    for r in got:
        own = windows.setdefault(r.sequence_id, {})
        own[by[r.doc_id]] = own.get(by[r.doc_id], 0) + r.length
    return [w for _, w in sorted(windows.items()) if sum(w.values()) == length]


def rows():
    """One hot source, one of a single long document, one of few ids, and others."""
    words = lambda n: "word " * n
    found = [(i, words(20 + i % 50), "hot") for i in range(300)] + [(300, words(4000), "long"), (301, words(15), None)]
    return found + [(310 + i, words(30), f"s{i % 3}") for i in range(60)]


def test_every_window_is_filled_in_the_shares(spark):
    table, length = rows(), 256
    windows = counts(packed(spark, table, length), table, length)
    total = {}
    for w in windows:
        for s, n in w.items():
            total[s] = total.get(s, 0) + n
    every = sum(total.values())
    assert len(windows) > 30
    for w in windows:
        assert all(abs(w.get(s, 0) - n / every * length) <= 6 for s, n in total.items())


def test_given_shares_hold_until_a_source_ends(spark):
    table, length = rows(), 256
    windows = counts(packed(spark, table, length, shares={"hot": 3, "long": 1}), table, length)
    assert all(abs(w["hot"] - 3 * w["long"]) <= 24 for w in windows[: len(windows) // 3])


@pytest.mark.parametrize("seed", range(20))
def test_pieces_fill_the_stream_once(seed):
    rng = np.random.default_rng(seed)
    queues = [rng.integers(1, 10 ** rng.integers(1, 5), rng.integers(1, 20)) for _ in range(rng.integers(1, 40))]
    held = np.array([q.sum() for q in queues])
    weights = held.astype(float) if seed % 2 else rng.random(len(held)) + 0.001
    own = np.repeat(np.arange(len(queues)), [len(q) for q in queues])
    start = np.concatenate([np.cumsum(q) - q for q in queues])
    doc, within, n, at = packing.Credits(held, weights, 64).pieces(own, start, np.concatenate(queues))
    order = np.argsort(at)
    assert (n > 0).all() and at[order].tolist() == (np.cumsum(n[order]) - n[order]).tolist() and n.sum() == held.sum()
    assert np.bincount(doc, n).tolist() == np.concatenate(queues).tolist()


@pytest.mark.parametrize("seed", range(20))
def test_credits_follow_a_loop_of_rounds(seed):
    rng, length = np.random.default_rng(seed), 128
    held = rng.integers(1, 4_000, rng.integers(1, 12))
    weights = rng.random(len(held)) + 0.01
    dealt = packing.Credits(held, weights, length)
    sent = np.zeros(len(held))
    for window in range(dealt.windows):
        room = float(min(length, held.sum() - sent.sum()))
        while room > 1e-6:  # a queue that ends leaves its part to the others
            live = sent < held - 1e-9
            step = min(room / weights[live].sum(), ((held - sent)[live] / weights[live]).min())
            sent[live] += step * weights[live]
            room -= step * weights[live].sum()
        got = dealt.after(np.arange(len(held)), np.full(len(held), window + 1))
        assert (np.abs(got - sent) <= 1 + 1e-6).all()


def test_named_shares_are_parts_of_a_window(spark):
    table, length = rows(), 256
    windows = counts(packed(spark, table, length, shares={"hot": 0.25}), table, length)
    assert all(abs(w["hot"] - length / 4) <= 6 for w in windows[: len(windows) // 3])


def test_a_hundred_thousand_sources(spark, monkeypatch):
    """Sources beyond the number of queues share some; all ids are packed once, and a share that is given holds."""
    from pyspark.sql import functions as F

    from cairn.llm import packing

    monkeypatch.setattr(packing, "QUEUES", 64)
    many = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"), F.concat(F.lit("host"), F.col("id").cast("string")).alias("source"))
    hot = spark.range(100_000, 140_000).select(F.col("id").alias("doc_id"), F.lit("a few words").alias("text"), F.lit("src0").alias("source"))
    docs = many.unionByName(hot).unionByName(spark.createDataFrame([(-1, "a few words", None)], "doc_id long, text string, source string"))
    bounded = packing.bounded_queues(docs, "source", {"src0": 0.25}, 64)
    assert bounded.select("source").distinct().count() <= 64 + 2 and bounded.count() == 140_001
    found = packing.pack(docs, "byte_bpe_50k.json", 1, shares={"src0": 0.25}, with_ids=False, by_window=True, queue_col="source")
    found = found.join(docs.select("doc_id", "source"), "doc_id")
    size = docs.count() * 4
    row = found.agg(F.sum("length").alias("n"), F.count_distinct("doc_id").alias("d")).first()
    assert row.d == 140_001 and row.n == size
    share = found.where("sequence_id < 100").groupBy("sequence_id").agg((F.sum(F.when(F.col("source") == "src0", F.col("length")).otherwise(0)) / F.sum("length")).alias("s"))
    assert all(abs(r.s - 0.25) < 0.02 for r in share.collect())
