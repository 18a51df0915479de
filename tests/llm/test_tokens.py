import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import huffman, packing, tokens

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
TEXT = st.text(st.one_of(st.sampled_from(" \n \n\t\xa0\u2003ab'sÉéΣß1.!<|"), st.characters(exclude_categories=["Cs"])), max_size=60)


def plain(name, text):
    return tokens.encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
def test_pieces_encode_like_whole_texts(name):
    encode = tokens.encoder(name)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(TEXT, max_size=4))
    def run(texts):
        assert [np.frombuffer(x, encode.dtype).tolist() for x in encode(texts)] == [plain(name, t) for t in texts]

    run()
    odd = ["a<|endoftext|>b c", "wait... (no) c#%x a-b_c [q]{r} e.g. x@y.z", "x  y", " lead", "trail \n", "\n\n a\tb  c", "don't they'll", "e\u0301 \u0301a", None, ""]
    assert [np.frombuffer(x, encode.dtype).tolist() for x in encode(odd)] == [plain(name, t) for t in odd]


def test_code_lengths_are_optimal_and_limited():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    free = huffman.code_lengths(counts, 18)
    assert free[0] == 0 and (free * counts).sum() == sum([2, 4, 7, 12, 20, 33, 54, 88, 143])  # a chain of merges
    for limit in (4, 5, 6):
        short = huffman.code_lengths(counts, limit)
        assert short.max() <= limit and sum(0.5 ** int(x) for x in short if x) <= 1
    assert huffman.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]


def test_bits_round_trip():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, 70_001), 5_000).astype(np.int64)
    lengths = huffman.code_lengths(np.bincount(ids))
    data, marks = huffman.pack(ids, huffman.canonical(lengths), lengths)
    table = huffman.decode_table(lengths, huffman.LIMIT)
    assert huffman.unpack(data, marks, len(ids), table, huffman.LIMIT, huffman.BLOCK).tolist() == ids.tolist()
    # any block can be decoded from its checkpoint alone
    k = 100
    own = huffman.unpack(data, marks[k : k + 1], huffman.BLOCK, table, huffman.LIMIT, huffman.BLOCK)
    assert own.tolist() == ids[k * huffman.BLOCK : (k + 1) * huffman.BLOCK].tolist()


ROWS = [(i * 7 % 41, f"Text {i} wörd " * (i % 9), f"s{i % 3}" if i % 5 else None) for i in range(41)]
ROWS += [(50, None, "s0"), (51, "", "s9"), (52, "long words here " * 9_000, "s1"), (None, "no id", "s0"), (3, "same id", "s1"), (3, "same id", "s1")]


def docs(spark):
    return spark.createDataFrame([(*r, 1) for r in ROWS], "doc_id long, text string, source string, part int").repartition(3)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_huffman_files(spark, tmp_path):
    name = NAMES[1]
    got = huffman.read_ids(huffman.write_ids(docs(spark), name, 2, f"file://{tmp_path}/t", file_ids=20_000)).collect()
    want = sorted((([*plain(name, t), 2], d) for d, t, _ in ROWS), key=lambda x: (x[1] is not None, x[1] or 0, np.array(x[0], "<u2").tobytes()))
    start, rows = 0, []
    for ids, doc in want:
        rows.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert [r[:4] for r in sorted(map(tuple, got), key=lambda r: r[1])] == rows
    assert all(crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 for r in got)


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, source string")
    assert huffman.read_ids(huffman.write_ids(none, NAMES[1], 2, f"file://{tmp_path}/t")).count() == 0
    assert packing.pack(none, NAMES[0], 1, queue_col="source").count() == 0


def check_pieces(got, length):
    """The documents that the pieces hold, and the documents there are."""
    name = NAMES[0]
    want = sorted((repr(d), (*plain(name, t), 1)) for d, t, _ in ROWS)
    got = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    sequences, built, chain = {}, [], []
    for r in got:  # a document's pieces follow each other in the stream
        assert crc(np.frombuffer(r.ids, "<u4")) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        assert r.start == len(chain)
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
        chain += np.frombuffer(r.ids, "<u4").tolist()
        if len(chain) == r.doc_tokens:
            built.append((repr(r.doc_id), tuple(chain)))
            chain = []
    assert not chain and all(s <= length and (s == length or s & (s - 1) == 0) for s in sequences.values())
    return sorted(built), want


def test_packing_holds_every_id_once(spark):
    got = packing.pack(docs(spark), NAMES[0], 1, length=64, queue_col="source").collect()
    built, want = check_pieces(got, 64)
    assert built == want


def test_every_prefix_keeps_the_mixture(spark):
    rows = [(i, "word " * 20, "big" if i % 4 else "small") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = packing.pack(frame, NAMES[0], 1, length=128, queue_col="source", with_ids=False).collect()
    by = {i: s for i, _, s in rows}
    seen = {"big": 0, "small": 0}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        seen[by[r.doc_id]] += r.length
        total = sum(seen.values())
        assert abs(seen["small"] - total / 4) <= 128 + 2 * 21
    even = packing.pack(frame, NAMES[0], 1, length=128, shares={"big": 1, "small": 1}, queue_col="source", with_ids=False).collect()
    head = sorted(even, key=lambda r: (r.sequence_id, r.offset))[:60]
    small = sum(r.length for r in head if by[r.doc_id] == "small") / sum(r.length for r in head)
    assert 0.4 < small < 0.6


def test_one_document_in_many_rows_is_dealt_over_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from cairn.llm import huffman

    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(7)).cast("long").alias("doc_id"), F.lit("some words of a text ").alias("text")).repartition(4)
    made = huffman.write_ids(docs, "word_bpe_49k.json", 2, f"file://{tmp_path}/ids", file_ids=2000)
    sizes = [r.n_ids for r in made.collect()]
    assert len(sizes) > 5 and max(sizes) < 0.5 * sum(sizes)
    back = huffman.read_ids(made, with_ids=False).collect()
    assert len(back) == 4000
    starts = sorted((r.start, r.n_tokens, r.doc_id) for r in back)
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:])) and [r[2] for r in starts] == [None] * 2000 + [7] * 2000
