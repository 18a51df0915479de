import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes, fanout):
    """The root of a list of digests, and each one's path of (before, after)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, place in enumerate(at):
            run, own = runs[place // fanout], place % fanout
            paths[k].append(("".join(run[:own]), "".join(run[own + 1 :])))
        at, nodes = [p // fanout for p in at], [h(*r) for r in runs]
    return nodes[0], paths


def brute(leaves, fanout):
    """(id, leaf, subroot, root, path) of (id, group, leaf) rows."""
    groups = {}
    for i, g, leaf in leaves:
        groups.setdefault(g, []).append((i, leaf))
    names = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    own = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        own[g] = climb([leaf for _, leaf in groups[g]], fanout)
    root, above = climb([own[g][0] for g in names], fanout)
    return [(i, leaf, own[g][0], root, path + up) for g, up in zip(names, above) for (i, leaf), path in zip(groups[g], own[g][1])]


@pytest.mark.parametrize("n, fanout", [(700, 8), (90, 2), (1, 8), (8, 8), (9, 8)])
def test_matches_plain_tree(spark, n, fanout):
    from cairn.session import materialise

    rng = random.Random(n)
    rows = [(rng.choice([None, *range(n)]), rng.choice(["en", "en", "en", "de", "é", "", None]), h(str(rng.randrange(n)))) for _ in range(n)]
    rows += rows[: n // 4]
    leaves = materialise(spark.createDataFrame([(*r, "x") for r in rows], "id long, g string, leaf string, position string").repartition(5), "leaves")
    got = merkle.manifest(leaves, "g", "id", fanout, carry=("id2",) if "id2" in leaves.columns else ()).collect()
    want = brute([(i, g, leaf) for i, g, leaf in rows], fanout)
    key = lambda r: (r[0], r[1], r[2], [tuple(p) for p in r[3]])
    assert sorted(key((r.leaf, r.subroot, r.root, r.path)) for r in got) == sorted(key(w[1:]) for w in want)


def text_of(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, "A", "en", "s", 1), (2, None, "en", None, None), (3, "", None, "s", 0), (4, "Ünï CODE", "en", "s", 8), (5, "x" * 300_000 + "A", "de", "s", 9), (None, "A", "en", "s", 1), (6, "lower", "en", "s", 5), (6, "lower", "en", "s", 5), (-7, "Q", "en", "s", 5)]
    rows += [(i, f"Text {i}", "en", "s", i) for i in range(10, 200)]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, leaf string, total int")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle(spark, str(tmp_path)).collect()
    plain = docs.collect()
    want = brute([(r.doc_id, r.lang, text_of(r, r.text)) for r in plain], 8)
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    changed = {(r.doc_id, text_of(r, r.text)): text_of(r, lower(r.text)) for r in plain if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0}
    rows = []
    for i, leaf, subroot, root, path in want:
        own = changed.get((i, leaf), leaf)
        for before, after in path:
            own = h(before, own, after)
        rows.append((i, leaf, subroot, root, h(*(b + a for b, a in path)), own, own == root))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, rows))
    assert {r.verified for r in got} == {True, False}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert merkle.op11_merkle(spark, str(tmp_path)).count() == 0


def test_fields_are_told_apart(spark):
    rows = spark.createDataFrame([("a", None), ("a", ""), ("", "a"), (None, "a"), ("1:a", "-"), ("é", "x")], "a string, b string")
    found = [r.d for r in rows.select(merkle.digest([F.col("a"), F.col("b")]).alias("d")).collect()]
    assert len(set(found)) == 6 and found[0] == h("1:a-") and found[5] == h("2:é1:x")
