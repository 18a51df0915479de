import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import neighbours


def brute(rows, similarity=0.9):
    """(id, number of links, component, kept) of (id, vector) rows."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    units = [np.array(v, float) / np.abs(np.array(v, float)).max() if k else None for k, (_, v) in zip(ok, rows)]
    units = [u / np.sqrt((u * u).sum()) if u is not None else None for u in units]
    pairs = set()
    by_length = {}
    for i, u in enumerate(units):
        if u is not None:
            by_length.setdefault(len(u), []).append(i)
    for own in by_length.values():
        x = np.stack([units[i] for i in own])
        a, b = np.nonzero(np.triu(x @ x.T >= similarity, 1))
        pairs |= {(own[i], own[j]) for i, j in zip(a.tolist(), b.tolist())}
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
        parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    comp = [least.get(root(i)) for i in range(len(rows))]
    return sorted(((d, n[i], comp[i], comp[i] is None or d == comp[i]) for i, (d, _) in enumerate(rows)), key=repr), pairs


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    rows = [(i, (base[i % 60] * rng.uniform(0.1, 9) + rng.normal(size=8) * rng.uniform(0, 0.6)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(90)] + [(2000, None), (2001, [0.0] * 8), (2002, [1.0, float("nan")]), (2003, [float("inf")] * 8), (2004, [None, 1.0]), (2005, []), (2006, [1.0, 0.0]), (2007, [1.0, 0.01])]
    rows += [(None, rows[7][1]), (None, [0.0, 0.0, 1.0]), (5, rows[5][1]), (5, rows[5][1]), (5, rows[9][1]), (2008, [1e-300, 2e-300]), (2009, [1e300, 2e300])]
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, key string, c int").repartition(5)
    got = neighbours.near_vectors(frame)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)[0]
    # the blocks of a crowded leaf are compared with each other
    assert sorted(map(tuple, neighbours.near_vectors(frame, block=50).collect()), key=repr) == brute(rows)[0]


@pytest.mark.parametrize("sample", [1 << 16, 2000])
def test_recall_and_precision(spark, monkeypatch, sample):
    """Pairs right above the threshold, in leaves of few vectors, beside a large group of near copies."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    # partners at cosines from 0.9 to 0.97
    other = rng.normal(size=(1500, 64))
    other -= (other * x[:1500]).sum(1)[:, None] * x[:1500]
    other /= np.linalg.norm(other, axis=1)[:, None]
    cos = rng.uniform(0.9, 0.97, size=(1500, 1))
    near = cos * x[:1500] + np.sqrt(1 - cos * cos) * other
    group = x[3999] + rng.normal(size=(600, 64)) * 0.01
    vectors = np.concatenate([x, near, group]).astype(np.float32)
    monkeypatch.setattr(neighbours, "LEAF", 150)
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<float>")
    want, pairs = brute([(i, v) for i, v in enumerate(vectors.tolist())])
    got = {r.vec_id: r for r in neighbours.near_vectors(frame, sample=sample).collect()}
    want = {r[0]: r for r in want}
    assert all(got[i].n_links <= want[i][1] for i in want)
    found = sum(r.n_links for r in got.values()) / 2
    single = [i for i in range(4000, 5500)]
    recall = sum(got[i].n_links for i in single) / sum(want[i][1] for i in single)
    print("recall of all pairs", found / len(pairs), "of single pairs", recall)
    assert found >= 0.97 * len(pairs) and recall >= 0.95
    assert all(got[i].component_id >= want[i][2] for i in want)


def test_empty_table(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.near_vectors(none).count() == 0
    void = spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, neighbours.near_vectors(void).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert neighbours.near_vectors(void.withColumn("embedding", F.lit(None).cast("array<float>"))).count() == 2
