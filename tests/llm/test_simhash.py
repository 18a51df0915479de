import numpy as np
import xxhash

from cairn.llm import simhash


def brute(rows, size, bits):
    def print_of(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    fps = [print_of(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= bits and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (doc, _), k in zip(rows, label):
        if doc is not None:
            least[k] = min(doc, least.get(k, doc))
    return sorted(((d, f, least.get(k)) for (d, _), f, k in zip(rows, fps, label)), key=repr)


def texts():
    rng = np.random.default_rng(1)
    words = [f"w{i}é" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, 60))) for i in range(30)]
    for i in range(30, 60):
        w = rows[i % 7][1].split()
        w[int(rng.integers(60))] = "edited"
        rows.append((i, " ".join(w)))
    rows += [(60, None), (61, ""), (62, " \n\t"), (63, "One Two"), (64, "one  two"), (65, rows[0][1]), (None, "one two"), (3, rows[3][1])]
    rows.append((66, " ".join(rng.choice(words, 70_000))))
    return rows


def test_components_match_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fp string")
    got = simhash.near_duplicates(docs, shingle=4, bits=4).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=repr) == brute(rows, 4, 4)


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(2)
    base = int(rng.integers(2**62))
    fps = {base}
    while len(fps) < 120:
        x = list(fps)[int(rng.integers(len(fps)))]
        for _ in range(int(rng.integers(1, 6))):
            x ^= 1 << int(rng.integers(63))
        fps.add(x)
    fps = sorted(fps)
    parent = list(range(len(fps)))
    for _ in fps:
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4:
                    parent[i] = parent[j] = min(parent[i], parent[j])
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    edges = simhash.links(df, block=8).collect()
    assert all((r.u ^ r.v).bit_count() <= 4 for r in edges)
    own = list(range(len(fps)))
    at = {x: i for i, x in enumerate(fps)}
    for _ in fps:
        for r in edges:
            i, j = at[r.u], at[r.v]
            own[i] = own[j] = min(own[i], own[j])
    assert own == parent


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
