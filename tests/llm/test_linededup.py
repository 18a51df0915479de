import random
from collections import defaultdict

from cairn.llm import linededup


def brute(rows):
    seen = defaultdict(set)
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= 20:
                seen[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(seen[key(x)]) < 3 or max(seen[key(x)]) == doc]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    pool = [f"a shared line of words number {i} é" for i in range(12)] + ["short", "", "  ", "x" * 19, "y" * 20, "ÉCOLE " * 5, "école " * 5]
    # what other readers take for line ends stands within lines here
    pool += [f"a shared line of text{c}{b}with blanks inside" for c in ("\r", "\x85", "\u2028", "\u2029") for b in ("", "   ")]
    rows = []
    for i in range(60):
        lines = [rng.choice(["", " ", "\t\r"]) + rng.choice([str, str.upper])(rng.choice(pool)) + rng.choice(["", " ", "\x0b"]) for _ in range(rng.randint(0, 9))]
        rows.append((i % 50, "\n".join(lines)))
    rows += [(100, None), (101, ""), (None, "\n".join(pool)), (102, "\n".join(pool * 400)), (103, "a\r\n" * 3)]
    docs = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, text string, drop string")
    got = linededup.dedup_lines(docs, keep=("drop",)).collect()
    assert sorted(((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_million_blanks_take_no_time(spark):
    import time

    texts = ["a" + " \t" * 500_000 + "b", " " * 1_000_000 + "x" * 30 + "\r" * 1_000_000, "x" * 30]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(9, "X" * 30)], "doc_id long, text string")
    linededup.dedup_lines(docs.limit(0)).count()
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_dropped) for r in linededup.dedup_lines(docs).collect()}
    assert got == {0: (1, 0), 1: (1, 1), 2: (1, 1), 9: (1, 0)} and time.time() - began < 15
