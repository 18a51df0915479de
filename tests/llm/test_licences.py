import random
import re

from cairn.llm import licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    own, places, labels = words(text), [], set()
    for label, phrase in licences.BASE:
        p = phrase.split()
        found = [i for i in range(len(own) - len(p) + 1) if own[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


ROWS = [
    (1, "Released under the MIT License."), (2, "x. Licensed under the Apache License, Version 2.0. y " * 3), (3, "Licensed under CC BY-NC 4.0."),
    (4, "This work is licensed under the GNU General Public License, version 3."), (5, None), (6, ""), (7, "..., !"),
    (8, "the mit of the under license"), (9, "Permission is hereby granted, free of charge, to any person getting a copy of this software"),
    (10, "cc by nc" * 2 + " cc-by-nc cc by nc"), (11, "word " * 60_000 + "under the mit license"), (None, "under the MİT license under the mit license"),
    (1, "Released under the MIT License."), (12, "released into the public domain"), (13, "under the mit apache license version 2"), (14, "\u212a c by nc"),
]


def judged(text, index):
    """Labels and score by trying every template at every place."""
    own, labels, score = words(text), set(), 0.0
    for t in index.templates:
        live = {r for w, k, r, _ in index.postings if index.templates[k] is t}
        for s in range(1 - len(t.words), len(own)):
            at = [r for r, w in enumerate(t.words) if 0 <= s + r < len(own) and own[s + r] == w]
            enough = 5 * len(at) >= 4 * len(t.words)
            agreeing = len(live.intersection(at))
            assert agreeing >= 2 or not enough  # the index misses no alignment that is enough for a label
            if agreeing >= 2:
                score = max(score, len(at) / len(t.words))
                labels |= {t.label} if enough and set(t.must) <= set(at) else set()
    return labels, score


def spoilt(rng, index):
    """A template with words replaced, dropped or put in, between other words."""
    own = [w if rng.random() > rng.choice([0, 0.1, 0.2]) else rng.choice(["xx", "software", "license", "granted"]) for w in rng.choice(index.templates).words]
    if rng.random() < 0.3:
        own.insert(rng.randrange(len(own)), "more")
    cut = rng.choice([len(own), rng.randrange(1, len(own) + 1)])
    return ", ".join([*["the foo of"] * rng.randrange(3), *own[:cut], *["Bär baz"] * rng.randrange(3)]).title()


def test_matches_brute_force(spark):
    rng, index = random.Random(4), licences.Index()
    rows = ROWS + [(100 + i, spoilt(rng, index)) for i in range(200)] + [(400 + i, t) for i, (_, _, t) in enumerate(licences.TEXTS)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, words string")
    got = sorted(licences.scan(docs).collect(), key=repr)
    want = []
    for d, t in rows:
        labels, score = judged(t, index) if d != 11 else ({"mit"}, 4 / 5)  # too long to try
        known = base(t)
        want.append((d, *known, ",".join(sorted(labels | set(filter(None, known[-1].split(","))))), round(score, 12)))
    assert sorted(((*tuple(r)[:7], round(r.score, 12)) for r in got), key=repr) == sorted(want, key=repr)
    by = {r.doc_id: r for r in got}
    assert {i: by[i].labels for i in (1, 2, 3, 4, 5, 8, 9, 12)} == {1: "mit", 2: "apache-2", 3: "cc-by-nc", 4: "gpl-3", 5: "", 8: "", 9: "mit", 12: ""}
    assert by[1].score == 1 and by[5].score == 0
    assert all(label in by[400 + i].labels.split(",") and by[400 + i].score == 1 for i, (label, _, _) in enumerate(licences.TEXTS))


def test_a_file_is_judged_alike_in_any_company(spark):
    text = "permission is hereby granted free of xx to any person yy a zz of this software"
    alone = licences.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    other = licences.scan(spark.createDataFrame([(1, text), (2, "charge obtaining copy")], "doc_id long, text string")).where("doc_id = 1").first()
    assert alone == other and alone.labels == "mit" and alone.score == 13 / 16


def test_plan_has_no_python_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    found = licences.scan(docs)
    assert found.count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
