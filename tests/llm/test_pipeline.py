import re

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    from cairn.llm import tokens

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    texts = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            texts[name] = {r.doc_id: r.text for r in docs.collect()}
    first = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert texts["language_id"] == {d: t for d, t in first.items() if re.search(r"[^\W\d_]", t or "")}
    assert texts["line_dedup"].keys() == texts["language_id"].keys() > texts["near_dedup"].keys() == texts["decontamination"].keys()
    ids = tokens.encoder("byte_bpe_50k.json").tokenizer
    want = {d: len(ids.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in texts["decontamination"].items()}
    got = {}
    for r in docs.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_edge_rows(spark):
    rows = [(1, "Same text here " * 9, "en", "a", 1), (2, "Same text here " * 9, "en", "a", 1), (None, "Same text here " * 9, None, None, None), (3, None, "en", "a", 0), (4, "12", "en", "a", 2), (5, "Other words " * 9, "en", "b", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_copies(spark, docs, SF)
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == ["1", "3", "4", "5", "None"]
    stayed = pipeline.identify_language(spark, docs, SF)
    assert sorted(map(repr, (r.doc_id for r in stayed.collect()))) == ["1", "2", "5", "None"]
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_last_stage_writes_the_ids(spark):
    import numpy as np

    from cairn.llm import tokens

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = {}
    for r in pipeline.STAGES[-1][1](spark, docs, SF).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    ids = tokens.encoder("byte_bpe_50k.json").tokenizer
    assert {d: sum((x for _, x in sorted(p)), []) for d, p in pieces.items()} == {d: [*ids.encode(t or "", add_special_tokens=False).ids, 1] for d, t in texts.items()}


def test_stages_equal_brute_force(spark, tmp_path):
    """Each stage against plain loops over its own input."""
    import test_decontaminate
    import test_linededup
    import test_nearcopies

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        rows[name] = sorted((r.doc_id, r.text) for r in docs.collect())
        assert all(r.n_chars == len(r.text) for r in docs.collect()) or name in ("language_id", "near_dedup")
    assert rows["line_dedup"] == sorted((d, t) for d, t, _, _ in test_linededup.brute(rows["language_id"]))
    least = dict(test_nearcopies.brute(rows["line_dedup"]))
    assert rows["near_dedup"] == [(d, t) for d, t in rows["line_dedup"] if least[d] == d] and len(rows["near_dedup"]) < len(rows["line_dedup"])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = {d: (n, hit) for d, n, hit, _ in test_decontaminate.brute(rows["near_dedup"], bench, 10)}
    assert any(hit for _, hit in found.values())
    for (d, before), (e, after) in zip(rows["near_dedup"], rows["decontamination"]):
        assert d == e and (before == after if not found[d][1] else len(test_decontaminate.words(after)) == found[d][0] - found[d][1])


def test_clashing_columns_and_a_very_long_text(spark):
    rows = [(1, "Word one " * 20_000, "en", "a", 1), (2, "A short text of some words.", "en", "b", 2), (3, "A short text of some words.", None, None, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string, n_words int")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == ({1, 2} if name == "near_dedup" else {1, 2, 3})
