import json
import os

import pytest
from pyspark.sql import functions as F

from cairn.sources import readers as R

A, B = "a" * 40, "b" * 40


def test_commit_log(spark):
    lines = spark.createDataFrame([(f"{A}\x1f Ann \x1f2024-01-01\x1fFix\x1fbody \x1f more",), ("short\x1fline",), (f"{B}\x1fBo\x1f2024\x1fs",)], "value string")
    got = sorted(tuple(r) for r in R.parse_commit_log(lines).collect())
    assert got == [(A, "Ann", "2024-01-01", "Fix", "body \x1f more"), (B, "Bo", "2024", "s", "")]


def test_name_log_and_blame(spark):
    text = f"x.py\n{A}\n\nsrc\\a.py\nb.py\n{B}\nc.py\n"
    got = {tuple(r) for r in R.parse_name_log(spark.createDataFrame([("k", text)], "key string, text string")).collect()}
    assert got == {(A, "src/a.py"), (A, "b.py"), (B, "c.py")}
    blame = f"{A} 1 1 2\nauthor Ann\nsummary s\n\tx = 1\n{A} 2 2\n\ty = 2\n{B} 1 3 1\nauthor Bo\n\tz\n"
    got = sorted(tuple(r) for r in R.parse_blame(spark.createDataFrame([("k", blame)], "key string, text string")).collect())
    assert [(r[1], r[2], r[3]) for r in got] == [(A, "Ann", 1), (A, "Ann", 2), (B, "Bo", 3)]


def test_diff_stat(spark):
    lines = spark.createDataFrame([("s", " src/a.py | 5 +++--"), ("s", " 1 file changed"), ("s", " b.py  | 2 ++")], "sha string, line string")
    status = spark.createDataFrame([("s", "b.py", "A")], "sha string, path string, status string")
    got = {r.path: (r.insertions, r.deletions, r.status) for r in R.parse_diff_stat(lines, status).collect()}
    assert got == {"src/a.py": (3, 2, "M"), "b.py": (2, 0, "A")}


def test_files_on_disk(spark, tmp_path):
    os.makedirs(tmp_path / "in/sub/.hidden")
    for name, text in (("a.py", "x"), ("sub/b.PY", "y�" * 9), ("sub/.hidden/c.py", "z"), ("d.txt", "t")):
        (tmp_path / "in" / name).write_text(text)
    found = R.read_files(spark, str(tmp_path / "in")).withColumn("path", F.regexp_extract("path", r"/in/(.*)$", 1))
    kept = found.where(R.kept_paths(F.col("path"), F.col("size_bytes"), [".py"], ["skip"], 1000))
    assert {(r.path, r.b) for r in kept.select("path", R.likely_binary(F.col("content")).alias("b")).collect()} == {("a.py", False), ("sub/b.PY", True)}


def test_names(spark):
    rows = spark.createDataFrame([("my_agent_20240131_120000", "plan_v12"), ("x_99999999_000000", "plan")], "report string, artefact string")
    got = rows.select(R.parse_report_name(F.col("report")).alias("r"), R.parse_version_name(F.col("artefact")).alias("v")).collect()
    assert [(r.r.agent, str(r.r.at), tuple(r.v)) for r in got] == [("my_agent", "2024-01-31 12:00:00", ("plan", 12)), ("x", "None", ("plan", 0))]


def test_query_log_and_sinks(spark, tmp_path):
    log = tmp_path / "2024-01-01.jsonl"
    log.write_text(json.dumps({"id": "1", "agent": "a", "response_length": 3}) + "\nnot json\n")
    assert [r.id for r in R.read_query_log(spark, str(log)).collect()] == ["1"]
    R.write_digests(spark.sql("select date'2024-02-03' day, 'hello' body"), str(tmp_path / "digests"))
    assert (tmp_path / "digests/2024/02/03.md").read_text() == "hello"
    made = R.write_digests(spark.sql("select date'2024-02-05' day, 'a\nb\n' body"), str(tmp_path / "weeks"), "w-{week}/{date}.md", week=True)
    assert made.first().uri.endswith("w-2024-02-05/2024-02-05.md") and R.read_digests(spark, str(tmp_path / "weeks")).first().body == "a\nb\n"
    with pytest.raises(KeyError):
        R.write_digests(spark.sql("select date'2024-02-05' day, '' body"), str(tmp_path), "{hour}.md")
    nodes, edges = spark.createDataFrame([("n",)], "id string"), spark.createDataFrame([("n", "n")], "source string, target string")
    R.save_graph(nodes, edges, str(tmp_path / "graph"))
    assert [x.count() for x in R.load_graph(spark, str(tmp_path / "graph"))] == [1, 1]


def test_truncated_diff(spark):
    df = spark.createDataFrame([("a\nb\nc",), ("a",)], "d string")
    assert [r[0] for r in df.select(R.truncate_diff(F.col("d"), 2)).collect()] == ["a\nb\n... (1 lines omitted)", "a"]


def test_settings(spark, tmp_path):
    from cairn.functions import text as T
    from cairn.operators import extraction as X
    from cairn.sources import settings

    path = tmp_path / "s.json"
    path.write_text(json.dumps({"blocks": {"ui": ["web/", r"\.vue$"]}, "patterns": {"python": {"Class": [r"^\s*record (\w+)"]}}, "classes": {"a": ["x", "y"]}}))
    own = settings.load(str(path))
    rows = spark.createDataFrame([("web/a.py", "record Foo\nclass Bar"), ("b.vue", ""), ("c.py", "")], "path string, content string")
    assert [r[0] for r in rows.select(T.block(F.col("path"), own.blocks)).collect()] == ["ui", "ui", "other"]
    assert [(r.type, r.name) for r in X.extract(rows, own.pattern_table(spark))[0].collect()] == [("Class", "Foo")]
    assert [tuple(r) for r in own.class_table(spark).collect()] == [("a", 0, "x"), ("a", 1, "y")] and own.stopwords == T.STOPWORDS
    path.write_text('{"odd": 1}')
    with pytest.raises(ValueError):
        settings.load(str(path))
