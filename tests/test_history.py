import pytest
from pyspark.sql import functions as F

from cairn.sources import history

A, B, C = "a" * 40, "b" * 40, "c" * 40


@pytest.fixture(scope="module")
def read(spark):
    history.register(spark)
    return lambda kind, path, **options: spark.read.format(kind).options(**options).load(str(path))


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.txt").write_bytes(text.encode() if isinstance(text, str) else text)
    return folder


def rows(frame):
    return sorted(tuple(r)[:-1] for r in frame.collect())


def test_commits_are_whole_at_any_cut(read, tmp_path):
    lines = [f"{n:040x}\x1fann\x1f2024\x1fsübject {n}\x1fbody\x1f{'x' * (n % 7)}" for n in range(30)]
    folder = put(tmp_path / "log", one="\n".join(lines[:20]), two="\r\n".join(lines[20:]) + "\n\nshort\x1fline\n", three="")
    want = sorted((f"{n:040x}", "ann", "2024", f"sübject {n}", f"body\x1f{'x' * (n % 7)}") for n in range(30))
    for split in (7, 41, 100, 1 << 20):
        assert rows(read("commit_log", folder, split=split)) == want
    assert read("commit_log", folder, split=100).rdd.getNumPartitions() > 20
    put(folder, broken=b"s\x1fa\x1fd\x1f\xff")
    assert read("commit_log", folder / "broken.txt").first().subject == "\ufffd"


def test_files_of_commits_are_whole_at_any_cut(read, tmp_path):
    text = f"stray\n{A}\n\nsrc\\x.py\ny.py\n{B}\n{C}\n" + "".join(f"f{n}\n" for n in range(50))
    folder = put(tmp_path / "names", one=text, two=f"{A}\nz")
    want = sorted([(A, "src/x.py"), (A, "y.py"), (A, "z"), *((C, f"f{n}") for n in range(50))])
    for split in (1, 13, 64, 1 << 20):
        assert rows(read("name_log", folder, split=split)) == want
    empty = put(tmp_path / "none")
    assert read("name_log", empty).count() == 0


def test_long_lines_are_read_in_pieces(read, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "BLOCK", 5)
    put(tmp_path / "long", one=f"{A}\n{'p' * 1000}\nq\n{B}\nr")
    for split in (3, 50, 1 << 20):
        source = history._Batch("name_log", history.StructType(), str(tmp_path / "long"), split)
        got = [tuple(r.values())[:2] for part in source.partitions() for batch in source.read(part) for r in batch.to_pylist()]
        assert got == [(A, "p" * 1000), (A, "q"), (B, "r")]


def test_statistics_and_annotations(read, tmp_path):
    stats = put(tmp_path / "stat", one=f"{A}\n a.py | 3 ++-\n b | c.bin | 0\n 2 files changed\n{B}\n a.py | 1 -\n")
    assert rows(read("diff_stat", stats)) == [(A, "a.py", 2, 1), (A, "b | c.bin", 0, 0), (B, "a.py", 0, 1)]
    blame = put(tmp_path / "blame", one=f"{A} 1 1 2\nauthor Ann\nsummary s\n\tx = 1\n{A} 2 2\n\t\ty\n{B} 9 3 1\nauthor Bo\n\t\n{A} 4 4 1\n\tz\n")
    assert rows(read("blame", blame, split=9)) == [(A, "Ann", 1, "x = 1"), (A, "Ann", 2, "\ty"), (A, "Ann", 4, "z"), (B, "Bo", 3, "")]


def test_conditions_reach_the_reader(spark, read, tmp_path):
    folder = put(tmp_path / "names", one=f"{A}\nx\ny\n{B}\nx\n", two=f"{C}\nx\n")
    found = read("name_log", folder).where((F.col("path") == "x") & F.col("sha").isin(A, C) & (F.length("sha") == 40))
    assert rows(found) == [(A, "x"), (C, "x")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    left = "".join(line for line in plan.splitlines() if "Filter" in line)
    assert "length(sha" in left and "= x" not in left and " IN (" not in left
    own = read("name_log", folder)
    file = own.where(F.col("sha") == C).first().file
    assert rows(own.where(F.col("file") == file)) == [(C, "x")]


def test_new_files_of_a_stream(spark, read, tmp_path):
    folder = put(tmp_path / "in", day1=f"{A}\nx\n")
    for name, want in (("day1", [(A, "x")]), ("day2", [(A, "x"), (B, "y")])):
        if name == "day2":
            put(folder, day2=f"{B}\ny\n")
        stream = spark.readStream.format("name_log").load(str(folder)).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        stream.option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
        assert rows(spark.read.parquet(f"{tmp_path}/out")) == want
