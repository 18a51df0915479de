import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import text as T
from cairn.operators import model_rows as M
from cairn.operators import quality as Q
from cairn.operators import retrieval as R
from cairn.operators import temporal as TP
from cairn.streaming import live


def test_exact_search_and_ties(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v[7] = v[3]
    index = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id int, embedding array<double>").repartition(4)
    queries = index.where("id in (3, 11)").select(F.col("id").alias("query_id"), "embedding")
    got = {(r.query_id, r.rank): (r.id, r.score) for r in R.cosine_top_k(queries, index, 3).collect()}
    assert got[(3, 1)] == (3, 1.0) and got[(3, 2)] == (7, 1.0)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    assert got[(11, 2)][0] == int(np.argsort(-(u @ u[11]), kind="stable")[1])
    assert R.cosine_top_k(queries.limit(0), index, 3).count() == 0
    assert R.cosine_top_k(queries, index.limit(0), 3).count() == 0


def test_merge_and_boost(spark):
    hits = spark.createDataFrame([(1, "a", "s", "same text", 0.9), (1, "b", "s", "same text", 0.8), (1, "c", "t", "x", 0.85)], "query_id int, id string, source string, text string, score double")
    merged = R.merge_hits(hits, 5)
    assert [r.id for r in merged.orderBy("rank").collect()] == ["a", "c"]
    near = spark.createDataFrame([(1, "t", 0), (1, "t", 2)], "query_id int, source string, hop int")
    got = {r.id: (round(r.boosted, 4), r.graph_boosted) for r in R.boost(merged, near).collect()}
    assert got == {"a": (0.9, False), "c": (round(0.85 * 1.3, 4), True)}


def test_risk_score_cases(spark):
    rows = [("big", f"src/f{i}.py", 100, 0) for i in range(6)] + [("conf", "a/b/app.yaml", 10, 10), ("env", ".env", 0, 5), ("docker", "x/Dockerfile", 0, 0), ("hub", "src/auth/x.py", 0, 0)]
    c = spark.createDataFrame(rows, "sha string, path string, insertions int, deletions int")
    got = {r.sha: r.risk_score for r in TP.risk_scores(c, spark.createDataFrame([("src/auth",)], "module string")).collect()}
    assert got == {"big": 0.7, "conf": 0.2, "env": 0.0, "docker": 0.2, "hub": 0.2}


def test_digests(spark):
    day = dt.datetime(2024, 1, 5, 12)
    rows = [("a" * 40, "Ann", day, "Add x", "feature", 0.6, day, ["m"], "Adds x"), ("b" * 40, "Bo", day, "Fix y", "fix", 0.1, day, [], T.ABSTAIN), ("c" * 40, "Bo", day, "pending", "fix", 0.1, None, [], "")]
    c = spark.createDataFrame(rows, "sha string, author string, date timestamp, subject string, intent string, risk_score double, enriched_at timestamp, modules array<string>, summary string")
    (r,) = TP.daily(c).collect()
    assert (r.commits, r.authors, r.high_risk) == (2, 2, 1)
    assert r.body == (
        "# Changelog — 2024-01-05\n\n**2 commits**\nby 2 authors.\n**1 high-risk** change.\n\n## Features (1)\n\n- `feature`: Add x ⚠️ Risk: 0.6 → (`aaaaaaa`)\n  Modules: `m`\n  _Adds x_\n\n"
        "## Fixes (1)\n\n- `fix`: Fix y → (`bbbbbbb`)\n  _Summary unavailable_\n\n---\n\n*Generated from the change history.*\n"
    )
    assert TP.weekly(c, "2024-01-11").first().body.startswith("# Weekly Changelog — 2024-01-05 to 2024-01-11\n\n**2 commits**")
    assert TP.by_module(c, most=1).first().body.startswith("# Changelog — Module: m\n\n**1 commit**\nby 1 author.")
    assert TP.weekly(c, "2024-01-11").first().commits == 2 and TP.weekly(c, "2024-01-12").count() == 0
    assert TP.by_module(c).first().key == "m" and '"commits":2' in TP.as_json(TP.daily(c)).first().json
    assert '"by_intent":{"Features":1,"Fixes":1}' in TP.as_json(TP.daily(c)).first().json


def test_risk_is_rounded_like_its_binary_value(spark):
    values = [i / 100 for i in range(50, 101)] + [0.25, 0.849999]
    got = [r.t for r in spark.createDataFrame([(v,) for v in values], "x double").select(TP.tenths(F.col("x")).alias("t")).collect()]
    assert got == [f"{v:.1f}" for v in values]


def test_triplets(spark):
    raw = '```json\n{"nodes": [{"id": "My Mod", "label": "L", "type": "Odd"}, {"id": "x"}], "edges": [{"source": "class:a", "target": "B c", "relation": "likes", "weight": 7}, {"source": "a", "target": "b", "relation": "uses"}]}\n```'
    n, e = M.parse_triplets(spark.createDataFrame([(1, raw), (2, '{"nodes": []}'), (3, "no"), (4, None)], "key int, raw string"), ["Module"], ["uses"])
    assert [tuple(r) for r in n.collect()] == [(1, "module:my_mod", "L", "Module")]
    assert sorted(tuple(r) for r in e.collect()) == [(1, "class:a", "module:b_c", "uses", 1.0), (1, "module:a", "module:b", "uses", 0.7)]


def test_enrichment_and_tasks(spark):
    rows = [(1, '{"description": "' + "d" * 300 + '", "intent": "io", "confidence": 3}'), (2, "broken"), (3, '{"intent": "odd"}')]
    got = {r.key: r for r in M.parse_enrichment(spark.createDataFrame(rows, "key int, raw string"), ["io"]).collect()}
    assert len(got[1].description) == 200 and got[1].confidence == 1.0 and got[1].intent == "io"
    assert (got[2].description, got[2].intent, got[2].confidence) == (T.ABSTAIN, "unknown", 0.0) and got[3].intent == "unknown"
    tasks = M.parse_tasks(spark.createDataFrame([(1, 'x ```json\n[{"filepath": "a"}]\n```'), (2, "none")], "key int, raw string")).collect()
    assert {(r.key, r.filepath, r.action, r.error) for r in tasks} == {(1, "a", "modify", None), (2, None, None, "no tasks in the answer")}


def test_retry_accepts_rejects_and_abstains(spark):
    def model(texts):
        return ["fine" if "good" in t else T.ABSTAIN if "skip" in t else "fixed" if "Do not mention: BAD_X" in t and "stubborn" not in t else "BAD_X" for t in texts]

    rows = spark.createDataFrame([(1, "good"), (2, "skip"), (3, "retry"), (4, "stubborn")], "key int, prompt string")
    issues = lambda a: a.where("answer = 'BAD_X'").select("key", F.col("answer").alias("name"))
    got = {r.key: (r.answer, r.attempts, r.abstained, r.names) for r in M.retry_until_grounded(rows, model, issues).collect()}
    assert got == {1: ("fine", 1, False, []), 2: (T.ABSTAIN, 1, True, []), 3: ("fixed", 2, False, []), 4: (T.ABSTAIN, 3, True, ["BAD_X"])}


def test_retry_sees_long_prompts_whole(spark):
    def model(texts):
        return ["fixed" if t.endswith("Do not mention: BAD_X") else t for t in texts]

    rows = spark.createDataFrame([(1, "word " * 700 + "BAD_X"), (2, "word " * 700)], "key int, prompt string")
    issues = lambda a: a.where("answer like '%BAD_X%'").select("key", F.lit("BAD_X").alias("name"))
    got = {r.key: (r.answer, r.attempts, r.abstained) for r in M.retry_until_grounded(rows, model, issues).collect()}
    assert got == {1: ("fixed", 2, False), 2: ("word " * 700, 1, False)}


def calls(n=300):
    rng = random.Random(1)
    t, rows = 0.0, []
    for i in range(n):
        t += rng.choice([1, 5, 30, 90])
        rows.append((i, rng.choice("ab"), dt.datetime.fromtimestamp(t, dt.timezone.utc), True))
    return rows


def loop(rows, window, limit):
    state, out = {}, {}
    for i, tool, ts, _ in rows:
        start, count = state.get(tool, (ts, 0))
        if (ts - start).total_seconds() >= window:
            start, count = ts, 0
        out[i] = count < limit
        state[tool] = (start, count + out[i])
    return out


SCHEMA = "event_id long, tool string, ts timestamp, success boolean"


def test_rate_limit_batch_and_stream_equal_a_loop(spark, tmp_path):
    rows = calls()
    frame = spark.createDataFrame(rows, SCHEMA)
    want = loop(rows, 60, 3)
    assert {r.event_id: r.allowed for r in live.rate_limit(frame, 60, 3).collect()} == want
    for k in range(3):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.rate_limit_stream(live.read_files(spark, f"{tmp_path}/in", SCHEMA, 1), 60, 3)
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.event_id: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_rate_limit_of_dense_calls_is_cut_into_blocks(spark):
    rng = random.Random(2)
    t, rows = 0.0, []
    for i in range(6000):
        # no pause of a window; calls of one moment; a quiet stretch within a window before a block's end
        t += rng.choice([0, 0.25, 1, 3, 20]) if i % 2000 else 50
        rows.append((i, "hot" if i % 40 else None, dt.datetime.fromtimestamp(t, dt.timezone.utc), True))
    frame = spark.createDataFrame(rows, SCHEMA)
    for window, limit in ((60, 3), (60, 15), (7.5, 2)):
        for block in (live.CALLS, 250):
            assert {r.event_id: r.allowed for r in live.rate_limit(frame, window, limit, block=block).collect()} == loop(rows, window, limit)
    odd = spark.createDataFrame([(1, "a", None, True), (2, "a", None, True), (3, "a", rows[0][2], True), (4, "a", rows[0][2], True)], SCHEMA)
    assert {r.event_id: r.allowed for r in live.rate_limit(odd, 60, 1).collect()} == {1: True, 2: True, 3: True, 4: False}


def test_rate_limit_of_calls_of_one_moment(spark):
    at = lambda s: dt.datetime.fromtimestamp(1e9 + s, dt.timezone.utc)
    rows = [(i, "hot", at(0 if i < 700 else 30 if i < 900 else 60), True) for i in range(1000)]
    got = live.rate_limit(spark.createDataFrame(rows, SCHEMA).repartition(5), 60, 60, block=50).collect()
    assert {r.event_id for r in got if r.allowed} == {*range(60), *range(900, 960)} and len(got) == 1000


def test_rate_limit_folds_a_tool_in_a_tree(spark):
    rng = random.Random(3)
    t, rows = -2e5, []
    for i in range(4000):
        # quiet stretches of many blocks, and dense ones without a pause of a window
        t += rng.choice([0, 1, 4, 9]) if i % 500 else 2e4
        rows.append((i, "hot" if i % 9 else "rare", dt.datetime.fromtimestamp(t, dt.timezone.utc), True))
    frame = spark.createDataFrame(rows, SCHEMA)
    # up to 4000 / 40 blocks, for trees of up to seven levels; blocks shorter than a window
    for fan, block in ((2, 40), (4, 7), (live.FAN, 40)):
        assert {r.event_id: r.allowed for r in live.rate_limit(frame, 20, 2, fan, block).collect()} == loop(rows, 20, 2)
    assert live.rate_limit(frame.limit(0), 20, 2).count() == 0


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = calls()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/in")
    seen = []
    live.upsert_stream(live.read_files(spark, f"{tmp_path}/in", SCHEMA, 1), lambda df, n: seen.append(df.count()), f"{tmp_path}/log").awaitTermination()
    assert sum(seen) == len(rows) and len(seen) == 3
    windows = live.call_windows(live.read_files(spark, f"{tmp_path}/in", SCHEMA), "10 minutes", "1 hour")
    run = windows.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    batch = Q.call_metrics(spark.createDataFrame(rows, SCHEMA).withColumn("duration_ms", F.lit(1.0)), "10 minutes")
    key = lambda df: sorted((str(r.start), r.tool, r.n) for r in df.collect())
    assert key(spark.table("w")) == key(batch)


def test_clamped_scores(spark):
    rng = random.Random(4)
    rows = [("t", dt.date(2024, 1, 1 + i // 50), i, rng.choice([-30.0, 5.0, 25.0])) for i in range(200)]
    x = 50.0
    for *_, d in rows:
        x = min(100.0, max(0.0, x + d))
    (r,) = Q.clamped_scores(spark.createDataFrame(rows, "tool string, day date, n int, delta double")).collect()
    assert (r.score, r.quarantined) == (x, x < 30)


def test_index_stream_replaces_sources(spark, tmp_path):
    schema = "path string, content string"
    for rows in ([("a", "one"), ("b", "two")], [("a", "x" * 2000), ("c", "three")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live.index_stream(live.read_files(spark, f"{tmp_path}/in", schema, 1), f"{tmp_path}/t", f"{tmp_path}/log").awaitTermination()
    got = sorted((r.source, r.chunk_index, len(r.text)) for r in live.read_index(spark, f"{tmp_path}/t").collect())
    assert got in ([("a", 0, 1500), ("a", 1, 700), ("b", 0, 3), ("c", 0, 5)], [("a", 0, 3), ("b", 0, 3), ("c", 0, 5)])
    assert live.changed_paths(spark.createDataFrame([("a", "1")], "path string, hash string"), spark.createDataFrame([("b", "1")], "path string, hash string")).count() == 2


def test_index_forgets_emptied_files_and_repeated_batches(spark, tmp_path):
    schema, table = "path string, content string", f"{tmp_path}/t"
    rows = lambda: sorted((r.source, r.text) for r in live.read_index(spark, table).collect())

    def send(files, number, buckets=1 << 10):
        own = spark.createDataFrame(files, schema)
        fresh = live.chunk(own).withColumn("id", F.md5(F.concat("source", F.lit(":"), "text")))
        live.refresh_buckets(table, fresh, own.select(F.col("path").alias("source")), number, buckets)

    assert rows() == []
    send([("a.py", "one"), ("b.py", "two")], 0)
    send([("a.py", "")], 1)
    assert rows() == [("b.py", "two")]
    send([("b.py", " ")], 2)
    assert rows() == []
    send([("a.py", "three"), ("c.py", "four")], 3)
    send([("a.py", "three"), ("c.py", "four")], 3, buckets=2)  # the table keeps its buckets
    assert rows() == [("a.py", "three"), ("c.py", "four")]


def test_index_expires_versions_but_for_leased_ones(spark, tmp_path):
    schema, table = "path string, content string", f"{tmp_path}/t"
    read = lambda **at: sorted((r.source, r.text) for r in live.read_index(spark, table, **at).collect())
    files = lambda: sum(p.suffix == ".parquet" for p in (tmp_path / "t").rglob("*"))

    def send(number):
        own = spark.createDataFrame([(f"f{number % 5}", f"v{number}"), ("hot", f"h{number}")], schema)
        fresh = live.chunk(own).withColumn("id", F.md5("source"))
        live.refresh_buckets(table, fresh, own.select(F.col("path").alias("source")), number, 4)
        live.expire(table)

    with live.leased(table) as none:
        assert none is None
    counts = []
    for n in range(6):
        send(n)
    before = read()
    with live.leased(table) as version, live.leased(table, -1) as lapsed:
        assert (version, lapsed) == (5, 5)
        for n in range(6, 12):
            send(n)
            counts.append(files())
        assert read(version=version) == before != read()
    send(12)
    with pytest.raises(ValueError):
        read(version=5)
    want = {f"f{n % 5}": f"v{n}" for n in range(13)} | {"hot": "h12"}
    assert read() == sorted(want.items())
    send(12)  # a batch that is repeated builds on the version before it
    assert read() == sorted(want.items())
    assert files() <= live.KEEP * (4 + 1) and max(counts) <= (live.KEEP + 1) * (4 + 1)


def test_rate_limit_stream_drops_the_state_of_quiet_tools(spark, tmp_path):
    at = lambda s: dt.datetime.fromtimestamp(1e9 + s, dt.timezone.utc)
    batches = [[(n, f"t{n}", at(n), True) for n in range(50)], [(100, "new", at(9e5), True), (101, None, at(9e5), True), (102, None, None, True)], [(103, "new", at(9e5 + 1), True)]]
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = live.rate_limit_stream(live.read_files(spark, f"{tmp_path}/in", SCHEMA, 1), 60, 1, "1 hour")
    run = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.event_id: r.allowed for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {**dict.fromkeys(range(50), True), 100: True, 101: True, 102: True, 103: False}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert held[0] >= 50 and held[-1] < 10


def test_runs_of_commits_are_merged(spark, tmp_path):
    from cairn.streaming import changelog

    path, day = str(tmp_path), dt.datetime(2024, 1, 31, 12)
    read = lambda **at: {r.sha: r.subject for r in changelog.read_commits(spark, path, **at).collect()}
    files = lambda: sum(p.suffix == ".parquet" for p in (tmp_path / "commits").rglob("*"))
    schema = f"sha string, {changelog.BASE}, {changelog.KEPT}, day date, month string"
    want, counts = {}, []

    def send(n):
        own = {f"s{n % 7}": f"v{n}", f"new{n}": "one", "hot": f"h{n}"}
        rows = [(k, "a", day, v, "", None, None, None, None, None, day.date(), "2024-01") for k, v in own.items()]
        changelog.write_run(spark.createDataFrame(rows, schema), path, n, fan=3)
        return own

    for n in range(20):
        want |= send(n)
        counts.append(files())
        if n in (8, 17):
            assert read() == want
            assert read(before=n) == {k: v for k, v in want.items() if k != f"new{n}"} | {"hot": f"h{n - 1}", f"s{n % 7}": f"v{n - 7}"}
            send(n)  # a batch that is repeated, after its runs were merged
            assert read() == want
    assert read() == want
    # two runs of nine, none of three, two of one, and what the last batch may still need
    assert counts[-1] <= 5 and max(counts) < 16


def test_structure_reads_every_document_in_its_language(spark):
    from cairn.operators import extraction as X
    from cairn.plans import adapters as A
    from cairn.plans import service_queries as S

    sf = "/root/testdata/sf0.001"
    docs = A.files(spark, sf)
    files = S.structured(docs)
    assert files.count() == docs.count()
    text = {r.n: r.content for r in docs.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).alias("n"), "content").collect()}
    for r in files.withColumn("n", F.regexp_extract("path", r"(\d+)\.\w+$", 1)).collect():
        own = {line.strip() for line in r.content.split("\n")}
        assert all(line.strip() in own for line in (text[r.n] or "").split("\n"))
    nodes, edges = X.extract(files)
    seen = {(r.ext, r.type) for r in nodes.select(T.extension(F.col("file_path")).alias("ext"), "type").distinct().collect()}
    assert seen >= {(e, t) for e in (".py", ".java", ".js", ".ts", ".go") for t in ("Class", "Method")} | {(".java", "Field")}
    assert {r.relation for r in edges.select("relation").distinct().collect()} == {"calls", "contains", "imports", "extends", "implements"}


def test_search_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = rng.integers(-2, 3, (300, 4)).astype(float)  # many ties
    v[5] = 0
    u = np.divide(v, np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=np.linalg.norm(v, axis=1, keepdims=True) > 0)
    index = spark.createDataFrame([(f"k{i:03}", x.tolist(), None if i % 10 == 0 else "ab"[i % 2]) for i, x in enumerate(v)], "id string, embedding array<double>, side string").repartition(3)
    queries = index.select(F.col("id").alias("query_id"), "embedding").unionByName(spark.createDataFrame([("none", None)], "query_id string, embedding array<double>"))
    score = np.round(u @ u.T, 6)
    side = lambda j: None if j % 10 == 0 else "ab"[j % 2]
    for by in (None, "side"):
        want = set()
        for i in range(300):
            for own in ([None, "a", "b"] if by else ["all"]):
                near = sorted((j for j in range(300) if not by or side(j) == own), key=lambda j: (-score[i, j], j))[:7]
                want |= {(f"k{i:03}", f"k{j:03}", r, *([own] if by else [])) for r, j in enumerate(near, 1)}
        got = R.cosine_top_k(queries, index, 7, by).drop("score").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    large = np.sort(R._best(u, u, 7))
    monkeypatch.setattr(R, "SCORED", 16)
    assert (np.sort(R._best(u, u, 7)) == large).all()


def test_changelog_keeps_what_the_model_said(spark, tmp_path):
    from cairn.sources import readers
    from cairn.streaming import changelog

    def send(*rows):
        made = [("\x1f".join([c * 40, "Ann", day, subject, ""]), [f"src/m/{c}.py | 3 ++-"]) for c, day, subject in rows]
        spark.createDataFrame(made, "value string, stat array<string>").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = live.read_files(spark, f"{tmp_path}/in", "value string, stat array<string>")
        changelog.changelog_stream(stream, f"{tmp_path}/out", f"{tmp_path}/log", model).awaitTermination()

    def model(texts):
        return [f'{{"intent": "fix", "summary": "said of {t.splitlines()[0]}", "modules_affected": ["src/m"]}}' for t in texts]

    send(("a", "2024-01-05 10:00:00", "first"), ("b", "2024-01-06 10:00:00", "other day"))
    send(("a", "2024-01-05 10:00:00", "renamed"), ("c", "2024-01-05 11:00:00", "later"))
    got = {r.sha[0]: (r.subject, r.summary, r.intent, r.risk_score) for r in changelog.read_commits(spark, f"{tmp_path}/out").collect()}
    assert got == {"a": ("renamed", "said of first", "fix", 0.0), "b": ("other day", "said of other day", "fix", 0.0), "c": ("later", "said of later", "fix", 0.0)}
    bodies = {r.path[-13:]: r.body for r in readers.read_digests(spark, f"{tmp_path}/out/digests").collect()}
    assert set(bodies) == {"2024/01/05.md", "2024/01/06.md"} and "**2 commits**\nby 1 author." in bodies["2024/01/05.md"] and "_said of later_" in bodies["2024/01/05.md"]


def test_pruned_search_equals_a_full_scan(spark):
    import numpy as np

    from cairn.operators import vector_index as V

    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(40, size=6000)] + rng.normal(size=(6000, 24)) * 0.15
    x[5000:5900] = x[5000]  # a crowded place, with ties
    x[17] = 0
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(9000, None)]
    index = spark.createDataFrame(rows, "id long, embedding array<double>").withColumn("kind", F.col("id") % 3).repartition(6)
    queries = index.where("id % 50 = 0 or id = 17").select(F.col("id").alias("query_id"), "embedding")
    queries = queries.unionByName(spark.createDataFrame([(-1, rng.normal(size=24).tolist())], "query_id long, embedding array<double>"))
    built = V.build(index)
    for own, plain in ((built, index), (built.where("kind = 1"), index.where("kind = 1")), (V.open_index(spark, built.path), index)):
        hits, cost = V.search(queries, own, 7)
        assert sorted(map(tuple, hits.collect())) == sorted(map(tuple, R.cosine_top_k(queries, plain, 7).collect()))
        scored, pairs = cost.first()
        assert 0 < scored <= pairs
    assert V.search(queries, built, 7)[1].select(F.col("scored") / F.col("pairs")).first()[0] < 0.35
    assert V.search(queries, V.build(index.limit(0)), 7)[0].count() == 0


def test_stale_groups_shuffle_neither_hashes_nor_paths(spark, monkeypatch):
    from cairn.plans import adapters as A
    from cairn.plans import graph_queries

    for name in ("changes", "commits"):
        monkeypatch.setattr(A, name, None)
    got = {(r.module, r.stale) for r in graph_queries.c10_stale_groups(spark, "/root/testdata/sf0.001").collect()}
    monkeypatch.undo()
    rows = A.changes(spark, "/root/testdata/sf0.001").join(A.commits(spark, "/root/testdata/sf0.001"), "sha").select(F.split("path", "/")[1].alias("module"), "date", "intent").collect()
    newest = {m: max(r.date for r in rows if r.module == m) for m in {r.module for r in rows}}
    docs = {m: max((r.date for r in rows if r.module == m and r.intent == "docs"), default=None) for m in newest}
    assert got == {(m, docs[m] is None or docs[m] < newest[m]) for m in newest}


def test_changelog_log_is_cut_by_number_of_commits(spark, tmp_path, monkeypatch):
    """No task gathers a third of all commits; there still are two batches."""
    from cairn.plans import service_queries as S

    monkeypatch.setattr(S, "LOG_ROWS", 128)
    monkeypatch.setattr(S, "scratch", lambda spark, name: f"{tmp_path}/{name}")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    days = S.n1_changelog(spark, "/root/testdata/sf0.001").count()
    assert days == orders.select(F.to_date("o_orderdate")).distinct().count()
    assert len(list((tmp_path / "changelog" / "log").glob("part-*"))) == -(-orders.count() // 128) > 3
    assert sorted(f.name for f in (tmp_path / "changelog" / "checkpoint" / "commits").iterdir() if not f.name.startswith(".")) == ["0", "1"]


def test_structure_makes_its_texts_after_they_are_dealt(spark, monkeypatch):
    from cairn.operators import extraction as X
    from cairn.plans import service_queries as S

    plans, write = [], X.materialise
    monkeypatch.setattr(X, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    files = spark.createDataFrame([("a.py", "one two"), ("b.py", None), ("c.md", ""), ("d.java", "x\n\ny z")], "path string, content string")
    nodes, _ = X.extract(S.structured(files.repartition(3)))
    assert {r.file_path for r in nodes.collect()} == {"a.py", "d.java"}
    above, _, below = plans[0].partition("Repartition")
    assert "regexp_replace(content" in above and "content" in below and "regexp_replace(content" not in below
