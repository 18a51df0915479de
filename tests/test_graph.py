import itertools
import random
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from cairn.operators import components as CC
from cairn.operators import graph as G
from cairn.operators import upsert as U
from cairn.plans import registry

EDGE = "source_id string, target_id string, relation string, weight double"
NODE = "id string, type string, name string, file_path string, line_start int, line_end int"


def edges(spark, pairs, relation="calls"):
    return spark.createDataFrame([(a, b, relation, 1.0) for a, b in pairs], EDGE)


def nodes(spark, ids, file="f.py"):
    return spark.createDataFrame([(i, "Class", i, file, 1, 2) for i in ids], NODE)


def test_chain_impact(spark):
    (r,) = G.impact(edges(spark, [("A", "B"), ("B", "C")]), "B").collect()
    assert (r.callers, r.callees, r.reachable, r.dependents, r.degree, r.is_hub) == (1, 1, 1, 1, 2, False)


def test_star_is_the_only_hub(spark):
    e = edges(spark, [("hub", f"x{i}") for i in range(25)])
    (r,) = G.hubs(e, nodes(spark, ["hub", *[f"x{i}" for i in range(25)]]), 20).collect()
    assert (r.id, r.degree) == ("hub", 25)


def test_delete_file_cascades(spark):
    n = nodes(spark, ["N1", "N2"], "foo.java").unionByName(nodes(spark, ["N3"], "bar.java"))
    left, e = U.delete_file(n, edges(spark, [("N1", "N2"), ("N2", "N3")]), spark.createDataFrame([("foo.java",)], "file_path string"))
    assert (left.count(), e.count()) == (1, 0)


def test_co_change_weight(spark):
    touched = [(f"c{i}", f) for i in range(3) for f in ("a.py", "b.py")] + [("c9", "a.py"), ("c9", "z.py"), ("c1", "a.py")]
    got = G.co_change(spark.createDataFrame(touched, "sha string, path string")).collect()
    assert [tuple(r) for r in got] == [("a.py", "b.py", 3)]


def test_co_change_of_blocks_equals_all_pairs(spark):
    rng = random.Random(5)
    touched = [(f"c{c}", f"f{rng.randrange(40):02}") for c in range(12) for _ in range(30)] + [(None, "f00"), ("c1", None)]
    frame = spark.createDataFrame(touched, "sha string, path string")
    commits = {c: sorted({p for s, p in touched if s == c and p}) for c in {s for s, _ in touched if s}}
    pairs = Counter(pair for files in commits.values() for pair in itertools.combinations(files, 2))
    for least, block in ((1, 4), (3, 1), (2, 1024)):
        got = {(r.file_a, r.file_b): r.weight for r in G.co_change(frame, least, block=block).collect()}
        assert got == {p: n for p, n in pairs.items() if n >= least}
    assert G.co_change(frame.limit(0)).count() == 0


def test_co_change_of_a_mass_commit(spark):
    mass = spark.range(20000).select(F.lit("mass").alias("sha"), F.format_string("f%05d", "id").alias("path"))
    some = spark.range(0, 20000, 100).select(F.lit("some").alias("sha"), F.format_string("f%05d", "id").alias("path"))
    r = G.co_change(mass.unionByName(some)).agg(F.count("*").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high")).first()
    assert tuple(r) == (200 * 199 // 2, 2, 2)


def test_co_change_of_repeated_rows(spark):
    """A mass commit of repeated rows is paired without files of its own; commits of more files than `most_files` are left out."""
    mass = spark.range(40000).select(F.lit("mass").alias("sha"), F.format_string("f%05d", F.col("id") % 20000).alias("path"))
    some = spark.range(400).select(F.lit("some").alias("sha"), F.format_string("f%05d", F.col("id") % 200 * 100).alias("path"))
    both = mass.unionByName(some)
    r = G.co_change(both).agg(F.count("*").alias("n"), F.min("weight").alias("low"), F.max("weight").alias("high")).first()
    assert tuple(r) == (200 * 199 // 2, 2, 2)
    assert G.co_change(both, 1, most_files=300).agg(F.count("*"), F.max("weight")).first()[:] == (200 * 199 // 2, 1)


def test_co_change_counts_frequent_pairs_where_they_are(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIRS", 10)
    often = spark.createDataFrame([(c, p) for c in range(30) for p in ([1, 2] if c < 25 else [1, 3])], "sha long, path long")
    assert sorted(tuple(r) for r in G.co_change(often).collect()) == [(1, 2, 25), (1, 3, 5)]


def shuffled(spark):
    """Bytes so far, in local mode."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    return context.statusStore().executorSummary("driver").totalShuffleWrite()


def test_co_change_query_shuffles_numbers(spark, tmp_path):
    """Paths of 2,000 characters, 24 MB over all lines: only those of the 300 files are shuffled, not those of the lines."""
    parts = spark.range(300).select(F.col("id").alias("p_partkey"), F.lit("Brand#1").alias("p_brand"), (F.col("id") % 9).cast("int").alias("p_size"),
        F.concat(*[F.md5(F.concat_ws("/", "id", F.lit(k))) for k in range(63)]).alias("p_type"))
    lines = spark.range(12000).select((F.col("id") / 4).cast("long").alias("l_orderkey"), (F.col("id") * 119 % 300).alias("l_partkey"), F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), F.lit(0.1).alias("l_discount"))
    parts.write.parquet(f"{tmp_path}/part.parquet")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    before = shuffled(spark)
    got = registry.queries()["d3_co_change"](spark, str(tmp_path)).collect()
    assert 0 < (n := shuffled(spark) - before) < 8 << 20, n
    assert sum(r.weight for r in got) == 3000 * 6 and all(r.file_a < r.file_b for r in got)


def test_co_change_queries_on_odd_tables(spark, tmp_path):
    """Keys that are null, have no part or two, parts without brand, repeated lines: as their SQL says."""
    part = [(1, "Brand#1", "A", 1), (1, "Brand#2", "A", 9), (1, "Brand#2", "A", 9), (2, "Brand#3", "B", 5), (3, None, "C", 5), (None, "Brand#4", "D", 5), (4, "Brand#1", "A", 7), (10, "Brand#1", "A", 7)]
    bought = [*[(o, p) for o in (1, 2, 3) for p in (1, 2, 3, 4, 9, 10, None)], (1, 2), (4, 2), (4, 4), (None, 1), (None, 2), (5, 1)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = spark.createDataFrame(bought, "l_orderkey long, l_partkey long").select("*", F.lit(1).alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), F.lit(0.1).alias("l_discount"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for name in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("d3_co_change", "h9_topology"):
        con.execute(registry.oracle_sql()[name])
        want = Counter(con.fetchall())
        frame = registry.queries()[name](spark, str(tmp_path))
        assert Counter(tuple(r) for r in frame.select(*[d[0] for d in con.description]).collect()) == want and want


def test_paths_and_hops_equal_a_plain_search(spark):
    rng = random.Random(9)
    pairs = sorted({(f"v{rng.randrange(60):02}", f"v{rng.randrange(60):02}") for _ in range(110)})
    e, nodes_of = edges(spark, [*pairs, ("v00", None)]), sorted({v for p in pairs for v in p})

    def walk(start, step):
        seen, level = {start: 0}, [start]
        while level:
            level = sorted({w for v in level for w in step(v) if w not in seen})
            seen |= {w: seen[v] + 1 for v in list(seen) for w in step(v) if w in level and w not in seen}
        return seen

    out = lambda v: [b for a, b in pairs if a == v]
    both = lambda v: out(v) + [a for a, b in pairs if b == v]
    seeds = spark.createDataFrame([("v00",), ("v01",)], "seed string")
    for directed, step in ((True, out), (False, both)):
        got = {(r.seed, r.id): r.hop for r in G.hops(seeds, e, directed=directed).collect()}
        assert got == {(s, v): n for s in ("v00", "v01") for v, n in walk(s, step).items()}
    far = walk(nodes_of[0], out)
    for target in (max(far, key=far.get), sorted(far)[-1]):
        back = walk(target, lambda v: [a for a, b in pairs if b == v])
        want = [nodes_of[0]]
        while want[-1] != target:
            want.append(min(w for w in out(want[-1]) if back.get(w) == back[want[-1]] - 1))
        assert G.shortest_path(e, nodes_of[0], target).first().path == want


def test_plan_of_hops_does_not_grow(spark):
    e = edges(spark, [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)])
    seeds = spark.createDataFrame([("n000",)], "seed string")
    for directed in (True, False):
        found = G.hops(seeds, e, directed=directed)
        assert found._jdf.queryExecution().executedPlan().toString().count("Scan parquet") == 1
        assert {r.id: r.hop for r in found.collect()} == {f"n{i:03}": i for i in range(41)}


def test_shortest_path_and_hops(spark):
    e = edges(spark, [("a", "b"), ("b", "d"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "a"), ("e", "a")])
    assert G.shortest_path(e, "a", "e").first().path == ["a", "b", "d", "e"]
    assert G.shortest_path(e, "a", "x").count() == 0
    assert G.shortest_path(e, "a", "a").first().path == ["a"]
    chain = edges(spark, [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)])
    assert G.shortest_path(chain, "n000", "n060").first().path == [f"n{i:03}" for i in range(61)]
    seeds = spark.createDataFrame([("a",), ("none",)], "seed string")
    got = {(r.seed, r.id): r.hop for r in G.hops(seeds, e, 1).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("a", "x"): 1, ("a", "e"): 1, ("none", "none"): 0}


def test_components_query_takes_every_edge(spark, tmp_path):
    bought = [(o, p) for o, parts in enumerate([(1, 2), (1, 2), (2, 3), (2, 3), (2, 3), (7, 8)]) for p in parts]
    spark.createDataFrame(bought, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.id: r.component for r in registry.queries()["h5_components"](spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(["n1", "n2", "n3"], "n1")


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 3), (50, 49), (50, 48)]
    got = {r.id: r.component for r in CC.connected_components(spark.createDataFrame(pairs, "u int, v int")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 200: 200, 48: 48, 49: 48, 50: 48}
    assert CC.connected_components(spark.createDataFrame([], "u int, v int")).count() == 0


def test_resolution_prefers_the_file(spark):
    d = spark.createDataFrame([("3", "run", "a.py", "p"), ("2", "run", "b.py", "p"), ("9", "stop", "c.py", "q")], "id string, name string, file_path string, package string")
    c = spark.createDataFrame([(1, "run", "a.py", "p"), (2, "run", "z.py", "p"), (3, "gone", "a.py", "p")], "call_id int, name string, file_path string, package string")
    got = {r.call_id: (r.target_id, r.confidence, r.unresolved) for r in G.resolve_calls(c, d).collect()}
    assert got == {1: ("3", 1.0, False), 2: ("2", 0.5, False), 3: (None, 0.0, True)}


def test_dampening_and_ordinals(spark):
    e = edges(spark, [("h", str(i)) for i in range(3)] + [("a", "b")])
    got = {(r.source_id, r.target_id): round(r.weight, 3) for r in G.dampen_hubs(e, 10, 0.2, 0.3).collect()}
    assert got[("h", "0")] == 0.3 and got[("a", "b")] == 1.0
    rows = spark.createDataFrame([("Class", "f", 1, 5), ("Class", "f", 1, 2), ("Class", "f", 2, 1)], "type string, file_path string, line int, col int")
    assert {(r.line, r.col): r.id for r in G.add_ordinals(rows).collect()} == {(1, 2): "Class:f:1", (1, 5): "Class:f:1#1", (2, 1): "Class:f:2"}


def test_containment_tree(spark):
    files = spark.createDataFrame([("src/auth/login.py",), ("main.py",)], "path string")
    got = {tuple(r) for r in G.containment(files).collect()}
    assert got == {(".", "src", "Module"), ("src", "src/auth", "Module"), ("src/auth", "src/auth/login.py", "File"), (".", "main.py", "File")}


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, hash string")
    new = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "path string, hash string")
    assert {r.path: r.status for r in U.diff(old, new).collect()} == {"a": "deleted", "b": "modified", "c": "unchanged", "d": "added"}
    assert {tuple(r) for r in U.upsert(old, new, ["path"]).collect()} == {("a", "1"), ("b", "2"), ("c", None), ("d", "1")}
    assert {tuple(r) for r in U.upsert(U.upsert(old, new, ["path"]), new, ["path"]).collect()} == {("a", "1"), ("b", "2"), ("c", None), ("d", "1")}
    chunks = spark.createDataFrame([("1", "x"), ("2", "y")], "id string, source string")
    fresh = spark.createDataFrame([("3", "x"), ("2", "x"), ("3", "x")], "id string, source string")
    got = U.replace_sources(chunks, fresh, spark.createDataFrame([("x",)], "source string"))
    assert {tuple(r) for r in got.collect()} == {("2", "y"), ("3", "x")}


def test_equi_joins_stay_equi_joins(spark):
    n = nodes(spark, ["a", "b"])
    from cairn.operators.hierarchy import descendants

    leaves = spark.createDataFrame([("b", ["x", "y"])], "block string, segs array<string>")
    for frame in (G.nesting(n), descendants(leaves), G.neighbours(edges(spark, [("a", "b")]), n)):
        assert "CartesianProduct" not in frame._jdf.queryExecution().executedPlan().toString()


def test_library_does_not_pull_tables_to_the_driver():
    import pathlib

    root = pathlib.Path(G.__file__).parents[1]
    for part in ("operators", "sources", "functions", "streaming", "plans"):
        for f in (root / part).glob("*.py"):
            for line in f.read_text().splitlines():
                # what comes to the driver says what bounds it
                assert "toPandas" not in line and (".collect()" not in line or "# bounded" in line), (f, line)


def test_provenance(spark):
    rows = spark.createDataFrame([("a", "b", "uses", 0.2, ["x"], 1), ("a", "b", "calls", 0.9, ["y", "x"], 2), ("a", "c", "uses", 0.1, [], 3)], "source string, target string, relation string, weight double, source_docs array<string>, seq int")
    got = {r.target: (r.weight, r.relation, r.source_docs) for r in U.merge_provenance(rows).collect()}
    assert got == {"b": (0.9, "uses", ["x", "y"]), "c": (0.1, "uses", [])}
    assert U.retract(rows.where("target = 'b'"), F.lit("x")).count() == 1


def test_edges_are_dealt_by_number_of_lines(spark, tmp_path, monkeypatch):
    """Tasks hold a bounded number of lines, however few partitions adaptive execution would make of them."""
    from cairn.plans import adapters as A

    chance = random.Random(5)
    rows = [(chance.choice([None, *range(60)]), chance.choice([None, *range(12)])) for _ in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(A, "LINES", 32)
    found = A.edges(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 13
    bought = {r for r in rows if None not in r}
    want = Counter((a, b) for (o, a), (p, b) in itertools.product(bought, bought) if o == p and a < b)
    got = {(r.source_id, r.target_id): (r.relation, r.weight) for r in found.collect()}
    assert got == {(f"n{a}", f"n{b}"): ("calls" if (a + b) % 4 else "imports", n) for (a, b), n in want.items() if n >= 2}


def test_nodes_are_dealt_to_edges_by_key(spark, tmp_path):
    """Nodes in small files may be millions, so no task gets all of them."""
    from cairn.operators import retrieval as R

    edges(spark, [("a", "b"), ("b", "c"), ("c", "x"), ("x", "a"), (None, "a")]).write.parquet(f"{tmp_path}/edges")
    nodes(spark, "abc").unionByName(nodes(spark, "x", "g.py")).write.parquet(f"{tmp_path}/nodes")
    e, n = spark.read.parquet(f"{tmp_path}/edges"), spark.read.parquet(f"{tmp_path}/nodes")
    near = n.select(F.col("line_start").alias("query_id"), "id", F.lit(0).alias("hop"))
    found = {
        "callers": G.callers(e, n).select("target_id", "id"), "callees": G.callees(e, n).select("source_id", "id"), "neighbours": G.neighbours(e, n).select("node", "id"),
        "kept": G.drop_dangling(e, n.where("id <> 'c'")).select("source_id", "target_id"), "lost": G.dangling(e.where("source_id is not null"), n.where("id <> 'c'")).select("id"),
        "hubs": G.hubs(e, n, 2).select("id", "degree"), "modules": G.module_dependencies(e, n), "state": U.file_state(n, e),
        "deleted": U.delete_file(n, e, spark.createDataFrame([("g.py",)], "file_path string"))[1].select("source_id", "target_id"),
        "lines": R.subgraph_lines(e, near).select("text"),
    }
    want = {
        "callers": {("b", "a"), ("c", "b"), ("x", "c"), ("a", "x")}, "callees": {("a", "b"), ("b", "c"), ("c", "x"), ("x", "a"), (None, "a")},
        "neighbours": {("a", "b"), ("b", "c"), ("c", "x"), ("x", "a"), (None, "a"), ("b", "a"), ("c", "b"), ("x", "c"), ("a", "x")},
        "kept": {("a", "b"), ("x", "a")}, "lost": {("c",)}, "hubs": {("a", 3)}, "modules": {("f.py", "g.py", 1), ("g.py", "f.py", 1)}, "state": {("f.py", 3, 3), ("g.py", 1, 1)},
        "deleted": {("a", "b"), ("b", "c"), (None, "a")}, "lines": {("\n".join(f"{a} --calls--> {b}" for a, b in ("ab", "bc", "cx", "xa")),)},
    }
    for name, rows in found.items():
        assert {tuple(r) for r in rows.collect()} == want[name], name
        # delete_file finds the nodes of lost files by a table of two; file_state joins counts a file
        small = {"deleted": 1, "state": 1}.get(name, 0)
        assert rows._jdf.queryExecution().toString().split("== Physical Plan ==")[1].split("== Initial Plan ==")[0].count("BroadcastHashJoin") <= small, name
