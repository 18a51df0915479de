"""Property-graph operators over nodes (id, ...) and edges (source_id, target_id, relation, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import by_key, materialise, scratch


def callers(edges: DataFrame, nodes: DataFrame, relation: str = "calls") -> DataFrame:
    """(target_id, id, name, type) of the nodes that call each target."""
    return edges.where(F.col("relation") == relation).join(by_key(nodes), F.col("source_id") == F.col("id")).select("target_id", "id", "name", "type")


def callees(edges: DataFrame, nodes: DataFrame, relation: str = "calls") -> DataFrame:
    """(source_id, id, name, type) of the nodes that each source calls."""
    return edges.where(F.col("relation") == relation).join(by_key(nodes), F.col("target_id") == F.col("id")).select("source_id", "id", "name", "type")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, direction, relation, id, name): what each node touches, either way, over all relations."""
    out = edges.select(F.col("source_id").alias("node"), F.lit("out").alias("direction"), "relation", F.col("target_id").alias("id"))
    into = edges.select(F.col("target_id").alias("node"), F.lit("in").alias("direction"), "relation", F.col("source_id").alias("id"))
    return out.unionByName(into).join(by_key(nodes.select("id", "name")), "id").select("node", "direction", "relation", "id", "name")


def drop_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    known = by_key(nodes.select("id"))
    kept = edges.join(known, F.col("source_id") == F.col("id"), "left_semi")
    return kept.join(known, F.col("target_id") == F.col("id"), "left_semi")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ends of edges that aren't nodes, with the kind their id's prefix names."""
    ends = edges.select(F.col("source_id").alias("id")).unionByName(edges.select(F.col("target_id").alias("id"))).distinct()
    kind = F.when(F.col("id").contains(":"), F.substring_index("id", ":", 1)).otherwise("Module")
    return ends.join(by_key(nodes.select("id")), "id", "left_anti").select("id", kind.alias("type"))


def resolve_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """Targets of calls (call_id, file_path, package, name): in the file, anywhere, then in the package.

    `definitions` has (id, name, file_path, package). The first candidate of a name is the one in the file of the smallest
    id, then the smallest id. Adds target_id, confidence and unresolved.
    """
    first_in = definitions.groupBy("name", "file_path", "package").agg(F.min("id").alias("id"))
    in_file = first_in.groupBy("name", "file_path").agg(F.min("id").alias("same_file"))
    anywhere = first_in.groupBy("name").agg(F.min("id").alias("anywhere"))
    in_package = first_in.groupBy("name", "package").agg(F.min("id").alias("same_package"))
    found = calls.join(in_file, ["name", "file_path"], "left").join(anywhere, "name", "left").join(in_package, ["name", "package"], "left")
    target = F.coalesce("same_file", "anywhere", "same_package")
    return found.select(*calls.columns, target.alias("target_id"), F.when(F.col("same_file").isNotNull(), 1.0).when(target.isNotNull(), 0.5).otherwise(0.0).alias("confidence"), target.isNull().alias("unresolved"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, value, n): nodes by type, edges by relation, and totals."""
    count = lambda df, kind, value: df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    every = F.lit("all")
    files = nodes.select("file_path").distinct()
    return (
        count(nodes, "node", F.col("type")).unionByName(count(edges, "edge", F.col("relation"))).unionByName(count(nodes, "nodes", every))
        .unionByName(count(edges, "edges", every)).unionByName(count(files, "files", every))
    )


def degrees(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """(id, degree): rows of edges at each node, or pairs of nodes if `distinct`."""
    pairs = edges.select("source_id", "target_id").distinct() if distinct else edges
    return pairs.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def hubs(edges: DataFrame, nodes: DataFrame, threshold: int, most: int = 100) -> DataFrame:
    """Nodes of more than `threshold` edges, largest first."""
    found = degrees(edges).where(F.col("degree") > threshold).join(by_key(nodes.select("id", "name")), "id")
    return found.orderBy(F.desc("degree"), "id").limit(most)


#: Files of one commit that a block holds; two blocks are paired in one group of a join.
FILES = 1 << 10
#: Rows, and pairs of files, that a task holds when they are dealt.
ROWS, PAIRS = 1 << 18, 1 << 20


def co_change(touched: DataFrame, least: int = 2, most_files: int | None = None, block: int = FILES) -> DataFrame:
    """(file_a, file_b, weight): pairs of files that at least `least` commits (sha, path) share, in their order.

    Commits and files may be numbers (`named` puts names to the files): a pair then takes a fraction of the disk. Files of fewer commits are in
    no such pair and are left out first. Rows are dealt by commit, whose files are paired where they are, and pairs by files, so that each
    row and each pair is shuffled once; what a task holds doesn't grow with the table. Commits of more than `block` rows are dealt into blocks, and
    each pair of blocks is a group of its own, so that a commit of any size is many groups. Pairs grow with the square of a commit's files;
    `most_files` leaves larger commits out.
    """
    rows = touched.select("sha", "path").where("sha is not null and path is not null")
    if most_files:
        rows = rows.distinct()
        rows = rows.join(rows.groupBy("sha").count().where(F.col("count") <= most_files).select("sha"), "sha", "left_semi")
    rows = materialise(rows, "touched", ROWS)
    counts = materialise(rows.groupBy("path").agg(F.count("*").alias("n")), "touched-counts")
    n = F.col("n")
    rare = counts.where(n < least).select("path")
    if not rare.isEmpty():
        rows = materialise(rows.join(by_key(rare), "path", "left_anti"), "touched-often", ROWS)
    sizes = rows.groupBy("sha").agg(F.count("*").alias("n"))
    cores, held = touched.sparkSession.sparkContext.defaultParallelism, rows.count()
    most, twice = sizes.agg(F.coalesce(F.max("n"), F.lit(0)), F.coalesce(F.sum(F.when(n <= block, n * (n - 1))), F.lit(0))).first()
    large = None
    if most > block:
        mass = materialise(sizes.where(n > block).select("sha"), "touched-mass")
        # without repeated rows, and then without files that too few other commits have
        own = rows.join(mass, "sha", "left_semi").groupBy("sha", "path").agg(F.count("*").alias("own"))
        large = materialise(own.join(by_key(counts), "path").where(n - F.col("own") >= least - 1).select("sha", "path"), "touched-large")
        rows, left = rows.join(mass, "sha", "left_anti"), large.groupBy("sha").agg(F.count("*").alias("n"))
        twice += left.agg(F.coalesce(F.sum(n * (n - 1)), F.lit(0))).first()[0]
    dealt = rows.repartition(max(cores, -(-held // ROWS)), "sha").distinct()
    a, b = dealt.alias("a"), dealt.alias("b")
    pairs = a.join(b, (F.col("a.sha") == F.col("b.sha")) & (F.col("a.path") < F.col("b.path"))).select(F.col("a.path").alias("file_a"), F.col("b.path").alias("file_b"))
    if large is not None:
        pairs = pairs.unionByName(_pairs_of_blocks(large, left, block))
    # a pair has no more commits than the second most frequent file: if these are many, equal pairs are counted before they are dealt
    if all(r.n <= PAIRS for r in counts.orderBy(F.desc("n")).take(2)[1:]):
        pairs = pairs.repartition(max(cores, -(-twice // (2 * PAIRS))), "file_a", "file_b")
    return pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def _pairs_of_blocks(rows: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(file_a, file_b) of commits of any size, block against block; `sizes` is (sha, n)."""
    parts = sizes.where("n > 1").select("sha", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    dealt = rows.join(parts, "sha").withColumn("own", F.pmod(F.xxhash64("path"), "parts").cast("int"))
    sides = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sides = sides.select("sha", "path", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    by = ["sha", "low", "high"]
    pairs = sides.where("own = low").select(*by, F.col("path").alias("p")).join(sides.where("own = high").select(*by, F.col("path").alias("q")), by)
    return pairs.where("low < high or p < q").select(F.least("p", "q").alias("file_a"), F.greatest("p", "q").alias("file_b"))


def named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """`co_change` of numbered files, with their names (path, name); numbers are in the order of names."""
    a, b = (by_key(names.select(F.col("path").alias(c), F.col("name").alias(f"{c}_name"))) for c in ("file_a", "file_b"))
    found = pairs.join(a, "file_a").join(b, "file_b")
    return found.select(F.col("file_a_name").alias("file_a"), F.col("file_b_name").alias("file_b"), "weight")


def hops(seeds: DataFrame, edges: DataFrame, max_hops: int | None = None, directed: bool = False) -> DataFrame:
    """(seed, id, hop): the fewest edges from each seed (column seed) to what it reaches, itself at 0.

    One join a hop; nodes already reached are taken out, and it ends when nothing is new. Each hop is a folder of one table, so
    that the plan of a round, and of the result, is the same at any depth. Where edges lead both ways, what was reached earlier
    can only be in the last two hops, and no more is read.
    """
    way = edges.select("source_id", "target_id")
    if not directed:
        # by rows of both ways, as a union would make the edges twice
        way = way.select(F.inline(F.array(F.struct("source_id", "target_id"), F.struct(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id")))))
    way = way.where("source_id is not null and target_id is not null")
    # one hop reads the edges once
    way = way if max_hops == 1 else materialise(way.distinct(), "hops-edges")
    start = seeds.select("seed", F.col("seed").alias("id")).where("seed is not null").distinct()
    spark, path, kind = edges.sparkSession, scratch(edges.sparkSession, "hops"), start.withColumn("hop", F.lit(0)).schema
    read = lambda low, high: spark.read.schema(kind).option("basePath", path).parquet(*[f"{path}/hop={k}" for k in range(low, high)])
    start.write.parquet(f"{path}/hop=0")
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = read(hop - 1, hop).join(way, F.col("id") == F.col("source_id")).select("seed", F.col("target_id").alias("id")).distinct()
        fresh = reached.join(read(0 if directed else max(hop - 2, 0), hop).select("seed", "id"), ["seed", "id"], "left_anti")
        fresh.write.parquet(f"{path}/hop={hop}")
        if read(hop, hop + 1).isEmpty():
            break
    return read(0, hop + 1)


def nearest_hop(seeds: DataFrame, edges: DataFrame, max_hops: int) -> DataFrame:
    """(id, hop): the fewest edges from any seed."""
    return hops(seeds, edges, max_hops).groupBy("id").agg(F.min("hop").alias("hop"))


def shortest_path(edges: DataFrame, source: str, target: str) -> DataFrame:
    """One row with the smallest of the shortest directed paths, however long; none if there isn't one.

    Searched from both ends, the smaller frontier first, until the frontiers meet. A node carries its smallest neighbour towards
    the target rather than a path: nodes found from the target get it as they are reached, of those found
    from the source only the ones that lead to where the searches met, once they have. The path then follows these pointers.
    """
    spark, kind = edges.sparkSession, "id string, next string"
    way = materialise(edges.select("source_id", "target_id").where("source_id is not null and target_id is not null").distinct(), "path-edges")
    begin, end, near = (scratch(spark, f"path-{n}") for n in ("begin", "end", "near"))
    read = lambda path, *levels: spark.read.schema(kind).parquet(*[f"{path}/{k}" for k in levels])
    for path, node in ((begin, source), (end, target)):
        spark.createDataFrame([(node, None)], kind).write.parquet(f"{path}/0")
    depth, size = {begin: 0, end: 0}, {begin: 1, end: 1}
    while (met := read(begin, depth[begin]).join(read(end, depth[end]), "id", "left_semi").select("id")).isEmpty():
        side = min(size, key=size.get)
        old, new = ("source_id", "target_id") if side == begin else ("target_id", "source_id")
        grown = read(side, depth[side]).join(way, F.col("id") == F.col(old)).groupBy(F.col(new).alias("found")).agg(F.min(old).alias("next"))
        fresh = grown.withColumnRenamed("found", "id").join(read(side, *range(depth[side] + 1)).select("id"), "id", "left_anti")
        depth[side] += 1
        fresh.write.parquet(f"{side}/{depth[side]}")
        if not (n := read(side, depth[side]).count()):
            return spark.createDataFrame([], "path array<string>")
        size[side] = n
    for k in reversed(range(depth[begin])):
        ahead = way.join(met.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        onward = read(begin, k).select("id").join(ahead, F.col("id") == F.col("source_id")).groupBy("id").agg(F.min("target_id").alias("next"))
        onward.write.parquet(f"{near}/{k}")
        met = read(near, k).select("id")
    path = [source]
    for level in [*(read(near, k) for k in range(depth[begin])), *(read(end, k) for k in range(depth[end], 0, -1))]:
        path.append(level.where(F.col("id") == path[-1]).first().next)
    return spark.createDataFrame([(path,)], "path array<string>")


def impact(edges: DataFrame, node: str, hub_degree: int = 20) -> DataFrame:
    """One row: direct callers and callees, everything reachable either way, degree, and whether a hub."""
    seed = edges.sparkSession.createDataFrame([(node,)], "seed string")
    back = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    down = hops(seed, edges, directed=True).where("hop > 0").agg(F.count("*").alias("reachable"))
    up = hops(seed, back, directed=True).where("hop > 0").agg(F.count("*").alias("dependents"))
    calls = F.col("relation") == "calls"
    own = edges.where((F.col("source_id") == node) | (F.col("target_id") == node))
    direct = own.agg(
        F.count_distinct(F.when(calls & (F.col("target_id") == node), F.col("source_id"))).alias("callers"),
        F.count_distinct(F.when(calls & (F.col("source_id") == node), F.col("target_id"))).alias("callees"),
        F.count_distinct("source_id", "target_id").alias("degree"),
    )
    # three aggregates of one row each
    return direct.join(F.broadcast(down)).join(F.broadcast(up)).withColumn("is_hub", F.col("degree") > hub_degree)


def dampen_hubs(edges: DataFrame, n_nodes: Column | int, threshold: float = 0.2, factor: float = 0.3) -> DataFrame:
    """Edges of sources with an out-degree above int(threshold * nodes) weigh less; adds `dampened`."""
    out = edges.groupBy("source_id").agg(F.count("*").alias("out_degree"))
    limit = F.floor(F.lit(threshold) * n_nodes)
    hub = out.where(F.col("out_degree") > limit).select("source_id", F.lit(True).alias("hub"))
    weight = F.coalesce("weight", F.lit(1.0))
    marked = edges.join(hub, "source_id", "left")
    return marked.select(*[c for c in edges.columns if c != "weight"], F.when(F.col("hub"), weight * factor).otherwise(weight).alias("weight"), F.coalesce("hub", F.lit(False)).alias("dampened"))


def ancestors(path: Column) -> Column:
    """All folders above a path, the root `.` first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, ".").otherwise(F.array_join(F.slice(parts, 1, i), "/")))


def containment(files: DataFrame) -> DataFrame:
    """(parent, child, kind): folders within folders, and files (path) within folders."""
    above = files.select("path", ancestors(F.col("path")).alias("dirs"))
    direct = above.select(F.element_at("dirs", -1).alias("parent"), F.col("path").alias("child"), F.lit("File").alias("kind"))
    pairs = above.select(F.explode(F.transform(F.slice("dirs", F.lit(2), F.size("dirs")), lambda d, i: F.struct(F.get("dirs", i).alias("parent"), d.alias("child")))).alias("p"))
    return direct.distinct().unionByName(pairs.select("p.parent", "p.child", F.lit("Module").alias("kind")).distinct())


#: Lines whose definitions are told apart at once when a file is cut where no definition spans.
LINES = 1 << 12


def nesting(spans: DataFrame) -> DataFrame:
    """(parent, child): the smallest definition of a file (id, file_path, line_start, line_end) around another.

    Of equal spans the smaller id is the outer one; of parents of one length the later, then the smaller id counts. Spans may cross.
    Files are cut at lines that no definition spans, found from one row for every LINES lines. What lies between cuts is
    swept once, sorted by where it begins: an index by end line gives each definition the smallest of those that end no earlier.
    """
    rows = materialise(spans.select("file_path", "line_start", "line_end", "id").where("line_start <= line_end").withColumn("block", F.floor(F.col("line_start") / LINES)), "spans")
    blocks = rows.groupBy("file_path", "block").agg(F.min("line_start").alias("low"), F.max("line_end").alias("high"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.when(F.max("high").over(before) < F.col("low"), 1).otherwise(0)
    parts = blocks.withColumn("cut", cut).select("file_path", "block", F.sum("cut").over(Window.partitionBy("file_path").orderBy("block")).alias("part"))
    keyed = rows.join(materialise(parts, "spans-parts"), ["file_path", "block"])
    order = ["file_path", "part", "line_start", F.desc("line_end"), "id"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def found() -> pa.RecordBatch:
            pairs = _smallest(held)
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], kind), pa.array([c for _, c in pairs], kind)], ["parent", "child"])

        for batch in batches:
            kind = batch.column("id").type
            for path, part, start, end, own in zip(*(batch.column(c).to_pylist() for c in ("file_path", "part", "line_start", "line_end", "id"))):
                if (path, part) != at:
                    if len(held) > 1:
                        yield found()
                    held, at = [], (path, part)
                held.append((start, end, own))
        if len(held) > 1:
            yield found()

    name = spans.schema["id"].dataType.simpleString()
    return keyed.repartition("file_path", "part").sortWithinPartitions(*order).mapInArrow(sweep, f"parent {name}, child {name}")


def _smallest(spans: list[tuple]) -> list[tuple]:
    """(parent, child) of spans (start, end, id) in order: prefix minima over descending ends, as a binary indexed tree."""
    ends = sorted({end for _, end, _ in spans}, reverse=True)
    place, best, pairs = {end: n for n, end in enumerate(ends, 1)}, [None] * (len(ends) + 1), []
    for start, end, own in spans:
        n, least = place[end], None
        while n:
            if best[n] is not None and (least is None or best[n] < least):
                least = best[n]
            n &= n - 1
        if least:
            pairs.append((least[2], own))
        n, mine = place[end], (end - start, -start, own)
        while n < len(best):
            if best[n] is None or mine < best[n]:
                best[n] = mine
            n += n & -n
    return pairs


def neighbourhood_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, text): a line for the node and its file, its callers and its callees by name."""
    who = callers(edges, nodes).groupBy(F.col("target_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("callers"))
    whom = callees(edges, nodes).groupBy(F.col("source_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("callees"))
    line = lambda label, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), c))
    head = F.concat("type", F.lit(" "), "name")
    return nodes.join(who, "id", "left").join(whom, "id", "left").select("id", F.concat_ws("\n", head, F.concat(F.lit("File: "), "file_path"), line("Callers", "callers"), line("Callees", "callees")).alias("text"))


def module_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source_module, target_module, n): edges between files, rolled up."""
    own = by_key(nodes.select("id", "file_path"))
    s, t = own.select(F.col("id").alias("source_id"), F.col("file_path").alias("source_module")), own.select(F.col("id").alias("target_id"), F.col("file_path").alias("target_module"))
    both = edges.join(s, "source_id").join(t, "target_id").where("source_module <> target_module")
    return both.groupBy("source_module", "target_module").agg(F.count("*").alias("n"))


def change_impact(changed: DataFrame, edges: DataFrame, nodes: DataFrame, max_hops: int = 3) -> DataFrame:
    """(module, impact): sum of 1/hop over the nodes that depend on changed ones (column seed)."""
    back = edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))
    near = hops(changed, back, max_hops, directed=True).where("hop > 0").groupBy("id").agg(F.min("hop").alias("hop"))
    return near.join(by_key(nodes.select("id", "file_path")), "id").groupBy(F.col("file_path").alias("module")).agg(F.sum(1 / F.col("hop")).alias("impact"))


def naming_families(names: DataFrame, least: int = 3) -> DataFrame:
    """(family, n) of names that end in the same capitalised or last word."""
    family = F.regexp_extract("name", r"([A-Z][a-z0-9]+|[^ ]+)$", 1)
    return names.groupBy(family.alias("family")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def runtime_weights(edges: DataFrame, observed: DataFrame) -> DataFrame:
    """Edge weight 0.3 structural + 0.7 observed; `observed` has (source_id, target_id, calls)."""
    most = observed.agg(F.max("calls").alias("most"))
    seen = observed.join(F.broadcast(most)).select("source_id", "target_id", (F.col("calls") / F.col("most")).alias("seen"))  # most is one row
    return edges.join(seen, ["source_id", "target_id"], "left").withColumn("blended", 0.3 * F.least("weight", F.lit(1.0)) + 0.7 * F.coalesce("seen", F.lit(0.0)))


def build_topology(files: DataFrame, touched: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type) and edges (source_id, target_id, relation, weight): folders, files, and files that change together.

    `files` is (path), `touched` (sha, path), with numbers for paths if `names` is there (see `named`); pairs with a file that is gone are left out.
    """
    held = containment(files)
    folders = held.select(F.explode(F.array("parent", F.when(F.col("kind") == "Module", F.col("child")))).alias("id")).where("id is not null").distinct().select("id", F.lit("Module").alias("type"))
    own = folders.unionByName(files.select(F.col("path").alias("id"), F.lit("File").alias("type")).distinct())
    contains = held.select(F.col("parent").alias("source_id"), F.col("child").alias("target_id"), F.lit("contains").alias("relation"), F.lit(1.0).alias("weight"))
    pairs = co_change(touched)
    pairs = named(pairs, names) if names is not None else pairs
    together = pairs.select(F.col("file_a").alias("source_id"), F.col("file_b").alias("target_id"), F.lit("co_changes").alias("relation"), F.col("weight").cast("double").alias("weight"))
    return own, contains.unionByName(drop_dangling(together, own))


def add_ordinals(definitions: DataFrame) -> DataFrame:
    """Ids `Type:file:line`, repeated ones with #1, #2, ... in order of (line, col)."""
    base = F.concat("type", F.lit(":"), "file_path", F.lit(":"), F.col("line").cast("string"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("line", "col")) - 1
    return definitions.withColumn("base", base).withColumn("n", n).withColumn("id", F.when(F.col("n") > 0, F.concat("base", F.lit("#"), F.col("n").cast("string"))).otherwise(F.col("base"))).drop("base", "n")
