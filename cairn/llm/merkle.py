"""A Merkle manifest of a table: a hash tree over its rows, each row's proof, and their check.

A row's leaf is the SHA-256 of its fields, each with its length before it. Leaves are put in order within
their group; every `fanout` consecutive digests make a parent, up to the group's root, and the groups' roots make the
manifest's root in the same way. Each level is a slot pivot: conditional aggregates spread a parent's children into
`fanout` columns, whose concatenation is hashed. A child's siblings are the same columns but for its own, so that proofs are
handed down from the root without looking any sibling up. The lowest level's slots hold the rows themselves, and no join has
more than a row a parent.

Null fields are told from empty ones. Rows of one id, and repeated rows, are leaves of their own, in the order of their digests.
Null ids come first. An empty table has no leaves and no root.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.texts import LOWER, UPPER
from cairn.operators.ranking import numbered
from cairn.session import materialise

FANOUT = 8
PATH = "array<struct<before:string,after:string>>"


def field(value: Column) -> Column:
    """A value with the number of its bytes before it; `-` for null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


@dataclass
class Tree:
    """Levels of parents (grp, position, total, digest, slots), lowest first, and the roots (grp, digest, level) of its groups."""

    levels: list[DataFrame]
    roots: DataFrame
    fanout: int


def build(leaves: DataFrame, fanout: int = FANOUT, carry: tuple[str, ...] = ()) -> Tree:
    """The tree over `leaves` (grp, position, total, digest, *carry), a written table; slots of the lowest level hold `carry` too."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    nodes, levels = leaves, []
    roots = leaves.where("total = 1").select("grp", "digest", F.lit(0).alias("level"))
    while most > 1:
        held = F.struct("digest", *(() if levels else carry))
        slots = [F.max(F.when(F.pmod("position", F.lit(fanout)) == k, held)).alias(f"s{k}") for k in range(fanout)]
        spread = (
            nodes.where("total > 1")
            .groupBy("grp", F.floor(F.col("position") / fanout).alias("position"), F.ceil(F.col("total") / fanout).alias("total")).agg(*slots)
        )
        whole = F.sha2(F.concat_ws("", *[f"s{k}.digest" for k in range(fanout)]), 256)
        levels.append(materialise(spread.withColumn("digest", whole), f"merkle-{len(levels) + 1}"))
        nodes, most = levels[-1].select("grp", "position", "total", "digest"), -(-most // fanout)
        roots = roots.unionByName(nodes.where("total = 1").select("grp", "digest", F.lit(len(levels)).alias("level")))
    return Tree(levels, materialise(roots, "merkle-roots"), fanout)


def paths(tree: Tree, leaves: DataFrame, tops: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(grp, digest, *carry, *columns of tops, path) of every leaf; `tops` (grp, level, path, ...) has the path above each root.

    A path is, level by level upwards, what stands before and after the own digest in the parent's columns.
    """
    more = [c for c in tops.columns if c not in ("grp", "level", "path")]
    below = None
    for n in range(len(tree.levels), 0, -1):
        here = tops.where(F.col("level") == n).select("grp", F.lit(0).cast("long").alias("position"), *more, "path")
        here = here.unionByName(below) if below is not None else here
        level = tree.levels[n - 1].drop("digest", "total").join(here, ["grp", "position"])
        slots = [F.col(f"s{k}") for k in range(tree.fanout)]
        own = []
        for k, slot in enumerate(slots):
            before, after = (F.concat_ws("", *[s["digest"] for s in part]) if part else F.lit("") for part in (slots[:k], slots[k + 1 :]))
            own.append(F.when(slot.isNotNull(), F.struct(slot.alias("s"), F.lit(k).alias("k"), before.alias("before"), after.alias("after"))))
        one = level.select("grp", "position", *more, "path", F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("c"))
        below = one.select(
            "grp", (F.col("position") * tree.fanout + F.col("c.k")).alias("position"), *more,
            F.concat(F.array(F.struct("c.before", "c.after")), "path").cast(PATH).alias("path"), *([F.col("c.s.digest").alias("digest"), *[F.col(f"c.s.{x}").alias(x) for x in carry]] if n == 1 else []),
        )
    lone = leaves.where("total = 1").select("grp", "digest", *carry).join(tops.where("level = 0"), "grp")
    lone = lone.select("grp", *more, "path", "digest", *carry)
    return lone.unionByName(below.drop("position")) if below is not None else lone


def manifest(leaves: DataFrame, group: str, id_col: str, fanout: int = FANOUT, carry: tuple[str, ...] = ()) -> DataFrame:
    """(grp, leaf, *carry, subroot, root, path) per row of `leaves` (id_col, group, leaf, *carry), a written table."""
    # null before all others, the empty string too
    named = leaves.select(F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"), F.col(id_col).alias("id"), F.col("leaf").alias("digest"), *carry)
    low = materialise(numbered(named, ["id", "digest"], "grp", "merkle-leaves").drop("id"), "merkle-0")
    tree = build(low, fanout, carry)
    subroots = tree.roots.select(F.col("grp").alias("name"), "digest", F.col("level").alias("height"))
    high = materialise(numbered(subroots, ["name"], None, "merkle-subroots").withColumn("grp", F.lit("")), "merkle-top-0")
    top = build(high, fanout, ("name", "height"))
    above = top.roots.select("grp", "level", F.col("digest").alias("root"), F.array().cast(PATH).alias("path"))
    tops = paths(top, high, above, ("name", "height")).select(F.col("name").alias("grp"), F.col("height").alias("level"), F.col("digest").alias("subroot"), "root", "path")
    return paths(tree, low, materialise(tops, "merkle-tops"), carry).withColumnRenamed("digest", "leaf")


def proof(path: Column) -> Column:
    """All siblings' digests, level by level upwards, left to right, as one string."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to along a path."""
    return F.aggregate(path, leaf, lambda own, p: F.sha2(F.concat(p["before"], own, p["after"]), 256))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """The contract's query: leaves of documents by lang; every third one (by CRC-32 of its id) is checked with A-Z of its text lower-cased."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    given = F.when(changed, digest([*kept, F.translate("text", UPPER, LOWER)])).otherwise(digest([*kept, F.col("text")]))
    leaves = materialise(docs.select("doc_id", "lang", digest([*kept, F.col("text")]).alias("leaf"), given.alias("given")).withColumn("own", F.col("doc_id")), "leaves")
    found = manifest(leaves, "lang", "doc_id", carry=("own", "given"))
    out = found.select(F.col("own").alias("doc_id"), "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), fold(F.col("given"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql(levels: int) -> str:
    """The tree level by level, `levels` of them: enough for 8 to their power rows."""
    upper, lower = f"'{UPPER}'", f"'{LOWER}'"
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, ("doc_id", "source", "lang", "n_chars")), part(text)]) + ")"
    crc = (
        "xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: "
        "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
    )
    steps = [
        f"d AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(f'translate(text, {upper}, {lower})')} ELSE {leaf('text')} END AS given FROM documents)",
        "a0 AS MATERIALIZED (SELECT coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n, leaf AS h FROM d)",
        "p0 AS MATERIALIZED (SELECT coalesce('=' || lang, '') AS g, doc_id, leaf, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS sib, given AS f FROM d)",
    ]

    def climb(a: str, p: str, k: int) -> None:
        steps.append(f"{a}{k} AS MATERIALIZED (SELECT g, i // 8 AS i, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {a}{k - 1} WHERE n > 1 GROUP BY g, i // 8, (n + 7) // 8)")
        agg = lambda op: f"coalesce(string_agg(a.h, '' ORDER BY a.i) FILTER (WHERE a.i {op} p.i), '')"
        steps.append(
            f"{p}{k} AS MATERIALIZED (SELECT p.g, doc_id, leaf, p.i // 8 AS i, sib || {agg('<>')} AS sib, CASE WHEN count(a.h) = 0 THEN f ELSE sha256({agg('<')} || f || {agg('>')}) END AS f "
            f"FROM {p}{k - 1} p LEFT JOIN {a}{k - 1} a ON a.n > 1 AND a.g = p.g AND a.i // 8 = p.i // 8 GROUP BY p.g, doc_id, leaf, p.i, sib, f)"
        )

    for k in range(1, levels + 1):
        climb("a", "p", k)
    steps.append("s AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT g, h FROM a{k} WHERE n = 1" for k in range(levels + 1)) + ")")
    steps.append("t0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n, h, g AS own FROM s)")
    steps.append(f"q0 AS MATERIALIZED (SELECT '' AS g, doc_id, leaf, t0.i, sib, f FROM p{levels} p JOIN t0 ON t0.own = p.g)")
    for k in range(1, levels + 1):
        climb("t", "q", k)
    roots = " UNION ALL ".join(f"SELECT h FROM t{k} WHERE n = 1" for k in range(levels + 1))
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT q.doc_id, q.leaf, s.h AS subroot, r.h AS root, sha256(sib) AS proof_sha256, f AS folded_root, f = r.h AS verified\n"
        f"FROM q{levels} q JOIN (SELECT doc_id, leaf, g FROM p0) p0 ON q.doc_id IS NOT DISTINCT FROM p0.doc_id AND q.leaf = p0.leaf JOIN s ON s.g = p0.g CROSS JOIN ({roots}) r"
    )


OP11_SQL = _sql(5)
