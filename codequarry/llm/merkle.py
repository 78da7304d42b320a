"""A Merkle manifest of a dataset: a tree of digests over each group's rows, and one over the groups' roots.

Positions come from a distributed sort: range partitions are numbered inside,
and the few counts of partitions give the offsets, so that no group has to fit
one task. Levels are windows over (group, parent's index): an ordered
full-frame ``collect_list`` gives the parent's preimage and its nodes, which
are each other's siblings, and one row of each run goes on as the parent.
``STEP`` levels share one shuffle, dealt by blocks of ``FAN**STEP`` nodes; a
block's root keeps its block's digests (at most ``2 * FAN**STEP``). On the way
down each block's nodes meet the path of their block's root, so that no key of
a join has more rows than a block.

A digest is the lowercase hex sha256 of its inputs' concatenation, digests as
hex text; a run of one node is hashed again too, but a group's only row is its
subroot. Null fields are ``-``. Rows that share a doc_id stand in the order of
their leaves (equal leaves: in any order, each row with a right path of its
own). A null doc_id comes first and is never tampered with; a null lang is a
group of its own, the first. Texts may be empty or long. An empty table has no
rows and no root. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codequarry.runtime import materialize

#: Nodes under one parent, and levels done in one shuffle.
FAN, STEP = 2, 6
BLOCK = FAN**STEP
#: A group's key: whether it has a name, and the name.
GROUP = ["named", "name"]
#: A path: at each level, the other nodes of the run, left and right.
_PATH = "array<struct<left:array<binary>,right:array<binary>>>"
_LEVELS = "array<array<binary>>"


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def shown(node: Column) -> Column:
    return F.lower(F.hex(node))


def _joined(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, shown), "")


def _above(idx: Column) -> Column:
    return F.floor(idx / BLOCK)


def field(value: Column) -> Column:
    """A field as it enters a leaf: ``-`` if null, else byte count, colon and value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return digest(F.concat(*map(field, values)))


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``idx``, their place in their group by ``order`` from 0, and ``n``, the group's rows."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(n, *GROUP, *order, "spread")
    placed = dealt.sortWithinPartitions(*GROUP, *order, "spread").withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed.drop("spread").withColumn("part", F.shiftright("at", 33)), "merkle-places")  # dealt once: another run may deal otherwise
    counts = placed.groupBy("part", *GROUP).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    group = Window.partitionBy(*GROUP)
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", *GROUP, (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("n"))
    return placed.join(starts, ["part", *GROUP]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _levels(n: Column) -> Column:
    """Levels above ``n`` nodes until one is left."""
    powers = F.array(*[F.lit(FAN**k) for k in range(STEP)])
    return F.size(F.filter(powers, lambda p: p < n))


def climbed(nodes: DataFrame) -> DataFrame:
    """``STEP`` levels over nodes (group, idx, n, node), fewer for a group of which one node is left before.

    One row for each block, with the same columns, and ``levels``, the block's
    nodes of each level from left to right, of which the path takes ``height``.
    """
    now = nodes.select(*GROUP, _above(F.col("idx")).alias("block"), "idx", "n", "node", F.array().cast(_LEVELS).alias("levels"))
    now = now.repartition(*GROUP, "block")
    for level in range(STEP):
        parent = F.floor(F.col("idx") / FAN)
        run = Window.partitionBy(*GROUP, "block", "parent").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        seen = now.withColumn("parent", parent).withColumn("run", F.collect_list(F.struct("node", "levels")).over(run))
        first = seen.filter(F.col("idx") == F.col("parent") * FAN)
        members = F.transform("run", lambda x: x["node"])
        below = [F.flatten(F.transform("run", lambda x: F.get(x["levels"], F.lit(k)))) for k in range(level)]  # noqa: B023
        now = first.select(*GROUP, "block", F.col("parent").alias("idx"), "n", digest(_joined(members)).alias("node"), F.array(*below, members).alias("levels"))
    now = now.withColumn("height", _levels(F.col("n")))
    height = F.col("height")
    root = F.when(height < STEP, F.get(F.get("levels", height), F.lit(0))).otherwise(F.col("node"))
    return now.select(*GROUP, F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), root.alias("node"), "levels", "height")


def tree(nodes: DataFrame, label: str) -> tuple[DataFrame, list[DataFrame]]:
    """Each group's root (group, node), and the steps up to it, from the lowest on."""
    now, steps = nodes.select(*GROUP, "idx", "n", "node"), []
    most = now.agg(F.max("n")).first()[0] or 0
    while most > 1:
        steps.append(materialize(climbed(now), f"merkle-{label}"))
        now, most = steps[-1].select(*GROUP, "idx", "n", "node"), -(-most // BLOCK)
    return now.select(*GROUP, "node"), steps


def _within(idx: Column, levels: Column, height: Column) -> Column:
    """The part of a node's path that lies in its block."""

    def one(level):
        width = F.element_at(F.array(*[F.lit(FAN**k) for k in range(STEP)]), level + 1)
        at = F.floor((idx % BLOCK) / width).cast("int")
        first = (F.floor(at / FAN) * FAN).cast("int")
        nodes = F.get(levels, level)
        return F.struct(F.slice(nodes, first + 1, at - first).alias("left"), F.slice(nodes, at + 2, first + (FAN - 1) - at).alias("right"))

    return F.when(height > 0, F.transform(F.sequence(F.lit(0), height - 1), one)).otherwise(F.array().cast(_PATH))


def met(nodes: DataFrame, steps: list[DataFrame], ends: DataFrame) -> DataFrame:
    """``nodes`` (group, idx, any others) with ``path`` and the group's columns of ``ends``, which has ``path`` above the roots."""
    if not steps:
        return nodes.join(ends, GROUP)  # every group has one node
    more = [c for c in ends.columns if c not in (*GROUP, "path")]
    known = ends
    for k in range(len(steps), -1, -1):
        here = nodes if k == 0 else steps[k - 1]
        if k == len(steps):  # one block for each group
            known = materialize(here.select(*GROUP, F.col("idx").alias("block"), "levels", "height").join(known, GROUP), "merkle-paths")
            continue
        here = here if k == 0 else here.select(*GROUP, "idx", "levels", "height")
        above = known.select(*GROUP, "block", F.col("levels").alias("up_levels"), F.col("height").alias("up_height"), F.col("path").alias("up_path"), *more)
        here = here.withColumn("block", _above(F.col("idx"))).join(above, [*GROUP, "block"])
        path = F.concat(_within(F.col("idx"), F.col("up_levels"), F.col("up_height")), F.col("up_path"))
        here = here.withColumn("path", path).drop("block", "up_levels", "up_height", "up_path")
        if k == 0:
            return here
        known = materialize(here.withColumnRenamed("idx", "block"), "merkle-paths")
    raise AssertionError


def folded(node: Column, path: Column) -> Column:
    """The root that a node and its path give."""
    return F.aggregate(path, node, lambda at, x: digest(F.concat(_joined(x["left"]), shown(at), _joined(x["right"]))))


def proof(path: Column) -> Column:
    """All nodes of a path as hex text, level by level and left to right."""
    return _joined(F.flatten(F.transform(path, lambda x: F.concat(x["left"], x["right"]))))


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` (group, place, leaf, any others) with subroot, root and path; groups' names may be null, places order a group's rows."""
    others = [c for c in rows.columns if c != "group"]
    group = F.col("group").cast("string")
    leaves = materialize(rows.select(group.isNotNull().alias("named"), F.coalesce(group, F.lit("")).alias("name"), *others), "merkle-rows")
    leaves = materialize(positions(leaves, ["place", "leaf"]), "merkle-leaves")
    subroots, steps = tree(leaves.withColumnRenamed("leaf", "node"), "groups")
    # the tree over the groups' roots: one group of them all, in the order of their names
    tops = subroots.select(F.lit(True).alias("named"), F.lit("").alias("name"), F.struct("named", "name").alias("place"), F.col("node").alias("leaf"))
    tops = materialize(positions(tops, ["place", "leaf"]), "merkle-subroots")
    roots, top_steps = tree(tops.withColumnRenamed("leaf", "node"), "top")
    ends = met(tops, top_steps, roots.select(*GROUP, F.col("node").alias("root"), F.array().cast(_PATH).alias("path")))
    ends = ends.select("place.named", "place.name", F.col("leaf").alias("subroot"), "root", "path")
    return met(leaves.drop("n"), steps, materialize(ends, "merkle-ends")).drop(*GROUP, "idx", "levels", "height")


def documents_manifest(documents: DataFrame) -> DataFrame:
    """Each row's leaf, its group's subroot, the root, its path, and its leaf as tampering would leave it (null: untouched)."""
    d = documents
    doc_id, source, lang, n_chars, text = d["doc_id"].cast("long"), d["source"], d["lang"], d["n_chars"].cast("long"), d["text"]
    hit = (F.crc32(doc_id.cast("string").cast("binary")) % 7 == 0) & n_chars.isNotNull()
    tampered = F.when(hit, leaf(doc_id, source, lang, n_chars.cast("decimal(20,0)") + 1, text))
    return manifest(d.select(lang.alias("group"), doc_id.alias("place"), leaf(doc_id, source, lang, n_chars, text).alias("leaf"), doc_id.alias("doc_id"), tampered.alias("tampered")))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    rows = documents_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    again = folded(F.coalesce("tampered", "leaf"), F.col("path"))
    rows = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), again.alias("folded_root"))
    rows = rows.withColumn("verified", F.col("folded_root") == F.col("root"))
    return rows.withColumns({c: shown(F.col(c)) for c in ("leaf", "subroot", "root", "folded_root")})


_FIELD = "coalesce(concat(octet_length(encode(CAST({0} AS VARCHAR))), ':', {0}), '-')"
_LEAF = "sha256(concat({}))".format(", ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{n_chars}", "text")))
#: The tree level by level; a path's part above the subroot stands at levels from 1000 on.
SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
rows_ AS (SELECT doc_id, lang, {_LEAF.format(n_chars="n_chars")} AS leaf, CASE WHEN xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 THEN {_LEAF.format(n_chars="(n_chars + 1)")} ELSE {_LEAF.format(n_chars="n_chars")} END AS held FROM documents, crc),
leaves AS (SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM rows_),
nodes AS (SELECT 0 AS level, g, idx, n, leaf AS node FROM leaves UNION ALL SELECT level + 1, g, idx // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY level + 1, g, idx // 2),
subroots AS (SELECT g, node, row_number() OVER (ORDER BY g) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (SELECT 1000 AS level, idx, n, node FROM subroots UNION ALL SELECT level + 1, idx // 2, any_value((n + 1) // 2), sha256(string_agg(node, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level + 1, idx // 2),
places AS (SELECT l.doc_id, l.leaf, l.held, x.level, l.g, l.idx // CAST(pow(2, x.level) AS BIGINT) AS idx FROM leaves l JOIN (SELECT DISTINCT level, g FROM nodes WHERE n > 1) x ON x.g = l.g
  UNION ALL SELECT l.doc_id, l.leaf, l.held, x.level, NULL, s.idx // CAST(pow(2, x.level - 1000) AS BIGINT) FROM leaves l JOIN subroots s ON s.g = l.g JOIN (SELECT DISTINCT level FROM upper WHERE n > 1) x ON true),
every AS (SELECT level, g, idx, node FROM nodes UNION ALL SELECT level, NULL, idx, node FROM upper),
beside AS (SELECT p.doc_id, p.leaf, p.held, p.level, row_number() OVER (PARTITION BY p.doc_id, p.leaf ORDER BY p.level) AS step, e.node, p.idx % 2 AS side FROM places p LEFT JOIN every e ON e.level = p.level AND e.g IS NOT DISTINCT FROM p.g AND e.idx = xor(p.idx, 1)),
fold AS (SELECT doc_id, leaf, CAST(0 AS BIGINT) AS step, held AS node FROM leaves UNION ALL SELECT b.doc_id, b.leaf, b.step, sha256(CASE WHEN b.side = 1 THEN concat(b.node, f.node) ELSE concat(f.node, b.node) END) FROM fold f JOIN beside b ON b.doc_id = f.doc_id AND b.leaf = f.leaf AND b.step = f.step + 1)
SELECT l.doc_id, l.leaf, s.node AS subroot, r.node AS root, sha256(coalesce(p.nodes, '')) AS proof_sha256, f.node AS folded_root, f.node = r.node AS verified
FROM leaves l JOIN subroots s ON s.g = l.g JOIN (SELECT node FROM upper WHERE n = 1) r ON true
LEFT JOIN (SELECT doc_id, leaf, string_agg(node, '' ORDER BY level) AS nodes FROM beside GROUP BY doc_id, leaf) p ON p.doc_id = l.doc_id AND p.leaf = l.leaf
JOIN (SELECT doc_id, leaf, arg_max(node, step) AS node FROM fold GROUP BY doc_id, leaf) f ON f.doc_id = l.doc_id AND f.leaf = l.leaf"""


def brute_force(rows) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text) rows."""
    import hashlib
    import zlib

    def h(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf_of(values):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def built(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][i : i + FAN]) for i in range(0, len(levels[-1]), FAN)])
        return levels

    def path_of(levels, i):
        out = []
        for nodes in levels[:-1]:
            first = i - i % FAN
            out.append((nodes[first:i], nodes[i + 1 : first + FAN]))
            i //= FAN
        return out

    groups: dict = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: built([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    top = built([trees[g][-1][0] for g in names])
    out = []
    for i, g in enumerate(names):
        for j, (_, _, leaf_, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = path_of(trees[g], j) + path_of(top, i)
            node = leaf_of((*r[:3], r[3] + 1, r[4])) if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else leaf_
            for left, right in path:
                node = h(*left, node, *right)
            out.append((r[0], leaf_, trees[g][-1][0], top[-1][0], h(*(n for side in path for n in side[0] + side[1])), node, node == top[-1][0]))
    return out
