"""Merkle manifest of a dataset: one tree of hashes for each group of rows, and one over the groups' roots.

Trees are built bottom-up: the nodes of a level are numbered within their group, every run of `fanout` consecutive ones
is hashed into a parent, and each level is a written table of parents with their children. Proofs are pushed top-down:
a level's rows join the proofs of their parents, and each child puts its siblings in front of what it inherits. So only
a sixteenth of the rows meets the (long) proofs in a join, and a leaf's own proof is made where its run is exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, written

FANOUT = 16
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes in front, so that different rows never run together alike; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put together."""
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `pos`, the place from 0 in their `grp` by `order`, and `size`, the rows of the grp.

    The table is range-sorted and written; a place is the offset of its task's first row of the grp and a count from
    there. What is summed by grp has a row for each task that holds some of it, so that a grp may hold most rows.
    """
    ranged = rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    placed = written(ranged.withColumn("at", F.monotonically_increasing_id()), "merkle").withColumn("task", F.shiftright("at", 33))
    runs = placed.groupBy("task", "grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("grp")
    before = F.sum("n").over(whole.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("task", "grp", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    return placed.join(runs, ["task", "grp"]).withColumn("pos", F.col("at") + F.col("shift")).drop("task", "at", "shift")


def build(nodes: DataFrame, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """Levels of parents, lowest first, and (grp, hash) of the roots.

    nodes: (grp, pos, size, hash) and what else a leaf carries. A level is (grp, pos, size, hash, children): its nodes
    with their runs of children in order. A grp of one node is its own root and has no level.
    """
    most, rest = nodes.agg(F.max("size")).first()[0] or 0, [c for c in nodes.columns if c not in ("grp", "pos", "size")]
    levels, roots = [], [nodes.where("size = 1").select("grp", "hash")]
    while most > 1:
        keys = ["grp", F.expr(f"pos div {fanout}").alias("pos"), F.expr(f"(size + {fanout - 1}) div {fanout}").alias("size")]
        run = F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("children")
        level = nodes.where("size > 1").groupBy(*keys).agg(run)
        level = written(level.withColumn("hash", F.sha2(F.array_join("children.hash", ""), 256)), "merkle")
        levels.append(level)
        roots.append(level.where("size = 1").select("grp", "hash"))
        nodes, rest, most = level.select("grp", "pos", "size", "hash"), ["hash"], -(-most // fanout)
    out = roots[0]
    for more in roots[1:]:
        out = out.unionByName(more)
    return levels, out


def pushed(nodes: DataFrame, levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """nodes' own columns but pos and size, with `path` and whatever else `above` says of their grp.

    above: (grp, path, ...), the proof of each grp's root. A path holds, from the node upwards, the siblings to the left
    and to the right, each side as one string of hashes.
    """
    more = [c for c in above.columns if c not in ("grp", "path")]
    own = [c for c in nodes.columns if c not in ("grp", "pos", "size")]
    got = None  # (grp, pos, path, ...) of the nodes of the level at hand
    for i in range(len(levels) - 1, -1, -1):
        level = levels[i]
        tops = level.where("size = 1").select("grp", "pos").join(above, "grp")
        known = tops if got is None else tops.unionByName(got)
        runs = level.select("grp", F.col("pos").alias("parent"), "children").join(known.withColumnRenamed("pos", "parent"), ["grp", "parent"])
        hashes = runs.withColumn("hashes", F.col("children.hash")).select("grp", "path", *more, "hashes", F.posexplode("children").alias("nth", "child"))
        left = F.array_join(F.slice("hashes", 1, F.col("nth")), "")
        right = F.array_join(F.slice("hashes", F.col("nth") + 2, F.greatest(F.size("hashes") - F.col("nth") - 1, F.lit(0))), "")
        path = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), "path").cast(PATH).alias("path")
        got = hashes.select("grp", "child.pos", path, *more, *([f"child.{c}" for c in own] if i == 0 else []))
    lone = nodes.where("size = 1").select("grp", *own).join(above, "grp")
    return lone if got is None else lone.unionByName(got.drop("pos"))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda node, side: F.sha2(F.concat(side["left"], node, side["right"]), 256))


def siblings(path: Column) -> Column:
    """All hashes of a path as one string, level by level and from left to right."""
    return F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), "")


def manifest(docs: DataFrame, leaf: Column, altered: Column | None = None, id_col: str = "doc_id", group_col: str = "source", fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, altered, subroot, root, path) for each row: its hash, its group's root, the root of all, and its proof.

    `leaf` and `altered` (null if not given) are hashes of a row. In a group leaves ascend by id, nulls first and equal
    ids by hash; groups ascend by name in bytes, null first. Rows that are equal throughout are leaves of their own, next
    to each other. A lone leaf is its group's root, a lone group's root is that of all, and a run of one node is hashed
    all the same. An empty table gives an empty result. Other columns play no part. Of the trees the driver sees their
    heights and the one root.
    """
    grp = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    other = F.lit(None).cast("string") if altered is None else altered
    rows = docs.select(grp.alias("grp"), F.col(id_col).cast("long").alias("id"), leaf.alias("hash"), other.alias("altered"), F.monotonically_increasing_id().alias("tie"))
    leaves = numbered(written(rows, "merkle"), ["id", "hash", "tie"]).drop("tie")
    levels, subroots = build(leaves, fanout)
    tops = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash"), ["name"])
    upper, root = build(tops, fanout)
    root = root.first()
    none = docs.sparkSession.createDataFrame([("", [])], f"grp string, path {PATH}")
    above = pushed(tops, upper, none).select(F.col("name").alias("grp"), "path", F.col("hash").alias("subroot"))
    proved = pushed(leaves, levels, written(above, "merkle"))
    return proved.select("id", F.col("hash").alias("leaf"), "altered", "subroot", F.lit(root and root["hash"]).cast("string").alias("root"), "path")


def op13(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    front = [field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    altered = F.when(tampered, digest(*front, field(ascii_lower(F.col("text")))))
    proved = manifest(docs, digest(*front, field(F.col("text"))), altered)
    root = folded(F.coalesce("altered", "leaf"), F.col("path"))
    out = proved.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_FRONT = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(a, b)), 4294967295::BIGINT), 4294967295)"
OP13_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT doc_id, source, sha256({_FRONT} || {_FIELD.format('text')}) AS leaf,
    CASE WHEN {_CRC} % 5 = 0 THEN sha256({_FRONT} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS altered FROM documents),
leaf AS (SELECT *, coalesce('=' || source, '') AS grp, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS size FROM raw),
tree(lvl, grp, pos, size, hash) AS (
  SELECT 0, grp, pos, size, leaf FROM leaf
  UNION ALL SELECT lvl + 1, grp, pos // 16, (size + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM tree WHERE size > 1 GROUP BY ALL),
sub AS (SELECT grp, hash, row_number() OVER (ORDER BY encode(grp)) - 1 AS pos, count(*) OVER () AS size FROM (SELECT DISTINCT grp, hash FROM tree WHERE size = 1)),
upper_tree(lvl, pos, size, hash) AS (
  SELECT 100, pos, size, hash FROM sub
  UNION ALL SELECT lvl + 1, pos // 16, (size + 15) // 16, sha256(string_agg(hash, '' ORDER BY pos)) FROM upper_tree WHERE size > 1 GROUP BY ALL),
sides AS (
  SELECT l.grp, l.pos, t.lvl, coalesce(string_agg(t.hash, '' ORDER BY t.pos) FILTER (t.pos < l.pos // (16::BIGINT ** t.lvl)::BIGINT), '') AS before,
    coalesce(string_agg(t.hash, '' ORDER BY t.pos) FILTER (t.pos > l.pos // (16::BIGINT ** t.lvl)::BIGINT), '') AS after
  FROM leaf l JOIN tree t ON t.grp = l.grp AND t.size > 1 AND t.pos // 16 = l.pos // (16::BIGINT ** (t.lvl + 1))::BIGINT GROUP BY ALL
  UNION ALL
  SELECT l.grp, l.pos, t.lvl, coalesce(string_agg(t.hash, '' ORDER BY t.pos) FILTER (t.pos < s.pos // (16::BIGINT ** (t.lvl - 100))::BIGINT), ''),
    coalesce(string_agg(t.hash, '' ORDER BY t.pos) FILTER (t.pos > s.pos // (16::BIGINT ** (t.lvl - 100))::BIGINT), '')
  FROM leaf l JOIN sub s ON s.grp = l.grp JOIN upper_tree t ON t.size > 1 AND t.pos // 16 = s.pos // (16::BIGINT ** (t.lvl - 99))::BIGINT GROUP BY ALL),
step AS (SELECT *, row_number() OVER (PARTITION BY grp, pos ORDER BY lvl) AS nth FROM sides),
fold(grp, pos, nth, hash) AS (
  SELECT grp, pos, 0, coalesce(altered, leaf) FROM leaf
  UNION ALL SELECT f.grp, f.pos, f.nth + 1, sha256(s.before || f.hash || s.after) FROM fold f JOIN step s ON s.grp = f.grp AND s.pos = f.pos AND s.nth = f.nth + 1),
proof AS (SELECT grp, pos, sha256(string_agg(before || after, '' ORDER BY nth)) AS proof FROM step GROUP BY ALL),
root AS (SELECT max(hash) AS root FROM upper_tree WHERE size = 1)
SELECT l.doc_id, l.leaf, s.hash AS subroot, root, coalesce(p.proof, sha256('')) AS proof_sha256, f.hash AS folded_root, f.hash = root AS verified
FROM leaf l JOIN sub s USING (grp) CROSS JOIN root LEFT JOIN proof p ON p.grp = l.grp AND p.pos = l.pos
JOIN (SELECT grp, pos, arg_max(hash, nth) AS hash FROM fold GROUP BY ALL) f ON f.grp = l.grp AND f.pos = l.pos
"""
