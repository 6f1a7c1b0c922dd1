"""The manifest against plain trees, and what a proof shows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(leaves, fanout):
    """(root, proofs): for each leaf its siblings, as (left, right) of each level."""
    nodes, under, proofs = list(leaves), [[i] for i in range(len(leaves))], [[] for _ in leaves]
    while len(nodes) > 1:
        runs = [range(a, min(a + fanout, len(nodes))) for a in range(0, len(nodes), fanout)]
        for run in runs:
            for n in run:
                for leaf in under[n]:
                    proofs[leaf].append(("".join(nodes[run.start : n]), "".join(nodes[n + 1 : run.stop])))
        nodes, under = [h(*(nodes[n] for n in run)) for run in runs], [[i for n in run for i in under[n]] for run in runs]
    return nodes[0], proofs


def expected(rows, fanout):
    groups = {}
    for i, source, text in rows:
        groups.setdefault(source, []).append((i, h(text or "-")))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        leaves = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = (leaves, *plain([x for _, x in leaves], fanout))
    root, above = plain([trees[s][1] for s in names], fanout)
    return sorted((repr(i), leaf, trees[s][1], root, tuple(trees[s][2][n] + above[k])) for k, s in enumerate(names) for n, (i, leaf) in enumerate(trees[s][0]))


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_plain_trees(spark, fanout):
    """Groups of one, of a whole number of runs, of one more, and one that holds most rows; null names, ids and texts."""
    rng = random.Random(5)
    rows = [(rng.randrange(1 << 40), s, f"text {i}") for s, n in (("big", 150), ("sixteen", 16), ("seventeen", 17), ("one", 1), (None, 5), ("", 2), ("é", 3)) for i in range(n)]
    rows += [(None, "one", "no id"), (7, "big", None), (7, "big", ""), (7, "big", "same"), (7, "big", "same")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    for name in ("grp", "id", "hash", "pos", "size", "path", "tie", "altered", "leaf", "root", "name", "children", "at", "task", "parent"):
        docs = docs.withColumn(name, F.lit("x"))
    found = merkle.manifest(docs, merkle.digest(F.when(F.length("text") > 0, F.col("text")).otherwise("-")), fanout=fanout)
    got = [(repr(r.id), r.leaf, r.subroot, r.root, tuple((p.left, p.right) for p in r.path)) for r in found.collect()]
    assert sorted(got) == expected(rows, fanout)
    checked = found.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("right"), (merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("wrong"))
    assert {(r.right, r.wrong) for r in checked.collect()} == {(True, False)}


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "a", "x")], "doc_id long, source string, text string")
    leaf = merkle.digest(F.col("text"))
    only = merkle.manifest(docs, leaf).first()
    assert only.leaf == only.subroot == only.root == h("x") and only.path == []
    assert merkle.manifest(docs.where("false"), leaf).collect() == []


def test_fields_do_not_run_together(spark):
    row = spark.range(1).select(*(merkle.field(F.lit(v)).alias(n) for n, v in (("a", "é-"), ("b", None), ("c", ""), ("d", -12), ("e", "-")))).first()
    assert list(row) == ["3:é-", "-", "0:", "3:-12", "1:-"]
