"""The Merkle manifest against a plain level-by-level version."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from colsense.llm import merkle


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def levels(leaves):
    out = [list(leaves)]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][k:k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def climb(tree, i):
    path = []
    for level in tree[:-1]:
        path += level[i ^ 1:(i ^ 1) + 1]
        i >>= 1
    return path


def laid(levels_):
    """Places of (depth, index) by recursion on whole subtrees."""
    if levels_ == 1:
        return [(0, 0)]
    top = levels_ // 2
    out, below = laid(top), laid(levels_ - top)
    return out + [(top + d, (s << d) + i) for s in range(1 << top) for d, i in below]


def test_address_is_the_recursive_layout():
    for n in range(1, 12):
        order = laid(n)
        assert len(order) == (1 << n) - 1 == len(set(order))
        got = [int(merkle.address(n, d, np.array([i]))[0]) for d, i in order]
        assert got == list(range(len(order)))


def test_block_and_fold():
    rng = random.Random(1)
    for n in (1, 2, 3, 5, 8, 13, 100):
        leaves = [rng.randbytes(32) for _ in range(n)]
        tree = levels([x.hex() for x in leaves])
        depth = merkle.block_levels(n, n)
        nodes = merkle.lay_out(leaves, depth)
        assert nodes[:32].hex() == tree[-1][0]
        for i in range(n):
            path = merkle.siblings(nodes, depth, n, i)
            assert path.hex() == "".join(climb(tree, i))
            assert merkle.fold(leaves[i], path, (i, n)) == nodes[:32]
            assert merkle.fold(b"x" * 32, path, (i, n)) != nodes[:32]


def check(rows, df):
    manifest = merkle.build(df.withColumn("leaf", F.unhex("hex")), "leaf", "part", ["id"], ("id", "hex"))
    trees = {}
    for part, i, leaf in rows:
        trees.setdefault(part, []).append((i is not None, i or 0, leaf, i))
    order = sorted(trees, key=lambda p: (p is not None, (p or "").encode()))
    built = {p: levels([x[2] for x in sorted(trees[p], key=lambda x: x[:3])]) for p in order}
    over = levels([built[p][-1][0] for p in order])
    want = []
    for t, p in enumerate(order):
        own = sorted(trees[p], key=lambda x: x[:3])
        for i, x in enumerate(own):
            want.append((str(x[3]), x[2], built[p][-1][0], "".join(climb(built[p], i) + climb(over, t))))
    out = merkle.proofs(manifest)
    out = out.withColumn("good", merkle.folded(manifest, F.col("leaf"))).withColumn("bad", merkle.folded(manifest, F.unhex(F.repeat(F.lit("ab"), 32))))
    got = out.collect()
    assert sorted((str(r["item"]["id"]), r["leaf"].hex(), r["subroot"].hex(), r["path"].hex()) for r in got) == sorted(want)
    assert manifest.root.hex() == over[-1][0]
    assert all(r["item"]["hex"].lower() == r["leaf"].hex() and bytes(r["good"]) == manifest.root != bytes(r["bad"]) for r in got)


def test_manifest_matches_a_plain_tree(spark):
    rng = random.Random(2)
    rows = [("en", i, h(str(i))) for i in range(2500)]  # three blocks and a second tier
    rows += [(None, i, h(f"n{i}")) for i in (None, None, 4, 4, 1)] + [("é", 7, h("a"))] * 3 + [("z", None, h("b"))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "part string, id long, hex string")
    check(rows, df.select("*", *(F.lit(1).alias(c) for c in ("tree", "index", "total", "block", "digest", "item", "path", "nodes"))))


def test_many_small_trees(spark):
    rows = [(f"t{i % 1100:04}", i, h(str(i))) for i in range(1500)]
    check(rows, spark.createDataFrame(rows, "part string, id long, hex string"))


def test_one_leaf_and_none(spark):
    rows = [("a", 1, h("x"))]
    check(rows, spark.createDataFrame(rows, "part string, id long, hex string"))
    empty = spark.createDataFrame([], "part string, id long, leaf binary")
    manifest = merkle.build(empty, "leaf", "part", ["id"], ("id",))
    assert manifest.root is None and merkle.proofs(manifest).count() == 0


def test_fields_of_a_row(spark):
    df = spark.createDataFrame([(1, None, ""), (None, "é:1-", "x" * 100000)], "a long, b string, c string")
    got = [r.leaf.hex() for r in df.select(merkle.row_digest(*(merkle.field_text(c) for c in "abc")).alias("leaf")).collect()]
    assert got == [h("1:1-0:"), h("-5:é:1-100000:" + "x" * 100000)]
