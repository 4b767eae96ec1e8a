"""Merkle manifests of a data set, stored in van Emde Boas order.

The leaves of a tree are numbered by a distributed sort.  Aligned runs of
``2 ** HEIGHT`` leaves are subtrees ("blocks"), each one row with its nodes in
one byte string.  The roots of the blocks are the leaves of the next tier of
blocks, until one block holds the root of the tree; the roots of all trees are
the leaves of one more tree.

Inside a block the nodes lie in van Emde Boas order: the upper half of the
levels first, then the subtrees below it from left to right, each laid out the
same way.  ``address`` finds a node by arithmetic alone, for construction and
for reading siblings, so a path from a leaf up touches few cache lines whatever
their size is.

A node is the SHA-256 (lowercase hex) of its two children's hex texts, or of its
one child's where the last run of a level has one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.llm.common import map_batches, numbered, ship, written

#: Levels of nodes below the root of a full block: 1024 leaves, 64 KB.
HEIGHT = 10
SIZE = 32


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes ``index`` at ``depth`` (0 is the root) in a block of
    ``levels`` levels in van Emde Boas order."""
    index, at = np.asarray(index, np.int64), np.zeros(np.shape(index), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        below, depth = levels - top, depth - top
        subtree = index >> depth
        at = at + (1 << top) - 1 + subtree * ((1 << below) - 1)
        index, levels = index - (subtree << depth), below
    return at


@lru_cache(maxsize=2 * HEIGHT + 2)
def _places(levels: int) -> tuple[list[int], ...]:
    return tuple((SIZE * address(levels, d, np.arange(1 << d))).tolist() for d in range(levels))


def digest(*children: bytes) -> bytes:
    return hashlib.sha256(b"".join(children).hex().encode()).digest()


def block_levels(n: int, total: int) -> int:
    """Levels of a block of ``n`` leaves in a tier of ``total``: all, if there are more blocks."""
    return HEIGHT + 1 if total > 1 << HEIGHT else (n - 1).bit_length() + 1


def lay_out(leaves: list[bytes], levels: int) -> bytes:
    """The nodes over ``leaves`` in van Emde Boas order; missing ones are zeros."""
    out, places = bytearray(SIZE * ((1 << levels) - 1)), _places(levels)
    for depth in range(levels - 1, -1, -1):
        for at, node in zip(places[depth], leaves):
            out[at:at + SIZE] = node
        leaves = [digest(*leaves[k:k + 2]) for k in range(0, len(leaves), 2)]
    return bytes(out)


def siblings(nodes: bytes, levels: int, n: int, leaf: int) -> bytes:
    """The siblings on the way from ``leaf`` to the block's root, lowest first."""
    out, places = [], _places(levels)
    for depth in range(levels - 1, 0, -1):
        other = leaf ^ 1
        if other < n:
            at = places[depth][other]
            out.append(nodes[at:at + SIZE])
        leaf, n = leaf >> 1, (n + 1) >> 1
    return b"".join(out)


def fold(leaf: bytes, path: bytes, *ways: tuple[int, int]) -> bytes:
    """The root that ``leaf`` and the siblings ``path`` give.  ``ways`` are the
    (place, number of leaves) in the tree and in the tree over the trees."""
    at = 0
    for index, n in ways:
        while n > 1:
            if index ^ 1 < n:
                other, at = path[at:at + SIZE], at + SIZE
                leaf = digest(other, leaf) if index & 1 else digest(leaf, other)
            else:
                leaf = digest(leaf)
            index, n = index >> 1, (n + 1) >> 1
    return leaf


@dataclass(frozen=True)
class Manifest:
    """``tiers``: tables (tree, block, total, digests, items, nodes, root), leaves
    first; ``top``: the same for the tree over the trees; ``trees``: (tree, the
    grouping column, subroot); ``root``: 32 bytes, or null without leaves."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    trees: DataFrame
    n_trees: int
    root: bytes | None


def field_text(name: str) -> Column:
    """A column as ``-`` if it is null, else its UTF-8 byte count, ``:`` and its value."""
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(*parts: Column) -> Column:
    """32 bytes: SHA-256 of the parts, one after another."""
    return F.unhex(F.sha2(F.concat(*(p.cast("binary") for p in parts)), 256))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks over ``nodes(tree, index, total, digest, item)``, as a table."""
    def run(batch: pa.RecordBatch):
        rows = {c: batch.column(c).to_pylist() for c in ("total", "digests")}
        laid = [lay_out(d, block_levels(len(d), t)) for t, d in zip(rows["total"], rows["digests"])]
        yield {c: batch.column(c) for c in batch.schema.names} | {"nodes": laid, "root": [x[:SIZE] for x in laid]}

    own = (nodes.groupBy("tree", F.shiftright("index", HEIGHT).alias("block"), "total")
           .agg(F.array_sort(F.collect_list(F.struct("index", "digest", "item"))).alias("own"))  # 1024 at most
           .select("tree", "block", "total", F.col("own.digest").alias("digests"), F.col("own.item").alias("items")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
    return written(map_batches(own, run, f"{kinds}, nodes binary, root binary"), "merkle-blocks")


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """All tiers over ``nodes``: each has a 1024th of the blocks of that before."""
    out = []
    while True:
        out.append(_blocks(nodes))
        more = out[-1].where(F.col("total") > 1 << HEIGHT)
        if more.limit(1).count() == 0:
            return out
        nodes = more.select("tree", F.col("block").alias("index"), F.shiftright(F.col("total") + (1 << HEIGHT) - 1, HEIGHT).alias("total"),
                            F.col("root").alias("digest"), F.lit(0).alias("item"))


def build(rows: DataFrame, leaf: str, tree: str, order: list[str], items: tuple[str, ...] = ()) -> Manifest:
    """The manifest of ``rows``: a tree for each value of column ``tree`` (nulls
    are one value) over the binary digests ``leaf``, by ``order``, nulls first,
    then by the digest; the trees by value, null first, strings bytewise.

    Rows that repeat are leaves of their own.  ``items`` are columns that
    ``proofs`` gives back.  A null ``leaf`` raises.  Further columns are ignored,
    whatever they are called.  An empty table has no tree and no root.
    """
    own = rows.select(F.col(tree).alias("tree_key"), *(F.col(c).alias(f"by{i}") for i, c in enumerate(order)),
                      F.coalesce(leaf, F.raise_error(F.lit("a leaf is null")).cast("binary")).alias("digest"),
                      (F.struct(*items) if items else F.lit(0)).alias("item"))
    leaves = numbered(own, ["tree_key"], [f"by{i}" for i in range(len(order))] + ["digest"], "merkle-leaves")
    keys = numbered(leaves.select("tree_key").distinct(), [], ["tree_key"], "merkle-trees")
    keys = keys.select(F.col("tree_key").alias("key"), F.col("index").alias("tree"))
    tiers = _tiers(leaves.join(keys, F.col("tree_key").eqNullSafe(F.col("key"))).select("tree", "index", "total", "digest", "item"))
    roots = tiers[0].where(F.col("total") <= 1 << HEIGHT).select("tree", "root")
    for tier in tiers[1:]:
        roots = roots.union(tier.where(F.col("total") <= 1 << HEIGHT).select("tree", "root"))
    n_trees = keys.count()
    top = _tiers(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"),
                              F.lit(n_trees).cast("long").alias("total"), F.col("root").alias("digest"), F.lit(0).alias("item")))
    root = top[-1].where("block = 0").select("root").first()
    trees = keys.join(roots.withColumnRenamed("root", "subroot"), "tree").withColumnRenamed("key", tree)
    return Manifest(tiers, top, trees, n_trees, bytes(root["root"]) if root else None)


def _paths(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, block, total, digests, items, paths): for each leaf of the lowest
    tier its siblings up to the root, then those ``above(tree, above)``."""
    def run(batch: pa.RecordBatch):
        rows = batch.select(["total", "digests", "nodes", "above"]).to_pylist()
        paths = []
        for r in rows:
            n = len(r["digests"])
            levels = block_levels(n, r["total"])
            paths.append([siblings(r["nodes"], levels, n, k) + r["above"] for k in range(n)])
        yield {c: batch.column(c) for c in keep} | {"paths": paths}

    below = None
    for tier in reversed(tiers):
        last = F.col("total") <= 1 << HEIGHT
        joined = tier.where(last).join(above, "tree")
        if below is not None:
            joined = joined.unionByName(tier.where(~last).join(below, ["tree", "block"]))
        keep = [c for c in joined.columns if c not in ("nodes", "above", "root")]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.select(*keep).schema.fields)
        out = map_batches(joined, run, f"{kinds}, paths array<binary>", piece_rows=64)
        below = out.select("tree", F.posexplode("paths").alias("at", "above"), "block").select(
            "tree", (F.col("block") * (1 << HEIGHT) + F.col("at")).alias("block"), "above")
    return out


def proofs(manifest: Manifest) -> DataFrame:
    """Per leaf: (tree, index, total, leaf, item, path, subroot): ``path`` has the
    siblings from the leaf to the root of all, 32 bytes each, lowest first."""
    nothing = manifest.trees.select(F.lit(0).cast("long").alias("tree"), F.lit(b"").alias("above")).limit(1)
    over = _paths(manifest.top, nothing).select(
        F.posexplode(F.arrays_zip("digests", "paths")).alias("at", "own"), "block")
    over = written(over.select((F.col("block") * (1 << HEIGHT) + F.col("at")).alias("tree"), F.col("own.paths").alias("above")),
                   "merkle-above")
    out = _paths(manifest.tiers, over).join(manifest.trees.select("tree", "subroot"), "tree")
    out = out.select("tree", "subroot", "block", "total", F.posexplode(F.arrays_zip("digests", "items", "paths")).alias("at", "own"))
    return out.select("tree", "subroot", (F.col("block") * (1 << HEIGHT) + F.col("at")).alias("index"), "total",
                      F.col("own.digests").alias("leaf"), F.col("own.items").alias("item"), F.col("own.paths").alias("path"))


def folded(manifest: Manifest, leaf: Column) -> Column:
    """The root that ``leaf`` gives with the siblings of a row of ``proofs``."""
    from pyspark.sql import SparkSession
    ship(SparkSession.active())
    trees = manifest.n_trees

    @F.pandas_udf("binary")
    def root(leaf: pd.Series, path: pd.Series, index: pd.Series, total: pd.Series, tree: pd.Series) -> pd.Series:
        return pd.Series([fold(a, p, (i, n), (t, trees)) for a, p, i, n, t in zip(leaf, path, index, total, tree)], dtype=object)

    return root(leaf, "path", "index", "total", "tree")
