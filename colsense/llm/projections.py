"""Near-duplicate vectors by collision counting on one-dimensional projections.

A unit vector has one number on each of ``projections`` random directions.  The
numbers of two vectors at distance d differ by a normal variable of deviation
d, so a window of ``width`` times the largest distance of a link, centred at
one, holds the other with a known probability.  A pair whose number of such
collisions reaches a threshold is compared exactly; the threshold is the largest
that a link misses with probability ``miss`` at most (``calibrate``).

Work is done in tiles.  The vectors of a label, sorted by their first
projection, are cut into blocks, and two blocks are a tile unless the gap
between them is wider than a link can be.  In a tile each projection of one
block is sorted, so the window of a query is a run of that order; the runs of
all projections are counted per vector.  Links never leave a tile: it gives each
vector's number of links, and one edge to the smallest vector it is connected
with, so rows grow with vectors and tiles, not with links.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsense.llm.common import map_batches, numbered, written
from colsense.llm.components import min_labels


def calibrate(distance: float, projections: int, width: float, miss: float) -> tuple[float, int]:
    """(half window, least collisions): two vectors at ``distance`` or nearer
    collide less often with probability ``miss`` at most."""
    p = math.erf(width / math.sqrt(2))
    below, least = 0.0, 0
    while least < projections:
        below += math.comb(projections, least) * p ** least * (1 - p) ** (projections - least)
        if below > miss:
            break
        least += 1
    return width * distance, least


def reach(miss: float) -> float:
    """Deviations that a normal variable exceeds with probability ``miss``."""
    lo, hi = 0.0, 40.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(mid / math.sqrt(2)) > miss else (lo, mid)
    return hi


def directions(dim: int, projections: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, dim])).normal(size=(dim, projections))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def compare(x: np.ndarray, wx: np.ndarray, y: np.ndarray, wy: np.ndarray, same: bool, cosine: float, half: float,
            least: int, along: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows of ``x`` and then of ``y`` (units; the same rows if ``same``):
    number of linked vectors by the weights of the others, and the first row of
    those it is connected with."""
    n = len(x)
    links, group = np.zeros(n + len(y), np.int64), np.arange(n + len(y))
    px, py = x @ along, y @ along
    order = np.argsort(py, axis=0).T.copy()
    lo, hi = np.zeros((n, len(order)), np.int64), np.zeros((n, len(order)), np.int64)
    for j, o in enumerate(order):
        lo[:, j] = np.searchsorted(py[o, j], px[:, j] - half, "left")
        hi[:, j] = np.searchsorted(py[o, j], px[:, j] + half, "right")
    for q in range(n):
        runs = [o[a:b] for o, a, b in zip(order, lo[q].tolist(), hi[q].tolist())]
        met = np.flatnonzero(np.bincount(np.concatenate(runs), minlength=len(y)) >= least)
        if same:
            met = met[met > q]
        met = met[np.einsum("ij,j->i", y[met], x[q]) >= cosine]
        if not len(met):
            continue
        others = met if same else met + n
        links[q] += wy[met].sum()
        links[others] += wx[q]
        groups = np.unique(np.append(group[others], group[q]))
        if len(groups) > 1:
            group[np.isin(group, groups)] = groups[0]
    return links, group


def _block(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, weights, units) of one array of structs."""
    flat = rows.field("embedding").flatten().to_numpy(zero_copy_only=False)
    return (rows.field("node"), rows.field("weight").to_numpy(zero_copy_only=False), unit(flat.reshape(len(rows), -1)))


def links(vectors: DataFrame, cosine: float = 0.93, projections: int = 48, width: float = 1.4, miss: float = 1e-6,
          block_rows: int = 2048, salts: int = 8, seed: int = 21) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors(vec_id, embedding, label)``.

    Rows with equal labels are linked if the cosine of their vectors in double
    precision is at least ``cosine``; a link at that cosine is missed with
    probability ``2 * miss`` at most, a nearer one more rarely, and a pair below
    it is never linked.  Null labels, and vectors that are null, empty, zero or
    hold a null or a component that is not finite, link with nothing; vectors of
    different lengths don't either.  ``n_links`` counts the other rows linked
    directly, copies too.  ``component_id`` is the smallest vec_id reachable,
    nulls left out; ``kept`` says that it is the row's own.  Rows that repeat,
    also with one vec_id or a null one, are vectors of their own.  Other columns
    are ignored.  An empty table gives an empty one.

    Equal vectors of a label are compared once.  Work grows with the square of
    a label's distinct vectors, less the tiles that are too far apart, in tasks
    of ``block_rows ** 2`` pairs.  A node with very many copies is joined to its
    rows in ``salts`` shares.
    """
    half, least = calibrate(math.sqrt(2 - 2 * cosine), projections, width, miss)
    gap = reach(miss) * math.sqrt(2 - 2 * cosine)
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = (vectors.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
            .select("vec_id", "label", F.when(usable, F.col("embedding")).alias("embedding")))

    def describe(batch: pa.RecordBatch):
        nodes, leads = [], []
        for label, x in zip(batch.column("label"), batch.column("embedding")):
            if x.as_py() is None:
                nodes.append(None)
                leads.append(None)
                continue
            x = x.values.to_numpy(zero_copy_only=False)
            nodes.append(hashlib.blake2b(x.tobytes() + label.as_py().encode(), digest_size=16).digest())
            leads.append(float(unit(x[None, :])[0] @ directions_of(len(x))[:, 0]))
        yield {c: batch.column(c) for c in batch.schema.names} | {"node": nodes, "lead": leads}

    known: dict[int, np.ndarray] = {}

    def directions_of(dim: int) -> np.ndarray:
        if dim not in known:
            known.clear()
            known[dim] = directions(dim, projections, seed)
        return known[dim]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = written(map_batches(rows, describe, f"{kinds}, node binary, lead double").withColumn(
        "row", F.monotonically_increasing_id()), "projected")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(
        F.count(F.lit(1)).alias("weight"), F.any_value(F.struct("label", "lead", "embedding")).alias("own"))
    nodes = nodes.select("node", "weight", "own.*").withColumn("dim", F.size("embedding"))
    per_block = F.greatest(F.lit(64), F.least(F.lit(block_rows), F.floor(F.lit(1 << 21) / (8 * F.col("dim")))))
    blocks = (numbered(nodes, ["label", "dim"], ["lead"], "projected-nodes")
              .groupBy("label", "dim", F.floor(F.col("index") / per_block).alias("block"))
              .agg(F.collect_list(F.struct("node", "weight", "embedding")).alias("rows"),  # block_rows at most
                   F.min("lead").alias("low"), F.max("lead").alias("high")))
    blocks = written(blocks, "projected-blocks")
    heads = blocks.select("label", "dim", "block", "low", "high")
    later = heads.select("label", "dim", F.col("block").alias("other"), F.col("low").alias("other_low"))
    tiles = heads.join(later, ["label", "dim"]).where((F.col("block") <= F.col("other")) & (F.col("other_low") - F.col("high") <= gap))
    right = blocks.select("label", "dim", F.col("block").alias("other"), F.col("rows").alias("other_rows"))
    tiles = (tiles.select("label", "dim", "block", "other").join(blocks.select("label", "dim", "block", "rows"), ["label", "dim", "block"])
             .join(right, ["label", "dim", "other"]).select("dim", (F.col("block") == F.col("other")).alias("same"), "rows", "other_rows"))

    def run(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            same = batch.column("same")[i].as_py()
            names, wx, x = _block(batch.column("rows")[i].values)
            other, wy, y = (names, wx, x) if same else _block(batch.column("other_rows")[i].values)
            found, group = compare(x, wx, y, wy, same, cosine, half, least, directions_of(batch.column("dim")[i].as_py()))
            every = names if same else pa.concat_arrays([names, other])
            some = np.flatnonzero(found)
            yield {"node": every.take(pa.array(some)), "links": found[some], "root": every.take(pa.array(group[some]))}

    tiled = written(map_batches(tiles, run, "node binary, links long, root binary"), "projected-links")
    counted = tiled.groupBy("node").agg(F.sum("links").alias("links"))
    labels = min_labels(tiled.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known_nodes = (nodes.select("node", "weight").join(counted, "node", "left").join(labels, "node", "left")
                   .select("node", F.coalesce("label", "node").alias("component"),
                           (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    shares = known_nodes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = written(rows.select("row", "vec_id", "node", (F.col("row") % salts).cast("int").alias("salt"))
                    .join(shares, ["node", "salt"], "left"), "projected-found")
    smallest = found.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("component_id"))
    smallest = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    out = found.join(smallest, ["component", "salt"], "left")
    own = F.when(F.col("component").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
                      F.col("vec_id").eqNullSafe(own).alias("kept"))
