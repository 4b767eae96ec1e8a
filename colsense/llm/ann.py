"""Nearest neighbours by learned partitions.

Nearness is the inner product, so long vectors are near to more queries.  As a
candidate, a vector is therefore its direction and, as one more component, the
logarithm of its length.  The neighbour graph of a bounded sample of candidates
is cut into parts of nearly equal size with few edges between them, and a small
network learns which part a candidate is in.  Every row is indexed in its likeliest
part.  A second network learns, for a query, how its neighbours by inner product
are spread over the parts of the index.  A query is compared with all rows of
its likeliest parts, as many as hold a share of the network's mass.  That share
is set on queries that the network was not fitted on, so that they find
``coverage`` of their neighbours.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsense.llm.common import ship, written


@dataclass(frozen=True)
class Router:
    """Two layers: probabilities of the parts."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def neighbour_graph(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """[row of q, k]: the rows of x with the largest inner products, its own left out."""
    out = np.zeros((len(q), k), np.int32)
    for a in range(0, len(q), 512):
        s = q[a:a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a:a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(graph: np.ndarray, parts: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Part of each node.  Parts grow breadth first to an equal size; then nodes
    move to the part where most of their neighbours are while it has room."""
    n, k = graph.shape
    into = [[] for _ in range(n)]
    for a in range(n):
        for b in graph[a]:
            into[b].append(a)
    near = [np.concatenate([graph[a], np.array(into[a], np.int32)]) for a in range(n)]
    part, room = np.full(n, -1), math.ceil(n / parts)
    order, at = rng.permutation(n), 0
    for p in range(parts):
        queue, size, head = [], 0, 0
        while size < room:
            if head == len(queue):
                while at < n and part[order[at]] >= 0:
                    at += 1
                if at == n:
                    break
                queue.append(order[at])
                part[order[at]] = p
                size += 1
            a = queue[head]
            head += 1
            for b in near[a]:
                if part[b] < 0 and size < room:
                    part[b] = p
                    size += 1
                    queue.append(b)
    sizes = np.bincount(part, minlength=parts)
    most = math.ceil(1.1 * n / parts)
    for _ in range(rounds):
        for a in rng.permutation(n):
            votes = np.bincount(part[near[a]], minlength=parts)
            to = int(votes.argmax())
            if votes[to] > votes[part[a]] and sizes[to] < most:
                sizes[part[a]] -= 1
                sizes[to] += 1
                part[a] = to
    return part


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as queries: of length one, since a query's length changes no order."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def log_length(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, keepdims=True)
    return np.log(most) + np.log(np.linalg.norm(x / most, axis=1, keepdims=True))


def placed(x: np.ndarray, scale: tuple[float, float]) -> np.ndarray:
    """Rows as candidates: direction, and the length on the given log scale."""
    return np.concatenate([unit(x), (log_length(x) - scale[0]) * scale[1]], axis=1)


def spread(graph: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
    """[row, part]: the share of a row's neighbours that are in the part."""
    goal = np.zeros((len(graph), parts))
    np.add.at(goal, (np.arange(len(graph))[:, None], part[graph]), 1 / graph.shape[1])
    return goal


def calibrated(router: Router, x: np.ndarray, goal: np.ndarray, coverage: float) -> float:
    """The least mass of likeliest parts that holds ``coverage`` of the rows'
    neighbours in the mean."""
    p = router(x)
    order = np.argsort(-p, axis=1)
    mass = np.cumsum(np.take_along_axis(p, order, 1), axis=1)
    held = np.cumsum(np.take_along_axis(goal, order, 1), axis=1)
    rows = np.arange(len(x))
    for share in (0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.93, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 0.9999):
        if held[rows, np.minimum((mass < share).sum(axis=1), p.shape[1] - 1)].mean() >= coverage:
            return share
    return 1.1  # all parts


def fit(x: np.ndarray, scale: tuple[float, float], parts: int, coverage: float, k: int = 20, seed: int = 5) -> tuple[Router, Router, float]:
    """Routers of candidates and of queries from the sample ``x``, and the mass
    a query's parts have to hold."""
    rng = np.random.Generator(np.random.PCG64(seed))
    parts, k = max(1, min(parts, len(x) // 2)), min(k, len(x) - 1)
    if parts < 2 or k < 1:
        return tuple(Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1)) for d in (x.shape[1] + 1, x.shape[1])) + (1.1,)
    own, asked = placed(x, scale), unit(x)
    # the smallest distance as the largest inner product
    graph = neighbour_graph(np.c_[own, np.ones(len(own))], np.c_[own, -(own * own).sum(axis=1) / 2], k)
    part = balanced_parts(graph, parts, rng)
    goal = (k * spread(graph, part, parts) + np.eye(parts)[part]) / (k + 1)
    index = fit_router(own, goal, rng)
    found = spread(neighbour_graph(asked, x / np.abs(x).max(), k), index(own).argmax(axis=1), parts)
    late = rng.permutation(len(x)) < len(x) // 5
    router = fit_router(asked[~late], found[~late], rng)
    return index, router, calibrated(router, asked[late], found[late], coverage) if late.any() else 1.1


def fit_router(x: np.ndarray, goal: np.ndarray, rng: np.random.Generator, hidden: int = 128, epochs: int = 30) -> Router:
    """A router that gives the shares ``goal`` for the rows ``x``."""
    dim, parts = x.shape[1], goal.shape[1]
    weights = [rng.normal(0, math.sqrt(2 / dim), (dim, hidden)), np.zeros(hidden),
               rng.normal(0, math.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
            xb = x[at]
            h = np.maximum(xb @ weights[0] + weights[1], 0)
            z = h @ weights[2] + weights[3]
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = (e / e.sum(axis=1, keepdims=True) - goal[at]) / len(at)
            dh = (d @ weights[2].T) * (h > 0)
            step += 1
            for i, g in enumerate((xb.T @ dh, dh.sum(0), h.T @ d, d.sum(0))):
                g = g + 1e-4 * weights[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                weights[i] -= 0.01 * (1 - epoch / epochs) * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.99 ** step)) + 1e-8)
    return Router(*weights)


def usable(vectors: DataFrame) -> DataFrame:
    """One row (vec_id, embedding array<double>) for each id that takes part.

    Left out: null ids; vectors that are null, empty, zero or hold a null or a
    component that is not finite; vectors whose length is not the most frequent
    one (the smallest of them, if two are).  Of several usable rows with one id
    the smallest vector stands for it, so repeated rows count once.
    """
    own = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("embedding", lambda x: x != 0))
    own = own.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    lengths = own.groupBy(F.size("embedding").alias("n")).count()
    best = lengths.orderBy(F.desc("count"), "n").limit(1).select("n")
    return own.join(F.broadcast(best), F.size("embedding") == F.col("n")).drop("n")  # one row


def search(vectors: DataFrame, is_query, k: int = 20, part_rows: int = 4096, sample_rows: int = 8192, coverage: float = 0.97,
           block_rows: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found for each row
    of ``vectors(vec_id, embedding)`` where ``is_query`` holds, by inner product
    in double precision, ties to the smaller vec_id; a query's own id is no
    candidate.  See ``usable`` for the rows that take no part.  Fewer candidates
    than ``k`` give fewer rows, an empty table none.

    The routers are fitted on at most ``sample_rows`` rows (half of them those
    with the smallest hash of their id, the others the longest vectors, which
    are near to most queries), which bounds what comes to the driver; every
    row is indexed.  There is a part for about ``part_rows`` rows, 16 at least,
    and at most one for 32 rows of the sample.  A query visits parts until they
    hold its share and more than ``k`` rows.  Rows of a part fall into blocks of about ``block_rows`` by
    hash of the id, and so do its queries, so no task holds a whole part,
    however many equal vectors it has.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = written(usable(vectors), "ann-rows")
    length = F.aggregate("embedding", F.lit(0.0), lambda s, e: s + e * e)  # squared; only their order counts
    n_rows = rows.count()
    by_hash = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows // 2)
    by_length = rows.orderBy(length.desc(), F.xxhash64("vec_id"), "vec_id").limit(sample_rows - sample_rows // 2)
    sample = by_hash.union(by_length).dropDuplicates(["vec_id"]).orderBy("vec_id").toPandas()
    schema = "query_id long, rank int, vec_id long, score double"
    if not len(sample):
        return spark.createDataFrame([], schema)
    parts = min(max(16, math.ceil(n_rows / part_rows)), max(1, len(sample) // 32))
    x = np.stack(sample["embedding"].to_numpy())
    wide = float(log_length(x).std())
    scale = float(log_length(x).mean()), 0.5 / wide if wide > 1e-4 else 0.0
    index, router, share = fit(x, scale, parts, coverage)

    def route(frames):
        for f in frames:
            if len(f):
                x = np.stack(f["embedding"].to_numpy())
                yield f.assign(part=index(placed(x, scale)).argmax(axis=1), probs=list(router(unit(x))))

    routed = written(rows.mapInPandas(route, "vec_id long, embedding array<double>, part int, probs array<double>"), "ann-routed")
    part = F.col("part")
    held = {r["part"]: r["n"] for r in routed.groupBy(part).agg(F.count("*").alias("n")).collect()}
    n_parts = len(router.b2)
    sizes = [held.get(p, 0) for p in range(n_parts)]

    # parts of a query by probability, until they hold enough
    ranked = F.reverse(F.array_sort(F.transform("probs", lambda x, i: F.struct(x.alias("x"), i.alias("part")))))
    size = F.array(*(F.lit(s) for s in sizes))
    walked = F.aggregate(ranked, F.struct(F.lit(0.0).alias("mass"), F.lit(0).cast("long").alias("rows"),
                                          F.array().cast("array<int>").alias("parts")),
                         lambda s, r: F.when((s["mass"] < share) | (s["rows"] <= k), F.struct(
                             (s["mass"] + r["x"]).alias("mass"),
                             (s["rows"] + F.element_at(size, r["part"] + 1)).cast("long").alias("rows"),
                             F.concat(s["parts"], F.array(r["part"])).alias("parts"))).otherwise(s))["parts"]
    asked = written(routed.where(is_query).select("vec_id", "embedding", F.explode(walked).alias("part")), "ann-asked")
    asks = {r["part"]: r["n"] for r in asked.groupBy("part").agg(F.count("*").alias("n")).collect()}
    blocks = F.array(*(F.lit(math.ceil(s / block_rows)) for s in sizes))
    q_blocks = F.array(*(F.lit(math.ceil(asks.get(p, 0) / block_rows)) for p in range(n_parts)))

    def dealt(df: DataFrame, own, other, name: str, other_name: str) -> DataFrame:
        """Each row in a block of its own kind, once for each block of the other."""
        count, others = F.element_at(own, F.col("part") + 1), F.element_at(other, F.col("part") + 1)
        return (df.where((count > 0) & (others > 0)).withColumn(name, F.pmod(F.xxhash64("vec_id"), count).cast("int"))
                .withColumn(other_name, F.explode(F.sequence(F.lit(0), others - 1)))
                .select("part", "block", "q_block", "vec_id", "embedding"))

    base = dealt(routed.select("vec_id", "embedding", "part"), blocks, q_blocks, "block", "q_block")
    queries = dealt(asked, q_blocks, blocks, "q_block", "block")

    def nearest(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(q) and len(b):
            ids, x = b["vec_id"].to_numpy(), np.stack(b["embedding"].to_numpy())
            for at in range(0, len(q), 128):
                own, y = q["vec_id"].to_numpy()[at:at + 128], np.stack(q["embedding"].to_numpy()[at:at + 128])
                s = np.zeros((len(y), len(x)))
                for d in range(x.shape[1]):  # one component after another: equal vectors get equal scores
                    s += np.outer(y[:, d], x[:, d])
                s[own[:, None] == ids] = -np.inf
                least = np.partition(s, max(0, len(x) - k), axis=1)[:, max(0, len(x) - k)]
                for i in range(len(y)):
                    c = np.flatnonzero((s[i] >= least[i]) & (s[i] > -np.inf))
                    c = c[np.lexsort((ids[c], -s[i, c]))[:k]]
                    out.append(pd.DataFrame({"query_id": own[i], "vec_id": ids[c], "score": s[i, c]}))
        return pd.concat(out)

    keys = ("part", "block", "q_block")
    found = queries.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInPandas(
        nearest, "query_id long, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
