"""Collision counting on projections against all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from colsense.llm import projections


def brute(rows, cosine):
    good = []
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            a = a / np.abs(a).max()
            good.append((i, label, a / np.linalg.norm(a)))
    links, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, li, a) in enumerate(good):
        for j, lj, b in good[:k]:
            if li == lj and len(a) == len(b) and a @ b >= cosine:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least.setdefault(find(i), []).append(r[0])
    out = []
    for i, r in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        own = min(ids) if ids else None
        out.append((str(r[0]), links[i], str(own), r[0] == own))
    return sorted(out)


def vectors():
    rng = np.random.Generator(np.random.PCG64(3))
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] * 10 ** (i % 3) + 10 ** (i % 3) * rng.normal(size=24) * (0.1 + 0.25 * (i % 5 == 0))).tolist(), i % 2) for i in range(300)]
    rows += [(300 + i, rng.normal(size=24).tolist(), 1) for i in range(200)]
    rows += [(600 + i, rows[1][1], 1) for i in range(150)] + [(601, rows[1][1], 1), (None, rows[1][1], 1), (None, rows[2][1], None)]
    rows += [(700, None, 1), (701, [], 1), (702, [0.0] * 24, 1), (703, [None] + [1.0] * 23, 1), (704, [math.nan] + [1.0] * 23, 1),
             (705, [math.inf] + [1.0] * 23, 1), (706, [1.0, 2.0], 1), (707, [2.0, 4.0], 1), (708, [1e300, 1e300], 1), (709, [1e-300, 1e-300], 1),
             (-5, [-1.0, -2.0], 1), (711, [1.0, 2.0], 0)]
    return rows


def test_links_match_all_pairs(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select(
        "*", *(F.lit(1).alias(c) for c in ("row", "node", "lead", "weight", "block", "dim", "links", "component")))
    want = brute(rows, 0.93)
    for block_rows in (2048, 70):  # one tile a label, and many
        got = projections.links(df, block_rows=block_rows).collect()
        assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in got) == want
    assert projections.links(df.where("false")).count() == 0
    alone = projections.links(df.where("embedding IS NULL")).collect()
    assert [(r.vec_id, r.n_links, r.component_id, r.kept) for r in alone] == [(700, 0, 700, True)]


def test_calibration():
    half, least = projections.calibrate(math.sqrt(2 - 2 * 0.93), 48, 1.4, 1e-6)
    p = math.erf(1.4 / math.sqrt(2))
    below = sum(math.comb(48, i) * p ** i * (1 - p) ** (48 - i) for i in range(least))
    assert below <= 1e-6 < below + math.comb(48, least) * p ** least * (1 - p) ** (48 - least)
    assert abs(math.erfc(projections.reach(1e-6) / math.sqrt(2)) - 1e-6) < 1e-9
    # vectors right at the threshold, in many directions
    rng = np.random.Generator(np.random.PCG64(4))
    a = projections.unit(rng.normal(size=(4000, 32)))
    b = rng.normal(size=(4000, 32))
    b = projections.unit(b - (a * b).sum(1)[:, None] * a)
    b = 0.93 * a + math.sqrt(1 - 0.93 ** 2) * b
    along = projections.directions(32, 48, 21)
    assert ((np.abs(a @ along - b @ along) <= half).sum(1) >= least).all()
    # few of the pairs that are unlike are compared exactly
    far = rng.permutation(4000)
    assert ((np.abs(a @ along - a[far] @ along) <= half).sum(1) >= least)[far != np.arange(4000)].mean() < 0.01
