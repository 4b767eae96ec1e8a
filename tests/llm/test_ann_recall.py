import numpy as np
import pytest
from pyspark.sql import functions as F

from colsense.llm import ann


def vectors(kind: str, rows: int, dim: int = 24) -> np.ndarray:
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, dim))[rng.integers(0, 60, rows)] + 0.4 * rng.normal(size=(rows, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * rng.lognormal(0, 1, (rows, 1)) if kind == "unequal" else x


@pytest.mark.parametrize("kind", ["unit", "unequal"])
def test_recall_where_most_rows_are_not_in_the_sample(spark, monkeypatch, kind):
    x, tables, write = vectors(kind, 8000), {}, ann.written
    monkeypatch.setattr(ann, "written", lambda df, label: tables.setdefault(label, write(df, label)))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.search(df, F.col("vec_id") % 50 == 0, part_rows=250, sample_rows=1024).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 50):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & got[q])
    sizes = {r["part"]: r["count"] for r in tables["ann-routed"].groupBy("part").count().collect()}
    visited = sum(sizes.get(r["part"], 0) for r in tables["ann-asked"].collect()) / len(x) / len(got)
    assert len(sizes) > 8 and all(len(g) == 20 for g in got.values())
    assert hits >= 0.9 * 20 * len(got)
    assert visited < 0.6
