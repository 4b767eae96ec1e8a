"""What near-duplicates write: bands that one document has go no further."""

import random

import pytest
from pyspark.sql import functions as F

from colsense.llm import components, minhash


@pytest.fixture
def tables(monkeypatch):
    """The tables that the operator writes, by label."""
    found, write = {}, minhash.written

    def noted(df, label, *args, **kwargs):
        return found.setdefault(label, []).append(out := write(df, label, *args, **kwargs)) or out

    monkeypatch.setattr(minhash, "written", noted)
    monkeypatch.setattr(components, "written", noted)
    return found


@pytest.mark.parametrize("bits", [1 << 26, 64])
def test_only_bands_met_twice_are_written(spark, tables, monkeypatch, bits):
    rng = random.Random(21)
    text = [" ".join(f"w{rng.randint(0, 10 ** 6)}" for _ in range(60)) for _ in range(400)]
    rows = [*enumerate(text), (400, text[7] + " end"), (401, text[9]), (402, None), (None, "end " + text[7])]
    monkeypatch.setattr(minhash, "SIEVE", bits, raising=False)  # of 64 bits all are set: nothing is held back or lost
    got = {(r.doc_id, r.component_id, r.kept) for r in
           minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(i, {400: 7, 401: 9, None: 7}.get(i, i), i not in (400, 401, None)) for i, _ in rows}
    if bits > 64:
        # 402 nodes have 40 bands each; few nodes share some
        assert sum(t.count() for t in tables["minhash-bands"]) < 1000
        assert all(t.count() < 1000 for of in ("minhash-open", "minhash-sets") for t in tables[of])
        texts = [t for made in tables.values() for t in made if "text" in t.columns]
        assert len(texts) == 1


def test_sieve_keeps_all_that_is_found(spark):
    rows = spark.range(-5000, 5000).select("id", F.col("id").cast("string").alias("__text"))
    found = rows.where("id % 7 = 0").select("id").union(spark.sql("SELECT CAST(NULL AS BIGINT) AS id"))
    kept = [r.id for r in minhash.sieve(rows, found, "id").collect()]
    assert len(kept) == len(set(kept)) and set(range(-4998, 5000, 7)) <= set(kept) and len(kept) < 1500
    assert minhash.sieve(rows, found.limit(0), "id").count() == 0
