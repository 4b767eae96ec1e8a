"""What Python workers of the pipeline's stages hold."""

from __future__ import annotations

import numpy as np

from colsense.llm import langid, minhash


def test_fit_is_one_python_pass(spark, monkeypatch):
    # a second pass in the stage would keep a second worker for each core of an executor
    docs = spark.createDataFrame([("the cat", "en"), ("der hund", "de"), (None, "en"), ("le chat", None)], "text string, lang string")
    kind, seen = type(docs), []
    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(kind, name, lambda self, *a, f=getattr(kind, name), **b: seen.append(1) or f(self, *a, **b))
    assert langid.fit(docs).langs == ("de", "en")
    assert len(seen) == 1


def test_profiles_are_exact_sums_however_rows_are_dealt(spark):
    rows = [(f"the {chr(97 + i % 26)}{chr(0x4e00 + i)} and {i}", "en" if i % 3 else "xx") for i in range(1200)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    one, many = langid.fit(docs.coalesce(1)), langid.fit(docs.repartition(7))
    codes, counts = langid._counts([t.encode() for t, lang in rows if lang == "xx"], 3)
    whole = counts.sum(axis=0) @ langid._bound(codes, 1024, 3, 7)  # bound all at once
    assert np.array_equal(one.sums, many.sums) and one.langs == many.langs == ("en", "xx")
    assert np.array_equal(one.sums[1], whole.astype(np.int64))


def test_n_grams_are_bound_in_blocks(monkeypatch):
    sizes, bound = [], langid._bound
    monkeypatch.setattr(langid, "_bound", lambda codes, *a: sizes.append(len(codes)) or bound(codes, *a))
    codes, counts = np.arange(5000), np.random.default_rng(1).integers(0, 9, (3, 5000)).astype(np.float32)
    got = langid._vectors(codes, counts, 64, 3, 7)
    assert max(sizes) <= 2048 and np.array_equal(got, counts @ bound(codes, 64, 3, 7))


def test_few_words_are_kept():
    minhash.forget()
    minhash.shingles(" ".join(map(str, range(200_000))).encode(), 5)
    assert len(minhash._WORDS) <= 150_000
    minhash.forget()
