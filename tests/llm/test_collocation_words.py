"""Collocations: texts are split once, and what is done or not active is not sorted again."""

from collections import Counter

import numpy as np
import pytest
from test_collocations import counts, rows  # noqa: F401

from colsense.llm import collocations
from colsense.llm.common import pa_schema


def chunk_of(rows):
    return [(lang or "und", (t or "").encode(), b"") for lang, t in rows]


def bits(fill):
    return collocations.Bits(np.full(1 << 16, fill, np.uint8))


def test_phrases_that_are_done_are_not_sorted(rows, monkeypatch):  # noqa: F811
    chunk, every, none = chunk_of(rows) * 3, bits(255), bits(0)
    assert [len(h) for h, _ in collocations.count_chunk(chunk, every, none, True)][0] > 0

    def sort(*a, **b):
        raise AssertionError("sorted")

    monkeypatch.setattr(np, "unique", sort)
    assert list(collocations.count_chunk(chunk, every, every)) == []
    assert list(collocations.count_chunk(chunk, none, none)) == []


def test_words_come_back_from_their_row(rows):  # noqa: F811
    words = collocations.split([*chunk_of(rows), ("en", b"tail of", b" a cut text")])
    back = collocations.from_row(*collocations.to_row(words))
    for name, a, b in zip(words._fields, words, back):
        assert a.equals(b) if name == "names" else list(a) == list(b), name
    assert collocations.split([("en", b" .,\n", b""), ("de", b"", b"")]) is None


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_exact_counts_go_by_the_bytes_of_phrases(spark, rows, parts, monkeypatch):  # noqa: F811
    every, schema, sent = bits(255), pa_schema(spark, collocations.FOUND), []
    chunks = [chunk_of(rows[i::4]) for i in range(4)]
    for two in (chunks[:2], chunks[2:]):
        found = []
        for chunk in two:
            for c in collocations.count_words(collocations.split(chunk), every, None):
                if parts == 3:  # as if the hashes of all were the same
                    c["part"] = np.zeros(len(c["k"]), np.uint64)
                found.append(c)
        batches = list(collocations._dealt(found, parts, schema))
        sent.append([r for b in batches for r in b.to_pylist()])
    assert all(len(rows) <= parts and len({r["part"] for r in rows}) == len(rows) for rows in sent)  # one row for a part
    got, want = Counter(), counts(rows)
    for part in range(parts):
        for c in collocations._totals([r for rows in sent for r in rows if r["part"] == part], 2):
            for lang, k, phrase, f in zip(c["lang"].to_pylist(), c["k"].tolist(), c["phrase"].to_pylist(), c["f"].tolist()):
                assert (lang, k, phrase) not in got
                got[lang, k, phrase] = f
    n = Counter()
    for (lang, p), f in want.items():
        n[lang, 0, b""] += f * (" " not in p)
    n = {x: got[x] for x in got if x[1] == 0 and not n[x] and got[x] == 0} | n  # languages without a word
    assert got == {(lang, p.count(" ") + 1, p.encode()): f for (lang, p), f in want.items() if f >= 2} | n
    assert list(collocations._totals([], 2)) == []


def test_small_pieces_of_an_exact_scan(spark, rows, monkeypatch):  # noqa: F811
    monkeypatch.setattr(collocations, "HELD", 1)
    monkeypatch.setattr(collocations, "CHUNK", 2000)
    df = spark.createDataFrame(rows, "lang string, text string").coalesce(2)
    frequent, words = collocations.frequent_phrases(df, least=20, table_bits=16)
    want = counts(rows)
    assert {(r.lang, bytes(r.phrase).decode()): r.f for r in frequent.collect()} == {k: c for k, c in want.items() if c >= 20}
    n = Counter()
    for (lang, p), f in want.items():
        n[lang] += f * (" " not in p)
    assert {r.lang: r.n for r in words.collect()} == {x: f for x, f in n.items() if f}
