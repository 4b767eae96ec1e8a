"""Dynamic itemset counting against counts of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colsense.llm import collocations


def counts(rows):
    f = Counter()
    for lang, text in rows:
        low = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            w = re.findall("[^\x20\x09]+", piece)
            f.update((lang or "und", " ".join(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return f


def brute(rows, least, top):
    f = counts(rows)
    n = Counter()
    for (lang, p), c in f.items():
        n[lang] += c * (" " not in p)
    found = {(lang, p): c for (lang, p), c in f.items() if c >= least and " " in p}
    out = {}
    for (lang, p), a in found.items():
        w = p.split(" ")
        inside = any((x + 1 < len(v)) and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) and 100 * c >= 80 * a
                     for (other, q), c in found.items() if other == lang for v in [q.split(" ")] for x in [len(w) - 1] if len(v) > len(w))
        if inside:
            continue
        cuts = []
        for k in range(1, len(w)):
            left, right = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, p.encode(), left, right))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0])
                  for lang, xs in out.items() for i, x in enumerate(sorted(xs)[:top]))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = ["New", "york", "City", "é", "the", "of", "漢字", "x y", "A'b", "state", "-"]
    fixed = ["new york city hall", "the state of the", "of of of of of", "é É é"]

    def text():
        return "".join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) + rng.choice([" ", "\t", "  ", ". ", "\n", " ; ", ",", "\r\n"])
                       for _ in range(rng.randint(0, 60)))

    out = [(rng.choice(["en", "en", "en", "de", None, "und"]), text()) for _ in range(200)]
    out += [("en", "hot pair " * 500)] * 3 + [("fr", None), (None, ""), ("en", None), ("es", "rare words only")]
    return out + [("en", " ".join(rng.choice(words) for _ in range(6000)))]


def test_phrases_match_all_counts(spark, rows):
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5).select(
        "*", *(F.lit("x").alias(c) for c in ("phrase", "k", "f", "hash", "shard", "since", "part", "salt")))
    for shards, table_bits, least, top in ((4, 20, 30, 2000), (3, 16, 300, 7), (1, 16, 12, 2000)):
        got = collocations.mine(df, least=least, top=top, shards=shards, table_bits=table_bits).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, least, top)
    assert collocations.mine(df.where("false")).count() == 0


def test_frequent_phrases(spark, rows):
    frequent, words = collocations.frequent_phrases(spark.createDataFrame(rows, "lang string, text string"), least=20, table_bits=16)
    want = {k: c for k, c in counts(rows).items() if c >= 20}
    assert {(r.lang, bytes(r.phrase).decode()): r.f for r in frequent.collect()} == want
    assert {r.lang for r in words.collect()} == {"en", "de", "und", "es"}


def test_long_texts_are_cut_at_words():
    rng = random.Random(6)
    text = " ".join(rng.choice("ab") + str(rng.randint(0, 9)) for _ in range(3000)).encode()
    every = np.full(1 << 8, 255, np.uint8)
    parts = list(collocations.cut(text, 500))
    assert len(parts) > 10 and b"".join(p for p, _ in parts) == text
    got = Counter()
    for own, ahead in parts:
        for c in collocations.count_chunk([("en", own, ahead)], collocations.Bits(every), None):
            if c["k"][0]:
                got.update(dict(zip([("en", x.decode()) for x in c["phrase"].to_pylist()], c["f"].tolist())))
    assert got == counts([("en", text.decode())])
    assert list(collocations.cut(b"a" * 100, 10)) == [(b"a" * 100, b"")]


def test_each_phrase_is_counted_for_one_circle(rows):
    """The counts of all steps are those of all phrases that were active."""
    least, shards, size = 20, 3, 1 << 20
    chunks = [[(lang or "und", (t or "").encode(), b"") for lang, t in rows[i::shards]] for i in range(shards)]
    bits, table, got = [np.zeros(size // 8, np.uint8)], np.zeros(size, np.int64), Counter()
    for step in range(4 * shards):
        now, before = collocations.Bits(bits[step]), collocations.Bits(bits[max(0, step - shards)])
        for hashes, f in collocations.count_chunk(chunks[step % shards], now, before, step < shards):
            got.update(dict(zip(hashes.tolist(), f.tolist())))
            np.add.at(table, (hashes >> now.shift).astype(np.int64), f)
        bits.append(np.packbits(table >= least, bitorder="little"))
    assert np.array_equal(bits[-1][:size // 16], bits[-1 - shards][:size // 16])
    want = counts(rows)
    assert len(want) > len(got)  # not all phrases were ever active
    every = np.full(size // 8, 255, np.uint8)
    chunk = [c for part in chunks for c in part]
    for hashes, f in collocations.count_chunk(chunk, collocations.Bits(every), collocations.Bits(bits[0]), True):
        for h, c in zip(hashes.tolist(), f.tolist()):
            assert got.get(h, c) == c
            assert c < least or h in got


def test_a_bit_set_too_early_ends_no_phrase():
    """The counter of "b c" is full from the start, by other phrases; "a b c" is active
    only once the words are, so it is not done a circle after that bit, but after theirs."""
    chunk, size = [("en", b"a b c. " * 9, b"")], 1 << 20
    words, none = np.full(size // 8, 255, np.uint8), np.zeros(size // 8, np.uint8)
    every, nothing = collocations.Bits(words), collocations.Bits(none)
    found = [dict(zip(h.tolist(), f.tolist())) for h, f in collocations.count_chunk(chunk, every, nothing, True)]
    assert [len(x) for x in found] == [3, 2, 1]  # words, pairs, "a b c"
    early = none.copy()
    for h in found[1]:
        at = int(h) >> int(nothing.shift)
        early[at >> 3] |= 1 << (at & 7)
    got = {}
    for h, f in collocations.count_chunk(chunk, every, collocations.Bits(early)):
        got |= dict(zip(h.tolist(), f.tolist()))
    assert got == found[1] | found[2]


def test_counters():
    rng = np.random.Generator(np.random.PCG64(8))
    for most in (30, 1000):
        one, want = collocations.Counters(most), np.zeros(3 * collocations.PAGE, np.int64)
        for size in (10, 200000, 500):
            slots, f = rng.integers(0, len(want), size), rng.integers(1, 20, size)
            one.add_slots(slots, f)
            np.add.at(want, slots, f)
        other = collocations.Counters(most)
        for page, slots, f in one.rows():
            other.add(page, np.frombuffer(slots, np.uint16), np.frombuffer(f, one.kind))
        got = np.concatenate([other.pages[i] for i in range(3)])
        assert (got == np.minimum(want, most)).all()
