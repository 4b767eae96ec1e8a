"""Repeated passages when many blocks travel together."""

import random

import numpy as np
import pytest

from colsense.llm import passages


def rows_of(seed=4, n=120):
    rng = random.Random(seed)
    long = ["".join(rng.choice("abc dé") for _ in range(rng.randint(40, 160))) for _ in range(8)]
    return [(rng.choice([None, *range(90)]), "".join(rng.choice(long + ["x", "yz "] * 6) for _ in range(rng.randint(0, 12)))) for _ in range(n)]


def brute(rows):
    key, first, out = (lambda i: 1 << 62 if i is None else i), {}, []
    for i, t in rows:
        b = t.encode()
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(first.get(b[k:k + 50], 1 << 63), key(i))
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            gone[k:k + 50] |= first[b[k:k + 50]] < key(i)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((str(i), len(b), edge.tolist(), np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out)


@pytest.mark.parametrize("held", [1, 2000])
def test_a_load_sends_one_row_to_each_part(spark, monkeypatch, held):
    rows, counts, write = rows_of(), {}, passages.written

    def written(df, label, **more):
        out = write(df, label, **more)
        counts[label] = out.count()
        return out

    monkeypatch.setattr(passages, "written", written)
    monkeypatch.setattr(passages, "HELD", held, raising=False)  # several pieces of a load, too
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    out = passages.remove_repeats(df, block_bytes=300).collect()
    assert sorted((str(r.doc_id), r.n_bytes, [x for s in r.removed for x in (s.start, s.end)], bytes(r.kept)) for r in out) == brute(rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sum(len(t.encode()) for _, t in rows) > 60 * 300  # so there are more than 30 blocks
    assert counts["passages-flags"] <= 2 * parts  # one row for each task and part, not for each block and part


def test_loads_are_bounded(spark):
    rows, sizes = rows_of(5, 60), []
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    packed = passages._packed(df, 300, 1500)
    for r in packed.collect():
        sizes.append(r.n_bytes)
        assert sum(r.texts) == len(bytes(r.sizes)) // 8 == len(bytes(r.nulls)) and len(r.texts) == len(r.data)
    assert sum(sizes) == sum(len(t.encode()) for _, t in rows) and len(sizes) > 2
    out = passages.remove_repeats(df, block_bytes=300, load_bytes=1500).collect()
    assert sorted((str(r.doc_id), r.n_bytes, [x for s in r.removed for x in (s.start, s.end)], bytes(r.kept)) for r in out) == brute(rows)


@pytest.mark.parametrize("stride", [1, 7, 64, 1 << 15])
def test_runs_do_not_depend_on_the_stride(monkeypatch, stride):
    texts = [t.encode() for _, t in rows_of(6)] + [b"", b"a" * 3000, b"b" * 49]
    sizes = np.array([len(t) for t in texts])
    whole = passages.Block(np.arange(len(texts)), sizes, b"".join(texts), 50)
    monkeypatch.setattr(passages, "STRIDE", stride)
    block = passages.Block(np.arange(len(texts)), sizes, b"".join(texts), 50)
    for name in ("sums", "start", "windows", "anchor"):
        assert (getattr(block, name) == getattr(whole, name)).all()
    assert block.windows.sum() == np.maximum(sizes - 49, 0).sum() and block.windows.max() <= 256
    ends = np.cumsum(sizes)[block.owner[block.start]]
    assert (block.start + block.windows + 49 <= ends).all()


def test_strings_that_start_at_one_place_only_are_told_apart():
    rng = np.random.default_rng(3)
    for length in (16, 23, 50):
        data = rng.integers(97, 100, 4000).astype(np.uint8)
        data[2000:2300] = data[100:400]
        places = rng.permutation(len(data) - length + 1)[:3000].astype(np.int32)
        strings = [data[p:p + length].tobytes() for p in places]
        want = [strings.count(x) > 1 for x in strings]
        assert passages.repeated(data, places, length).tolist() == want
    assert passages.repeated(data, places[:0], 50).tolist() == []


def test_each_block_gets_its_own_values_back():
    rng, parts = np.random.default_rng(2), 7
    blocks = [(np.sort(rng.integers(0, parts, n)), rng.integers(0, 200, n).astype(np.uint8)) for n in (30, 0, 5, 60)]
    rows = [(p, np.concatenate([v[at == p] for at, v in blocks])) for p in rng.permutation(parts).tolist()]
    dealt = passages.Dealt(rows, parts)
    for at, v in blocks:
        assert dealt.take(np.bincount(at, minlength=parts)).tolist() == v.tolist()
