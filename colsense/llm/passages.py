"""Repeated passages, removed byte by byte with a family of suffix arrays.

A byte goes if it lies in a ``length``-byte string that also starts in a
document with a smaller id.  Strings are compared within suffix arrays: the
strings of a batch are sorted by their bytes, scanned in one merge against each
level of the index, and become a new level; two levels of like size merge into
one, so an index of n strings has about log2(n) levels.

Only strings that can repeat come that far.  Each window of ``length`` bytes has
an anchor, its ``GRAM``-byte string of the smallest hash; equal windows have
equal anchors.  Neighbouring windows with one anchor form a run.

1. Documents are packed into blocks, hashed one at a time, and blocks into loads,
   rows of a table in the shared folder.  A load asks for each distinct anchor of
   each of its blocks whether another document has it.  Anchors are dealt out by
   hash to parts, one row for a load and part; the answer is one byte for each.
2. Runs whose anchor repeats are dealt out by that anchor, a run once for each
   block that has it.  The task of an anchor leaves out windows whose hash no
   other window there has, builds the family of suffix arrays of the others in
   the order of ids and answers, for every window, whether an id has it that is
   smaller than the block's smallest.  An anchor that very many blocks have, such as
   a common line, would put all its surroundings into one task: its windows are
   dealt out one by one, by their own hash.  Windows of one anchor all go one
   way, so nothing is lost.
3. Each load joins its answers; its blocks take theirs in turn and mark the bytes.

What is shuffled is 5 bytes for each anchor (about 18 bytes of text), the
repeated runs, and the blocks.  Rows are loads times parts, not blocks times parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsense.llm.common import map_batches, pa_schema, ship, written

GRAM = 16
#: Stands for a null id: larger than all.
NO_ID = np.iinfo(np.int64).max
ONCE, REPEATED, COMMON = 0, 1, 2
#: Bytes of an anchor that are asked for, besides its part.  Two anchors that share
#: them count as one: more is compared then, and nothing is missed.
ASKED = 5
#: Windows that are hashed at once, so that they stay in a core's cache.
STRIDE = 1 << 15
#: Bytes of strings that a load gathers before it hands them over.
HELD = 48 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, _BACK)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Rises with ``h``, so sorted hashes lie part by part."""
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


class Block:
    """Texts side by side, with hashes of any of their strings."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes, length: int):
        self.ids, self.sizes, self.length = ids, sizes, length
        self.data = np.frombuffer(data, np.uint8)
        n = len(self.data)
        room = 1 << max(20, n.bit_length())
        self.up, self.down = (p[:n + 1] for p in _powers(room + 1))
        self.sums = np.zeros(n + 1, np.uint64)
        letters = _letters()
        for a in range(0, n, STRIDE):
            own = self.sums[a + 1:a + 1 + STRIDE]
            np.cumsum(letters[self.data[a:a + STRIDE]] * self.up[a:a + len(own)], out=own)
            own += self.sums[a]
        self.owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self._runs()

    def hash(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[start + size] - self.sums[start]) * self.down[start])

    def _runs(self, most: int = 256) -> None:
        """``start``, ``windows`` and ``anchor`` (mixed once more, to be dealt out)
        of each run, in order.  Runs of more than ``most`` windows (text that
        repeats itself) are cut.  Hashes are made for ``STRIDE`` windows at a time."""
        n = len(self.data) - self.length + 1
        if n <= 0:
            self.start = self.windows = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        ends = np.cumsum(self.sizes)
        begins = ends - self.sizes
        new = np.zeros(n, bool)
        for edge in (begins, np.maximum(begins, ends - self.length + 1)):  # of a text, and of its end that no window fits in
            new[edge[edge < n]] = True
        span, anchors, last = self.length - GRAM + 1, [], None
        for a in range(0, n, STRIDE):
            b = min(a + STRIDE, n)
            g = b + span - 1
            low, width = _mix((self.sums[a + GRAM:g + GRAM] - self.sums[a:g]) * self.down[a:g]), 1
            while width * 2 <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if span > width:
                low = np.minimum(low[:-(span - width)], low[span - width:])
            own = new[a:b]
            own[1:] |= low[1:] != low[:-1]
            own[0] |= last is None or low[0] != last
            last = low[-1]
            anchors.append(low[own])
        at, anchor = np.flatnonzero(new), np.concatenate(anchors)
        sizes = np.diff(np.append(at, n))
        whole = at + self.length <= ends[self.owner[at]]
        at, sizes, anchor = at[whole], sizes[whole], _mix(anchor[whole] + _BASE)
        pieces = -(-sizes // most)
        if (pieces > 1).any():
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            at, left, anchor = np.repeat(at, pieces) + nth * most, np.repeat(sizes, pieces) - nth * most, np.repeat(anchor, pieces)
            sizes = np.minimum(left, most)
        self.start, self.windows, self.anchor = at, sizes, anchor

    def questions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct anchors in order, whether two documents here have it, and
        which of them each run has."""
        order = np.argsort(self.anchor)
        anchors, first, at = _groups(self.anchor[order])
        if not len(first):
            return anchors, np.zeros(0, bool), at
        doc, run = self.owner[self.start[order]], np.empty(len(order), np.int64)
        run[order] = at
        return anchors, np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first), run

    def strings(self, flag: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
        """The distinct strings to be looked up, part by part: (part, start, size,
        smallest id) of each, then which place (start) has which string."""
        whole, single = flag == REPEATED, flag == COMMON
        count = self.windows[single]
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        one = np.repeat(self.start[single], count) + nth
        start = np.concatenate([self.start[whole], one])
        size = np.concatenate([self.windows[whole] + self.length - 1, np.full(len(one), self.length)])
        if not len(start):
            return (*(np.zeros(0, np.int64) for _ in range(6)),)
        key = self.hash(start, size)
        part = part_of(np.concatenate([self.anchor[whole], key[int(whole.sum()):]]), parts)
        order = np.lexsort((size, key))
        _, first, group = _groups(key[order], size[order])
        place, least = start[order], np.minimum.reduceat(self.ids[self.owner[start[order]]], first)
        first = order[first]
        by = np.argsort(part[first], kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        first = first[by]
        return part[first], start[first], size[first], least[by], place, rank[group]


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted keys: the distinct first ones, where each begins, and the group of each place."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return keys[0][first], first, np.cumsum(new) - 1


class Dealt:
    """Values that a load's blocks dealt out to parts, one block after the other:
    each block gets back its own, part by part."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], parts: int):
        """(part, values), those of a part in the order they were dealt."""
        rows = sorted(rows, key=lambda x: x[0])
        self.values = np.concatenate([np.zeros(0, np.uint8), *(v for _, v in rows)])
        sizes = np.zeros(parts, np.int64)
        np.add.at(sizes, [p for p, _ in rows], [len(v) for _, v in rows])
        self.at = np.cumsum(sizes) - sizes

    def take(self, counts: np.ndarray) -> np.ndarray:
        """``counts``: of the block's values in each part."""
        out = self.values[slices(self.at, counts)]
        self.at += counts
        return out


def slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of the bytes of all strings, one string after the other."""
    return np.repeat(start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


class SuffixLevels:
    """Suffix arrays over one buffer of bytes: places sorted by the ``length``
    bytes that start there, one place and the smallest id for each string, in
    levels of growing size.  Ids must not fall from one ``add`` to the next.

    A level keeps places, not strings.  Levels are merged in slices between
    strings that both have bounds for, so at most ``slice_rows`` strings of a
    level are held at once, whatever the strings are.
    """

    def __init__(self, data: np.ndarray, length: int, slice_rows: int = 1 << 16) -> None:
        self.view = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None
        self.length, self.slice_rows = length, slice_rows
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def strings(self, places: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.view[places]).view(f"S{self.length}").ravel()

    def _before(self, places: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """How many of the sorted ``places`` have a smaller string, for each bound."""
        low, high = np.zeros(len(bounds), np.int64), np.full(len(bounds), len(places))
        while (open_ := np.flatnonzero(low < high)).size:
            middle = (low[open_] + high[open_]) // 2
            smaller = self.strings(places[middle]) < bounds[open_]
            low[open_[smaller]], high[open_[~smaller]] = middle[smaller] + 1, middle[~smaller]
        return low

    def _merge(self, old: tuple[np.ndarray, np.ndarray], new: tuple[np.ndarray, np.ndarray]):
        """Both sorted, without repeats; the sort of a slice only merges them.
        Gives the joined level and the smallest id of each string of ``new``."""
        bounds = np.unique(self.strings(np.concatenate([x[0][self.slice_rows::self.slice_rows] for x in (old, new)])))
        cuts = [np.concatenate([[0], self._before(x[0], bounds), [len(x[0])]]) for x in (old, new)]
        least, places, ids = new[1].copy(), [], []
        for a, b, c, d in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:]):
            at = np.concatenate([old[0][a:b], new[0][c:d]])
            own = np.concatenate([old[1][a:b], new[1][c:d]])
            found = self.strings(at)
            order = np.argsort(found, kind="stable")  # equal strings: old first
            found = found[order]
            first = np.ones(len(order), bool)
            first[1:] = found[1:] != found[:-1]
            answer = np.zeros(len(order), np.int64)
            answer[order] = own[order][first][np.cumsum(first) - 1]
            least[c:d] = answer[b - a:]
            places.append(at[order][first])
            ids.append(own[order][first])
        return (np.concatenate(places), np.concatenate(ids)), least

    def add(self, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The smallest id that has the string at each place, this batch included."""
        if not len(places):
            return np.zeros(0, np.int64)
        order = np.argsort(ids, kind="stable")
        found = self.strings(places[order])
        sort = np.argsort(found, kind="stable")  # the batch's suffix array
        order, found = order[sort], found[sort]
        first = np.ones(len(order), bool)
        first[1:] = found[1:] != found[:-1]
        del found
        new = (places[order][first], ids[order][first])
        least = new[1].copy()
        for level in self.levels:
            joined, found = self._merge(level, new)
            least = np.minimum(least, found)
        answer = np.zeros(len(order), np.int64)
        answer[order] = least[np.cumsum(first) - 1]
        if self.levels and len(self.levels[-1][0]) <= 2 * len(new[0]):
            self.levels[-1] = joined
        else:
            self.levels.append(new)
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            last = self.levels.pop()
            self.levels[-1] = self._merge(self.levels[-1], last)[0]
        return answer


def _packed(docs: DataFrame, block_bytes: int, load_bytes: int) -> DataFrame:
    """Loads of blocks that travel together: a row each."""
    schema = "load long, ids binary, nulls binary, sizes binary, texts array<long>, data array<binary>, n_bytes long"  # data: Zstandard
    out = pa_schema(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        at, ids, sizes, texts, data, held, size, full = TaskContext.get().partitionId() << 32, [], [], [], [], [], 0, 0
        pack = zstandard.ZstdCompressor(level=3).compress

        def load() -> pa.RecordBatch:
            keys = np.array([NO_ID if i is None else i for i in ids], np.int64)
            return pa.RecordBatch.from_pylist([{
                "load": at, "ids": keys.tobytes(), "nulls": np.array([i is None for i in ids]).tobytes(),
                "sizes": np.array(sizes, np.int64).tobytes(), "texts": texts, "data": data, "n_bytes": full}], schema=out)

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1)):
                t = t.as_py() or b""
                if held and size + len(t) > block_bytes:
                    texts.append(len(held))
                    data.append(pack(b"".join(held)))
                    full, held, size = full + size, [], 0
                    if full >= load_bytes:
                        yield load()
                        at, ids, sizes, texts, data, full = at + 1, [], [], [], [], 0
                ids.append(i.as_py())
                sizes.append(len(t))
                held.append(t)
                size += len(t)
        if held:
            texts.append(len(held))
            data.append(pack(b"".join(held)))
            full += size
            yield load()

    return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema), "passages")


def repeated(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Whether a string may start at another of the ``places`` too: false if its hash has no like."""
    if not len(places):
        return np.zeros(0, bool)
    odd = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, -(-length // 8), np.uint64) * np.uint64(2) + np.uint64(1)
    view, hashes = np.lib.stride_tricks.sliding_window_view(data, length), np.empty(len(places), np.uint64)
    wide = np.zeros((1 << 13, 8 * len(odd)), np.uint8)
    for a in range(0, len(places), len(wide)):
        some = view[places[a:a + len(wide)]]
        wide[:len(some), :length] = some
        words = wide[:len(some)].view(np.uint64)
        total = words[:, 0] * odd[0]
        for k in range(1, len(odd)):  # between the words, else sums of other words would often be the same
            total = (total ^ (total >> np.uint64(31))) * odd[0] + words[:, k] * odd[k]
        hashes[a:a + len(some)] = _mix(total)
    found = np.sort(hashes)
    twice = np.unique(found[1:][found[1:] == found[:-1]])
    del found
    if not len(twice):
        return np.zeros(len(places), bool)
    return twice[np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)] == hashes


def remove_repeats(docs: DataFrame, length: int = 50, block_bytes: int = 2 << 20, part_bytes: int = 4 << 20,
                   common: int = 1000, batch_bytes: int = 1 << 20, load_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (array of (start, end) in bytes, the
    maximal removed runs) and ``kept`` (the other bytes) for each row of
    ``docs(doc_id, text)``.

    Texts are taken as UTF-8 bytes, null as empty; matches never cross
    documents.  Rows that repeat a doc_id do not remove each other's bytes, as
    none has a smaller id.  A null doc_id counts as larger than any, and null
    ids are equal.  Texts shorter than ``length`` stay whole.  Other columns
    are ignored; an empty table gives an empty one.

    ``length`` must be at least ``GRAM``.  ``common`` is the number of blocks
    from which on an anchor's windows are dealt out one by one.  Blocks travel in
    loads of ``load_bytes`` or little more: a load sends one row to each part.
    """
    spark = docs.sparkSession
    ship(spark)
    loads = _packed(docs, block_bytes, load_bytes)
    total = loads.agg(F.sum("n_bytes")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / part_bytes))

    def opened(batch: pa.RecordBatch, i: int) -> Iterator[Block]:
        ids, sizes = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("ids", "sizes"))
        at, unpack = 0, zstandard.ZstdDecompressor().decompress
        for n, data in zip(batch.column("texts")[i].as_py(), batch.column("data")[i]):
            yield Block(ids[at:at + n], sizes[at:at + n], unpack(data.as_py()), length)
            at += n

    def ask(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            asked = [b.questions()[:2] for b in opened(batch, i)]
            anchors, twice = (np.concatenate([a[k] for a in asked]) for k in (0, 1))
            part = part_of(anchors, parts)
            order = np.argsort(part, kind="stable")
            some, cuts = np.unique(part[order], return_index=True)
            cuts = [*cuts.tolist(), len(order)]
            short, twice = np.ascontiguousarray(anchors[order].view(np.uint8).reshape(-1, 8)[:, :ASKED]), twice[order]
            yield {"part": some, "load": np.full(len(some), batch.column("load")[i].as_py()),
                   "anchors": [short[a:b].tobytes() for a, b in zip(cuts, cuts[1:])],
                   "twice": [twice[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        sizes = [len(r["twice"]) for r in rows]
        wide = np.zeros((sum(sizes), 8), np.uint8)
        wide[:, :ASKED] = np.frombuffer(b"".join(r["anchors"] for r in rows), np.uint8).reshape(-1, ASKED)
        anchors = wide.view(np.uint64).ravel() + (np.repeat(np.array([r["part"] for r in rows], np.uint64), sizes) << np.uint64(8 * ASKED))
        twice = np.frombuffer(b"".join(r["twice"] for r in rows), bool)
        order = np.argsort(anchors)
        _, first, at = _groups(anchors[order])
        n = np.diff(np.append(first, len(order)))
        found = np.where(n >= common, COMMON, np.where((n > 1) | np.logical_or.reduceat(twice[order], first), REPEATED, ONCE))
        flag = np.empty(len(order), np.uint8)
        flag[order] = found[at]
        ends = np.cumsum(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r["load"] for r in rows], pa.int64()), pa.array([r["part"] for r in rows], pa.int32()),
             pa.array([flag[e - n:e].tobytes() for n, e in zip(sizes, ends)], pa.binary())], ["load", "part", "flags"])

    asked = map_batches(loads, ask, "part int, load long, anchors binary, twice binary", piece_rows=1)
    flags = written(asked.repartitionById(parts, "part").mapInArrow(count, "load long, part int, flags binary"), "passages-flags")
    flagged = loads.join(flags.groupBy("load").agg(F.collect_list(F.struct("part", "flags")).alias("flags")), "load", "left")

    def looked_up(batch: pa.RecordBatch, i: int) -> Iterator[tuple[Block, tuple[np.ndarray, ...]]]:
        flags = Dealt([(x["part"], np.frombuffer(x["flags"], np.uint8)) for x in batch.column("flags")[i].as_py() or ()], parts)
        for b in opened(batch, i):
            anchors, _, run = b.questions()
            yield b, b.strings(flags.take(np.bincount(part_of(anchors, parts), minlength=parts))[run], parts)

    def look_up(batch: pa.RecordBatch):
        pack = zstandard.ZstdCompressor(level=1).compress

        def rows(held: list[tuple], load: int, piece: int):
            """Of the held blocks' strings: a row for each part, blocks in order."""
            ends = [np.searchsorted(h[0], np.arange(parts + 1)) for h in held]
            out, size = [], 0
            for p in np.unique(np.concatenate([h[0] for h in held])).tolist():
                cuts = [(h, int(e[p]), int(e[p + 1])) for h, e in zip(held, ends)]
                data = b"".join(h[3][h[4][a]:h[4][b]] for h, a, b in cuts)
                out.append((p, pack(data), pack(b"".join(h[1][a:b].tobytes() for h, a, b in cuts)), pack(b"".join(h[2][a:b].tobytes() for h, a, b in cuts))))
                size += len(out[-1][1]) + len(out[-1][2]) + len(out[-1][3])
                if size >= 4 << 20:
                    yield packed(out, load, piece)
                    out, size = [], 0
            if out:
                yield packed(out, load, piece)

        def packed(out: list[tuple], load: int, piece: int) -> dict:
            return {"part": [x[0] for x in out], "load": [load] * len(out), "piece": [piece] * len(out),
                    "data": [x[1] for x in out], "sizes": [x[2] for x in out], "ids": [x[3] for x in out]}

        for i in range(batch.num_rows):
            held, size, piece, load = [], 0, 0, batch.column("load")[i].as_py()
            for b, (part, start, sizes, least, _, _) in looked_up(batch, i):
                if not len(start):
                    continue
                ends = np.concatenate([[0], np.cumsum(sizes)])
                cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1], 1 << 20))).tolist() + [len(start)]
                data = b"".join(b.data[slices(start[x:y], sizes[x:y])].tobytes() for x, y in zip(cuts, cuts[1:]))
                held.append((part, sizes.astype(np.int32), least, data, ends))
                size += len(data)
                if size >= HELD:
                    yield from rows(held, load, piece)
                    held, size, piece = [], 0, piece + 1
            if held:
                yield from rows(held, load, piece)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        unpack = zstandard.ZstdDecompressor().decompress
        sizes = [np.frombuffer(unpack(r["sizes"]), np.int32).astype(np.int64) for r in rows]
        size, ids = np.concatenate(sizes), np.concatenate([np.frombuffer(unpack(r.pop("ids")), np.int64) for r in rows])
        data = np.frombuffer(b"".join(unpack(r.pop("data")) for r in rows), np.uint8)
        start = np.cumsum(size) - size
        windows = size - length + 1
        offset = np.cumsum(windows) - windows
        # runs of equal bytes have equal answers: one of them, that with the smallest id, goes in
        order, seen, stands = np.argsort(ids, kind="stable"), {}, np.zeros(len(ids), np.int64)
        text, ends_at = data.tobytes(), (start + size).tolist()
        for i, a in zip(order.tolist(), start[order].tolist()):
            stands[i] = seen.setdefault(text[a:ends_at[i]], i)
        del seen, text, ends_at
        order, family = order[stands[order] == order], SuffixLevels(data, length)
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        may = np.zeros(int(windows.sum()), bool)
        may[slices(offset[order], windows[order])] = repeated(data, slices(start[order], windows[order]).astype(kind), length)
        least = np.repeat(ids, windows)
        cuts = np.flatnonzero(np.diff(np.cumsum(size[order]) // batch_bytes)) + 1
        for batch in np.split(order, cuts):
            at = slices(offset[batch], windows[batch])
            some = may[at]
            places = slices(start[batch], windows[batch])[some].astype(kind)
            least[at[some]] = family.add(places, np.repeat(ids[batch], windows[batch])[some])
        copies = np.flatnonzero(stands != np.arange(len(stands)))
        least[slices(offset[copies], windows[copies])] = least[slices(offset[stands[copies]], windows[copies])]
        before = least < np.repeat(ids, windows)
        ends, pack = np.cumsum([int((s - length + 1).sum()) for s in sizes]), zstandard.ZstdCompressor(level=1).compress
        begins = np.concatenate([[0], ends[:-1]])
        for r, a, e in zip(rows, begins, ends):
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["load"]], pa.int64()), pa.array([r["part"]], pa.int32()), pa.array([r["piece"]], pa.int32()),
                 pa.array([pack(before[a:e].tobytes())], pa.binary())], ["load", "part", "piece", "before"])

    wanted = map_batches(flagged, look_up, "part int, load long, piece int, data binary, sizes binary, ids binary", piece_rows=1)
    answers = (wanted.repartitionById(parts, "part").mapInArrow(index, "load long, part int, piece int, before binary")
               .groupBy("load").agg(F.collect_list(F.struct("part", "piece", "before")).alias("answers")))
    kind = "removed array<struct<start: long, end: long>>"

    def mark(batch: pa.RecordBatch):
        unpack = zstandard.ZstdDecompressor().decompress
        for i in range(batch.num_rows):
            answers = sorted(batch.column("answers")[i].as_py() or (), key=lambda x: (x["part"], x["piece"]))
            before = Dealt([(x["part"], np.frombuffer(unpack(x["before"]), np.uint8)) for x in answers], parts)
            nulls, at = np.frombuffer(batch.column("nulls")[i].as_py(), bool), 0
            for b, (part, _, size, least, place, string) in looked_up(batch, i):
                windows = size - length + 1
                own = before.take(np.bincount(part, windows, parts).astype(np.int64))
                marked = np.zeros(len(b.data), bool)
                # a string's answer holds for the smallest id here that has it; for larger ones that id is enough
                later, begin = least[string] < b.ids[b.owner[place]], (np.cumsum(windows) - windows)[string]
                for some, old in ((~later, False), (later, True)):
                    spots = slices(place[some], windows[string[some]])
                    marked[spots if old else spots[own[slices(begin[some], windows[string[some]])] != 0]] = True
                upto = np.concatenate([np.zeros(length, np.int32), np.cumsum(marked, dtype=np.int32)])
                gone = upto[length:] > upto[:-length]  # a marked string starts in the last ``length`` bytes
                ends = np.cumsum(b.sizes)
                begins = ends - b.sizes
                edge = np.zeros(len(gone) + 1, bool)  # where a run of equal bytes begins
                edge[1:-1] = gone[1:] != gone[:-1]
                edge[begins] = edge[ends] = True
                edge = np.flatnonzero(edge)
                edge, until = edge[:-1][gone[edge[:-1]]], edge[1:][gone[edge[:-1]]]
                cuts = np.searchsorted(edge, np.append(begins, len(gone))).tolist()
                doc = b.owner[edge]
                spans = [{"start": x, "end": y} for x, y in zip((edge - begins[doc]).tolist(), (until - begins[doc]).tolist())]
                kept = b.data[~gone].tobytes()
                left = np.concatenate([[0], np.cumsum(~gone)])[np.append(0, ends)].tolist()
                yield {"doc_id": [None if null else key for key, null in zip(b.ids.tolist(), nulls[at:at + len(ends)].tolist())],
                       "n_bytes": b.sizes, "removed": [spans[x:y] for x, y in zip(cuts, cuts[1:])],
                       "kept": [kept[x:y] for x, y in zip(left, left[1:])]}
                at += len(ends)

    return map_batches(flagged.join(answers, "load", "left"), mark,
                       f"doc_id long, n_bytes long, {kind}, kept binary", piece_rows=1)
