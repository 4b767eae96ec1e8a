"""Byte-level BPE as a lazily determinised transducer.

Merging by ranks has a left-to-right form: every prefix of a piece has one
encoding, whose last token is the only vocabulary suffix that fits the last
token of the prefix before it.  Two tokens fit if merging their joined bytes
gives these two tokens again.  The transducer reads the bytes once.  Its state
holds the live positions (those after which the bytes so far begin a longer
token) by these bytes; the last token before each is among the tokens that have
ended so far.  The arc over a byte has the tokens that can end there, and that
which fits the last token before it does.  A token start that all live positions
share can't change any more, so everything before it is emitted; a live position
is less than ``max_len`` bytes back, so the wait is bounded.

States and arcs are made when first met and kept (up to ``max_states``; then
the table starts anew, which costs time and changes nothing).  No token is part
of a state, so there are few of them, whatever the text.  ``Decoder`` turns ids
back into text block by block and holds back what does not end a character.
"""

from __future__ import annotations

import base64
import codecs
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.llm.common import map_batches, slices


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes -> rank, of lines that hold a base64 token and its rank."""
    return {base64.b64decode(t): int(r) for t, r in map(bytes.split, filter(bytes.strip, data.splitlines()))}


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return parse_ranks(f.read())


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Encoding of ``piece`` by its definition: merge the adjacent pair of the
    lowest rank, leftmost first, until none is in the vocabulary."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks),
                   default=None)
        if best is None:
            break
        i = best[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """Bytes of one piece -> ids, one byte at a time."""

    #: Pieces of more bytes than this are encoded by ``stream``.
    WALK = 4096
    #: Pairs of tokens whose fit is remembered: one by one, and by hash for whole arrays.
    FITS, FIT_BITS = 200_000, 20

    def __init__(self, ranks: dict[bytes, int], max_states: int = 30_000):
        self.ranks = ranks
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.size_of = {r: len(t) for t, r in ranks.items()}
        self.max_len = max(map(len, ranks))
        self.max_states = max_states
        #: Beginnings of tokens, numbered from the empty one (0): (node, byte) -> node, and for each node
        #: its token, its length and whether a longer token begins so.
        self._child: dict[int, int] = {}
        self._token, self._size, self._more = [None], [0], [True]
        for t in sorted(ranks):
            node = 0
            for byte in t:
                self._more[node] = True
                at = node << 8 | byte
                node = self._child.get(at)
                if node is None:
                    node = self._child[at] = len(self._token)
                    self._token.append(ranks.get(t[:self._size[at >> 8] + 1]))
                    self._size.append(self._size[at >> 8] + 1)
                    self._more.append(False)
        #: token -> token before it -> whether they fit
        self._fits: dict[int, dict[int, bool]] = {}
        self._n_fits = 0
        self._pair = np.full(1 << self.FIT_BITS, -1, np.int64)
        self._pair_fits = np.zeros(1 << self.FIT_BITS, bool)
        self._sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        self._sizes[list(ranks.values())] = list(map(len, ranks))
        self._spines: dict[int, tuple[list[tuple[int, int]], list[tuple[int, int]]]] = {}
        self._reset()

    def _reset(self) -> None:
        self._ids: dict[tuple[int, ...], int] = {}
        self._states: list[tuple[int, ...]] = []
        self._arcs: dict[int, tuple[int, tuple[tuple[int, int, dict[int, bool]], ...], int]] = {}
        self.start = self._state((0,))
        #: The same arcs as arrays: state | byte -> number + 1 of the arc; of each arc the next
        #: state, the shortest token, how many longer ones and where in ``_longer`` they are.
        self._number = np.zeros(1 << 16, np.int32)
        self._table = np.zeros((4, 1 << 12), np.int64)
        self._longer = np.zeros(1 << 12, np.int64)
        self._n_arcs = self._n_longer = 0

    def _state(self, live: tuple[int, ...]) -> int:
        """The number, times 256, of the state with these live positions, each
        the node of the bytes since."""
        found = self._ids.get(live)
        if found is None:
            found = self._ids[live] = len(self._states) << 8
            self._states.append(live)
        return found

    def _edges(self, token: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """What can border on a neighbour while ``token`` is being merged: at
        its left and its right edge, (rank of the merge that ends it, part)."""
        found = self._spines.get(token)
        if found is None:
            parts = [bytes([x]) for x in self.bytes_of[token]]
            left, right = [], []
            while len(parts) > 1:
                rank, i = min((self.ranks.get(x + y, 1 << 40), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if i == 0:
                    left.append((rank, self.ranks[parts[0]]))
                if i == len(parts) - 2:
                    right.append((rank, self.ranks[parts[-1]]))
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            left.append((1 << 40, token))
            right.append((1 << 40, token))
            found = self._spines[token] = (left, right)
        return found

    def _fit(self, a: int, b: int) -> bool:
        """No merge across the border of ``a`` and ``b`` comes before the merges
        that take its two sides away; -1 is no token.  Of equal ranks the leftmost goes first:
        one inside ``a`` before the border, the border before one inside ``b``."""
        if a < 0:
            return True
        known = self._fits.setdefault(b, {})
        found = known.get(a)
        if found is None:
            rights, lefts, i, j, found = self._edges(a)[1], self._edges(b)[0], 0, 0, True
            while True:
                (end_a, x), (end_b, y) = rights[i], lefts[j]
                border = self.ranks.get(self.bytes_of[x] + self.bytes_of[y])
                if border is not None and border < end_a and border <= end_b:
                    found = False
                    break
                if end_a >= 1 << 40 and end_b >= 1 << 40:
                    break
                if end_a <= end_b:
                    i += 1
                else:
                    j += 1
            if self._n_fits >= self.FITS:
                for one in self._fits.values():
                    one.clear()
                self._n_fits = 0
            self._n_fits += 1
            known[a] = found
        return found

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[tuple[int, int, dict[int, bool]], ...], int]:
        """The next state, and the tokens that can end after ``byte``: the longer
        ones with their sizes and known fits, longest first, and the shortest."""
        ends, live = [], []
        for position in self._states[state >> 8]:
            node = self._child.get(position << 8 | byte)
            if node is not None:
                token = self._token[node]
                if token is not None:
                    ends.append((token, self._size[node], self._fits.setdefault(token, {})))
                if self._more[node]:
                    live.append(node)
        live.append(0)
        arc = self._arcs[state | byte] = (self._state(tuple(live)), tuple(ends[:-1]), ends[-1][0])
        return arc

    def _walk(self, state: int, chunk: bytes, ended: list[int]) -> int:
        """The state after ``chunk``; adds to ``ended`` the token that ends after
        each byte.  ``ended`` begins with the token before all others (-1 at the
        start of a piece) and goes back as far as live positions need.  Of the
        tokens that can end at a place one fits: the shortest if no other does."""
        arcs, at = self._arcs, len(ended)
        for byte in chunk:
            state, longer, token = arcs.get(state | byte) or self._arc(state, byte)
            for one, size, known in longer:
                before = ended[at - size]
                fit = known.get(before)
                if fit or fit is None and self._fit(before, one):
                    token = one
                    break
            ended.append(token)
            at += 1
        return state

    def encode(self, piece: bytes) -> list[int]:
        """All ids of ``piece``: one walk to its end, then back along the tokens;
        of a long piece each id as soon as it is sure."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        if len(piece) > self.WALK:
            return list(self.stream((piece,)))
        if len(self._states) > self.max_states:
            self._reset()
        ended = [-1]
        self._walk(self.start, piece, ended)
        return self._walk_back(ended, len(piece))[::-1]

    def _numbers(self, at: np.ndarray) -> np.ndarray:
        """The numbers of the arcs ``state | byte``; new ones are entered."""
        found = self._number[at] - 1
        if (found < 0).any():
            for x in np.unique(at[found < 0]).tolist():
                to, longer, token = self._arcs.get(x) or self._arc(x & ~255, x & 255)
                if len(self._number) <= to | 255:
                    self._number = np.concatenate([self._number, np.zeros(max(len(self._number), to), np.int32)])
                if self._n_arcs == self._table.shape[1]:
                    self._table = np.concatenate([self._table, np.zeros_like(self._table)], axis=1)
                if self._n_longer + len(longer) > len(self._longer):
                    self._longer = np.concatenate([self._longer, np.zeros(len(self._longer) + len(longer), np.int64)])
                self._table[:, self._n_arcs] = to, token, len(longer), self._n_longer
                self._longer[self._n_longer:self._n_longer + len(longer)] = [x for x, _, _ in longer]
                self._n_longer += len(longer)
                self._n_arcs += 1
                self._number[x] = self._n_arcs
            found = self._number[at] - 1
        return found

    def _fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """``_fit`` of each pair.  A pair forgets another one at its place in the table."""
        key = a << 32 | b
        at = key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.FIT_BITS)
        out = self._pair_fits[at] | (a < 0)
        new = np.flatnonzero((self._pair[at] != key) & (a >= 0))
        if len(new):
            _, first, same = np.unique(key[new], return_index=True, return_inverse=True)
            first = new[first]
            fits = np.fromiter(map(self._fit, a[first].tolist(), b[first].tolist()), bool, len(first))
            self._pair[at[first]], self._pair_fits[at[first]] = key[first], fits
            out[new] = fits[same]
        return out

    def encode_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has.  All
        pieces take a byte at a time together; none may be empty or long, as
        the tokens that end are a matrix [piece, byte]."""
        if len(self._states) > self.max_states:
            self._reset()
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-size, kind="stable")
        data, begin, n = np.frombuffer(b"".join(pieces), np.uint8), (np.cumsum(size) - size)[order], size[order]
        ended = np.full((len(n), n.max(initial=0) + 1), -1, np.int64)
        state = np.full(len(n), self.start)
        for i, m in enumerate(np.searchsorted(-n, -np.arange(n.max(initial=0))), 1):
            arc = self._numbers(state[:m] | data[begin[:m] + i - 1])
            state, token, longer, first = self._table[:, arc]
            at, step = np.flatnonzero(longer), 0
            while len(at):
                one = self._longer[first[at] + step]
                fits = self._fit_all(ended[at, i - self._sizes[one]], one)
                token[at[fits]] = one[fits]
                at, step = at[~fits], step + 1
                at = at[longer[at] > step]
            ended[:m, i] = token
        stay, at, end = np.zeros(ended.shape, bool), np.arange(len(n)), n
        while len(at):  # back along the tokens
            stay[at, end] = True
            end = end - self._sizes[ended[at, end]]
            at, end = at[end > 0], end[end > 0]
        ids, count = ended[stay], np.zeros(len(n), np.int64)
        sorted_count = stay.sum(axis=1)
        count[order] = sorted_count
        first = np.zeros(len(n), np.int64)
        first[order] = np.cumsum(sorted_count) - sorted_count
        return ids[np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(ids))], count

    def _walk_back(self, ended: list[int], end: int) -> list[int]:
        out, size_of = [], self.size_of
        while end > 0:
            token = ended[end]
            out.append(token)
            end -= size_of[token]
        return out

    def stream(self, chunks: Iterable[bytes]) -> Iterator[int]:
        """Ids of one piece that comes in chunks, each as soon as no later byte
        can change it.  Holds at most the bytes since the last sure token, and
        little more than ``max_states`` states."""
        ended, state = [-1], self.start
        for chunk in chunks:
            for at in range(len(chunk)):
                if len(self._states) > self.max_states:
                    live = self._states[state >> 8]
                    self._reset()
                    state = self._state(live)
                state = self._walk(state, chunk[at:at + 1], ended)
                starts = {len(ended) - 1 - self._size[node] for node in self._states[state >> 8]}
                while len(starts) > 1:  # the furthest goes back by one token, until all meet
                    end = max(starts)
                    starts.discard(end)
                    starts.add(end - self.size_of[ended[end]])
                sure = starts.pop()
                if sure:
                    yield from self._walk_back(ended, sure)[::-1]
                    del ended[:sure]
        yield from self._walk_back(ended, len(ended) - 1)[::-1]


class Encoder:
    """Whole texts -> ids: splits by ``pattern``, encodes each match alone.

    No match of the pattern holds a character that is not white space followed
    by one that is, and no rule looks behind, so the text falls into parts
    (white space, then the rest up to the next white space) that can be encoded
    independently.  Ids of recent parts are kept: those met last, up to
    ``max_parts``, and as many from before.
    """

    #: White space as the pattern's \\s has it; re's own \\s has other control characters too.
    _W = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    PART = re.compile(rf"[{_W}]*+[^{_W}]++|[{_W}]++")

    #: Pieces of more bytes than this are walked one by one.
    TOGETHER = 64

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_parts: int = 120_000, keep_len: int = 64):
        self.transducer = Transducer(ranks)
        self.split = regex.compile(pattern)
        self.max_parts = max_parts
        self.keep_len = keep_len
        #: The ids, as 32-bit numbers, of each part met; those from before.
        self.parts: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn(self, parts: list[str]) -> None:
        """Enter the ids of ``parts``."""
        cut = list(map(self.split.findall, parts))
        pieces = [x.encode("utf-8") for one in cut for x in one]
        tokens = list(map(self.transducer.ranks.get, pieces))
        walked = [i for i, token in enumerate(tokens) if token is None]
        near = [i for i in walked if len(pieces[i]) <= self.TOGETHER]
        far = [i for i in walked if len(pieces[i]) > self.TOGETHER]
        near_ids, n = self.transducer.encode_all([pieces[i] for i in near])
        far_ids = [self.transducer.encode(pieces[i]) for i in far]
        count, kind = np.ones(len(pieces), np.int64), np.zeros(len(pieces), np.int8)
        count[near], kind[near] = n, 1
        count[far], kind[far] = list(map(len, far_ids)), 2
        kind = np.repeat(kind, count)
        out = np.empty(len(kind), np.int32)
        out[kind == 0] = [token for token in tokens if token is not None]
        out[kind == 1], out[kind == 2] = near_ids, list(chain.from_iterable(far_ids))
        data = out.tobytes()
        ends = 4 * np.append(0, np.cumsum(count))[np.cumsum(list(map(len, cut)))]
        start = 0
        for part, end in zip(parts, ends.tolist()):
            self.parts[part] = data[start:end]
            start = end

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.  New parts of all texts are encoded together."""
        cut = list(map(self.PART.findall, texts))
        if len(self.parts) >= self.max_parts:
            self.before, self.parts = self.parts, {}
        new = []
        for part in set().union(*cut).difference(self.parts):
            found = self.before.get(part)
            if found is None:
                new.append(part)
            else:
                self.parts[part] = found
        if new:
            self._learn(new)
        out = [np.frombuffer(b"".join(map(self.parts.__getitem__, x)), np.int32) for x in cut]
        for part in new:
            if len(part) > self.keep_len:
                del self.parts[part]
        return out


class Decoder:
    """Ids -> text, block by block; holds back the bytes of a character that
    is not complete.  Bytes that can't be part of one become U+FFFD, one for
    each longest beginning of a character."""

    def __init__(self, ranks: dict[bytes, int]):
        self._size = np.zeros(max(ranks.values()) + 1, np.int64)
        self._size[list(ranks.values())] = list(map(len, ranks))
        self._end = np.cumsum(self._size)
        self._flat = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens, joined: each taken at its place in ``_flat``."""
        size = self._size[ids]
        ends = np.cumsum(size)
        return self._flat[np.repeat(self._end[ids] - ends, size) + np.arange(size.sum())].tobytes()

    def stream(self, ids: Iterable[int], block: int = 1 << 16) -> Iterator[str]:
        """Text as it becomes certain; the last piece closes the stream."""
        held, at, rest = b"", 0, iter(())
        if not isinstance(ids, np.ndarray):
            rest = iter(ids)
            ids = np.fromiter(islice(rest, block), np.int64)
        while len(ids):
            raw = held + self.decode_bytes(ids[at:at + block])
            text, used = codecs.utf_8_decode(raw, "replace", False)
            held, at = raw[used:], at + block
            if text:
                yield text
            if at >= len(ids):
                at, ids = 0, np.fromiter(islice(rest, block), np.int64)
        if held:
            yield held.decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _codec(data: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """One pair for each Python worker, so that states outlive a task."""
    ranks = parse_ranks(data)
    return Encoder(ranks, pattern), Decoder(ranks)


def forget() -> None:
    """Drop what this worker keeps between tasks."""
    _codec.cache_clear()


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, text: Column | str = "text",
                  keep: tuple[str, ...] = ("doc_id",), decode: bool = True) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and, with ``decode``, ``decoded``:
    the text that the ids give back through the streaming decoder.

    ``vocabulary`` is a rank file that the driver can read (a vocabulary has a
    fixed size; its bytes are broadcast).  Special tokens have no role: their
    strings are ordinary text.  Null and empty texts give no ids and the empty
    text.  Bytes that are not UTF-8 count as U+FFFD.  Each row stands alone, so
    repeated rows and null ids are kept as they are; other columns are ignored.
    One narrow pass: no shuffle, and a lost task is simply run again.
    """
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batch: pa.RecordBatch):
        encoder, decoder = _codec(data.value, pattern)
        texts = [raw.decode("utf-8", "replace") if raw else "" for raw in batch.column("__text").to_pylist()]
        found = [ids for a, b in slices(texts, 2_000_000) for ids in encoder.encode_all(texts[a:b])]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(ends, np.concatenate([np.zeros(0, np.int32), *found]))
        decoded = {"decoded": ["".join(decoder.stream(x)) for x in found]} if decode else {}
        yield {c: batch.column(c) for c in keep} | {"ids": ids} | decoded

    text = F.col(text) if isinstance(text, str) else text
    rows = docs.select(*keep, text.cast("binary").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, run, f"{kept}, ids array<int>" + ", decoded string" * decode, piece_rows=512)
