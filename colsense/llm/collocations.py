"""Collocations by dynamic itemset counting.

The texts are split into words once and dealt into shards, a table of chunks with
their words numbered; each step scans one shard, in a circle.
Words are counted from the first step on.  A longer phrase is counted from the
step after both phrases that it has one word less than (without its last word,
without its first) reached the threshold, so several lengths are counted in one
scan.  A phrase is done after one full circle, which met every shard once.

These counts are kept in ``2 ** table_bits`` counters, a phrase in that of its
hash.  A counter holds at least what its phrases occur, so none that reaches the
threshold is missed, and phrases that meet in one only make more phrases active.
Tasks get one bit a counter (has it reached the threshold?), as it was before a
step and as it was a circle ago: a phrase is active if both subphrases, and all
that these depend on, are in the first, and done if they are in the second.  (A
subphrase alone may be in the bits too early, by others that share its counter.)
When no phrase is active any more, one scan counts those exactly that are in the
bits, by their words: chunks send them side by side, one row for each part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsense.llm.common import pa_schema, ship, written

LONGEST = 4
COUNTS = "lang string, k int, phrase binary, f long"
#: A chunk in words, packed by Zstandard.
WORDS = ("shard int, langs array<string>, names binary, sizes binary, of_unit binary, lang binary, unit binary, own binary, "
         "together binary, n_bytes long")
#: Exact counts on their way: phrases side by side.
FOUND = "part int, langs array<string>, lang binary, k binary, sizes binary, phrases binary, f binary"
#: Phrases, in bytes, that an exact scan holds before it hands them over.
HELD = 24 << 20
#: Counters of a page, numbered by 16 bits.
PAGE = 1 << 16
PAGES = "page int, slots binary, counts binary"
#: Text that a task holds at once, in bytes.
CHUNK = 1 << 23

_BLANKS, _BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Per byte: 0 in a word, 1 between words, 2 between pieces.
_KIND = bytes(2 if x in _BREAKS else x in _BLANKS for x in range(256))
_LOWER = bytes(range(256)).lower()
_EDGE = re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]")
_AHEAD = re.compile(rb"(?:[ \t]+[^ \t.,;:!?\n\x0b\x0c\r]+){0,%d}" % (LONGEST - 1))
_RANDOM = np.random.Generator(np.random.PCG64(13)).integers(0, 1 << 64, 256, np.uint64)
_STEP, _ONE, _UPPER = np.uint64(0x9E3779B97F4A7C15), np.uint64(1), np.uint64(1 << 63)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _hash_words(words: pa.Array) -> np.ndarray:
    """Per word: the sum of its bytes' random numbers, each times a power of ``_STEP`` for its place."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    power = np.full(int(sizes.max()), _STEP)
    power[0] = 1
    place = np.arange(len(data)) - np.repeat(starts, sizes)
    return _mix(np.add.reduceat(_RANDOM[data] * np.cumprod(power)[place], starts))


def cut(text: bytes, size: int) -> Iterator[tuple[bytes, bytes]]:
    """Parts of about ``size`` bytes that end where a word ends, each with the
    words after it that a phrase which starts in the part may reach into."""
    at = 0
    while len(text) - at > size:
        edge = _EDGE.search(text, at + size)
        if edge is None:
            break
        yield text[at:edge.start()], _AHEAD.match(text, edge.start()).group()
        at = edge.start()
    yield text[at:], b""


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes, bytes]]]:
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text")):
            for own, ahead in cut(text.as_py() or b"", CHUNK):
                held.append((lang.as_py(), own, ahead))
                size += len(own)
                if size >= CHUNK:
                    yield held
                    held, size = [], 0
    if held:
        yield held


class Bits:
    """Hashed phrases, as bits."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.shift = bits, np.uint64(64 - (len(bits) * 8).bit_length() + 1)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 != 0


class Words(NamedTuple):
    """A chunk split into words.  A unit is a word of a language."""
    langs: list[str]
    names: pa.Array
    of_unit: np.ndarray  # its word, as a place in ``names``
    lang: np.ndarray  # of each unit, as a place in ``langs``
    unit: np.ndarray  # of each word of the text
    own: np.ndarray  # whether a phrase that starts here is counted here
    together: np.ndarray  # whether the next word is in the same piece


def split(chunk: list[tuple[str, bytes, bytes]]) -> Words | None:
    langs = sorted({c[0] for c in chunk})
    code = {x: i for i, x in enumerate(langs)}
    joined = b"\n".join(own + ahead for _, own, ahead in chunk)
    ends_own = np.cumsum([0] + [len(own) + len(ahead) + 1 for _, own, ahead in chunk])
    kind = np.frombuffer(joined.translate(_KIND) + b"\x02", np.uint8)
    inside = kind == 0
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    n = len(starts)
    if not n:
        return None
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    data = joined.translate(_LOWER, _BLANKS + _BREAKS)
    words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    names, word = words.dictionary, words.indices.to_numpy()
    segment = np.repeat(np.arange(len(chunk)), np.diff(np.searchsorted(starts, ends_own)))
    own = starts < (ends_own[:-1] + np.array([len(c[1]) for c in chunk]))[segment]
    together = np.maximum.reduceat(kind, starts)[:-1] < 2
    del joined, kind, inside, edges, data
    lang = np.array([code[c[0]] for c in chunk])[segment]
    units, _, unit = _distinct(lang * len(names) + word, len(langs) * len(names))
    return Words(langs, names, units % len(names), units // len(names), unit, own, together)


def to_row(words: Words) -> tuple:
    """``WORDS`` without the shard."""
    pack = zstandard.ZstdCompressor(level=1).compress
    offsets = np.frombuffer(words.names.buffers()[1], np.int64)[words.names.offset:words.names.offset + len(words.names) + 1]
    data = memoryview(words.names.buffers()[2])[offsets[0]:offsets[-1]]
    return (words.langs, pack(data), *(pack(x.astype(np.int32).tobytes()) for x in (np.diff(offsets), words.of_unit, words.lang, words.unit)),
            *(pack(np.packbits(x).tobytes()) for x in (words.own, words.together)))


def from_row(langs: list[str], *packed: bytes) -> Words:
    data, *rest = map(zstandard.ZstdDecompressor().decompress, packed)
    sizes, of_unit, lang, unit = (np.frombuffer(x, np.int32).astype(np.int64) for x in rest[:4])
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    names = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    own, together = (np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for x, n in zip(rest[4:], (len(unit), len(unit) - 1)))
    return Words(langs, names, of_unit, lang, unit, own, together)


def count_chunk(chunk: list[tuple[str, bytes, bytes]], now: Bits, before: Bits | None, words_too: bool = False) -> Iterator:
    """``count_words`` of texts."""
    words = split(chunk)
    if words is None:
        return
    for found in count_words(words, now, before, words_too):
        if before is None:
            found.pop("part")
        yield found


def count_words(words: Words, now: Bits, before: Bits | None, words_too: bool = False) -> Iterator:
    """With ``before``: (hashes in order, counts) of the phrases that are active by
    ``now`` and not done by ``before``.  Without it: columns of ``COUNTS`` and the
    hashes (``part``) of the phrases that are in ``now`` themselves, and a row
    without words (k 0) with the number of words for each language.

    Phrases are hashed where they occur, and only those to be counted are sorted."""
    langs, names, of_unit, lang, unit, own, together = words
    of_lang = np.array([xxhash.xxh3_64_intdigest(x.encode(), seed=1) for x in langs], np.uint64)
    one = _mix(_hash_words(names)[of_unit] + of_lang[lang]) >> _ONE

    def columns(k: int, at: np.ndarray, f: np.ndarray, part: np.ndarray) -> dict:
        parts = [names.take(pa.array(of_unit[unit[at + j]])) for j in range(k)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if k > 1 else parts[0]
        return {"lang": pa.array(langs).take(pa.array(lang[unit[at]])), "k": np.full(len(at), k), "phrase": phrase.cast(pa.binary()), "f": f, "part": part}

    reached = now[one]
    if before is None:
        total = np.bincount(lang[unit[own]], minlength=len(langs))
        yield {"lang": pa.array(langs), "k": np.zeros(len(langs), int), "phrase": pa.array([b""] * len(langs)), "f": total, "part": of_lang}
    if before is None or words_too:
        f = np.bincount(unit[own], minlength=len(one))
        some = np.flatnonzero((f > 0) & reached if before is None else f)
        if before is None:
            first = np.zeros(len(one), np.int64)
            first[unit[::-1]] = np.arange(len(unit) - 1, -1, -1)
            yield columns(1, first[some], f[some], one[some])
        else:
            order = np.argsort(one[some])
            yield one[some][order], f[some][order]
    last = one[unit]
    hashes, frequent, ident = last, reached[unit], unit
    past = None if before is None else before[one][unit]  # was it in the bits, with all that it depends on?
    for k in range(2, LONGEST + 1):
        both = frequent[:-1] & frequent[1:]
        if k == 2:
            both &= together
        at = np.flatnonzero(both)
        if not len(at):
            return
        longer = _mix(hashes[at] * _STEP + last[at + k - 1]) >> _ONE
        if k == LONGEST:  # the upper half: nothing depends on these bits, so the circle may end before they do
            longer |= _UPPER
        reached = now[longer]
        if before is None:
            at, longer, reached = at[reached], longer[reached], True
            _, first, phrase = np.unique(ident[at] * len(one) + unit[at + k - 1], return_index=True, return_inverse=True)
            f = np.bincount(phrase[own[at]], minlength=len(first))
            some = np.flatnonzero(f)
            if len(some):
                yield columns(k, at[first[some]], f[some], longer[first[some]])
            ident = np.zeros(len(both), np.int64)
            ident[at] = phrase
        else:
            done = past[at] & past[at + 1]
            some = ~done & own[at]
            if some.any():
                yield np.unique(longer[some], return_counts=True)
            past = np.zeros(len(both), bool)
            past[at[done]] = before[longer[done]]
        hashes, frequent = np.zeros(len(both), np.uint64), np.zeros(len(both), bool)
        hashes[at], frequent[at] = longer, reached


def _distinct(keys: np.ndarray, bound: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``np.unique`` with first places and inverse; without a sort if the keys are dense."""
    if bound > 8 * len(keys):
        return np.unique(keys, return_index=True, return_inverse=True)
    first = np.full(bound, -1)
    first[keys[::-1]] = np.arange(len(keys) - 1, -1, -1)
    some = np.flatnonzero(first >= 0)
    number = np.zeros(bound, np.int64)
    number[some] = np.arange(len(some))
    return some, first[some], number[keys]


class Counters:
    """Counters up to ``most``, in pages that exist once something is added."""

    def __init__(self, most: int):
        self.most, self.kind = most, np.min_scalar_type(2 * most)
        self.pages: dict[int, np.ndarray] = {}

    def add(self, page: int, slots: np.ndarray, counts: np.ndarray) -> None:
        """``slots`` without repeats; none means all in order."""
        if page not in self.pages:
            self.pages[page] = np.zeros(PAGE, self.kind)
        own, at = self.pages[page], slots if len(slots) else slice(None)
        own[at] = np.minimum(own[at] + np.minimum(counts, self.most).astype(self.kind), self.most)

    def add_slots(self, slots: np.ndarray, counts: np.ndarray) -> None:
        if (slots[1:] < slots[:-1]).any():
            order = np.argsort(slots)
            slots, counts = slots[order], counts[order]
        new = np.flatnonzero(np.diff(slots, prepend=-1))
        slots, counts = slots[new], np.add.reduceat(counts, new) if len(new) else counts
        pages = slots // PAGE
        heads = np.flatnonzero(np.diff(pages, prepend=-1)).tolist()
        for a, b in zip(heads, heads[1:] + [len(slots)]):
            self.add(int(pages[a]), slots[a:b] % PAGE, counts[a:b])

    def rows(self) -> Iterator[tuple[int, bytes, bytes]]:
        for page, own in self.pages.items():
            some = np.flatnonzero(own)
            sparse = len(some) * (2 + own.itemsize) < own.nbytes
            yield page, some.astype(np.uint16).tobytes() if sparse else b"", (own[some] if sparse else own).tobytes()

    def batches(self) -> Iterator[pa.RecordBatch]:
        held = list(self.rows())
        for a in range(0, len(held), 256):
            page, slots, counts = zip(*held[a:a + 256])
            yield pa.RecordBatch.from_arrays([pa.array(page, pa.int32()), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())],
                                             names=["page", "slots", "counts"])


def _merged(rows: DataFrame, least: int) -> DataFrame:
    """One row a page: the sums of ``rows``, in a stream that holds the pages of one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counters(least)
        for batch in batches:
            for page, slots, counts in zip(*(batch.column(c) for c in ("page", "slots", "counts"))):
                held.add(page.as_py(), np.frombuffer(slots.as_py(), np.uint16), np.frombuffer(counts.as_py(), held.kind))
        yield from held.batches()

    return rows.repartition("page").mapInArrow(run, PAGES)


def _dealt(found: list[dict], parts: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of ``FOUND``, one for each part: phrases go to parts by their hash."""
    pack = zstandard.ZstdCompressor(level=1).compress
    langs = sorted({x for c in found for x in c["lang"].unique().to_pylist()})
    lang = np.concatenate([pc.index_in(c["lang"], pa.array(langs, pa.string())).to_numpy() for c in found]).astype(np.int32)
    k, f = (np.concatenate([c[x] for c in found]) for x in ("k", "f"))
    part = ((np.concatenate([c["part"] for c in found]) & ~_UPPER) >> np.uint64(31)) * np.uint64(parts) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    phrases = pa.concat_arrays([c["phrase"].cast(pa.large_binary()) for c in found]).take(pa.array(order))
    offsets = np.frombuffer(phrases.buffers()[1], np.int64)[phrases.offset:phrases.offset + len(phrases) + 1]
    data, sizes, rows = memoryview(phrases.buffers()[2]), np.diff(offsets).astype(np.int32), []
    lang, k, f = lang[order], k[order].astype(np.uint8), f[order].astype(np.int64)
    some, cuts = np.unique(part[order], return_index=True)
    for p, a, b in zip(some.tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        rows.append((p, langs, *(pack(x[a:b].tobytes()) for x in (lang, k, sizes)), pack(data[offsets[a]:offsets[b]]), pack(f[a:b].tobytes())))
        if len(rows) == 1024 or b == len(order):
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), schema)], schema=schema)
            rows = []


def _totals(rows: list[dict], least: int) -> Iterator[dict]:
    """Columns of ``COUNTS``: the sums of rows of ``FOUND``, by the bytes of the phrases."""
    if not rows:
        return
    unpack = zstandard.ZstdDecompressor().decompress
    langs = sorted({x for r in rows for x in r["langs"]})
    code = {x: i for i, x in enumerate(langs)}
    lang = np.concatenate([np.array([code[x] for x in r["langs"]])[np.frombuffer(unpack(r["lang"]), np.int32)] for r in rows])
    k = np.concatenate([np.frombuffer(unpack(r["k"]), np.uint8) for r in rows])
    f = np.concatenate([np.frombuffer(unpack(r["f"]), np.int64) for r in rows])
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.frombuffer(unpack(r["sizes"]), np.int32) for r in rows]), dtype=np.int64)])
    data = b"".join(unpack(r.pop("phrases")) for r in rows)
    phrases = pa.Array.from_buffers(pa.large_binary(), len(k), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    key = (phrases.indices.to_numpy().astype(np.int64) * len(langs) + lang) * (LONGEST + 1) + k
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    f, key = np.add.reduceat(f[order], first), key[first]
    k = key % (LONGEST + 1)
    some = (f >= least) | (k == 0)
    key, k = key[some] // (LONGEST + 1), k[some]
    yield {"lang": pa.array(langs).take(pa.array(key % len(langs))), "k": k,
           "phrase": phrases.dictionary.take(pa.array(key // len(langs))).cast(pa.binary()), "f": f[some]}


def frequent_phrases(docs: DataFrame, least: int = 30, shards: int = 4, table_bits: int = 26) -> tuple[DataFrame, DataFrame]:
    """((lang, k, phrase as bytes, f) of the phrases of 1 to 4 words with
    ``f >= least``, (lang, n) with n all words).

    ``docs(lang, text)``: A-Z are lowered, texts split at ``.,;:!?`` and line
    breaks into pieces and these at blanks and tabs into words; phrases are
    contiguous words of a piece, counted with overlaps, per language (null:
    ``und``).  Null and empty texts have no words; repeated rows count each
    time.  A long text is counted in parts that know the words after them.  Other
    columns are ignored.  An empty table gives two empty ones.

    The counters (one half for the longest phrases) are a table of ``2 ** table_bits`` numbers up to ``least``,
    whatever the texts are; a task holds at most as many, and the driver and the
    tasks get a bit of each.  Fewer counters than distinct active phrases give
    the same result, but count more phrases exactly.
    """
    spark = docs.sparkSession
    ship(spark)
    as_row = pa_schema(spark, WORDS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        at = TaskContext.get().partitionId()
        for chunk in _chunks(batches):
            if (words := split(chunk)) is not None:
                row = (at % shards, *to_row(words), sum(len(c[1]) for c in chunk))
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, as_row)], schema=as_row)
                at += 1

    dealt = written(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
                    .mapInArrow(deal, WORDS), "dic-shards", partition_by="shard")
    packed = dealt.drop("shard", "n_bytes")

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from_row(*(c[i].as_py() for c in batch.columns))

    table_bits = max(table_bits, 16)
    bits, counters, step = [np.zeros((1 << table_bits) // 8, np.uint8)], None, 0
    half = len(bits[0]) // 2
    while step < shards or not np.array_equal(bits[step][:half], bits[step - shards][:half]):
        state = spark.sparkContext.broadcast((bits[step], bits[max(0, step - shards)]))
        words_too = step < shards

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, before = map(Bits, state.value)
            held = Counters(least)
            for words in opened(batches):
                for hashes, f in count_words(words, now, before, words_too):
                    held.add_slots((hashes >> now.shift).astype(np.int64), f)
            yield from held.batches()

        found = dealt.where(F.col("shard") == step % shards).select(*packed.columns).mapInArrow(scan, PAGES)
        counters = written(_merged(found if counters is None else counters.unionByName(found), least), "dic-counters")

        def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                one = Counters(least)
                for page, slots, counts in zip(*(batch.column(c) for c in ("page", "slots", "counts"))):
                    one.add(page.as_py(), np.frombuffer(slots.as_py(), np.uint16), np.frombuffer(counts.as_py(), one.kind))
                reached = [np.packbits(x >= least, bitorder="little").tobytes() for x in one.pages.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(one.pages), pa.int32()), pa.array(reached, pa.binary())], names=["page", "bits"])

        bits.append(bits[step].copy())
        for p in counters.mapInArrow(full, "page int, bits binary").collect():  # 8 KB a page
            bits[-1][p["page"] * PAGE // 8:(p["page"] + 1) * PAGE // 8] = np.frombuffer(p["bits"], np.uint8)
        if step >= shards:
            bits[step - shards] = None
        state.destroy()
        step += 1

    last, out = spark.sparkContext.broadcast(bits[step]), pa_schema(spark, COUNTS)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(dealt.agg(F.sum("n_bytes")).first()[0] or 0) // CHUNK))
    as_found = pa_schema(spark, FOUND)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = Bits(last.value), [], 0
        for words in opened(batches):
            for c in count_words(words, now, None):
                held.append(c)
                size += c["phrase"].nbytes
            if size >= HELD:
                yield from _dealt(held, parts, as_found)
                held, size = [], 0
        if held:
            yield from _dealt(held, parts, as_found)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _totals([r for batch in batches for r in batch.to_pylist()], least):
            for a in range(0, len(c["k"]), 50000):
                yield pa.RecordBatch.from_arrays([pa.array(c[f.name][a:a + 50000], f.type) for f in out], schema=out)

    counted = written(packed.mapInArrow(exact, FOUND).repartitionById(parts, "part").mapInArrow(total, COUNTS), "dic-frequent")
    return counted.where("k > 0"), counted.where("k = 0 AND f > 0").select("lang", F.col("f").alias("n"))


def mine(docs: DataFrame, least: int = 30, top: int = 2000, inside_percent: int = 80, scale: int = 2_000_000,
         shards: int = 4, table_bits: int = 26, salts: int = 8) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each
    language; see ``frequent_phrases`` for what is counted.

    A phrase of 2 to 4 words with ``a`` occurrences, cut after its first words,
    scores ``floor(scale * a / (l + r))`` with the counts of both parts; its
    lowest cut counts, ties to the shortest first part.  Phrases inside a longer
    one that has ``inside_percent`` of their occurrences go.  Order: score and
    ``a`` descending, then bytes of the phrase.  Products are decimals of 38
    digits.  A part that very many phrases share, as a frequent word is, is
    joined in ``salts`` shares.
    """
    frequent, words = frequent_phrases(docs, least, shards, table_bits)
    frequent = frequent.withColumn("phrase", F.col("phrase").cast("string"))
    phrases = frequent.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    salt = F.pmod(F.xxhash64("phrase"), F.lit(salts)).cast("int")
    sides = phrases.select(
        "lang", "phrase", "k", "a", salt.alias("salt"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    sides = sides.select("lang", "phrase", "a", "salt", "cut", F.posexplode(F.array(
        F.expr("substring_index(phrase, ' ', cut)"), F.expr("substring_index(phrase, ' ', cut - k)"))).alias("side", "part"))
    counts = frequent.where(F.col("k") < LONGEST).select(
        F.col("lang"), F.col("phrase").alias("part"), "f", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    cuts = [(cut, side) for cut in range(1, LONGEST) for side in (0, 1)]
    scored = sides.join(counts, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a").agg(
        *(F.max(F.when((F.col("cut") == c) & (F.col("side") == s), F.col("f"))).alias("lr"[s] + str(c)) for c, s in cuts))
    wide = "decimal(20,0)"
    options = [F.when(F.col(f"l{c}").isNotNull(), F.struct(
        F.expr(f"CAST({scale} AS {wide}) * CAST(a AS {wide}) div (CAST(l{c} AS {wide}) + CAST(r{c} AS {wide}))").alias("score"),
        F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r"))) for c in range(1, LONGEST)]
    scored = scored.select("lang", "phrase", "a", F.least(*options).alias("best"))

    inner = [(n, at) for n in range(2, LONGEST) for at in range(LONGEST - n + 1)]
    part = F.array(*(F.when(F.col("k") >= at + n + (at == 0), F.expr(
        f"substring_index(substring_index(phrase, ' ', {at + n}), ' ', -{n})")) for n, at in inner))
    longer = (phrases.where("k > 2").select("lang", F.explode(part).alias("phrase"), "a").where("phrase IS NOT NULL")
              .groupBy("lang", "phrase").agg(F.max("a").alias("most")))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(
        f"most IS NULL OR 100 * CAST(most AS {wide}) < {inside_percent} * CAST(a AS {wide})")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", "rank", "phrase", "a", "best.l", "best.r", "n", "best.score")
