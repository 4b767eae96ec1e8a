"""Near-duplicate documents by circulant MinHash, exact on the links it meets.

Signature.  One permutation (sigma) scatters the shingles of a document over a
circle of ``CIRCLE`` places, a second one (pi) ranks the places.  Coordinate k
is the smallest rank of the document's places after the circle is turned by k,
so the two permutations give all coordinates.  Coordinates are cut into
``BANDS`` bands of ``ROWS``; two documents with similarity s share a band with
probability about 1 - (1 - s^ROWS)^BANDS, which is above 0.999999 at s = 0.75.

Links.  Documents with the same shingle set are one node (its members are linked
whatever their number).  Nodes that share a band are candidates, and a link
counts if the full sets confirm it.  Candidates meet inside tasks, where one
byte of each coordinate tells how many coordinates agree; a pair goes on to its
full sets if so many agree that a pair at the least similarity falls short with
probability ``MISS`` at most.  Pairs are not written out: first each node names
two partners (that with most agreement and the smallest), which connects most
groups, and bands of one component drop out.  Among the rest, pairs of different
components whose coordinates agree make a graph; each task names stars that
connect its part as well, and its connected parts are the families.  In a family all
pairs that are still apart are compared on full sets inside tasks, which name
only links that join two components.  So any two candidates end connected,
compared, or known to be too different, and the rows written grow with nodes.
A band or family of many nodes is dealt out to several tiles, and the hub, a node
of its largest component, first meets all of it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colsense.llm.common import map_batches, own_worker, pa_schema, ship, written
from colsense.llm.components import min_labels

CIRCLE = 1 << 20
BANDS, ROWS = 40, 4
MISS = 3e-7
TILE = 1024
#: Nodes of a tile that has full sets.
SET_TILE = 256
#: Bits of a ``sieve``: 8 MB for every task.
SIEVE = 1 << 26


@lru_cache(maxsize=2)
def _permutations(seed: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sigma, windows of pi: row p is the ranks of places p, p+1, ...)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    sigma = rng.permutation(CIRCLE).astype(np.uint32)
    pi = rng.permutation(CIRCLE).astype(np.uint32)
    turned = np.concatenate([pi, pi[:width]])
    return sigma, np.lib.stride_tricks.sliding_window_view(turned, width)


class _Words(dict):
    """64-bit hash of each word met, up to a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = _Words()


def forget() -> None:
    """Drop what this worker keeps between tasks."""
    _WORDS.clear()
    _permutations.cache_clear()


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word windows; see ``profile``."""
    found = list(map(_WORDS.__getitem__, (text or b"").lower().split()))
    if not found:
        return np.zeros(0, np.uint64)
    h = np.array(found, np.uint64)
    n = max(1, len(h) - words + 1)
    width = min(words, len(h))
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = _mix(out * _STEP + h[i:i + n])
    return np.unique(out)


def signature(sets: np.ndarray, seed: int) -> tuple[np.ndarray, bytes]:
    """Of a set that is not empty: one 64-bit key for each band, and the low
    byte of each coordinate."""
    sigma, windows = _permutations(seed, BANDS * ROWS)
    at = sigma[(sets >> np.uint64(44)).astype(np.int64)]
    low = np.full(BANDS * ROWS, CIRCLE, np.uint32)
    for i in range(0, len(at), 4096):
        low = np.minimum(low, windows[at[i:i + 4096]].min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, ROWS).T:
        key = _mix(key * _STEP + part.astype(np.uint64))
    return key, low.astype(np.uint8).tobytes()


def least_agreement(percent: int) -> int:
    """The number of coordinates below which a pair of similarity ``percent``
    stays with probability ``MISS`` at most."""
    n, p, below = BANDS * ROWS, percent / 100, 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
        if below > MISS:
            return k
    return n


def profile(docs: DataFrame, words: int = 5, seed: int = 11, others: tuple[str, ...] = ()) -> DataFrame:
    """``row`` (a number of the row), ``doc_id``, ``text``, ``node`` (16-byte
    digest of the shingle set; null if it is empty), ``n_shingles``, ``bands``
    and ``low`` (a byte of each coordinate).  Words are runs of other bytes than ASCII white space, with A-Z
    lowered; a text with fewer than ``words`` words has its whole sequence as
    its one shingle.  The result is a table in the shared folder."""
    def run(batch: pa.RecordBatch):
        node, size, bands, low = [], [], [], []
        for text in batch.column("text").to_pylist():
            s = shingles(text, words)
            size.append(len(s))
            node.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            keys, bytes_ = signature(s, seed) if len(s) else (None, None)
            bands.append(None if keys is None else keys.view(np.int64))
            low.append(bytes_)
        yield ({c: batch.column(c) for c in batch.schema.names}
               | {"node": node, "n_shingles": size, "bands": bands, "low": low})

    other = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(0)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.col("text").cast("binary"),
                       other.alias("other"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return written(map_batches(rows, run, f"{kinds}, node binary, n_shingles long, bands array<long>, low binary"), "minhash",
                   codec="zstd")


def sieve(rows: DataFrame, found: DataFrame, column: str) -> DataFrame:
    """The rows of ``rows`` whose ``column`` may be in ``found``: all that are,
    and a few others.  An exact join that follows shuffles only these, not the
    whole of a large table.  The hashed values of ``found`` are ``SIEVE`` bits in
    pages of 4 KB; with far more values more other rows pass, none is lost."""
    slot = F.pmod(F.xxhash64(column), F.lit(SIEVE))
    pages = (found.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("__page"))
             .agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("__bits")))
    at = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    met = (F.bitmap_bucket_number(slot) == F.col("__page")) & (F.bit_get(byte, (at % 8).cast("int")) == 1)
    return rows.join(F.broadcast(pages), met, "left_semi")


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(id, items) of the texts of ``rows``."""
    def run(batch: pa.RecordBatch):
        yield {"id": batch.column("id"),
               "items": [shingles(t, words).view(np.int64) for t in batch.column("text").to_pylist()]}

    return map_batches(rows.select("id", "text"), run, "id long, items array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return (pairs.join(left, "a").join(right, "b")
            .where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"))


def split_groups(now: DataFrame, turn: int, size: int) -> DataFrame:
    """Of each band of ``now`` with two groups or more: the largest group
    (``major``), a node of it (``hub``, another one each turn), and how many
    blocks of ``size`` nodes all of it and the other groups make."""
    pick = F.struct(F.xxhash64("id", F.lit(turn)), "id")
    return (now.groupBy("band", "group").agg(F.count("*").alias("m"), F.min(pick).alias("pick"))
            .groupBy("band").agg(F.sum("m").alias("m"), F.count("*").alias("groups"),
                                 F.max(F.struct("m", "group", F.col("pick.id").alias("hub"))).alias("top"))
            .where("groups > 1").select("band", F.ceil(F.col("m") / size).alias("blocks"), "top.hub", F.col("top.group").alias("major"),
                                        F.ceil((F.col("m") - F.col("top.m")) / size).alias("minor_blocks")))


def tiles(now: DataFrame, split: DataFrame, known: DataFrame, turn: int, everything: bool) -> DataFrame:
    """``key``, ``role``, ``group`` and the columns of ``known(id, ...)``: the rows
    of ``now(band, id, group)`` in the bands of ``split``, dealt to tiles; what is
    known of a node joins last, so that no other join carries it for each band.
    A band of one block is one tile and all its rows meet (role 0).  Of a larger
    one, ``everything`` lets each node outside the largest component (role 1)
    meet every node (role 2), block by block; else each block is a tile, with
    the band's hub in all of them."""
    block = lambda of: F.pmod(F.xxhash64("id", F.lit(turn)), F.col(of)).cast("int")
    every = lambda of: F.sequence(F.lit(0), (F.col(of) - 1).cast("int"))
    at = lambda role, i, j: F.struct(F.lit(role).alias("role"), i.alias("i"), j.alias("j"))
    zero = F.lit(0)
    one = F.array(at(0, zero, zero))
    if everything:
        seen = F.transform(every("minor_blocks"), lambda i: at(2, i, block("blocks")))
        asks = F.transform(every("blocks"), lambda j: at(1, block("minor_blocks"), j))
        many = F.when(F.col("group") == F.col("major"), seen).otherwise(F.concat(seen, asks))
    else:
        many = F.when(F.col("id") == F.col("hub"), F.transform(every("blocks"), lambda i: at(0, i, zero))
                      ).otherwise(F.array(at(0, block("blocks"), zero)))
    dealt = now.join(split, "band").withColumn("tile", F.explode(F.when(F.col("blocks") == 1, one).otherwise(many)))
    return dealt.select(F.xxhash64("band", "tile.i", "tile.j").alias("key"), F.col("tile.role").alias("role"), "id",
                        "group").join(known, "id")


def _whole_tiles(batches: Iterator[pa.RecordBatch], size: int = 1 << 22) -> Iterator[pa.Table]:
    """Tables of whole tiles, of about ``size`` bytes, from batches in the order of ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= size:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _meetings(table: pa.Table, percent: int, enough: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, agree): the pairs of rows of one tile, of different groups, whose
    sizes allow a link and whose coordinates agree ``enough``; each row is once
    at most in ``i`` of one step, and once in ``j``."""
    key, role, n, group = (table.column(c).to_numpy() for c in ("key", "role", "n", "group"))
    low = np.frombuffer(b"".join(table.column("low").to_pylist()), np.uint8).reshape(len(key), BANDS * ROWS)
    at, step = np.arange(len(key)), 0
    while len(at):
        step += 1
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        i, j = at, at + step
        right = ((group[i] != group[j]) & ((role[i] == 0) | (role[i] != role[j]))
                 & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])))
        i, j = i[right], j[right]
        agree = (low[i] == low[j]).sum(axis=1, dtype=np.int32)
        right = agree >= enough
        if right.any():
            yield i[right], j[right], agree[right]


def partners(dealt: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b), a < b: for each node of ``tiles``, that with which
    most coordinates agree and the smallest with which enough do."""
    ship(dealt.sparkSession)
    schema = "id long, agree int, best long, least long"
    out, enough = pa_schema(dealt.sparkSession, schema), least_agreement(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker(__name__)
        for table in _whole_tiles(batches):
            id_ = table.column("id").to_numpy()
            most, best = np.zeros(len(id_), np.int32), np.zeros(len(id_), np.int64)
            least = np.full(len(id_), np.iinfo(np.int64).max)
            for i, j, agree in _meetings(table, percent, enough):
                for x, y in ((i, j), (j, i)):
                    least[x] = np.minimum(least[x], id_[y])
                    more = (agree > most[x]) | ((agree == most[x]) & (id_[y] < best[x]))
                    most[x[more]], best[x[more]] = agree[more], id_[y[more]]
            if len(found := np.flatnonzero(most)):
                yield pa.RecordBatch.from_arrays([pa.array(c[found]) for c in (id_, most, best, least)], schema=out)

    met = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)
    return (met.groupBy("id").agg(F.max(F.struct("agree", F.negative("best").alias("best"))).alias("top"), F.min("least").alias("least"))
            .select("id", F.explode(F.array(F.negative("top.best"), F.col("least"))).alias("other"))
            .select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct())


def joining(dealt: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that join what a task's tiles have not joined yet.  With
    ``items`` in ``dealt``, links confirmed on full sets that join groups; else
    stars that connect the nodes whose coordinates agree enough."""
    ship(dealt.sparkSession)
    out, enough, confirmed = pa_schema(dealt.sparkSession, "a long, b long"), least_agreement(percent), "items" in dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker(__name__)
        for table in _whole_tiles(batches):
            id_ = table.column("id").to_numpy()
            part = np.unique(table.column("group" if confirmed else "id").to_numpy(), return_inverse=True)[1]
            if confirmed:
                lists = pa.concat_arrays(table.column("items").chunks)
                ends, items = lists.offsets.to_numpy(), lists.values.to_numpy()
            a, b = [], []
            for i, j, _ in _meetings(table, percent, enough):
                apart = part[i] != part[j]
                for x, y in zip(i[apart].tolist(), j[apart].tolist()):
                    if part[x] == part[y]:
                        continue
                    if confirmed:
                        one, two = items[ends[x]:ends[x + 1]], items[ends[y]:ends[y + 1]]
                        both = len(np.intersect1d(one, two, assume_unique=True))
                        if 100 * both < percent * (len(one) + len(two) - both):
                            continue
                    part[part == part[y]] = part[x]
                    a.append(id_[x])
                    b.append(id_[y])
            if a and not confirmed:
                # stars on the smallest node: the bands of one family mostly name the same ones
                least = np.full(len(part), np.iinfo(np.int64).max)
                np.minimum.at(least, part, id_)
                a, b = least[part], id_
                a, b = a[a != b], b[a != b]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def components(rows: DataFrame, nodes: DataFrame, words: int = 5, percent: int = 75) -> DataFrame:
    """(node, label) for the nodes of a ``profile`` that are linked with another;
    nodes alone have no row here.  ``nodes(node, id)`` names each by the smallest
    of its rows; both columns of the result are such numbers."""
    # most bands are met once: rows of the others go on by 40 bits of them, then exactly
    every = rows.select(F.col("row").alias("id"), F.explode("bands").alias("band"))
    short = F.shiftright("band", 24).alias("short")
    twice = written(every.groupBy(short).agg(F.count("*").alias("m")).where("m > 1").select("short"), "minhash-twice")
    own = sieve(every.withColumn("short", short), twice, "short").select("id", "band")
    # one row speaks for each node; rows with equal sets have equal bands
    own = written(own.join(nodes.select("id"), "id"), "minhash-bands")
    shared = own.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band")
    open_ = written(own.join(shared, "band"), "minhash-open")
    known = rows.select(F.col("row").alias("id"), F.col("n_shingles").alias("n"), "low")
    known = written(sieve(known, open_, "id").join(open_.select("id"), "id", "left_semi"), "minhash-known")

    def grouped(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return (rows.join(labels.select(F.col("node").alias("id"), "label"), "id", "left")
                .withColumn("group", F.coalesce("label", "id")).drop("label"))

    def joined(labels: DataFrame, found: DataFrame) -> DataFrame:
        # a star for each component says as much as all links before
        return min_labels(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(found))

    labels = sets = None
    for turn in range(3):
        now = open_.withColumn("group", F.col("id")) if labels is None else grouped(open_, labels)
        split = written(split_groups(now, turn, TILE), "minhash-split")
        pairs = written(partners(tiles(now, split, known, turn, False), percent), "minhash-pairs")
        large = split.where("blocks > 1").select("band")
        if sets is None:
            # a node without a partner here has none later, but for the bands of several tiles
            chosen = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(now.join(large, "band").select("id"))
                             .distinct(), "minhash-chosen")
            texts = sieve(rows.select(F.col("row").alias("id"), "text"), chosen, "id")
            sets = written(_sets(texts.join(chosen, "id"), words), "minhash-sets")
        found = written(confirm(pairs, sets, percent), "minhash-edges")
        labels = min_labels(found) if labels is None else joined(labels, found)
        open_ = open_.join(split.select("band"), "band")
        if large.limit(1).count() == 0:
            break  # in a band of one tile the last step compares all that is left
    now = grouped(open_, labels)
    split = written(split_groups(now, 3, TILE), "minhash-split")
    forest = written(joining(tiles(now, split, known, 3, True), percent), "minhash-forest")
    families = min_labels(forest).select(F.col("node").alias("id"), F.col("label").alias("band"))
    now = written(grouped(families, labels), "minhash-families")
    split = written(split_groups(now, 4, SET_TILE), "minhash-split")
    known = known.join(sieve(sets, now.join(split, "band"), "id"), "id")
    found = written(joining(tiles(now, split, known, 4, True), percent), "minhash-edges")
    return joined(labels, found)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, seed: int = 11,
                    others: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs``: ``row``, ``doc_id``, ``text`` (bytes), ``n_shingles``,
    ``component`` (number that names the component; null without a word),
    ``component_id`` (smallest doc_id reachable), ``kept`` and, if there are
    ``others``, the struct ``other`` with these columns.

    Null and empty texts have an empty set, no link and stay.  Rows with equal
    doc_id stand alone unless their texts link them; of several rows with the
    component's id all are kept by ``kept`` (``deduplicate`` keeps one).  A null
    doc_id counts as larger than any; a component of such rows has a null id
    and is kept.  Components with the same id, null or not, stay apart by
    ``component``.  An empty table gives an empty table.
    """
    rows = profile(docs, words, seed, others)
    nodes = written(rows.where("node is not null").groupBy("node").agg(F.min("row").alias("id"), F.min("doc_id").alias("least")),
                    "minhash-nodes")
    labels = components(rows, nodes, words, percent).select(F.col("node").alias("id"), "label")
    linked = written(nodes.join(labels, "id", "left").select("node", "least", F.coalesce("label", "id").alias("component")),
                     "minhash-groups")
    smallest = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = linked.select("node", "component").join(smallest, "component")
    out = rows.join(by_node, "node", "left")
    smallest_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("row", "doc_id", "text", "n_shingles", "component", smallest_id.alias("component_id"),
                      F.col("doc_id").eqNullSafe(smallest_id).alias("kept"), *(["other"] if others else []))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 75, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` with one document of each component: the first row
    (in the order they were dealt) that has the component's id.  Documents
    without a word stay, rows that repeat such a doc_id too."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = near_duplicates(docs, words, percent, seed, others).where("kept")
    first = out.where("n_shingles > 0").groupBy("component").agg(F.min("row").alias("row"))
    stay = out.join(first.select("row"), "row", "left_semi").unionByName(out.where("n_shingles = 0"))
    return stay.select(*(F.col("doc_id") if c == "doc_id" else F.col("text").cast("string").alias("text") if c == "text"
                         else F.col("other")[c].alias(c) for c in docs.columns))
