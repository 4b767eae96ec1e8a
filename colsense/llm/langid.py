"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  An n-gram of letters is the
product of its letters' vectors, each rotated by its place in the n-gram; a
text is the sum of its n-grams; a language is the sum of its training texts.  A
text gets the language whose vector has the largest cosine with its own.

A text is folded first: lower case, and every run of other characters than
letters becomes one boundary symbol (as do both ends).  Letters a-z have slots
of their own; other letters share the remaining slots by a fixed hash of their
code point, so the table of letter vectors has the same size for every script.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsense.llm.common import map_batches, own_worker, ship, slices

SLOTS = 128
UNKNOWN = "und"


@dataclass(frozen=True)
class Profiles:
    """Bundled language vectors (exact integer sums, one row per language)."""

    langs: tuple[str, ...]
    sums: np.ndarray
    n: int
    seed: int


@lru_cache(maxsize=1)
def _slot_of() -> np.ndarray:
    """Slot of each code point: 0 for all but letters."""
    slots = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            low = ord(low[0])
            slots[c] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % (SLOTS - 27)
    return slots


@lru_cache(maxsize=4)
def _rotated(dim: int, n: int, seed: int) -> np.ndarray:
    """[place in the n-gram, slot, dim] -> +1 or -1."""
    letters = np.random.Generator(np.random.PCG64(seed)).integers(0, 2, (SLOTS, dim)).astype(np.float32) * 2 - 1
    return np.stack([np.roll(letters, n - 1 - i, axis=1) for i in range(n)])


def forget() -> None:
    """Drop what this worker keeps between tasks."""
    _slot_of.cache_clear()
    _rotated.cache_clear()


def _counts(texts: list[bytes | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of the n-grams met, [text, n-gram] counts)."""
    parts = []
    for raw in texts:
        x = _slot_of()[np.frombuffer((raw or b"").decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        x = np.concatenate(([0], x, [0]))
        keep = x != 0
        keep[1:] |= x[:-1] != 0
        keep[0] = True
        parts.append(x[keep])
    sizes = np.array([len(p) for p in parts])
    flat = np.concatenate(parts).astype(np.int64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    if len(flat) < n:
        return np.zeros(0, np.int64), np.zeros((len(texts), 0), np.float32)
    size = len(flat) - n + 1
    codes = np.zeros(size, np.int64)
    for i in range(n):
        codes = codes * SLOTS + flat[i:i + size]
    ok = owner[:size] == owner[n - 1:]
    codes, owner = codes[ok], owner[:size][ok]
    if SLOTS ** n <= 1 << 22:
        met = np.zeros(SLOTS ** n, bool)
        met[codes] = True
        known = np.flatnonzero(met)
        place = np.zeros(SLOTS ** n, np.int32)
        place[known] = np.arange(len(known))
        at = place[codes]
    else:
        known, at = np.unique(codes, return_inverse=True)
    counts = np.bincount(owner * len(known) + at, minlength=len(texts) * len(known))
    return known, counts.reshape(len(texts), len(known)).astype(np.float32)


def _bound(codes: np.ndarray, dim: int, n: int, seed: int) -> np.ndarray:
    """[n-gram, dim]: the product of its rotated letters."""
    rotated, out = _rotated(dim, n, seed), None
    for i in range(n):
        part = rotated[i][(codes // SLOTS ** (n - 1 - i)) % SLOTS]
        out = part if out is None else out * part
    return out


def _vectors(codes: np.ndarray, counts: np.ndarray, dim: int, n: int, seed: int) -> np.ndarray:
    """[row, dim]: the sums of the rows' n-grams.  The n-grams are bound a block at
    a time; the sums are of whole numbers, so the blocks do not change them."""
    out = np.zeros((len(counts), dim), counts.dtype)
    for at in range(0, len(codes), 2048):
        out += counts[:, at:at + 2048] @ _bound(codes[at:at + 2048], dim, n, seed)
    return out


def fit(docs: DataFrame, dim: int = 1024, n: int = 3, seed: int = 7) -> Profiles:
    """Profiles of every language in ``docs(text, lang)``.

    Rows whose text or lang is null, and texts without a letter, teach nothing.
    Each task sums its texts; Spark adds the integer sums by (language, slot),
    so the result does not depend on how rows were dealt, and only a vector of
    ``dim`` numbers for each language comes to the driver, whatever the input.
    No training rows: no languages, and ``predict`` says ``und`` throughout.
    """
    ship(docs.sparkSession)

    def run(batches):
        own_worker(__name__)
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                texts, langs = batch.column("__text").to_pylist(), batch.column("__lang").to_pylist()
                names = sorted(set(langs))
                for a, b in slices(texts, 1_000_000):
                    codes, counts = _counts(texts[a:b], n)
                    if len(codes):
                        by_lang = np.zeros((len(names), len(codes)))
                        np.add.at(by_lang, np.searchsorted(names, langs[a:b]), counts)
                        for lang, v in zip(names, np.rint(_vectors(codes, by_lang, dim, n, seed)).astype(np.int64)):
                            total[lang] = total[lang] + v if lang in total else v
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dim), pa.array(range(dim), pa.int32()), pa.array(v)], ["lang", "slot", "value"])

    rows = docs.select(F.col("text").cast("binary").alias("__text"), F.col("lang").alias("__lang")).where(
        "__text is not null and __lang is not null")
    # one Python pass: a second one in the stage would keep a second worker for each core
    total = (rows.mapInArrow(run, "lang string, slot int, value long")
             .groupBy("lang", "slot").agg(F.sum("value").alias("value")).toPandas())
    langs = tuple(sorted(total["lang"].unique()))
    sums = np.zeros((len(langs), dim), np.int64)
    sums[np.searchsorted(langs, total["lang"].to_numpy(str)) if len(langs) else [], total["slot"].to_numpy(int)] = \
        total["value"].to_numpy()
    keep = sums.any(axis=1)
    return Profiles(tuple(x for x, k in zip(langs, keep) if k), sums[keep], n, seed)


def predict(docs: DataFrame, profiles: Profiles, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``: the largest cosine, cut to
    0..1.  ``und`` with score 0 for null texts, texts without a letter, and where
    no language was learned.  Equal cosines go to the first language by code
    point.  Reads nothing but the text; one narrow pass, each row on its own.
    """
    langs, n, seed = profiles.langs, profiles.n, profiles.seed
    dim = profiles.sums.shape[1] if len(langs) else 1
    unit = profiles.sums / np.maximum(np.linalg.norm(profiles.sums, axis=1, keepdims=True), 1e-300)
    unit = unit.astype(np.float32)

    def run(batch: pa.RecordBatch):
        texts = batch.column("__text").to_pylist()
        pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        for a, b in slices(texts, 1_000_000) if langs else ():
            codes, counts = _counts(texts[a:b], n)
            if not len(codes):
                continue
            counts[:, codes == 0] = 0  # boundaries alone: no letter
            vectors = _vectors(codes, counts, dim, n, seed)
            norms = np.linalg.norm(vectors, axis=1)
            cos = (vectors @ unit.T) / np.maximum(norms, 1e-30)[:, None]
            best = cos.argmax(axis=1)
            for i in np.flatnonzero(counts.any(axis=1)):
                pred[a + i] = langs[best[i]]
                score[a + i] = min(1.0, max(0.0, float(cos[i, best[i]])))
        yield {c: batch.column(c) for c in keep} | {"lang_pred": pred, "score": score}

    rows = docs.select(*keep, F.col("text").cast("binary").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_batches(rows, run, f"{kept}, lang_pred string, score double", piece_rows=512)
