"""Quality rules from word statistics and tokeniser fertility.

Base rules look at words, lines and repeated word windows.  The method adds
three measures of how public vocabularies cope with a text: characters per
token and the share of tokens that fall back to single bytes (a vocabulary with
byte fallback), and the entropy of its tokens in bits.  Each measure has a band
for each language of a script, and one for the script, which holds for texts
without a language and for languages with less than ``LEAST`` texts; a text
outside a band is rejected.

Bands come from all texts that pass the base rules: the median of a measure,
plus and minus ``spread`` times the median distance from it on that side (six of
them are about four standard deviations of a normal distribution), but never
narrower than ``FLOOR`` and never down to less than half of the median.  Scripts
are a fixed list and a language needs ``LEAST`` texts, so the table of bands is
small.

Words are encoded one by one (no piece of the vocabulary holds a space between
letters), with a bounded memory of the words met.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colsense.llm.common import SPACES, map_batches, written

SYMBOLS = b"#*$%&|<>"
#: Scripts by the first word of a letter's Unicode name; others are "Other".
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Cjk", "Hiragana", "Katakana", "Hangul", "Thai")
#: Least half-width of a band as a part of the median; of the fallback share, itself a part, as it is.
FLOOR = {"chars_per_token": 0.05, "fallback_share": 0.05, "token_entropy": 0.1}
MEASURES = tuple(FLOOR)
#: Texts that a language needs for bands of its own.
LEAST = 100
_CONTINUED = bytes(range(0x80, 0xC0))


@lru_cache(maxsize=1 << 16)
def _script(letter: str) -> int:
    name = unicodedata.name(letter, "").split(" ")[0].capitalize()
    return SCRIPTS.index(name) if name in SCRIPTS else len(SCRIPTS)


class Pieces:
    """Words -> token ids of a vocabulary, kept in flat arrays."""

    def __init__(self, model: bytes, max_words: int = 400_000):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.is_byte = np.array([self.model.is_byte(i) or self.model.is_unknown(i)
                                 for i in range(self.model.get_piece_size())])
        self.max_words = max_words
        pieces = self

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                found = self[word] = len(pieces.ids)
                pieces.ids.append(np.array(pieces.model.encode(word.decode("utf-8", "replace"), num_threads=1), np.int32))
                letter = next((c for c in word.decode("utf-8", "replace") if c.isalpha()), None)
                pieces.script.append(-1 if letter is None else _script(letter))
                return found

        self.Words = Words
        self.reset()

    def reset(self) -> None:
        self.words, self.ids, self.script = self.Words(), [], []

    def lookup(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))


def repeated_words(at: np.ndarray, window: int = 3) -> int:
    """How many places of ``at`` (word numbers) lie in a window that occurs
    twice or more, first occurrences included."""
    n = len(at) - window + 1
    if n < 2:
        return 0
    code = at[:n]
    for i in range(1, window):  # numbers stay below n, so pairs never overflow
        small = np.unique(at[i:i + n], return_inverse=True)[1]
        code = np.unique(code * n + small if code.max(initial=0) < 1 << 31 else
                         np.unique(code, return_inverse=True)[1] * n + small, return_inverse=True)[1]
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(len(at), bool)
    for i in range(window):
        covered[i:i + n] |= twice
    return int(covered.sum())


@lru_cache(maxsize=1)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def measure(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, the base counts and the measures of every whole text.

    Null and empty texts have counts 0 and null measures.  Repeated rows and
    null ids stand for themselves; other columns are ignored.  One narrow pass.
    """
    with open(vocabulary, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file has a fixed size

    def run(batch: pa.RecordBatch):
        pieces = _pieces(model.value)
        out: dict[str, list] = {c: [] for c in COLUMNS}
        for raw in batch.column("__text").to_pylist():
            raw = raw or b""
            words = raw.split()
            if len(pieces.words) > pieces.max_words:
                pieces.reset()
            at = pieces.lookup(words)
            solid = raw.translate(None, SPACES)
            chars = len(solid.translate(None, _CONTINUED))
            lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
            script = cpt = share = entropy = None
            if words:
                ids = np.concatenate([pieces.ids[i] for i in at])
                counts = np.bincount(ids)
                p = counts[counts > 0] / len(ids)
                cpt, share = chars / len(ids), float(counts[pieces.is_byte[:len(counts)]].sum() / len(ids))
                entropy = float(-(p * np.log2(p)).sum()) + 0.0
                scripts = np.array([pieces.script[i] for i in at]) + 1
                by_script = np.bincount(scripts, minlength=2)[1:]
                script = (*SCRIPTS, "Other")[int(by_script.argmax())] if by_script.any() else "Other"
            for name, value in zip(COLUMNS, (len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)),
                                             len(lines) - len(set(lines)), repeated_words(at), script, cpt, share, entropy)):
                out[name].append(value)
        yield {c: batch.column(c) for c in keep} | out

    rows = docs.select(*keep, F.col(text).cast("binary").alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return map_batches(rows, run, kept + ", ".join(f"{c} {kind}" for c, kind in COLUMNS.items()))


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
           "script": "string", "chars_per_token": "double", "fallback_share": "double", "token_entropy": "double"}


def bands(measured: DataFrame, spread: float = 6.0) -> DataFrame:
    """(script, lang, low and high of each measure) over the rows that pass the
    base rules; the bands of a whole script have a null ``lang``.  Medians are
    approximate ones that Spark merges from each task."""
    sane = measured.where("not base_failed and script is not null")
    # each row once for its script and, if it has a language, once for that
    levels = sane.select("script", F.explode(F.array_distinct(F.array(F.lit(None).cast("string"), "__lang"))).alias("lang"),
                         *MEASURES)
    middle = (levels.groupBy("script", "lang").agg(F.count("*").alias("n"), *(
        F.percentile_approx(m, 0.5, 1000).alias(f"{m}_mid") for m in MEASURES))
        .where((F.col("n") >= LEAST) | F.col("lang").isNull())
        .withColumnsRenamed({"script": "__of_script", "lang": "__of_lang"}))
    off = levels.join(F.broadcast(middle), (F.col("script") == F.col("__of_script")) & F.col("lang").eqNullSafe(F.col("__of_lang")))
    sides = []
    for m in MEASURES:
        far = F.col(m) - F.col(f"{m}_mid")
        sides += [F.percentile_approx(F.when(far <= 0, -far), 0.5, 1000).alias(f"{m}_down"),
                  F.percentile_approx(F.when(far >= 0, far), 0.5, 1000).alias(f"{m}_up"), F.first(f"{m}_mid").alias(f"{m}_mid")]
    width = off.groupBy("script", "lang").agg(*sides)

    def edge(m: str, side: str):
        mid = F.col(f"{m}_mid")
        least = F.lit(FLOOR[m]) if m == "fallback_share" else FLOOR[m] * mid
        return F.greatest(least, spread * F.coalesce(F.col(f"{m}_{side}"), F.lit(0.0)))

    return width.select("script", "lang", *(x for m in MEASURES for x in (
        (F.col(f"{m}_mid") - F.least(edge(m, "down"), F.col(f"{m}_mid") / 2)).alias(f"{m}_low"),
        (F.col(f"{m}_mid") + edge(m, "up")).alias(f"{m}_high"))))


def judge(docs: DataFrame, vocabulary: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          min_words: int = 50, spread: float = 6.0, lang: str | None = None) -> DataFrame:
    """``measure`` plus ``base_failed``, ``kept`` and ``reasons`` (the measures
    out of their band).  ``lang`` names the column of languages; without it
    bands are by script alone.  Texts that fail the base rules are not kept; a
    script without a band (no text of it passed) rejects nothing more.  Entropy
    has no upper bound of its own: long texts may hold many tokens, so only its
    lower end rejects; so does only the upper end of the fallback share."""
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    named = docs.withColumn("__lang", (F.col(f"`{lang}`") if lang else F.lit(None)).cast("string"))
    measured = written(measure(named, vocabulary, text, (*keep, "__lang")).withColumn("base_failed", failed), "fertility")
    limits = written(bands(measured, spread), "fertility-bands")  # a row for each script and language with texts enough
    edges = [f"{m}_{side}" for m in MEASURES for side in ("low", "high")]
    script = limits.where("lang is null").select(F.col("script").alias("__of_script"), F.struct(*edges).alias("__by_script"))
    own = limits.where("lang is not null").select(F.col("script").alias("__in_script"), F.col("lang").alias("__in_lang"),
                                                  F.struct(*edges).alias("__by_lang"))
    rows = (measured.join(F.broadcast(script), F.col("script") == F.col("__of_script"), "left")
            .join(F.broadcast(own), (F.col("script") == F.col("__in_script")) & (F.col("__lang") == F.col("__in_lang")), "left")
            .withColumn("__band", F.coalesce("__by_lang", "__by_script")))
    low = lambda m: F.col(m) < F.col("__band")[f"{m}_low"]
    high = lambda m: F.col(m) > F.col("__band")[f"{m}_high"]
    out = {"chars_per_token": low("chars_per_token") | high("chars_per_token"),
           "fallback_share": high("fallback_share"), "token_entropy": low("token_entropy")}
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(m)) for m, c in out.items())))
    return (rows.withColumn("reasons", reasons)
            .select(*keep, *COLUMNS, "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons"))
