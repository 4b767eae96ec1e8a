"""Personal data: fixed forms, and identifiers found by bootstrapped context.

The fixed forms (e-mail, IP, payment card, phone) are the seeds.  Every seed and
every other token that looks like an identifier (``CANDIDATE``) is an instance;
the words around it make lexical patterns.  Spark scores the graph of patterns
and instances in rounds: a pattern is as sure of a kind as the mean score of
its distinct instances, seeds scoring 1; an unseen instance scores 1 minus the
product of its sure patterns' doubts.  Patterns that end above
``min_confidence`` with ``min_seeds`` distinct seeds mark the unseen
identifiers that stand in them.
"""

from __future__ import annotations

import re
import string

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colsense.llm.common import map_batches, written

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+|[0-9][0-9 ().:/-]*[0-9]")
_WORD = re.compile(r"\w+")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @, domain.  Goes from @ to @: the local
    part is the run before it, so long runs without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(done, at + 1))
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)]
    if not _HAS_DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


_HAS_DIGIT = re.compile("[0-9]")


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) - (1 << 63)


def _context(text: str, start: int, end: int) -> list[int]:
    """Patterns of the place: the two words before it; the word before and the
    word after.  Reads a bounded stretch around it, on its own line."""
    before = _WORD.findall(text[max(text.rfind("\n", 0, start) + 1, start - 80):start].lower())
    after = _WORD.search(text[end:end + 40].split("\n", 1)[0].lower())
    out = []
    if len(before) > 1:
        out.append(_key("LL", before[-2], before[-1]))
    if before and after:
        out.append(_key("LR", before[-1], after.group()))
    return out


def _occurrences(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and unseen candidates, with their patterns."""
    out, covered = [], sorted((a, b) for _, a, b in spans)
    for kind, a, b in spans:
        out += [{"pattern": p, "instance": _key(text[a:b].lower()), "kind": kind, "start": a, "end": b}
                for p in _context(text, a, b)]
    i = 0
    for m in CANDIDATE.finditer(text) if "@" in text or _HAS_DIGIT.search(text) else ():
        a, b = m.span()
        while i < len(covered) and covered[i][1] <= a:
            i += 1
        if i < len(covered) and covered[i][0] < b:
            continue
        if "@" in m.group() or len(_NOT_DIGIT.sub("", m.group())) >= 6:
            out += [{"pattern": p, "instance": _key(m.group().lower()), "kind": None, "start": a, "end": b}
                    for p in _context(text, a, b)]
    return out


def _scored(edges: DataFrame, rounds: int, min_confidence: float, min_seeds: int) -> DataFrame:
    """(pattern, kind, confidence) of the sure patterns."""
    seeds = edges.where("kind is not null").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    known = seeds
    for i in range(rounds):
        met = edges.select("pattern", "instance").distinct().join(known, "instance", "left")
        sums = met.groupBy("pattern").agg(
            F.count_distinct("instance").alias("n"),
            *(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"s{k}") for k in range(len(KINDS))),
            F.sum(F.when(F.col("score") == 1.0, 1).otherwise(0)).alias("seeds"))
        best = F.greatest(*(F.col(f"s{k}") for k in range(len(KINDS))))
        which = F.coalesce(*(F.when(F.col(f"s{k}") == best, F.lit(k)) for k in range(len(KINDS))))
        sure = (sums.select("pattern", which.alias("kind"), (best / F.col("n")).alias("confidence"), "seeds")
                .where((F.col("confidence") >= min_confidence) & (F.col("seeds") >= min_seeds)))
        sure = written(sure.drop("seeds"), "pii-patterns")
        if i + 1 == rounds:
            return sure
        # an instance that is no seed: 1 - product of (1 - confidence), for its likeliest kind
        unseen = (edges.where("kind is null").select("pattern", "instance").distinct().join(sure, "pattern")
                  .groupBy("instance", "kind")
                  .agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
                  .groupBy("instance").agg(F.max(F.struct("score", -F.col("kind"))).alias("m"))
                  .select("instance", (-F.col("m.col2")).alias("kind"), F.least("m.score", F.lit(0.999)).alias("score")))
        known = seeds.union(unseen.join(seeds.select("instance").distinct(), "instance", "left_anti"))


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rounds: int = 3,
         min_confidence: float = 0.7, min_seeds: int = 5) -> DataFrame:
    """``keep`` columns, ``fixed`` and ``spans``: arrays of (kind, start, end) in
    code points, by kind in the order of ``KINDS``, then start.  ``fixed`` are
    the fixed forms; ``spans`` adds what the patterns found, which never
    overlaps a fixed form.

    Null and empty texts have no spans.  Rows stand for themselves: repeated
    rows and null ids keep their places, and their instances count once.
    Columns that are not kept are ignored.  An empty table gives an empty one.
    Texts are read once; what is shuffled is a few numbers for each identifier.
    """
    def run(batch: pa.RecordBatch):
        fixed, seen = [], []
        for raw in batch.column("__text").to_pylist():
            t = (raw or b"").decode("utf-8", "replace")
            spans = fixed_spans(t)
            fixed.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            seen.append(_occurrences(t, spans))
        yield {c: batch.column(c) for c in ("__row", *keep)} | {"fixed": fixed, "__seen": seen}

    source = docs.select(F.monotonically_increasing_id().alias("__row"), *keep, F.col(text).cast("binary").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:-1])
    span = "array<struct<kind: int, start: int, end: int>>"
    rows = written(map_batches(source, run, f"__row long, {kept}{', ' * bool(kept)}fixed {span}, __seen array<struct<"
                               "pattern: long, instance: long, kind: int, start: int, end: int>>"), "pii")
    met = rows.select("__row", F.explode("__seen").alias("o")).select("__row", "o.*")
    edges = written(met.select("pattern", "instance", "kind").distinct(), "pii-graph")
    sure = _scored(edges, rounds, min_confidence, min_seeds)
    # of the kinds that the patterns of one place give, the surest
    found = (met.where("kind is null").drop("kind").join(sure, "pattern").groupBy("__row", "start", "end")
             .agg(F.max(F.struct("confidence", -F.col("kind"))).alias("m"))
             .groupBy("__row").agg(F.collect_list(F.struct((-F.col("m.col2")).alias("kind"), "start", "end")).alias("more")))
    out = rows.join(found, "__row", "left")
    spans = F.array_sort(F.concat("fixed", F.coalesce("more", F.array().cast(span))))
    return out.select(*keep, "fixed", spans.alias("spans"))


def span_text(spans: Column | str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``rows`` with each span of ``text`` replaced by its kind in brackets.
    Spans that overlap become one, named after the first."""
    def run(batch: pa.RecordBatch):
        out = []
        for raw, found in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist()):
            if not found:
                out.append(raw)
                continue
            parts, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    parts += [raw[at:s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                at = max(at, s["end"])
            out.append("".join(parts) + raw[at:])
        yield {c: batch.column(c) for c in batch.schema.names} | {text: out}

    return map_batches(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields))
