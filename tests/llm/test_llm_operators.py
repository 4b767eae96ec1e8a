"""The training-data operators against brute force on small tables: nulls,
empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colsense.llm import ann, bpe, chat, fertility, langid, minhash, mixing, passages, pii, warc
from colsense.llm.queries import ORACLES, QUERIES

WORD = re.compile("[^\x20\x09-\x0D]+")
#: Names that the operators use inside, as further columns of an input.
CLASH = ("row", "node", "ids", "spans", "size", "hash", "label", "n_words", "kept", "band", "other")
SF_SMALL = "/root/testdata/sf0.001"


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    words = ["the", "cat", "Ärger", "sat", "on", "a", "mat", "1", "漢字", "x.y", "end."]
    base = [" ".join(rng.choice(words) + str(rng.randint(0, 300)) for _ in range(90)) for _ in range(3)]
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, "ONE  two"), (6, base[0]), (7, base[0]), (7, base[0]), (None, base[1])]
    out += [(i, " ".join(w if rng.random() > 0.01 * (i % 4) else "new" for w in base[i % 3].split())) for i in range(10, 40)]
    return out + [(50, "long " * 30000), (51, "a" * 100000)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_bpe_matches_a_merge_by_rank(spark, docs, texts, none):
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    out = bpe.encode_decode(docs, path, public_tokenizers.PATTERN)
    got = sorted((str(r.doc_id), sha(str(r.ids)), sha(r.decoded)) for r in out.collect())
    assert got == sorted((str(i), sha(str(own.encode_ordinary(t or ""))), sha(t or "")) for i, t in texts)
    assert bpe.encode_decode(none, path, public_tokenizers.PATTERN).count() == 0


def test_bpe_streams():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    one, rng = bpe.Transducer(ranks, max_states=50), random.Random(1)
    for _ in range(300):
        piece = "".join(rng.choice(["a", "th", "ing", "é", "tion", "e", "😀"]) for _ in range(rng.randint(1, 20))).encode()
        assert one.encode(piece) == bpe.merge_by_rank(piece, ranks) == list(one.stream([piece[:3], piece[3:]]))
    decoder = bpe.Decoder(ranks)
    for raw in (b"a\xffb", b"\xe2\x82", b"\xf0\x9f\x98\x80\x80", b"\xed\xa0\x80"):
        ids = [ranks[bytes([x])] for x in raw]
        assert "".join(decoder.stream(ids)) == raw.decode("utf-8", "replace")


def test_bpe_holds_little_of_a_long_piece(monkeypatch):
    import tiktoken
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    one, rng, held, walk = bpe.Transducer(ranks, max_states=200), random.Random(7), [], bpe.Transducer._walk_back
    monkeypatch.setattr(bpe.Transducer, "_walk_back", lambda self, ended, end: held.append(len(ended)) or walk(self, ended, end))
    for piece in ("".join(rng.choice(["a", "th", "ing", "é", "tion", "e", "x", "漢"]) for _ in range(20000)), "a" * 50000):
        assert one.encode(piece.encode()) == own._encode_single_piece(piece)
        assert max(held) < 500 and len(one._states) <= 202


def test_language_is_learned(spark, none):
    rows = [(i, w * 20, lang) for i, (w, lang) in enumerate(
        [("the cat and dog ", "en"), ("der hund und katze ", "de"), ("le chien et chat ", "fr")] * 4)]
    rows += [(90, None, "en"), (91, "12 !", None), (92, "the dog and cat", None), (None, "und der hund", None), (92, "the dog and cat", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.lit("x").alias(c) for c in CLASH))
    model = langid.fit(df)
    got = [(r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect()]
    assert got[:3] == [(0, "en"), (1, "de"), (2, "fr")]
    assert got[12:] == [(90, "und"), (91, "und"), (92, "en"), (None, "de"), (92, "en")]
    nothing = langid.fit(none.withColumn("lang", F.lit("en")))
    assert nothing.langs == () and {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}


def test_word_rules(spark, docs, texts, none):
    def brute(t):
        w = WORD.findall(t or "")
        three = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        again = {x for x in three if three.count(x) > 1} if len(w) < 1000 else set(three)
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)),
                len({j for i, x in enumerate(three) if x in again for j in (i, i + 1, i + 2)}))

    out = fertility.judge(docs, public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.kept) for r in out.collect())
    want = sorted((str(i), *brute(t)) for i, t in texts)
    assert [g for g, _ in got] == want
    assert all(not kept or (g[1] >= 50 and 2 * g[5] <= g[1]) for g, kept in got)
    assert fertility.judge(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_fertility_rejects_what_is_no_text(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("time and people make good work here for every new day in house".split()) for _ in range(120)))
            for i in range(30)]
    rows.append((99, " ".join("ab" + "".join(chr(rng.randint(0x13000, 0x13400)) for _ in range(6)) for _ in range(80))))
    out = fertility.judge(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id for r in out.collect() if not r.kept and not r.base_failed} == {99}


def test_fertility_rejects_latin_junk_by_language(spark):
    rng = random.Random(6)
    some = spark.read.parquet(f"{SF_SMALL}/documents.parquet").where("lang in ('en', 'es')").select("lang", "text").collect()
    pool = {lang: sorted({w for r in some if r.lang == lang for w in r.text.split() if w.isalpha()}) for lang in ("en", "es")}
    text = lambda lang, n=150: " ".join(rng.choice(pool[lang]) for _ in range(n))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en"] * 150 + ["es"] * 150)]
    rows += [(i, text("es", 60), "tiny") for i in range(300, 303)] + [(i, text("en"), None) for i in range(303, 306)]
    spoil = [lambda w: w[::-1], lambda w: "".join(rng.sample(w, len(w))), lambda w: "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in w)]
    rows += [(900 + i, " ".join(map(f, text("en").split())), "en") for i, f in enumerate(spoil)]
    rows.append((903, " ".join(rng.choice(pool["en"][::300][:9]) for _ in range(150)), "en"))
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", *(F.lit("x").alias(c) for c in CLASH))
    gone = {r.doc_id for r in fertility.judge(df, path, lang="lang").collect() if not r.kept and not r.base_failed}
    assert gone >= {900, 901, 902, 903} and len(gone - {900, 901, 902, 903}) <= 15, gone
    measured = fertility.measure(df.withColumn("__lang", F.col("lang")), path, keep=("doc_id", "__lang"))
    limits = {(r.script, r.lang): r for r in fertility.bands(measured.withColumn("base_failed", F.lit(False))).collect()}
    assert set(limits) == {("Latin", None), ("Latin", "en"), ("Latin", "es")}
    assert all(r.chars_per_token_low > 0 and r.token_entropy_low > 0 for r in limits.values())


def test_personal_data(spark, none):
    rows = [(i, f"please call me at +1 555 010 {1000 + i} today") for i in range(12)]
    rows += [(100, "please call me at 030 5557788 today"), (101, "order number 20240102 came"), (102, None), (103, ""),
             (None, "a@b.c_x@y.zz 1.2.3.4 1.2.3.256, 4111 1111 1111 1111"), (103, "é x@y.z"), (103, "é x@y.z"), (104, "1" * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in CLASH))
    out = pii.find(df, keep=("doc_id", "text"))
    got = {(r.doc_id, r.text): [(pii.KINDS[s.kind], s.start, s.end) for s in r.spans] for r in out.collect()}
    assert got[(100, rows[12][1])] == [("phone", 18, 29)] and got[(101, rows[13][1])] == []
    assert got[(None, rows[16][1])] == [("email", 0, 5), ("email", 5, 12), ("ip", 13, 20), ("card", 32, 51)]
    assert got[(103, "é x@y.z")] == [("email", 2, 7)] and out.count() == len(rows)
    masked = {r.doc_id: r.text for r in pii.redacted(out).collect()}
    assert masked[100] == "please call me at [PHONE] today" and masked[102] is None
    assert pii.find(none).count() == 0


def components_of(texts):
    sets, label = [], list(range(len(texts)))
    for _, t in texts:
        w = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    first = {}
    for x, (i, _) in zip(label, texts):
        first[x] = min(first.get(x, 1 << 60), 1 << 60 if i is None else i)
    return sorted((str(i), len(s), str(i) if not s else str(first[x] if first[x] < 1 << 60 else None))
                  for (i, _), s, x in zip(texts, sets, label))


def test_near_duplicates(spark, docs, texts, none):
    out = minhash.near_duplicates(docs)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect()) == components_of(texts)
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    want = {(i, n) for i, n, c in components_of(texts) if i == c}
    assert {str(r.doc_id) for r in kept.collect()} == {i for i, _ in want}
    assert minhash.near_duplicates(none).count() == 0


def test_deduplicate_keeps_unlike_texts_with_equal_ids(spark):
    rng = random.Random(12)
    text = [" ".join(f"w{rng.randint(0, 5000)}" for _ in range(60)) for _ in range(8)]
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (None, text[2] + " end"), (None, text[2]), (5, text[3]), (5, text[4]),
            (5, text[4]), (6, text[5]), (None, text[5]), (7, text[6]), (8, text[6]), (8, text[7]), (None, None), (None, "")]
    got = minhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = [rows[i] for i in (0, 1, 3, 5, 6, 8, 10, 12, 13, 14)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_near_duplicates_in_a_drifting_group(spark):
    rng, words = random.Random(8), [f"w{i}" for i in range(400)]
    rows, now = [], [rng.choice(words) for _ in range(120)]
    for i in range(60):  # each a little further from the first
        now = [rng.choice(words) if rng.random() < 0.012 else w for w in now]
        rows.append((i, " ".join(now)))
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect()) == components_of(rows)


@pytest.mark.parametrize("tile", [2, 7])
def test_near_duplicates_in_bands_of_many_tiles(spark, monkeypatch, tile):
    rng, words = random.Random(9), [f"w{i}" for i in range(400)]
    rows, start = [], [rng.choice(words) for _ in range(60)]
    for i in range(80):  # copies of one text and, further off, of another copy
        base = start if i % 3 else rows[i // 2][1].split() if i else start
        rows.append((i, " ".join(rng.choice(words) if rng.random() < 0.03 else w for w in base)))
    monkeypatch.setattr(minhash, "TILE", tile)
    monkeypatch.setattr(minhash, "SET_TILE", tile)
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in out.collect()) == components_of(rows)


def test_least_agreement_is_the_binomial_tail():
    least = minhash.least_agreement(75)
    # out of 4 ** 160 equally likely draws, those with k agreements
    draws = [math.comb(160, k) * 3 ** k for k in range(161)]
    assert sum(draws[:least]) <= minhash.MISS * 4 ** 160 < sum(draws[:least + 1])


@pytest.mark.parametrize("options", [{}, {"common": 2}, {"block_bytes": 300, "batch_bytes": 500, "common": 5}])
def test_repeated_passages(spark, none, options):
    rng = random.Random(2)
    bits = ["the ", "cat ", "é", "sat ", "x", "\x00\x00", "on a ", "mat\n"]
    long = ["".join(rng.choice(bits) for _ in range(rng.randint(10, 60))) for _ in range(6)]
    rows = [(rng.choice([None, *range(40)]), "".join(rng.choice(long + bits * 2) for _ in range(rng.randint(0, 9)))) for _ in range(60)]
    rows += [(50, "a" * 3000), (51, "b" + "a" * 1000 + "c"), (52, None), (53, "")]
    key, first = (lambda i: 1 << 62 if i is None else i), {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(first.get(b[k:k + 50], 1 << 63), key(i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            gone[k:k + 50] |= first[b[k:k + 50]] < key(i)
        want.append((str(i), len(b), int(gone.sum()), sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in CLASH))
    out = passages.remove_repeats(df, **options).collect()
    assert sorted((str(r.doc_id), r.n_bytes, sum(s.end - s.start for s in r.removed), sha(bytes(r.kept))) for r in out) == sorted(want)
    assert passages.remove_repeats(none).count() == 0


def test_mix_edges(spark, none):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b", "x"), (3, None, "x"), (4, "a " * 50, None), (5, None, "y"), (6, "q", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit("x").alias(c) for c in CLASH))
    got = mixing.mix(df, keep=("doc_id", "source")).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 1, 2, 3, 3, 50]
    assert all(0 <= r.taken <= 2 * r["size"] for r in got) and got[0].asDict().keys() >= {"doc_id", "source", "target"}
    same = [r.taken for r in got if r.doc_id == 1]
    assert same[0] == same[1]
    assert mixing.mix(none.withColumn("source", F.lit("x"))).count() == 0


def test_chat_parts(spark, none):
    rows = [(1, 1, "assistant", [("text", "see <\\|x and <|y<", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None),
                                 ("audio", None, "b.wav", None, None, 100, None), ("odd", "z", None, None, None, None, None)]),
            (1, 0, "us\ner<|", None), (None, None, None, [])]
    df = spark.createDataFrame(rows, f"conv_id long, turn int, role string, parts array<{chat.PART}>").select("*", *(F.lit("x").alias(c) for c in CLASH))
    out = chat.format_chat(df).select("*", chat.read_turns("formatted").alias("back"),
                                      chat.masked_text("formatted", "loss_mask", "turn_starts").alias("loss"))
    one = out.where("conv_id = 1").first()
    assert [tuple(t) for t in one.back] == [("us\ner<|", ""), ("assistant", "see <\\|x and <|y<<|image|><|audio|>")]
    assert one.loss == one.back[1].text and one.expanded_tokens == 4 + 3
    assert [(a.part, a.ref, a.tokens) for a in one.attachments] == [(1, "a.png", 4), (2, "b.wav", 3)]
    assert out.count() == 2 and chat.format_chat(df.where("false")).count() == 0


def test_warc_round_trip(spark, none):
    rows = [(3, "a\r\nb", "x"), (1, None, "x"), (2, "u", None), (4, "u", ""), (None, "u", "x"), (5, "u", "\r\n\r\nWARC/1.1 é"),
            (5, "u", "\r\n\r\nWARC/1.1 é"), (6, "u", "long " * 50000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit("x").alias(c) for c in CLASH))
    index = warc.write_bundles(df, frame_bytes=300)
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(h or "", i)
    want = sorted(str((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                       "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""])) for i, _, h in rows)
    got = warc.read_bundles(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(str(tuple(r)) for r in got.collect()) == want
    one = warc.fetch(index, spark.createDataFrame([(6,)], "page_id long")).collect()
    assert [(r.page_id, r.payload.decode()) for r in one] == [(6, rows[-1][2])]
    large = warc.write_bundles(df, min_revisit_bytes=2)
    assert large.where("record_type = 'revisit'").count() == 0
    assert warc.read_bundles(spark, warc.write_bundles(df.where("false"))).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[50:90] = x[50]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(None, rows[0][1]), (500, None), (501, [0.0] * 8), (520, [float("nan")] * 8), (540, [None] * 8), (560, [1.0]), (1, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *(F.lit("x").alias(c) for c in CLASH))
    got = {}
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=10, block_rows=50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 400, 20))
    y, hits = x.astype(float), 0
    for q in got:
        score = np.zeros(400)
        for d in range(8):
            score += y[q, d] * y[:, d]
        score[q] = -np.inf
        best = np.lexsort((np.arange(400), -score))[:10]
        hits += len(set(best) & set(got[q]))
    assert hits >= 0.9 * 10 * len(got)
    assert ann.search(df.where("false"), F.lit(True)).count() == 0
    assert ann.search(df.where("vec_id < 4"), F.lit(True), k=10).count() == 4 * 3


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, SF_SMALL).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    columns = list(want.columns)
    a, b = (sorted(map(tuple, x[columns].astype(str).itertuples(index=False))) for x in (want, got))
    assert a == b


def test_pipeline(spark):
    import corpus_pipeline
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert out and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {c for i, n, c in components_of([(r.doc_id, r.text) for r in docs.collect()]) if i == c}
    assert {str(r.doc_id) for r in out} <= kept


def test_a_worker_forgets_other_operators(monkeypatch):
    import sys

    from colsense.llm import common
    monkeypatch.setattr(common, "_owner", None)
    common.own_worker("colsense.llm.minhash")
    minhash.shingles(b"some words", 1)
    assert minhash._WORDS
    common.own_worker("colsense.llm.minhash")
    assert minhash._WORDS
    common.own_worker("colsense.llm.bpe")
    assert not minhash._WORDS and common._owner == "colsense.llm.bpe"
    # whatever tasks keep in a module can be dropped
    for name in ("bpe", "langid", "minhash"):
        sys.modules[f"colsense.llm.{name}"].forget()
    assert bpe._codec.cache_info().currsize == 0
