"""Pieces that are walked together, and what a Python worker keeps."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from colsense.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.mark.parametrize("bits, fits, states", [(20, 200_000, 30_000), (4, 5, 20)])
def test_pieces_walked_together(monkeypatch, ranks, bits, fits, states):
    monkeypatch.setattr(bpe.Transducer, "FIT_BITS", bits)
    monkeypatch.setattr(bpe.Transducer, "FITS", fits)
    one, rng = bpe.Transducer(ranks, max_states=states), random.Random(3)
    for n in (0, 1, 400, 400):
        pieces = ["".join(rng.choice(["a", "th", "ing", "é", "tion", "e", "漢", "ñ", "zz", "  "]) for _ in range(rng.randint(1, 12))).encode()
                  for _ in range(n)] + [b"a" * k for k in range(1, 40) if n]
        ids, count = one.encode_all(pieces)
        assert count.tolist() == [len(bpe.merge_by_rank(p, ranks)) for p in pieces]
        assert ids.tolist() == [x for p in pieces for x in bpe.merge_by_rank(p, ranks)]
        assert all(one.encode(p) == bpe.merge_by_rank(p, ranks) for p in pieces)


def test_states_are_few(ranks):
    one, rng = bpe.Transducer(ranks), random.Random(4)
    words = ["".join(rng.choice(["the", "an", "tion", "re", "ing", "ou", "sh"]) for _ in range(5)) for _ in range(3000)]
    for word in words:
        one.encode(word.encode())
    assert len(one._states) < 600


def test_texts_together(ranks):
    import tiktoken
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder, decoder, rng = bpe.Encoder(ranks, public_tokenizers.PATTERN, max_parts=50), bpe.Decoder(ranks), random.Random(5)
    alphabet = ["a", "th", " the", "tion", "'s", " ", "\n", "  ", "1", "😀", "!!", "ß", "\x1c", "x" * 70, "ab" * 2100]
    for _ in range(20):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 20))]
        found = encoder.encode_all(texts)
        assert [x.tolist() for x in found] == [own.encode_ordinary(t) for t in texts]
        assert ["".join(decoder.stream(x, block=rng.choice([1, 3, 1000]))) for x in found] == texts
        assert max(map(len, encoder.parts)) <= encoder.keep_len


def test_decoder_holds_back_what_is_not_whole(ranks):
    decoder = bpe.Decoder(ranks)
    ids = np.array([ranks[bytes([x])] for x in "a😀é".encode() + b"\xe2\x82"], np.int32)
    assert [len(x) for x in decoder.stream(ids, block=1)] == [1, 1, 1, 1]
    assert "".join(decoder.stream(ids.tolist(), block=2)) == "a😀é�"
