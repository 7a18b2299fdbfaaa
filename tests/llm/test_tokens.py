import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from grantlens.llm import byte_bpe, token_counts
from tests.llm.helpers import frame, odd_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def encoding():
    ranks = byte_bpe.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library(spark, library):
    rows = odd_rows()
    found = token_counts.count_tokens(frame(spark, rows), MODEL, limit=20).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in rows]
    key = lambda r: (r[0] is None, r)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in found), key=key) == sorted(expected, key=key)
    assert all(r.over_limit == (r.n_tokens > 20) for r in found)
    assert token_counts.count_tokens(frame(spark, []), MODEL).count() == 0


def test_cuts_do_not_change_counts(library):
    draw = random.Random(1)
    for _ in range(400):
        text = "".join(draw.choice(["a", "the", " ", "  ", "\n", "é", "▁", "x y", " ."]) for _ in range(40))
        for size in (1, 3, 10):
            parts = token_counts.cut_text(text, size)
            assert sum(len(library.encode(p)) for p in parts) == len(library.encode(text)), text


def test_bpe_equals_the_library(spark, encoding):
    rows = odd_rows()
    found = byte_bpe.round_trip(frame(spark, rows), RANKS, public_tokenizers.PATTERN).collect()
    expected = []
    for i, t in rows:
        ids = encoding.encode_ordinary(t or "")
        expected.append(
            (i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
             hashlib.sha256((t or "").encode()).hexdigest())
        )
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert byte_bpe.encode(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_trees_merge_as_the_library_does(encoding):
    coder = byte_bpe.byte_bpe(RANKS, public_tokenizers.PATTERN)
    draw = random.Random(2)
    texts = ["a" * 5000, "ab" * 900, "\x1c \x85　 x", "<|endoftext|>", "'s't I'Ve", "1" * 999]
    texts += ["".join(chr(draw.choice([97, 98, 32, 233, 0x4E2D, 0x1F600, 10])) for _ in range(n)) for n in range(60)]
    assert coder.encode_batch(texts) == [encoding.encode_ordinary(t) for t in texts]
    assert [coder.decode(ids) for ids in coder.encode_batch(texts)] == [t.encode() for t in texts]
