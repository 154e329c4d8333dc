import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from verdigris.llm import byte_bpe, token_counts

TEXTS = [
    "Hello world, it's 12 o'clock.",
    "",
    None,
    "  leading\n\n and   trailing  ",
    "<|endoftext|>a <|endoftext|> b<|endoftext|>",
    "naïve café Straße 漢字かな 🎉🎉  x y\x1cz\x85q",
    "new letters \U000323b0\U000323b1 Ᲊ ՘a՘",
    "word " * 30_000,
    "a" * 70_000,
    "\n".join(["x  y\t\tz"] * 9_000),
    "Hello world, it's 12 o'clock.",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "shadow", 7) for i, t in enumerate(TEXTS)] + [(None, "null key", "x", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, id int")


def test_counts_match_the_library(docs):
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, P.path("byte_bpe_50k.json"), P.PATTERN).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, text in enumerate(TEXTS):
        n = len(tokenizer.encode(text or "", add_special_tokens=False))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 1024), i


def test_encoding_matches_the_library_and_round_trips(docs):
    enc = byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert isinstance(enc, tiktoken.Encoding)
    full = {r.doc_id: r for r in byte_bpe.encode_documents(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    short = {r.doc_id: r for r in byte_bpe.encode_digests(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()}
    for i, text in enumerate(TEXTS):
        ids = enc.encode_ordinary(text or "")
        assert list(full[i].ids) == ids and bytes(full[i].decoded) == (text or "").encode()
        assert short[i].n_tokens == len(ids)
        assert short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_spans_join_and_are_safe():
    enc = byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    for text in [t for t in TEXTS if t]:
        for limit in (1, 7, 64):
            cut = list(byte_bpe.spans(text[:3000], limit))
            assert "".join(cut) == text[:3000]
            assert [x for s in cut for x in enc.encode_ordinary(s)] == enc.encode_ordinary(text[:3000])


def test_very_long_stretches_are_encoded_match_by_match(spark):
    """Runs of one kind of character, in which no span can be cut."""
    encode = byte_bpe.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    enc = byte_bpe.encoding(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    eager = byte_bpe.Encoder(byte_bpe.ranks_of(P.path("byte_bpe_50k.tiktoken")), P.PATTERN, limit=2, longest=0)
    for text in [t for t in TEXTS if t]:
        assert eager(text[:20_000]) == enc.encode_ordinary(text[:20_000])
    n = 3_000_000
    texts = [" " * n + "x", "\n" * n, "\u3000" * n, " \n\u3000" * (n // 3) + "end", "a" * n, "1" * n, "!" * n]
    for text in texts:
        assert enc.decode_bytes(encode(text)) == text.encode()
    assert encode(" " * n + "x") == encode(" " * (n - 1)) + enc.encode_ordinary(" x")
    rows = spark.createDataFrame([(1, " " * n), (None, None), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_tokens) for r in byte_bpe.encode_digests(rows, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect())
    assert got == [("1", n), ("None", 0), ("None", 0)]
    assert [r.n_tokens for r in token_counts.count_tokens(rows.where("doc_id = 1"), P.path("byte_bpe_50k.json"), P.PATTERN).collect()] == [n]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_counts.count_tokens(none, P.path("byte_bpe_50k.json"), P.PATTERN).count() == 0
    assert byte_bpe.encode_digests(none, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
