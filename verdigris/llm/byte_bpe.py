"""Operator 10: byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts of any length are encoded whole, in spans that are cut where no match of the pattern can lie.
Where a long stretch has no such place, as in a run of white space, it is cut at the matches of the
pattern, each of which is encoded by itself; the library's own splitter would overflow its stack there.

Null text counts as empty; empty text has no ids. A null or repeated key is carried through
as it is, each row by itself; other columns of the input are ignored unless asked for, so
clashing names cannot occur. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A single space between two characters that no library takes for white space. No match of the
#: pattern spans it from the left and the next match starts with it, so a cut before it is safe.
_SOLID = r"[^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
SAFE_BOUNDARY = regex.compile(f"(?<={_SOLID}) (?={_SOLID})")
#: Texts beyond this many characters are encoded in spans cut at safe boundaries, and spans beyond
#: the second number match by match.
SPAN_CHARS, LONG_SPAN = 1 << 15, 1 << 17


@functools.lru_cache(maxsize=4)
def ranks_of(rank_file: str) -> dict[bytes, int]:
    """The ranks of a local file."""
    with open(rank_file, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def by_ranks(ranks: dict[bytes, int], pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a local rank file, without special tokens."""
    return by_ranks(ranks_of(rank_file), pattern)


@functools.lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str) -> Encoder:
    return Encoder(ranks_of(rank_file), pattern)


def spans(text: str, limit: int = SPAN_CHARS) -> Iterator[str]:
    """Cut at safe boundaries into spans of about limit characters; they join to the text.

    A stretch without a safe boundary stays one span, however long it is.
    """
    start, n = 0, len(text)
    while n - start > limit:
        cut = SAFE_BOUNDARY.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class Encoder:
    """Encodes texts of any length by ranks (bytes to id) and a pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, limit: int = SPAN_CHARS, longest: int = LONG_SPAN):
        self.library, self.piece = by_ranks(ranks, pattern), by_ranks(ranks, "(?s:.+)")
        self.matches, self.limit, self.longest = regex.compile(pattern), limit, longest

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= self.limit:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for span in spans(text, self.limit):
            if len(span) <= self.longest:
                ids += self.library.encode_ordinary(span)
            else:
                for match in self.matches.finditer(span):
                    ids += self.piece.encode_ordinary(match[0])
        return ids


def decode(ids: list[int], enc: tiktoken.Encoding) -> bytes:
    """The raw bytes of the ids, which need not be whole characters."""
    return enc.decode_bytes(ids)


def encode_documents(df: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of each row. Map-only, one row in memory at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, encode = encoding(rank_file, pattern), encoder(rank_file, pattern)
        for pdf in frames:
            ids = [encode(t) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "ids": ids, "decoded": [decode(x, enc) for x in ids]})

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def encode_digests(df: DataFrame, rank_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as encode_documents(), digested where it is made."""

    def run(batches_: Iterator) -> Iterator:
        import pyarrow as pa

        enc, encode = encoding(rank_file, pattern), encoder(rank_file, pattern)
        decimal = [str(i) for i in range(enc.max_token_value + 1)]
        for batch in batches_:
            n, coded, back = [], [], []
            for text in batch.column("text"):
                ids = encode(text.as_py())
                n.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(decode(ids, enc)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)
