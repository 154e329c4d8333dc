"""Operator 5: token counts by a map-side two-tier lookup.

The first tier is a compact table of frequent pre-token lengths, broadcast once. What it lacks
goes to a bounded cache in each worker, which has the library encode the misses. No pre-token
is ever shuffled. Both tiers only remember what the library gives, so counts are exact.

Texts of any length are counted whole; one pre-token of millions of characters is left to the library.
Null text counts as empty: no bytes, no tokens. Repeated rows are counted each by itself, a
null key is carried through, other columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
from collections import Counter
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdigris.llm.common import BoundedCache, quiet_tokenizers

#: Texts that the frequent table is drawn from, by a hash of all that are no longer than so many
#: bytes, and its most entries. They change speed only, and bound what comes to the driver.
SAMPLE_ROWS, SAMPLE_BYTES, TABLE_ENTRIES = 512, 1 << 14, 1 << 15
#: Entries of a worker's cache, and the longest pre-token it keeps.
CACHE_ENTRIES, CACHE_KEY = 1 << 18, 64
#: Characters that old and new versions of Unicode class alike. A text with others is left to the
#: library as a whole, since its tables may differ from those of the pattern matcher here.
SETTLED = regex.compile(r"[\x00-\u0557\u05d0-\u06ff\u0900-\u0965\u0e01-\u0e5b\u1e00-\u1fbc\u2000-\u2070\u20a0-\u20b9\u2100-\u2188\u2190-\u23f3\u2460-\u26ff\u3000-\u312d\u4e00-\u9fcb\uac00-\ud7a3\uf900-\ufa2d\uff01-\uffbe\U0001f300-\U0001f64f]*+")


@functools.lru_cache(maxsize=4)
def load(tokenizer_file: str) -> tuple[Tokenizer, list[str]]:
    """The tokenizer, and the special strings that it recognises inside texts."""
    quiet_tokenizers()
    with open(tokenizer_file, encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f).get("added_tokens", [])]
    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, added


@functools.lru_cache(maxsize=4)
def splitters(pattern: str, added: tuple[str, ...]):
    """The pre-token finder, and a splitter at special strings (None if there are none)."""
    longest_first = sorted(added, key=len, reverse=True)
    special = regex.compile("|".join(map(regex.escape, longest_first))) if added else None
    return regex.compile(pattern), special


def settled(text: str) -> bool:
    return text.isascii() or SETTLED.fullmatch(text) is not None


def pre_tokens(text: str, pattern: str, added: tuple[str, ...]) -> tuple[list[str], int]:
    """The pre-tokens of a text, and how many special strings it holds."""
    find, special = splitters(pattern, added)
    if special is None or not any(x in text for x in added):
        return find.findall(text), 0
    pieces = special.split(text)
    return [t for p in pieces for t in find.findall(p)], len(pieces) - 1


def frequent_lengths(df: DataFrame, tokenizer_file: str, pattern: str, text_col: str) -> dict[str, int]:
    """The compact table: at most TABLE_ENTRIES frequent pre-tokens of a few texts, with lengths."""
    tokenizer, added = load(tokenizer_file)
    text, seen = F.col(text_col).cast("string"), Counter()
    picked = df.select(text.alias("text")).where(text.isNotNull() & (F.octet_length(text) <= SAMPLE_BYTES)).orderBy(F.xxhash64("text")).limit(SAMPLE_ROWS)
    for (found,) in picked.collect():
        if settled(found):
            seen.update(pre_tokens(found, pattern, tuple(added))[0])
    keys = [k for k, n in seen.most_common(TABLE_ENTRIES) if n > 1 and len(k) <= CACHE_KEY]
    return dict(zip(keys, (len(e) for e in tokenizer.encode_batch(keys, add_special_tokens=False))))


def count_tokens(df: DataFrame, tokenizer_file: str, pattern: str, *, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of each row, for a byte-level BPE tokenizer file."""
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, tokenizer_file, pattern, text_col))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        tokenizer, specials = load(tokenizer_file)
        added = tuple(specials)
        cache = BoundedCache(lambda t: len(tokenizer.encode(t, add_special_tokens=False)), CACHE_ENTRIES, CACHE_KEY)

        class Lengths(dict):
            """The first tier; what it lacks is asked of the second."""

            __missing__ = staticmethod(cache.__getitem__)

        length = Lengths(table.value).__getitem__
        for batch in batches:
            n = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                if settled(text):
                    found, special = pre_tokens(text, pattern, added)
                    n.append(sum(map(length, found)) + special)
                else:
                    n.append(len(tokenizer.encode(text, add_special_tokens=False)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).alias("id"), F.octet_length(F.coalesce(text, F.lit(""))).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
