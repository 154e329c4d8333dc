"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import sys

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.sources.work import shared_dir, written

__all__ = ["written"]


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage is cut and the rows outlive any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    return id_bucket(doc_id, modulus) == F.lit(remainder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(name: str, columns: list[str]) -> str:
    """A name for a column of one's own that none of the columns has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot if it holds more than one in so many rows, so at most so many keys are hot.
HOT = 1000


def hot_join(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """rows joined to named (key, ..., n), n being the number of rows with the key, at least. The
    hot keys, at most HOT, are broadcast, so that no key's rows meet in one task."""
    total = rows.count()
    hot = F.broadcast(named.where(F.col("n") > F.lit(max(total // HOT, 1))).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti").join(named.drop("n"), key)
    return rest.unionByName(rows.join(hot, key))


def squeeze(values: np.ndarray) -> bytes:
    """Integers or floats of 8 bytes, as compressed planes of bytes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def loosen(blob: bytes, kind=np.int64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=0) if blob else b"", np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(kind)


class BoundedCache(dict):
    """A dictionary that computes what it misses and starts anew when it is full."""

    def __init__(self, compute, limit: int, max_key: int = 256):
        super().__init__()
        self.compute, self.limit, self.max_key = compute, limit, max_key

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.max_key:
            if len(self) >= self.limit:
                self.clear()
            self[key] = value
        return value


def quiet_tokenizers() -> None:
    """One thread in each task: the scheduler has given the task one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))


def byte_letters() -> dict[int, str]:
    """The visible character that byte-level tokenizers write for each byte: printable Latin-1
    ones stand for themselves, the others are numbered from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
