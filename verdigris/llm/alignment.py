"""Operator 12: alignment of two tokenizers over a corpus, by packed int64 pair keys.

1. align(): each text is encoded by both tokenizers and cut into groups at the byte offsets where
   tokens of both end. What a text links, its distinct pairs of ids with the number of links, is kept
   with it as arrays of packed keys, so no text is encoded twice.
2. count_shards(): in each partition numpy.unique adds up in how many texts a key occurs; the partial
   counts are sorted by key over all partitions by ranges, and runs of one key are added up. Each
   range is one shard, a sorted file of keys and a file of counts in the shared folder.
3. corpus_counts(): every text's keys are looked up in the shards by searchsorted. Shards are mapped
   into memory where the shared folder is a file system of the machine, and else read one at a time.

A group links every token of A in it with every token of B in it. A key occurs once in each row of a
partial count at most, so no common pair makes a task of its own; the highest count of each id of A,
which is as many as the vocabulary has, is all that comes to the driver.

Texts that are null or empty, or whose joined bytes of either side are not those of space and text,
have no tokens: zeros and an empty digest. Each row counts as a document, repeated ones too; null ids
are carried through, other columns are ignored, an empty table gives an empty result. Texts of any
length are encoded whole; the links of one group are counted by its distinct ids.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.byte_bpe import Encoder
from verdigris.llm.common import byte_letters, quiet_tokenizers
from verdigris.llm.token_counts import settled
from verdigris.sources.work import work_dir, written

#: Keys that a task holds before it adds them up, and before it lets partial counts go.
HELD_KEYS, HELD_COUNTS = 1 << 21, 1 << 21
#: Texts of a batch of results and of a lookup; links of a group beyond which it is counted by its distinct ids.
BATCH_ROWS, LOOKUP_ROWS, GROUP_LINKS = 256, 1024, 1 << 16


class Side:
    """A tokenizer with the bytes of each id."""

    def __init__(self, pieces: list[bytes | None], encode):
        self.pieces, self.encode = pieces, encode
        self.lengths = np.array([len(p or b"") for p in pieces], np.int64)
        #: Ids in decimal with what follows them: another one of their group and side, or its end.
        self.decimal = {c: np.array([f"{i}{c}" for i in range(len(pieces))], object) for c in ",|;"}

    def bytes_of(self, ids: list[int]) -> bytes | None:
        try:
            return b"".join(map(self.pieces.__getitem__, ids))
        except TypeError:  # an id that stands for no bytes
            return None


@functools.lru_cache(maxsize=2)
def byte_level(tokenizer_file: str, pattern: str | None = None) -> Side:
    """A byte-level BPE tokenizer; special strings inside texts are plain text. With the pattern by which
    it splits texts, and ids in the order of its merges, tiktoken encodes by the same ranks, faster;
    texts with letters that the libraries may class differently are left to the tokenizer's own."""
    from tokenizers import Tokenizer

    quiet_tokenizers()
    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    with open(tokenizer_file, encoding="utf-8") as f:
        told = json.load(f)
    special = {t["id"] for t in told.get("added_tokens", [])}
    byte_of = {letter: b for b, letter in byte_letters().items()}
    pieces: list[bytes | None] = [None] * tokenizer.get_vocab_size(True)
    for token, i in tokenizer.get_vocab(True).items():
        if i not in special and all(c in byte_of for c in token):
            pieces[i] = bytes(byte_of[c] for c in token)
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    ranks = {p: i for i, p in enumerate(pieces) if p is not None}
    merged = [ranks.get(bytes(byte_of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))) for m in told["model"]["merges"]]
    if pattern is None or None in merged or merged != sorted(merged):
        return Side(pieces, lambda text: whole(" " + text))
    quick = Encoder(ranks, pattern)
    return Side(pieces, lambda text: quick(" " + text) if settled(text) else whole(" " + text))


@functools.lru_cache(maxsize=2)
def sentence_pieces(model_file: str) -> Side:
    """A piece tokenizer that adds the first space itself, with bytes for what it lacks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces: list[bytes | None] = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            pieces.append(None)
        else:
            pieces.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return Side(pieces, lambda text: model.encode(text, num_threads=1))


def side(file: str, pattern: str | None = None) -> Side:
    return byte_level(file, pattern) if file.endswith(".json") else sentence_pieces(file)


class Aligned:
    """The groups of one text: for each token the group it is in, and how many tokens a group has."""

    def __init__(self, a: Side, b: Side, a_ids: list[int], b_ids: list[int]):
        self.a, self.b, self.a_ids, self.b_ids = a, b, np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_ends, b_ends = np.cumsum(a.lengths[self.a_ids]), np.cumsum(b.lengths[self.b_ids])
        marks = np.zeros((2, int(a_ends[-1]) + 1), bool)
        marks[0, a_ends] = marks[1, b_ends] = True
        #: Whether a token is the last of its group; a token's group is the number of ends before it.
        self.a_last, self.b_last = marks[1, a_ends], marks[0, b_ends]
        self.a_group, self.b_group = np.cumsum(self.a_last) - self.a_last, np.cumsum(self.b_last) - self.b_last
        self.a_size, self.b_size = (np.diff(np.flatnonzero(x), prepend=-1) for x in (self.a_last, self.b_last))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct keys that are linked, ascending, and the number of links of each."""
        linked = self.a_size * self.b_size
        wide = np.flatnonzero(linked > GROUP_LINKS)
        a_at = np.flatnonzero(~np.isin(self.a_group, wide)) if len(wide) else np.arange(len(self.a_ids))
        group = self.a_group[a_at]
        n = self.b_size[group]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        b_at = np.repeat((np.cumsum(self.b_size) - self.b_size)[group], n) + within
        keys, times = [packed(np.repeat(self.a_ids[a_at], n), self.b_ids[b_at])], [np.ones(len(b_at), np.int64)]
        for g in wide:
            x, nx = np.unique(self.a_ids[self.a_group == g], return_counts=True)
            y, ny = np.unique(self.b_ids[self.b_group == g], return_counts=True)
            keys.append(packed(np.repeat(x, len(y)), np.tile(y, len(x))))
            times.append(np.repeat(nx, len(y)) * np.tile(ny, len(x)))
        return added(np.concatenate(keys), np.concatenate(times))

    def text(self) -> str:
        """a1,a2|b1;a3|b2,b3: the ids of each group in decimal, in order."""
        out = np.empty(len(self.a_ids) + len(self.b_ids), object)
        a_place = np.arange(len(self.a_ids)) + (np.cumsum(self.b_size) - self.b_size)[self.a_group]
        b_place = np.arange(len(self.b_ids)) + np.cumsum(self.a_size)[self.b_group]
        out[a_place], out[b_place] = self.a.decimal[","][self.a_ids], self.b.decimal[","][self.b_ids]
        out[a_place[self.a_last]] = self.a.decimal["|"][self.a_ids[self.a_last]]
        out[b_place[self.b_last]] = self.b.decimal[";"][self.b_ids[self.b_last]]
        return "".join(out.tolist())[:-1]


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A pair of ids as one key; keys are in order of the id of A, then of B."""
    return (a.astype(np.int64) << 32) | b


def added(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, with their times added up."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(times, first)


def aligned(text: str | None, a: Side, b: Side) -> Aligned | None:
    """A text's groups; None where it has no tokens."""
    if not text:
        return None
    whole = (" " + text).encode()
    a_ids, b_ids = a.encode(text), b.encode(text)
    if a.bytes_of(a_ids) != whole or b.bytes_of(b_ids) != whole:
        return None
    return Aligned(a, b, a_ids, b_ids)


def align(df: DataFrame, a_file: str, b_file: str, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups_sha256, keys array<long>, times array<long>). pattern: by
    which byte-level tokenizers split texts, if known; it changes speed only."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, times array<long>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = side(a_file, pattern), side(b_file, pattern)
        for batch in batches:
            for at in range(0, len(batch), BATCH_ROWS):
                part, numbers, digests, keys, times = batch.slice(at, BATCH_ROWS), [], [], [], []
                for text in part.column("text"):
                    found = aligned(text.as_py(), a, b)
                    if found is None:
                        numbers.append((0, 0, 0, 0))
                        digests.append("")
                        keys.append(np.empty(0, np.int64))
                        times.append(np.empty(0, np.int64))
                        continue
                    numbers.append((len(found.a_ids), len(found.b_ids), len(found.a_size), int((found.a_size * found.b_size).sum())))
                    digests.append(hashlib.sha256(found.text().encode()).hexdigest())
                    for kept, values in zip((keys, times), found.pairs()):
                        kept.append(values)
                columns = [pa.array([x[i] for x in numbers], pa.int64()) for i in range(4)]
                offsets = pa.array(np.append(0, np.cumsum([len(k) for k in keys])).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.empty(0, np.int64))) for x in (keys, times)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns, pa.array(digests, pa.string()), *lists], names=names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): in how many texts of the partition each key occurs, in parts of bounded size."""
    held: list[np.ndarray] = []
    keys, counts, size = np.empty(0, np.int64), np.empty(0, np.int64), 0

    def merge() -> None:
        nonlocal keys, counts, held, size
        found, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.int64), np.empty(0, np.int64))
        keys, counts = added(np.concatenate([keys, found]), np.concatenate([counts, n]))
        held, size = [], 0

    def let_go() -> pa.RecordBatch:
        nonlocal keys, counts
        out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["key", "n"])
        keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        return out

    for batch in batches:
        for values in batch.column("keys"):
            found = values.values.to_numpy()
            held.append(found)
            size += len(found)
            if size > HELD_KEYS:
                merge()
                if len(keys) > HELD_COUNTS:
                    yield let_go()
    merge()
    yield let_go()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and the folder's path there."""
    found = urlparse(folder)
    if found.scheme in ("", "file"):
        return fs.LocalFileSystem(), found.path or folder
    return fs.FileSystem.from_uri(folder)


def store_shard(folder: str, name: str, keys: np.ndarray, counts: np.ndarray) -> None:
    """A shard's two files, each moved into place when it is whole, so that a task that runs again or
    twice leaves the same."""
    where, path = opened(folder)
    where.create_dir(path, recursive=True)
    for part, values in (("keys", keys), ("counts", counts)):
        passing = f"{path}/.{name}-{part}-{uuid.uuid4().hex}"
        with where.open_output_stream(passing) as out:
            out.write(np.ascontiguousarray(values, np.int64).tobytes())
        where.move(passing, f"{path}/{name}-{part}")


def shard_values(folder: str, name: str, part: str) -> np.ndarray:
    """A shard's keys or counts: mapped from the file, or read where files cannot be mapped."""
    where, path = opened(folder)
    if isinstance(where, fs.LocalFileSystem):
        return np.memmap(f"{path}/{name}-{part}", np.int64, "r") if os.path.getsize(f"{path}/{name}-{part}") else np.empty(0, np.int64)
    with where.open_input_stream(f"{path}/{name}-{part}") as f:
        return np.frombuffer(f.read(), np.int64)


def count_shards(found: DataFrame) -> tuple[str, list[tuple[int, int, str]], dict[int, int]]:
    """(folder, [(first key, last key, name)], highest count of each id of A) of the corpus's keys."""
    folder = f"{work_dir(found.sparkSession)}/shards-{uuid.uuid4().hex}"

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds up the runs of a range, which come sorted, and stores them as one shard."""
        keys, counts = [], []
        for batch in batches:
            k, n = added(batch.column("key").to_numpy(), batch.column("n").to_numpy())
            if keys and len(k) and keys[-1][-1] == k[0]:  # a run goes on across batches
                counts[-1][-1] += n[0]
                k, n = k[1:], n[1:]
            if len(k):
                keys.append(k)
                counts.append(n)
        if keys:
            k, n = np.concatenate(keys), np.concatenate(counts)
            name = f"{int(k[0]):016x}"
            store_shard(folder, name, k, n)
            first = np.flatnonzero(np.append(True, (k[1:] >> 32) != (k[:-1] >> 32)))
            best = np.maximum.reduceat(n, first)
            size = len(first)
            yield pa.RecordBatch.from_arrays([pa.array([name] * size), pa.array([int(k[0])] * size, pa.int64()), pa.array([int(k[-1])] * size, pa.int64()), pa.array(k[first] >> 32), pa.array(best)], names=["name", "first", "last", "a_id", "best"])

    partial = found.select("keys").mapInArrow(partial_counts, "key long, n long")
    ranges = partial.repartitionByRange("key").sortWithinPartitions("key")
    told = written(ranges.mapInArrow(shard, "name string, first long, last long, a_id long, best long"), "shards")
    shards = sorted((r["first"], r["last"], r["name"]) for r in told.select("name", "first", "last").distinct().collect())
    best = {r["a_id"]: r["best"] for r in told.groupBy("a_id").agg(F.max("best").alias("best")).collect()}
    return folder, shards, best


class Counts:
    """Looks keys up in the shards of one folder."""

    def __init__(self, folder: str, shards: list[tuple[int, int, str]]):
        self.folder, self.names, self.open = folder, [s[2] for s in shards], {}
        self.first = np.array([s[0] for s in shards], np.int64)
        self.mapped = isinstance(opened(folder)[0], fs.LocalFileSystem)

    def shard(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        if at not in self.open:
            if not self.mapped:
                self.open.clear()
            self.open[at] = (shard_values(self.folder, self.names[at], "keys"), shard_values(self.folder, self.names[at], "counts"))
        return self.open[at]

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys, which are ascending and all in the shards."""
        out, place = np.zeros(len(keys), np.int64), np.searchsorted(self.first, keys, side="right") - 1
        cuts = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(keys) else []
        for start, end in zip(cuts, [*cuts[1:], len(keys)]):
            there, counts = self.shard(int(place[start]))
            out[start:end] = counts[np.searchsorted(there, keys[start:end])]
        return out


def corpus_counts(found: DataFrame, folder: str, shards: list[tuple[int, int, str]], best: dict[int, int]) -> DataFrame:
    """Adds n_best and count_sum to what align() gives, in place of keys and times."""
    top = np.zeros(max(best, default=0) + 1, np.int64)
    top[list(best)] = list(best.values())
    sent = found.sparkSession.sparkContext.broadcast((top, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        highest, counts = sent.value[0], Counts(folder, sent.value[1])
        for batch in (b.slice(at, LOOKUP_ROWS) for b in batches for at in range(0, len(b), LOOKUP_ROWS)):
            n_best, total, keys = [], [], batch.column("keys")
            # one lookup for the rows together: their keys in order, so each shard is gone through once
            flat, times = keys.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            unique, back = np.unique(flat, return_inverse=True)
            n = counts(unique)[back] if len(flat) else flat
            is_best, at = n == highest[flat >> 32], 0
            for size in (len(k) for k in keys):
                part = slice(at, at + size)
                n_best.append(int(times[part][is_best[part]].sum()))
                total.append(int((times[part] * n[part]).sum()))
                at += size
            kept = [c for c in batch.schema.names if c not in ("keys", "times")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=[*kept, "n_best", "count_sum"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name not in ("keys", "times"))
    return found.mapInArrow(run, f"{schema}, n_best long, count_sum long")


def pair_counts(spark: SparkSession, folder: str, shards: list[tuple[int, int, str]]) -> DataFrame:
    """(a_id, b_id, n): the corpus-wide table of linked pairs, a task a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("name").to_pylist():
                k, n = shard_values(folder, name, "keys"), shard_values(folder, name, "counts")
                for at in range(0, len(k), 1 << 16):
                    part = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(k[part] >> 32), pa.array(k[part] & 0xFFFFFFFF), pa.array(np.asarray(n[part]))], names=["a_id", "b_id", "n"])

    names = spark.createDataFrame([(s[2],) for s in shards], "name string").repartition(max(1, len(shards)))
    return names.mapInArrow(run, "a_id long, b_id long, n long")


def report(df: DataFrame, a_file: str, b_file: str, pattern: str | None = None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row."""
    found = written(align(df, a_file, b_file, pattern, id_col=id_col, text_col=text_col), "aligned")
    out = corpus_counts(found, *count_shards(found))
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
