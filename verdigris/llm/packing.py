"""Operator 2: vector bin packing of tokenised examples under simultaneous limits.

A sequence has three limits: tokens, segments and loss-bearing tokens. Each task packs its own
examples, so nothing is shuffled and no task holds more than a window of them. An example longer
than a sequence is cut into pieces that fill sequences of their own; what is left of it goes to
the window. From there the open sequence takes, again and again, the piece with the largest dot
product of its demands with what the sequence has left, each dimension weighted by the mean
demand in the window. When no whole piece fits, the best one is cut so that its head fills the
sequence. Only the last sequence of a task, or one at its segment or loss limit, is padded.

Null text counts as empty: such a row has the end token alone. Repeated keys and repeated rows
are packed row by row; a null key is carried through. Other columns are ignored. An empty table
gives an empty result. Ties go to the larger piece, then to the earlier row.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from verdigris.llm.common import BoundedCache, byte_letters, quiet_tokenizers
from verdigris.llm.token_counts import settled

#: Entries of a worker's cache of word ids, and the longest word it keeps.
CACHE_ENTRIES, CACHE_KEY = 1 << 18, 64
#: Pieces that a task holds at a time.
WINDOW = 1024


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 512
    loss: int = 2048


class WordBpe:
    """Token ids of texts as little-endian 32-bit blobs, with a bounded cache by word.

    The cache serves tokenizers of one kind: NFC, white space to one space, lower case, then a
    pattern whose matches hold no white space and are encoded each by itself; so a text's ids
    are those of its words, split at white space, one after the other. A text that the library's
    Unicode tables might treat differently, or that holds an added token, is encoded whole.
    """

    def __init__(self, tokenizer_file: str):
        quiet_tokenizers()
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [s["type"] for s in (spec.get("normalizer") or {}).get("normalizers", [])]
        first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        self.known = steps == ["NFC", "Replace", "Lowercase"] and first.get("type") == "Split" and bool(first.get("invert")) and first.get("behavior") == "Removed"
        self.find = regex.compile(first["pattern"]["Regex"]).findall if self.known else None
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        self.bytes = byte_letters()
        self.cache = BoundedCache(self.word, CACHE_ENTRIES, CACHE_KEY)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a normalised word."""
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.merge(word)]).tobytes()
        return array("I", [t.id for m in self.find(word) for t in self.merge(m.encode().decode("latin-1").translate(self.bytes))]).tobytes()

    def plain(self, text: str) -> bool:
        """Whether the cache may serve the text."""
        if not self.known or any(x in text for x in self.added) or any(x in text for x in "\x1c\x1d\x1e\x1f"):
            return False
        return text.isascii() or ("Σ" not in text and "İ" not in text and unicodedata.is_normalized("NFC", text) and settled(text))

    def blob(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, text.lower().split())) if self.plain(text) else self.whole(text)


@functools.lru_cache(maxsize=2)
def word_bpe(tokenizer_file: str) -> WordBpe:
    return WordBpe(tokenizer_file)


@dataclass
class Piece:
    key: object
    ids: bytes
    start: int
    total: int
    #: One byte for each token, 1 if it bears loss; None if all do.
    mask: bytes | None

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    @property
    def loss(self) -> int:
        return self.length if self.mask is None else sum(self.mask)

    def cut(self, tokens: int, loss: int) -> tuple[Piece, Piece]:
        """A head within both limits, as long as may be, and the rest."""
        n = min(tokens, self.length)
        if self.mask is None:
            n = min(n, loss)
        elif sum(self.mask[:n]) > loss:
            n = int(np.searchsorted(np.cumsum(np.frombuffer(self.mask, np.uint8), dtype=np.int64), loss, side="right"))
        parts = [None, None] if self.mask is None else [self.mask[:n], self.mask[n:]]
        return Piece(self.key, self.ids[: 4 * n], self.start, self.total, parts[0]), Piece(self.key, self.ids[4 * n :], self.start + n, self.total, parts[1])


class Packer:
    """Packs a stream of pieces; emit(sequence, pieces) is called for each closed sequence."""

    def __init__(self, limits: Limits, emit: Callable[[int, list[Piece]], None], first: int = 0):
        if min(limits.tokens, limits.segments, limits.loss) < 1:
            raise ValueError("limits must be positive")
        self.limits, self.emit, self.next = limits, emit, first
        self.held: list[Piece] = []

    def close(self, pieces: list[Piece]) -> None:
        self.emit(self.next, pieces)
        self.next += 1

    def add(self, key: object, ids: bytes, mask: bytes | None = None) -> None:
        rest = Piece(key, ids, 0, len(ids) // 4, mask)
        while rest.length > self.limits.tokens or rest.loss > self.limits.loss:
            head, rest = rest.cut(self.limits.tokens, self.limits.loss)
            if head.length == self.limits.tokens:
                self.close([head])
            else:
                self.held.append(head)
        if rest.length == self.limits.tokens:
            self.close([rest])
        elif rest.length:
            self.held.append(rest)
        if len(self.held) >= WINDOW:
            self.pack(last=False)

    def finish(self) -> None:
        self.pack(last=True)

    def pack(self, last: bool) -> None:
        """Close sequences until the window is used up; unless last, an unfilled one is held."""
        bins: dict[tuple[int, int], list[Piece]] = {}
        for p in reversed(self.held):
            bins.setdefault((p.length, p.loss), []).append(p)
        kinds = sorted(bins, reverse=True)
        stacks = [bins[k] for k in kinds]
        demand = np.array([(t, 1, x) for t, x in kinds], dtype=np.float64).reshape(-1, 3)
        count = np.array([len(s) for s in stacks])
        left, self.held = len(self.held), []
        full = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=np.float64)
        if left:
            weight = (demand * count[:, None]).sum(0) / left / full
        spare: list[Piece] = []  # rests of cut pieces, taken before all else
        while left or spare:
            room, mine = full.copy(), []

            def take(p: Piece) -> None:
                mine.append(p)
                room.__isub__((p.length, 1, p.loss))

            while room[0] > 0 and room[1] > 0:
                if spare and spare[-1].length <= room[0] and spare[-1].loss <= room[2]:
                    take(spare.pop())
                    continue
                best = None
                if left:
                    fits = (count > 0) & (demand <= room).all(1)
                    score = np.where(fits, demand @ (weight * room / full / full), -1.0)
                    best = int(score.argmax())
                    if not fits[best]:
                        best = None
                if best is not None:
                    take(stacks[best].pop())
                    count[best] -= 1
                    left -= 1
                    continue
                if room[2] <= 0 or not (spare or left):
                    break
                if spare:
                    chosen = spare.pop()
                else:
                    best = int(np.where(count > 0, demand @ (weight * room / full / full), -1.0).argmax())
                    chosen = stacks[best].pop()
                    count[best] -= 1
                    left -= 1
                head, rest = chosen.cut(int(room[0]), int(room[2]))
                if not head.length:
                    spare.append(chosen)
                    break
                take(head)
                spare.append(rest)
            if not last and not left and not spare and room[0] > 0 and room[1] > 0 and room[2] > 0:
                self.held = mine
                return
            self.close(mine)


FIELDS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment int, loss_tokens long"


def pack(df: DataFrame, encode: Callable[[list], list[tuple[bytes, bytes | None]]], limits: Limits, *, id_col: str, columns: list[str]) -> DataFrame:
    """One row for each piece: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ...).

    encode() gets a list of rows, each a tuple of the columns, and gives each row's ids and loss
    mask. A sequence's number is the task's number times 2**33 plus its number in the task.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[tuple] = []

        def emit(sequence: int, pieces: list[Piece]) -> None:
            at = 0
            for k, p in enumerate(pieces):
                out.append((p.key, p.start, p.length, zlib.crc32(p.ids), p.total, sequence, at, k, p.loss))
                at += p.length

        def flush(schema: pa.Schema) -> pa.RecordBatch:
            columns_ = list(zip(*out)) or [()] * len(schema)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns_, schema)], schema=schema)

        packer = Packer(limits, emit, TaskContext.get().partitionId() << 33)
        schema = None
        for batch in batches:
            if schema is None:
                long, int_ = pa.int64(), pa.int32()
                schema = pa.schema([("id", batch.schema.field("id").type), ("start", long), ("length", long), ("ids_crc32", long), ("doc_tokens", long), ("sequence_id", long), ("offset", long), ("segment", int_), ("loss_tokens", long)])
            for at in range(0, batch.num_rows, 64):
                keys, *columns_ = (c.to_pylist() for c in batch.slice(at, 64).columns)
                for key, (ids, mask) in zip(keys, encode(list(zip(*columns_)))):
                    packer.add(key, ids, mask)
            if len(out) >= 4096:
                yield flush(schema)
        packer.finish()
        if out:
            yield flush(schema)

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    return rows.mapInArrow(run, f"id {kind}, {FIELDS}").withColumnRenamed("id", id_col)


def pack_documents(df: DataFrame, tokenizer_file: str, *, end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Plain texts: every token, and the end token after each text, bears loss."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(rows: list) -> list[tuple[bytes, bytes | None]]:
        return [(blob + end, None) for blob in (word_bpe(tokenizer_file).blob(r[0] or "") for r in rows)]

    return pack(df, encode, limits, id_col=id_col, columns=[text_col])


def pack_turns(df: DataFrame, tokenizer_file: str, *, learned_role: str = "assistant", end_id: int = 1, limits: Limits = Limits(2048, 64, 1536), id_col: str = "conv_id", turns_col: str = "turns") -> DataFrame:
    """Instruction data: an array<struct<role, text>> a row; only the learned role's turns, with
    their end tokens, bear loss."""
    end = np.array([end_id], "<u4").tobytes()

    def encode(rows: list) -> list[tuple[bytes, bytes | None]]:
        coded = []
        for (turns,) in rows:
            turns = [t for t in turns or [] if t]
            blobs = [b + end for b in (word_bpe(tokenizer_file).blob(t["text"] or "") for t in turns)]
            coded.append((b"".join(blobs), b"".join((b"\1" if t["role"] == learned_role else b"\0") * (len(b) // 4) for t, b in zip(turns, blobs))))
        return coded

    return pack(df, encode, limits, id_col=id_col, columns=[turns_col])
