"""Operator 9: Katz backoff language model scoring.

Bigrams back off to unigrams, and those to one unknown word. Counts are discounted by
Good-Turing; backoff weights are exactly normalised: what discounting frees after a history is
shared out among the words not seen after it, in proportion to their unigram probabilities.

Texts are read once, into chunks of documents: sorted word hashes and numbered tokens, kept in a
table in the shared folder. Each level of the model is a table in buckets. A chunk asks each
bucket about its distinct words, then about its distinct bigrams, sending its own training
counts along; the bucket adds up what all chunks sent and answers each in the order asked. So
what moves is one entry for each distinct n-gram of a chunk, never a token. Buckets grow in
number with the corpus, so that each holds about ENTRIES entries. A history with more than HOT
occurrences is spread over several buckets by its next word, whose sums the chunk adds up. Each
token is then evaluated recursively in its chunk. Only counts of counts come to the driver.

Whole texts are scored, however long; a chunk is closed by its tokens as well as its documents. Words
are told apart by 64-bit XXH64. Null and empty texts are the end token alone. The first
token's history is a start mark, which is not a token. Where Good-Turing cannot be applied
(counts of counts that are zero, or a discount outside 0 to 1) a count r keeps (r - 1/2)/r of
itself, or all of itself if no word occurs once; a level that frees less than one part in its
total plus one is scaled to free that much. Without training texts every token is unknown with
probability 1. A null key counts as the empty text in the split; repeated rows count and are
scored one by one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import held_out, loosen, squeeze, written

#: Counts up to this are discounted.
K = 5
#: Tokens in a chunk, entries in a bucket, occurrences of a history in a bucket; about.
CHUNK, ENTRIES, HOT = 1 << 20, 1 << 20, 1 << 18
#: Hashes of the marks: no word holds white space.
END, START_ID = np.uint64(xxhash.xxh64_intdigest(b"\n")), -1


def mix(ids: np.ndarray) -> np.ndarray:
    """Spread ids evenly over 31 bits."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(33)).astype(np.int64)


def hashes(text: str | None) -> np.ndarray:
    """The hashes of a text's tokens."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    out = np.empty(len(found) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    out[-1] = END
    return out


def discounts(n: np.ndarray) -> np.ndarray:
    """What each count 0 to K + 1 keeps, from the counts of counts n[1] to n[K + 1]."""
    keep = np.ones(K + 2)
    if n[1] > 0:
        excess = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - excess) / (1 - excess) if n[r] and n[r + 1] and excess < 1 else 0.0
            keep[r] = d if 0 < d <= 1 else (r - 0.5) / r
    return keep


@dataclass
class Level:
    """Counts of counts of one level, and its discounts."""

    total: int
    kinds: int
    n: np.ndarray

    def __post_init__(self):
        self.keep = discounts(self.n)

    def seen(self, counts: np.ndarray, total, freed) -> np.ndarray:
        """Probabilities of seen events, given what is freed in all (see freed())."""
        raw, out = freed
        return self.keep[np.minimum(counts, K + 1)] * counts / np.maximum(total, 1) * (1 - out) / np.where(raw < 1, 1 - raw, 1)

    def freed(self, kinds_by_count: np.ndarray, total):
        """The mass that discounting frees, as it comes and as it is used."""
        raw = (kinds_by_count * ((1 - self.keep[1 : K + 1]) * np.arange(1, K + 1))).sum(-1) / np.maximum(total, 1)
        return raw, np.maximum(raw, 1 / (np.asarray(total, float) + 1))

    def unknown(self) -> float:
        return float(self.freed(self.n[1 : K + 1], self.total)[1]) if self.total else 1.0

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """Probability of words with these training counts; 0 is the unknown word."""
        if not self.total:
            return np.ones(len(counts))
        p = self.seen(counts, self.total, self.freed(self.n[1 : K + 1], self.total))
        return np.where(counts > 0, p, self.unknown())


def count_of_counts(counts: np.ndarray) -> np.ndarray:
    seen = counts[counts > 0]
    return np.concatenate([[seen.sum(), len(seen)], np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[: K + 2]]).astype(np.int64)


def level(answers: DataFrame) -> Level:
    """The level whose buckets told these counts of counts (rows without a chunk); summed in the tasks."""

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            found = sum((loosen(x) for x in b.column("a").to_pylist()), np.zeros(K + 4, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(range(K + 4), pa.int32()), pa.array(found)], names=["place", "n"])

    counts = answers.where("chunk is null").select("a").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = np.zeros(K + 4, np.int64)
    for r in counts.collect():
        found[r["place"]] = r["n"]
    return Level(int(found[0]), int(found[1]), found[2:])


class Chunk:
    """A row of the token table, with what the buckets have answered so far."""

    def __init__(self, row: dict):
        self.lengths, self.words, self.tokens = loosen(row["lengths"]), loosen(row["words"], np.uint64), loosen(row["tokens"])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.teach = np.repeat(np.asarray(row["teach"], bool), self.lengths)

    def word_slices(self, buckets: int) -> np.ndarray:
        edges = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
        return np.concatenate([[0], np.searchsorted(self.words, edges), [len(self.words)]]).astype(np.int64)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.tokens[self.teach], minlength=len(self.words)).astype(np.int64)

    def answer_words(self, answers: dict[int, tuple[bytes, bytes]], buckets: int) -> None:
        self.count, self.id = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        at = self.word_slices(buckets)
        for b, (counts, ids) in answers.items():
            self.count[at[b] : at[b + 1]], self.id[at[b] : at[b + 1]] = loosen(counts), loosen(ids)

    def arrange(self, buckets: int, starts: int, hot: int) -> None:
        """Distinct bigrams of known words, and the parts of their histories, by bucket."""
        size = len(self.words)
        before = np.empty_like(self.tokens)
        before[1:], before[self.starts] = self.tokens[:-1], size
        self.before = before
        codes, self.which = np.unique(before * size + self.tokens, return_inverse=True)
        self.history, self.next = codes // size, codes % size
        self.pair_counts = np.bincount(self.which[self.teach], minlength=len(codes)).astype(np.int64)
        count, ids = np.append(self.count, starts), np.append(self.id, START_ID)
        self.asked = np.unique(self.history)
        self.asked = self.asked[count[self.asked] > 0]
        parts = np.minimum(1 + count[self.asked] // hot, buckets)
        first = np.cumsum(parts) - parts
        owner = np.repeat(np.arange(len(self.asked)), parts)
        bucket = (mix(ids[self.asked])[owner] + np.arange(len(owner)) - first[owner]) % buckets
        self.part = np.lexsort((owner, bucket))
        place = np.empty(len(owner), np.int64)
        place[self.part] = np.arange(len(owner))
        self.part_owner, part_bucket = owner[self.part], bucket[self.part]
        self.part_id = ids[self.asked][self.part_owner]
        slot = np.full(size + 1, -1, np.int64)
        slot[self.asked] = np.arange(len(self.asked))
        self.slot = slot
        known = np.flatnonzero((slot[self.history] >= 0) & (self.count[self.next] > 0))
        mine = slot[self.history[known]]
        spot = place[first[mine] + mix(self.id[self.next[known]] + 1) % parts[mine]] if len(known) else known
        order = np.lexsort((self.id[self.next[known]], spot))
        self.pair, self.pair_spot = known[order], spot[order]
        self.part_at = np.searchsorted(part_bucket, np.arange(buckets + 1))
        self.pair_at = np.searchsorted(self.pair_spot, self.part_at)

    def answer_pairs(self, answers: dict[int, tuple], kinds: int = K) -> None:
        self.pair_total = np.zeros(len(self.history), np.int64)
        self.h_total, self.h_kinds, self.h_lower = np.zeros(len(self.asked), np.int64), np.zeros((len(self.asked), kinds), np.int64), np.zeros(len(self.asked))
        for b, (totals, histories, lower) in answers.items():
            self.pair_total[self.pair[self.pair_at[b] : self.pair_at[b + 1]]] = loosen(totals)
            owner = self.part_owner[self.part_at[b] : self.part_at[b + 1]]
            sums = loosen(histories).reshape(1 + kinds, -1)
            np.add.at(self.h_total, owner, sums[0])
            np.add.at(self.h_kinds, owner, sums[1:].T)
            np.add.at(self.h_lower, owner, loosen(lower, np.float64))

    def log_probabilities(self, one: Level, two: Level) -> np.ndarray:
        """log10 of each token's probability after the one before it."""
        lower = one.unigram(self.count)
        p = lower[self.next]
        slot = self.slot[self.history]
        told = slot >= 0
        told[told] = self.h_total[slot[told]] > 0
        s = slot[told]
        raw, freed = two.freed(self.h_kinds[s], self.h_total[s])
        seen = two.seen(self.pair_total[told], self.h_total[s], (raw, freed))
        backed = freed / np.maximum(1 - self.h_lower[s], one.unknown()) * p[told]
        p[told] = np.where(self.pair_total[told] > 0, seen, backed)
        return np.log10(p)[self.which]


def token_table(rows: DataFrame, kind: str, chunk_tokens: int) -> DataFrame:
    """Chunks of rows (id, text, teach): see Chunk."""

    def run(batches: Iterator) -> Iterator:
        part, seq = TaskContext.get().partitionId(), 0
        ids, teach, docs, size = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            words, tokens = np.unique(np.concatenate(docs), return_inverse=True)
            lengths = np.array([len(d) for d in docs], np.int64)
            cells = [part << 24 | seq, ids, teach, squeeze(lengths), squeeze(words), squeeze(tokens.astype(np.int64)), len(words), len(tokens), int((lengths[np.asarray(teach, bool)]).size)]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cells, [pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()])], names=names)

        names = ["chunk", "ids", "teach", "lengths", "words", "tokens", "n_words", "n_tokens", "n_teach"]
        for batch in batches:
            id_type = batch.schema.field("id").type
            for doc_id, text, learns in zip(*(batch.column(c) for c in ("id", "text", "teach"))):
                found = hashes(text.as_py())
                ids.append(doc_id.as_py())
                teach.append(learns.as_py())
                docs.append(found)
                size += len(found)
                if size >= chunk_tokens:
                    yield chunk()
                    ids, teach, docs, size, seq = [], [], [], 0, seq + 1
        if docs:
            yield chunk()

    return rows.mapInArrow(run, f"chunk long, ids array<{kind}>, teach array<boolean>, lengths binary, words binary, tokens binary, n_words long, n_tokens long, n_teach long")


def ask(table: DataFrame, answers: DataFrame | None, make: Callable[[Chunk, dict], Iterator[tuple[int, list]]]) -> DataFrame:
    """(bucket, chunk, a, b, c) of what each chunk asks, given the answers it has."""
    schema = pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("e", pa.binary())])
    ddl = "bucket int, chunk long, a binary, b binary, c binary, d binary, e binary"

    def rows(row: dict, got: dict) -> pa.RecordBatch:
        found = [(b, row["chunk"], *blobs, *[None] * (5 - len(blobs))) for b, blobs in make(Chunk(row), got)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*found)) or [[]] * len(schema), schema)], schema=schema)

    if answers is None:
        return table.mapInArrow(lambda batches: (rows(r, {}) for b in batches for r in b.to_pylist()), ddl)

    def run(mine: pa.Table, told: pa.Table) -> pa.Table:
        got = {r["bucket"]: r for r in told.to_pylist()}
        return pa.Table.from_batches([rows(r, got) for r in mine.to_pylist()], schema)

    return table.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, ddl)


def answered(asked: DataFrame, answer: Callable[[int, list[dict]], tuple[list[tuple], bytes]], name: str) -> DataFrame:
    """(chunk, bucket, a, b, c): the answers, and one row of counts of counts with no chunk."""
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        bucket = rows[0]["bucket"]
        replies, counts = answer(bucket, rows)
        found = [(r["chunk"], bucket, *reply, *[None] * (3 - len(reply))) for r, reply in zip(rows, replies)] + [(None, bucket, counts, None, None)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found), schema)], schema=schema)

    return written(asked.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, a binary, b binary, c binary"), name)


def score(df: DataFrame, *, modulus: int = 7, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = CHUNK, entries: int = ENTRIES, hot: int = HOT) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    kind = df.schema[id_col].dataType.simpleString()
    out = held_out(F.col(id_col), modulus, remainder)
    table = written(token_table(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (~out).alias("teach")), kind, chunk_tokens), "tokens")
    sizes = table.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_teach")).first()
    one_buckets, two_buckets, starts = max(1, -(-(sizes[0] or 0) // entries)), max(1, -(-(sizes[1] or 0) // entries)), int(sizes[2] or 0)

    def ask_words(chunk: Chunk, _: dict):
        at, counts = chunk.word_slices(one_buckets), chunk.word_counts()
        for b in range(one_buckets):
            if at[b] < at[b + 1]:
                yield b, [chunk.words[at[b] : at[b + 1]].tobytes(), squeeze(counts[at[b] : at[b + 1]])]

    def answer_words(bucket: int, rows: list[dict]):
        asked = [np.frombuffer(r["a"], np.uint64) for r in rows]
        words, which = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(which, np.concatenate([loosen(r["b"]) for r in rows]), len(words)).astype(np.int64)
        ids = np.empty(len(words), np.int64)
        ids[np.argsort(-total, kind="stable")] = np.arange(len(words)) * one_buckets + bucket
        parts = np.split(which, np.cumsum([len(a) for a in asked])[:-1])
        return [(squeeze(total[p]), squeeze(ids[p])) for p in parts], squeeze(count_of_counts(total))

    words = answered(ask(table, None, ask_words), answer_words, "unigrams")
    one = level(words)

    def with_words(chunk: Chunk, got: dict) -> Chunk:
        chunk.answer_words({b: (r["a"], r["b"]) for b, r in got.items()}, one_buckets)
        chunk.arrange(two_buckets, starts, hot)
        return chunk

    def ask_pairs(chunk: Chunk, got: dict):
        with_words(chunk, got)
        pairs = chunk.pair
        ids, counts, lower = chunk.id[chunk.next[pairs]], chunk.pair_counts[pairs], chunk.count[chunk.next[pairs]]
        runs = np.bincount(chunk.pair_spot, minlength=len(chunk.part)).astype(np.int64)
        for b in range(two_buckets):
            p, q = slice(*chunk.part_at[b : b + 2]), slice(*chunk.pair_at[b : b + 2])
            if p.start < p.stop:
                yield b, [squeeze(chunk.part_id[p]), squeeze(runs[p]), squeeze(ids[q]), squeeze(counts[q]), squeeze(lower[q])]

    def answer_pairs(bucket: int, rows: list[dict]):
        asked, runs = ([loosen(r[c]) for r in rows] for c in "ab")
        histories, h = np.unique(np.concatenate(asked), return_inverse=True)
        of_pair = np.repeat(h, np.concatenate(runs))
        nexts = [loosen(r["c"]) for r in rows]
        names, w = np.unique(np.concatenate(nexts), return_inverse=True)
        codes, first, which = np.unique(of_pair * max(1, len(names)) + w, return_index=True, return_inverse=True)
        total = np.bincount(which, np.concatenate([loosen(r["d"]) for r in rows]), len(codes)).astype(np.int64)
        lower = one.unigram(np.concatenate([loosen(r["e"]) for r in rows])[first])
        owner, n = codes // max(1, len(names)), len(histories)
        sums = [np.bincount(owner, total, n).astype(np.int64)] + [np.bincount(owner[total == r], minlength=n).astype(np.int64) for r in range(1, K + 1)]
        mass = np.bincount(owner[total > 0], lower[total > 0], n)
        replies, at, to = [], 0, 0
        for a, x in zip(asked, nexts):
            mine = h[at : at + len(a)]
            replies.append((squeeze(total[which[to : to + len(x)]]), squeeze(np.concatenate([s[mine] for s in sums])), squeeze(mass[mine])))
            at, to = at + len(a), to + len(x)
        return replies, squeeze(count_of_counts(total))

    asked_words = words.where("chunk is not null")
    pairs = answered(ask(table, asked_words, ask_pairs), answer_pairs, "bigrams")
    two = level(pairs)
    told = asked_words.withColumn("order", F.lit(1)).unionByName(pairs.where("chunk is not null").withColumn("order", F.lit(2)))

    def evaluate(mine: pa.Table, answers: pa.Table) -> pa.Table:
        got: dict[int, dict] = {1: {}, 2: {}}
        for r in answers.to_pylist():
            got[r["order"]][r["bucket"]] = r
        tables = []
        for row in mine.to_pylist():
            chunk = with_words(Chunk(row), got[1])
            chunk.answer_pairs({b: (r["a"], r["b"], r["c"]) for b, r in got[2].items()})
            count = chunk.count[chunk.tokens]
            base = np.log10((count + 1) / (one.total + one.kinds + 1))
            ids = mine.schema.field("ids").type.value_type
            sums = [np.add.reduceat(x, chunk.starts) for x in ((count > 0).astype(np.int64), base, chunk.log_probabilities(one, two))]
            columns = [pa.array(row["ids"], ids), pa.array([not t for t in row["teach"]]), pa.array(chunk.lengths), pa.array(sums[0]), pa.array([one.total] * len(chunk.lengths), pa.int64()), pa.array(sums[1]), pa.array(sums[2])]
            tables.append(pa.table(columns, names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(tables)

    scored = table.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(evaluate, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)
