"""Operator 6: toxicity by subword-bag embeddings and a linear softmax, trained jointly.

A word is the bag of its character n-grams (three to five, edges counted) and itself, each
hashed to a row of one embedding table. A text is the average of its words' vectors and a few
neutral ones, a word's being the average of its bag's; a linear softmax on that gives the score. Table and softmax are
trained together in numpy by full-batch Adam on the driver, so a misspelling never seen shares
most of its vectors with the word it stands for.

Training reads whole texts of a bounded sample of the labelled rows: at most TRAIN_ROWS rows
and TRAIN_BYTES bytes a label, in the order of a hash of the key; a text that would overrun the
bytes is passed over, but the shortest LEAST_ROWS of a label teach if fewer fit. Whole texts are
scored, map-only.
Null and empty texts, and those without a word, get the score of the bias alone; if either
label has no row to learn from, every score is the share of label 1 (0 without any rows). Null
labels teach nothing; of repeated labels the largest holds; a null key counts as the empty text
in the split and has no label. Repeated rows are scored alike; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm.common import held_out

WORD = re.compile(r"[^\W_]+")
GRAMS = (3, 4, 5)
#: Rows and width of the embedding table, bits as a power of two.
TABLE_BITS, WIDTH = 17, 4
#: Rows and bytes of each label that teach; neutral words that each average takes in.
TRAIN_ROWS, TRAIN_BYTES, NEUTRAL = {1: 2500, 0: 4000}, {1: 6_000_000, 0: 10_000_000}, 6
#: Rows of a label that teach, however long they are.
LEAST_ROWS = 4
#: Share of label 1 that the score assumes.
PRIOR = 0.33
STEPS, RATE, DECAY = 60, 0.4, 2e-6
#: Entries of a worker's cache of word scores, and the longest word it keeps.
CACHE_ENTRIES, CACHE_KEY = 1 << 18, 64

_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def bags(items: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of each word's bag, as (rows, which word), words in order within a size."""
    joined = "".join(f"<{w}>" for w in items)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in items), np.int64, len(items))
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(items)), lengths)
    room = ends[owner] - np.arange(len(points))
    shift = np.uint64(64 - TABLE_BITS)
    found, whose = [], []
    for n in GRAMS:
        at = np.flatnonzero(room >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = (h ^ points[at + k]) * _MIX
            h ^= h >> np.uint64(29)
        found.append((h * _MIX) >> shift)
        whose.append(owner[at])
    # the word itself: its code points, weighted by odd powers of their place
    if len(items):
        place = np.arange(len(points)) - np.repeat(ends - lengths, lengths)
        power = np.multiply.accumulate(np.full(int(lengths.max()) + 1, np.uint64(0x100000001B3) | np.uint64(1)))
        h = np.add.reduceat((points + np.uint64(7)) * power[place], ends - lengths)
        h ^= h >> np.uint64(31)
        found.append((h * _MIX) >> shift)
        whose.append(np.arange(len(items)))
    return np.concatenate(found).astype(np.int64) if found else np.empty(0, np.int64), np.concatenate(whose) if whose else np.empty(0, np.int64)


@dataclass
class Model:
    """The trained model, folded: a table row's share of the difference of the two logits."""

    pull: np.ndarray
    bias: float

    def word_pulls(self, items: list[str]) -> np.ndarray:
        rows, whose = bags(items)
        n = len(items)
        return np.bincount(whose, self.pull[rows], n) / np.maximum(np.bincount(whose, minlength=n), 1)

    def score(self, found: list[str], pull_of) -> float:
        logit = self.bias + sum(map(pull_of, found)) / (len(found) + NEUTRAL)
        return float(1 / (1 + np.exp(-np.clip(logit, -500, 500))))


def train(texts: list[str], labels: list[int], *, steps: int = STEPS, rate: float = RATE, seed: int = 1) -> Model:
    """Joint training; labels are weighted to count alike, and PRIOR is taken in afterwards."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(np.zeros(1 << TABLE_BITS), float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    vocabulary: dict[str, int] = {}
    doc_of, word_of, weight = [], [], []
    for d, text in enumerate(texts):
        counts = Counter(words(text))
        total = sum(counts.values())
        for w, n in counts.items():
            doc_of.append(d)
            word_of.append(vocabulary.setdefault(w, len(vocabulary)))
            weight.append(n / (total + NEUTRAL))
    doc_of, word_of, weight = np.asarray(doc_of, np.int32), np.asarray(word_of, np.int32), np.asarray(weight)
    names, blocks = list(vocabulary), []
    for at in range(0, len(names), 1 << 14):  # in blocks, so that the driver needs little memory
        found, of = bags(names[at : at + (1 << 14)])
        blocks.append((found.astype(np.int32), (of + at).astype(np.int32)))
    rows, whose = (np.concatenate(x) for x in zip(*blocks)) if blocks else (np.empty(0, np.int32), np.empty(0, np.int32))
    del blocks, names
    share = 1.0 / np.maximum(np.bincount(whose, minlength=len(vocabulary)), 1)
    n_docs, n_words, size = len(texts), len(vocabulary), 1 << TABLE_BITS
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / WIDTH, 1 / WIDTH, (WIDTH, size))
    softmax, bias = rng.uniform(-1, 1, (WIDTH, 2)), np.zeros(2)
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n_docs - y.sum()))
    target = np.stack([1 - y, y], 1)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, softmax, bias)]
    for step in range(1, steps + 1):
        word_vectors = np.stack([np.bincount(whose, table[k][rows], n_words) for k in range(WIDTH)]) * share
        hidden = np.stack([np.bincount(doc_of, word_vectors[k][word_of] * weight, n_docs) for k in range(WIDTH)])
        logits = hidden.T @ softmax + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * balance[:, None]
        g_hidden = (g @ softmax.T).T
        g_table = np.empty_like(table)
        for k in range(WIDTH):
            g_word = np.bincount(word_of, g_hidden[k][doc_of] * weight, n_words) * share
            g_table[k] = np.bincount(rows, g_word[whose], size)
        for param, grad, (m, v) in zip((table, softmax, bias), (g_table + DECAY * table, hidden @ g, g.sum(0)), state):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad**2
            param -= rate * min(1.0, 3 * (1 - (step - 1) / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(table.T @ (softmax[:, 1] - softmax[:, 0]), float(bias[1] - bias[0] + np.log(PRIOR / (1 - PRIOR))))


def learn(docs: DataFrame, labels: DataFrame, *, modulus: int = 5, remainder: int = 0, train_rows: dict[int, int] = TRAIN_ROWS, train_bytes: dict[int, int] = TRAIN_BYTES) -> Model:
    """Train on a bounded sample of docs (doc_id, text) with labels (doc_id, toxic)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).where(~held_out(F.col("doc_id"), modulus, remainder))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = docs.select("doc_id", F.octet_length("text").alias("size")).where(F.col("size").isNotNull())
    present = known.join(sizes.groupBy("doc_id").agg(F.max("size").alias("size")), "doc_id")
    chosen: dict[object, int] = {}
    for label in (1, 0):
        own = present.where(F.col("toxic") == label)
        spent, taken = 0, []
        for r in own.where(F.col("size") <= train_bytes[label]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows[label]).collect():
            if spent + r["size"] <= train_bytes[label]:
                spent += r["size"]
                taken.append(r["doc_id"])
        if len(taken) < LEAST_ROWS:
            shortest = own.orderBy("size", F.xxhash64("doc_id"), "doc_id").limit(min(LEAST_ROWS, train_rows[label])).collect()
            taken += [r["doc_id"] for r in shortest if r["doc_id"] not in taken][: LEAST_ROWS - len(taken)]
        chosen |= dict.fromkeys(taken, label)
    if not chosen:
        return train([], [])
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in chosen], docs.select("doc_id").schema)
    rows = docs.where(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    order = [i for i in chosen if i in texts]
    return train([texts[i] for i in order], [chosen[i] for i in order])


class Scorer:
    """Scores lists of texts, with a bounded cache of word scores."""

    def __init__(self, model: Model):
        self.model, self.cache = model, {}

    def __call__(self, texts: list[str | None]) -> list[float]:
        found = [words(t) for t in texts]
        new = set().union(*found) if found else set()
        if len(self.cache) + len(new) > CACHE_ENTRIES:
            self.cache.clear()
        cache, missing = self.cache, sorted(new - self.cache.keys())
        once: dict[str, float] = {}
        for at in range(0, len(missing), 8192):
            part = missing[at : at + 8192]
            for w, pull in zip(part, self.model.word_pulls(part).tolist()):
                (cache if len(w) <= CACHE_KEY else once)[w] = pull
        pull_of = (cache | once if once else cache).__getitem__
        return [self.model.score(f, pull_of) for f in found]


def keep_clean(df: DataFrame, labels: DataFrame, *, modulus: int = 5, remainder: int = 0, most: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, whole, that score less than most; map-only once trained."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = df.sparkSession.sparkContext.broadcast(learn(rows, labels.select("doc_id", "toxic"), modulus=modulus, remainder=remainder))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for texts in parts:
            yield pd.Series([x for at in range(0, len(texts), 256) for x in scorer(texts.iloc[at : at + 256].tolist())], dtype="float64")

    return df.where(scored(F.col(text_col)) < most)


def score(df: DataFrame, labels: DataFrame, *, modulus: int = 5, remainder: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of each row; held-out rows' labels teach nothing."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = df.sparkSession.sparkContext.broadcast(learn(rows, labels.select("doc_id", "toxic"), modulus=modulus, remainder=remainder))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        scorer = Scorer(model.value)
        for batch in batches:
            scores = [x for at in range(0, batch.num_rows, 256) for x in scorer(batch.column("text").slice(at, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    kind = df.schema[id_col].dataType.simpleString()
    scored = rows.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.select(F.col("doc_id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
