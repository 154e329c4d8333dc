import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from verdigris.llm import katz

END, START = object(), object()


def tokens(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), END]


class Brute:
    """The same model, from dictionaries."""

    def __init__(self, texts):
        self.one, self.two = Counter(), defaultdict(Counter)
        for text in texts:
            before = START
            for t in tokens(text):
                self.one[t] += 1
                self.two[before][t] += 1
                before = t
        self.total = sum(self.one.values())
        self.keep1 = self.keeps(self.one.values())
        self.keep2 = self.keeps([c for h in self.two.values() for c in h.values()])

    def keeps(self, counts):
        n = Counter(counts)
        keep = {r: 1.0 for r in range(1, 6)}
        if n[1]:
            excess = 6 * n[6] / n[1]
            for r in range(1, 6):
                d = 0
                if n[r] and n[r + 1] and excess < 1:
                    d = ((r + 1) * n[r + 1] / (r * n[r]) - excess) / (1 - excess)
                keep[r] = d if 0 < d <= 1 else (r - 0.5) / r
        return keep

    def split(self, counts, keep):
        total = sum(counts.values())
        raw = {w: keep.get(c, 1.0) * c / total for w, c in counts.items()}
        free = 1 - sum(raw.values())
        used = max(free, 1 / (total + 1))
        return {w: p * (1 - used) / (1 - free) for w, p in raw.items()}, used

    def unigram(self, w):
        if not self.total:
            return 1.0
        p, unknown = self.split(self.one, self.keep1)
        return p.get(w, unknown)

    def bigram(self, h, w):
        if h not in self.two:
            return self.unigram(w)
        p, free = self.split(self.two[h], self.keep2)
        return p[w] if w in p else free / (1 - sum(self.unigram(x) for x in p)) * self.unigram(w)

    def score(self, text):
        before, out = START, 0.0
        for t in tokens(text):
            out += math.log10(self.bigram(before, t))
            before = t
        return out


def fixture():
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{int(x)}" for x in rng.zipf(1.4, rng.integers(1, 60)) if x < 500) for _ in range(150)]
    return [*texts, None, "", "  ", "one two ONE", "été Été", "w1 " * 3000, texts[0], "unheard-of words here"]


@pytest.mark.parametrize("sizes", [(1 << 20, 1 << 20, 1 << 18), (200, 300, 20)])
def test_scores_match_brute_force(spark, sizes):
    texts = fixture()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "null w1 key", "y", 2), (3, texts[3], "z", 3)], "doc_id long, text string, score string, chunk int").repartition(3)
    got = katz.score(df, chunk_tokens=sizes[0], entries=sizes[1], hot=sizes[2]).collect()
    assert len(got) == len(texts) + 2
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    rows = [*enumerate(texts), (None, "null w1 key"), (3, texts[3])]
    model = Brute([t for i, t in rows if not out(i)])
    for r in got:
        text = dict(rows)[r.doc_id]
        ts = tokens(text)
        assert r.held_out == out(r.doc_id) and r.n_tokens == len(ts) and r.train_tokens == model.total
        assert r.n_known == sum(model.one[t] > 0 for t in ts)
        base = sum(math.log10((model.one[t] + 1) / (model.total + len(model.one) + 1)) for t in ts)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(model.score(text), rel=1e-9), r.doc_id


def test_probabilities_sum_to_one():
    model = Brute([t for t in fixture()])
    for h in [START, "w1", "w2", "w7"]:
        assert sum(model.bigram(h, w) for w in [*model.one, "unknown"]) == pytest.approx(1)


def test_without_training_texts_and_empty(spark):
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = katz.score(spark.createDataFrame([(out, "a b")], "doc_id long, text string")).collect()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (True, 3, 0, 0, 0.0, 0.0)
    assert katz.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
