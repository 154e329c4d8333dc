import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import toxicity


def test_bags_hold_the_grams_and_the_word():
    rows, whose = toxicity.bags(["abcd", "x", "abcd"])
    by = [sorted(rows[whose == k]) for k in range(3)]
    assert by[0] == by[2] and len(by[0]) == 4 + 3 + 2 + 1 and len(by[1]) == 1 + 1
    assert len(toxicity.bags([])[0]) == 0


def test_misspellings_share_vectors():
    rng = np.random.default_rng(0)
    plain = ["stone", "river", "green", "walks", "under", "light", "table", "cloud"]
    texts = [" ".join(rng.choice(plain, 30)) for _ in range(120)]
    labels = [i % 2 for i in range(120)]
    texts = [t + (" idiot moron" if y else " gentle") for t, y in zip(texts, labels)]
    model = toxicity.train(texts, labels)
    pull = dict(zip(["idioot", "moronn", "gentlee"], model.word_pulls(["idioot", "moronn", "gentlee"])))
    assert pull["idioot"] > 0 and pull["moronn"] > 0 and pull["gentlee"] < 0


def test_scores_and_edge_cases(spark):
    bad, good = "you idiot moron go away now", "you are kind please stay with us"
    rows = [(i, (good, bad)[i % 2], "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "!!", "x"), (None, bad, "x"), (103, bad * 3000, "x"), (1, bad, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(0, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 60:
            assert r.predicted == r.doc_id % 2
    assert len({r.score for r in got if r.doc_id in (100, 101, 102)}) == 1
    assert toxicity.score(docs.limit(0), labels).count() == 0
    for none in (labels.limit(0), labels.where("toxic = 1")):
        assert len({r.score for r in toxicity.score(docs, none).collect()}) == 1


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.score(docs, labels).where("held_out").join(labels, "doc_id").select("score", "toxic").toPandas()
    rank = got["score"].rank()
    y = got["toxic"] == 1
    auc = (rank[y].mean() - (y.sum() + 1) / 2) / (len(y) - y.sum())
    assert auc > 0.9


def test_an_overlong_row_does_not_end_the_sample(spark):
    bad, good = "you idiot moron go away now", "you are kind please stay with us"
    for long in ("first", "all"):
        rows = [(i, (good, bad)[i % 2] * (3000 if long == "all" else 1)) for i in range(60)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
        if long == "first":  # the row of each label that the hash puts first
            for y in (0, 1):
                one = labels.where(f"toxic = {y} and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0").selectExpr("doc_id").orderBy(F.xxhash64("doc_id")).first().doc_id
                rows[one] = (one, rows[one][1] * 3000)
            docs = spark.createDataFrame(rows, "doc_id long, text string")
        model = toxicity.learn(docs, labels, train_bytes={1: 5000, 0: 5000})
        scores = toxicity.Scorer(model)([bad, good])
        assert scores[0] > 0.5 > scores[1], long


def brute_bag(word):
    """The table rows of a word's bag, by plain integers."""
    mask, mix, shift = (1 << 64) - 1, 0x9E3779B97F4A7C15, 64 - toxicity.TABLE_BITS
    points, out = [ord(c) for c in f"<{word}>"], []
    for n in toxicity.GRAMS:
        for at in range(len(points) - n + 1):
            h = n
            for p in points[at : at + n]:
                h = ((h ^ p) * mix) & mask
                h ^= h >> 29
            out.append(((h * mix) & mask) >> shift)
    h, power = 0, 1
    for p in points:
        power = power * 0x100000001B3 & mask
        h = (h + (p + 7) * power) & mask
    h ^= h >> 31
    return [*out, ((h * mix) & mask) >> shift]


def brute_train(texts, labels, steps):
    """The same training word by word, in plain Python; gives the logit of a text."""
    W, rng = toxicity.WIDTH, np.random.default_rng(1)
    table, softmax, bias = rng.uniform(-1 / W, 1 / W, (W, 1 << toxicity.TABLE_BITS)), rng.uniform(-1, 1, (W, 2)), np.zeros(2)
    bag = {w: brute_bag(w) for t in texts for w in toxicity.words(t)}
    state = {id(p): (np.zeros_like(p), np.zeros_like(p)) for p in (table, softmax, bias)}

    def hidden(text):
        found = toxicity.words(text)
        return sum((np.mean([table[:, r] for r in brute_bag(w)], axis=0) for w in found), np.zeros(W)) / (len(found) + toxicity.NEUTRAL)

    for step in range(1, steps + 1):
        grads = [toxicity.DECAY * table, np.zeros_like(softmax), np.zeros(2)]
        for text, y in zip(texts, labels):
            h = hidden(text)
            p = np.exp(h @ softmax + bias)
            g = (p / p.sum() - np.eye(2)[y]) * 0.5 / labels.count(y)
            grads[1] += np.outer(h, g)
            grads[2] += g
            found = toxicity.words(text)
            for w in found:
                for r in bag[w]:
                    grads[0][:, r] += softmax @ g / (len(found) + toxicity.NEUTRAL) / len(bag[w])
        for param, grad in zip((table, softmax, bias), grads):
            m, v = state[id(param)]
            m[:] = 0.9 * m + 0.1 * grad
            v[:] = 0.99 * v + 0.01 * grad**2
            param -= toxicity.RATE * min(1.0, 3 * (1 - (step - 1) / steps)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    prior = np.log(toxicity.PRIOR / (1 - toxicity.PRIOR))
    return lambda text: float(np.diff(hidden(text) @ softmax + bias)[0] + prior)


def test_training_and_scores_match_brute_force():
    texts, labels = ["you idiot, go", "a kind day", "kind idiot day day", "", "go ünïcode x"], [1, 0, 0, 0, 1]
    logit = brute_train(texts, labels, 3)
    asked = [*texts, "idioot", "!!", "kind kind words"]
    got = toxicity.Scorer(toxicity.train(texts, labels, steps=3))(asked)
    assert np.allclose(got, [1 / (1 + np.exp(-logit(t))) for t in asked], atol=1e-9)
