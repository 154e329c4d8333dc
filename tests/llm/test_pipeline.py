import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from pyspark.sql import functions as F

import corpus_pipeline
from verdigris.llm import language_id, simhash, toxicity


def similarity(a, b):
    def runs(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    a, b = runs(a), runs(b)
    return len(a & b) / max(1, len(a | b))


def test_stages_on_the_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    one = corpus_pipeline.known_language(spark, docs, d)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert kept == {i for i, r in rows.items() if r.text and any(c.isalpha() for c in r.text)}
    two = corpus_pipeline.not_toxic(spark, one, d)
    assert two.columns == docs.columns
    clean = {r.doc_id for r in two.collect()}
    assert clean <= kept and len(clean) > 0.8 * len(kept)
    assert not [i for i in kept & clean if labels.get(i) == 1 and zlib.crc32(str(i).encode()) % 5]
    three = corpus_pipeline.no_copies(spark, two, d)
    assert three.columns == docs.columns
    left = {r.doc_id for r in three.collect()}
    assert left <= clean
    for i in clean - left:  # brute force: a copy with a smaller key stays or leads to one that does
        assert any(similarity(rows[i].text, rows[j].text) > 0.6 for j in clean if j < i)
    texts = {}
    for i in sorted(left):
        assert texts.setdefault(rows[i].text, i) == i
    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = corpus_pipeline.packed(spark, three, d).collect()
    found = {}
    for r in pieces:
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == left
    for i, own in found.items():
        ids = tokenizer.encode(rows[i].text, add_special_tokens=False).ids + [1]
        assert sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[r.start : r.start + r.length], "<u4").tobytes())


def test_odd_rows_pass_every_stage(spark, tmp_path):
    text = "the cat sat on the mat and looked at the moon all night long with great care "
    rows = [(1, text * 3, "en", "a", 1, "x"), (1, text * 3, "en", "a", 1, "x"), (None, "der hund ist nicht hier", "de", None, None, None), (None, "der hund ist nicht hier", "de", None, None, None), (2, None, "en", None, 0, "x"), (3, "", None, "b", 0, "x"), (4, "12 34", "de", "b", 0, "x"), (5, "a long river ran under the old stone bridge to the sea " * 2000, "en", "b", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    spark.createDataFrame([(1, 0), (5, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = docs
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
        assert out.columns == docs.columns
        counts.append(out.count())
    assert counts == [5, 5, 3]
    assert {r.doc_id for r in corpus_pipeline.packed(spark, out, str(tmp_path)).collect()} == {1, None, 5}
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_operators_agree_with_their_stages(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id for r in toxicity.keep_clean(docs, labels).collect()}
    assert kept == {r.doc_id for r in toxicity.score(docs, labels).where("predicted = 0").collect()}
    judged = {r.doc_id: r for r in language_id.identify(docs).collect()}
    known = {r.doc_id for r in language_id.keep_known(docs).collect()}
    assert all(judged[i].nearness > 0 for i in known) and {i for i, r in judged.items() if r.nearness > language_id.KNOWN_MOST} <= known


def test_gibberish_and_unlearned_languages_go(spark):
    rng = random.Random(5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = "talvella on aina kylmä ja lumi peittää metsän kun lapset menevät koulun jälkeen ulos leikkimään pimeässä illassa".split()
    letters = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(10_000_000 + i, " ".join(letters(rng.randint(2, 9)) for _ in range(n)), None, "s", 1) for i, n in enumerate((20, 100, 500, 3000) * 5)]
    rows += [(10_001_000 + i, " ".join(rng.choice(words) for _ in range(n)), None, "s", 1) for i, n in enumerate((50, 200, 1000) * 5)]
    junk = spark.createDataFrame(rows, docs.schema)
    kept = {r.doc_id for r in language_id.keep_known(docs.unionByName(junk)).select("doc_id").collect()}
    assert not [i for i in kept if i >= 10_000_000]
    sound = {r.doc_id for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    assert len(sound - kept) <= 0.002 * len(sound)


def test_all_labelled_rows_teach_languages(spark):
    rows = spark.range(9000).selectExpr("concat('ab ', id) as text", "if(id % 9 = 0, null, 'xx') as lang")
    assert language_id.labelled(rows).count() == 8000
    model = language_id.learn(language_id.labelled(rows.withColumn("text", F.expr("if(lang = 'xx', 'q', text)"))))
    assert model.names == ["xx"] and model.judge("q")[0] == "xx"


def test_copies_among_the_groups(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    groups = {r.group_id for r in simhash.copy_groups(docs).collect()}
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == groups


def test_keys_of_other_kinds_and_clashing_names(spark):
    text = "the cat sat on the mat and looked at the moon all night long with great care"
    rows = [("doc-b", text, 1), ("doc-a", text, 2), (None, "another text altogether that has no copy in here", 3), ("doc-c", "x", 4), ("doc-c", "y", 5)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __KEY int")
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or "", r["__KEY"]) for r in got.collect()) == [("", 3), ("doc-a", 2), ("doc-c", 4), ("doc-c", 5)]
