import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from verdigris.llm import language_id, packing

FILE = P.path("word_bpe_49k.json")
TEXTS = ["A small text, isn't it?", "", None, "  ", "Äpfel ÉCOLE ΣΑΣ İx", "<|endoftext|>a b<|startoftext|>", "x" * 5000, "word 12 " * 4000, "a\x1cb\x85c d", "A small text, isn't it?", "é combininǵ", "\U000323b0 new"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "null key", "y", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, id int").repartition(2)


def check_pieces(rows, ids_of, limits):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits.tokens and len(pieces) <= limits.segments and sum(r.loss_tokens for r in pieces) <= limits.loss
    return by_sequence


def test_documents_are_packed_whole(docs):
    tokenizer = Tokenizer.from_file(FILE)
    rows = packing.pack_documents(docs, FILE).collect()
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(TEXTS)} | {None: tokenizer.encode("null key", add_special_tokens=False).ids + [1]}
    sequences = check_pieces(rows, ids, packing.Limits())
    short = [s for s in sequences.values() if sum(r.length for r in s) < 2048]
    assert len(short) <= 2  # the last of each task


@pytest.mark.parametrize("limits", [packing.Limits(64, 4, 64), packing.Limits(64, 16, 20), packing.Limits(50, 2, 10)])
def test_all_limits_hold(spark, limits):
    rng = np.random.default_rng(3)
    turns = [(i, [(("user", "assistant")[k % 2], "w " * int(rng.integers(0, 60))) for k in range(int(rng.integers(0, 5)))]) for i in range(80)]
    df = spark.createDataFrame([*turns, (80, None), (81, [("assistant", None)])], "doc_id long, turns array<struct<role:string,text:string>>")
    rows = packing.pack_turns(df, FILE, limits=limits, id_col="doc_id").collect()
    tokenizer = Tokenizer.from_file(FILE)
    ids = {i: [x for _, t in ts for x in [*tokenizer.encode(t, add_special_tokens=False).ids, 1]] for i, ts in turns}
    check_pieces(rows, {i: x for i, x in ids.items() if x} | {81: [1]}, limits)


def test_packing_an_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), FILE).count() == 0


def brute_profile(text):
    grams = Counter()
    for word in "".join(c if c.isalpha() else " " for c in text.lower()).split():
        padded = f" {word} "
        for n in (1, 2, 3):
            grams.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != " ")
    code = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [code(g) for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][: language_id.PROFILE]


def test_profiles_match_brute_force():
    for text in ("The cat, the hat; a b!", "Ünïcode 漢字 straße x1y2", "a"):
        assert language_id.ranked(*language_id.gram_counts(text)).tolist() == brute_profile(text)


def test_distance_matches_brute_force():
    ranks = {"aa": brute_profile("the cat and the hat"), "bb": brute_profile("der hund und die katze")}
    profiles, doc = language_id.Profiles(ranks), brute_profile("the hund sat")
    for name, got in zip(profiles.names, profiles.distances(np.asarray(doc))):
        far = sum(abs(ranks[name].index(g) - i) if g in ranks[name] else language_id.PROFILE for i, g in enumerate(doc))
        assert got == pytest.approx(far / (language_id.PROFILE * len(doc)))


def test_language_edge_cases_and_held_out(spark):
    en, de = "the cat sat on the mat and it was this", "der hund ist nicht und die katze das ein"
    rows = [(i, (en, de)[i % 2], ("en", "de")[i % 2], "z") for i in range(40)]
    rows += [(100, None, "en", "z"), (101, "", None, "z"), (102, "12 %% 3", "de", "z"), (None, en, "en", "z"), (103, de, None, "z"), (1, de, "de", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.identify(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2)
        if r.doc_id in (100, 101, 102):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id < 100:
            assert r.lang_pred == ("en", "de")[r.doc_id % 2] and 0 <= r.score <= 1
        elif r.doc_id == 103:
            assert r.lang_pred == "de"
    bare = language_id.identify(df.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()
    assert {r.lang_pred for r in bare} == {"und"}
    assert language_id.identify(df.limit(0)).count() == 0


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred != 'und'")
    assert got.where("lang = lang_pred").count() / got.count() > 0.98
