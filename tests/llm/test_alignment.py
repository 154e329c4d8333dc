import hashlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from verdigris.llm import alignment as A

FILES = (P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
TEXTS = [
    "Hello world, it's 12 o'clock; hello again.",
    "",
    None,
    "naïve café Straße 漢字かな 🎉🎉 x\u0085y",
    "<|endoftext|> is plain, and so is <s> or </s> <unk>",
    "  two  spaces\n\nand\ttabs ",
    "▁ a lower block is read as a space",
    "word " * 4000,
    "a" * 30_000,
    " " * 50_000,
    "Hello world, it's 12 o'clock; hello again.",
    "Hello world",
    "null \x00 byte and \r\n line ends",
    "𐍈" * 300,
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "shadow") for i, t in enumerate(TEXTS)] + [(None, "Hello world", "x"), (None, "Hello world", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, keys string")


def plain(texts):
    """The report by plain loops: bytes, ends, groups and links of every text."""
    t = Tokenizer.from_file(FILES[0])
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    rows, held = [], Counter()
    for text in texts:
        groups = []
        if text:
            whole = (" " + text).encode()
            a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            x = [bytes(byte_of[c] for c in t.id_to_token(i)) for i in a]
            y = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [sp.id_to_piece(i)]]
            if b"".join(x) == whole and b"".join(y) == whole:
                i = j = m = n = 0
                ga, gb = [], []
                while i < len(a) or j < len(b):
                    if m <= n and i < len(a):
                        ga.append(a[i])
                        m += len(x[i])
                        i += 1
                    else:
                        gb.append(b[j])
                        n += len(y[j])
                        j += 1
                    if m == n and ga and gb:
                        groups.append((ga, gb))
                        ga, gb = [], []
        links = Counter()
        for ga, gb in groups:
            na, nb = Counter(ga), Counter(gb)
            for p in na:
                for q in nb:
                    links[p, q] += na[p] * nb[q]
        held.update(links.keys())
        rows.append((groups, links))
    best = Counter()
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for groups, links in rows:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()), sum(n for (p, q), n in links.items() if held[p, q] == best[p]), sum(n * held[k] for k, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, held


def test_report_equals_plain_loops(docs, monkeypatch):
    rows = docs.select("doc_id", "text").collect()
    want, _ = plain([r.text for r in rows])
    for pattern in (None, P.PATTERN):
        got = [tuple(r) for r in A.report(docs.repartition(5), *FILES, pattern).collect()]
        assert sorted(got, key=str) == sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=str)
    assert sum(w[2] > 0 for w in want) >= 10


def test_bounded_buffers_and_wide_groups_give_the_same(monkeypatch):
    monkeypatch.setattr(A, "GROUP_LINKS", 1)
    monkeypatch.setattr(A, "HELD_KEYS", 5)
    monkeypatch.setattr(A, "HELD_COUNTS", 7)
    import pyarrow as pa

    a, b = A.side(FILES[0]), A.side(FILES[1])
    texts = [t for t in TEXTS if t and len(t) < 1000]
    found = [A.aligned(t, a, b) for t in texts]
    pairs = [f.pairs() for f in found if f]
    _, held = plain(texts)
    batches = [pa.RecordBatch.from_arrays([pa.array([k.tolist() for k, _ in pairs[i : i + 2]], pa.list_(pa.int64()))], names=["keys"]) for i in range(0, len(pairs), 2)]
    got = Counter()
    for out in A.partial_counts(iter(batches)):
        keys = out.column("key").to_numpy()
        assert (np.diff(keys) > 0).all()
        for k, n in zip(keys.tolist(), out.column("n").to_pylist()):
            got[k >> 32, k & 0xFFFFFFFF] += n
    assert got == held


def test_both_libraries_give_the_same_ids():
    slow, quick = A.byte_level(FILES[0]), A.byte_level(FILES[0], P.PATTERN)
    rng = np.random.default_rng(4)
    letters = list("aAzZ019 \t\n\r\u00a0\u3000'’.,;!?-_<|>äßéñ漢字🎉\x00\x1c\x85ſK")
    made = ["".join(rng.choice(letters, size=rng.integers(1, 60))) for _ in range(3000)]
    for text in [t for t in TEXTS if t] + ["new letters \U000323b0\U000323b1 Ᲊ ՘a՘", "a\u0085b\x1cz \u3000x"] + made:
        assert quick.encode(text) == slow.encode(text), text


def test_table_of_pairs(spark, docs):
    _, held = plain([r.text for r in docs.select("text").collect()])
    found = A.written(A.align(docs, *FILES), "aligned")
    folder, shards, best = A.count_shards(found)
    assert {(r.a_id, r.b_id): r.n for r in A.pair_counts(spark, folder, shards).collect()} == dict(held)
    assert best == {a: max(n for (x, _), n in held.items() if x == a) for a, _ in held}
    assert all(x[1] < y[0] for x, y in zip(shards, shards[1:]))


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert A.report(none, *FILES).count() == 0
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, A.report(only, *FILES).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
