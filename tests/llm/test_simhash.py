import re

import numpy as np
import pytest
import xxhash

from verdigris.llm import simhash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, seed=42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    group = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return group


def test_tree_search_matches_brute_force():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    codes = np.unique(np.concatenate([codes, codes[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), codes[:50] ^ np.uint64(5)]))
    codes = codes[np.argsort(simhash.gray_rank(codes))]
    for radius in (0, 2, 4):
        got = {(int(a), int(b)) for q, n in simhash.GrayTree(codes).search(codes, radius) for a, b in zip(q, n)}
        want = np.argwhere(np.bitwise_count(codes[:, None] ^ codes[None]) <= radius)
        assert got == {(int(a), int(b)) for a, b in want}
    for size in (0, 1, 7, 8, 9, 65):
        assert len([1 for q, n in simhash.GrayTree(codes[:size]).search(codes[:size], 0) for _ in q]) == size


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(simhash, "RANGE", 16)


def test_near_duplicates_match_brute_force(spark, small_ranges):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(50)]
    texts = [None, "", " \t", "One", "one", "ONE two", "É\x85x  é"]
    for _ in range(40):
        words = [vocabulary[i] for i in rng.integers(0, 50, 300)]
        texts += [" ".join(words), " ".join(words).upper()]
        for _ in range(2):
            words[int(rng.integers(0, 300))] = "z"
            texts.append("\n".join(words))
    df = spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(texts)], "doc_id long, text string, fp string, item int").repartition(3)
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(prints)


def test_long_chains_of_links(spark, small_ranges):
    codes, x = [0], 0
    for step in range(31):  # a path: each is two bits from the next only
        x |= 3 << (2 * step)
        codes.append(x)
    df = spark.createDataFrame([(c, c, None) for c in codes], "code long, item long, payload binary")
    roots = {r.node: r.root for r in simhash.components(simhash.spanning_edges(df, 2)).collect()}
    assert roots == dict.fromkeys(codes, 0)


def test_null_keys_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "lone row here"), (7, "a b c"), (7, "a b c"), (9, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 7), (None, None), (7, 7), (7, 7), (9, 9)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.copy_groups(df.limit(0)).count() == 0


def test_copy_groups_find_edited_texts_and_leave_others(spark):
    rng = np.random.default_rng(2)
    texts, want = [], []
    for g in range(30):
        words = [f"{g % 3}v{i}" for i in rng.integers(0, 4000, 150)]
        first = len(texts)
        for edits in (0, 0, 1, 2):
            new = list(words)
            for at in rng.choice(150, edits, replace=False):
                new[at] = f"edit{rng.integers(0, 99)}"
            texts.append(" ".join(new))
            want.append(first)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.group_id for r in simhash.copy_groups(df).collect()}
    assert [got[i] for i in range(len(texts))] == want


def edited(rng, words, share):
    """The words with runs of new ones at the end, so that about the share of all five-word shingles is common."""
    n = len(words) - 4
    new = round(n * (1 - share) / (1 + share))
    return words[: len(words) - new] + [f"new{x}" for x in rng.integers(0, 1 << 30, new)]


def runs(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_only_pairs_alike_in_four_fifths_link(spark):
    rng = np.random.default_rng(8)
    texts, kind = [], []
    for share in (0.7, 0.75, 0.785, 0.8, 0.815, 0.85):
        for _ in range(60):
            words = [f"v{i}" for i in rng.integers(0, 1 << 30, 300)]
            texts += [" ".join(words), " ".join(edited(rng, words, share))]
            kind.append(share)
    got = {r.doc_id: r.group_id for r in simhash.copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}
    found = {}
    for k, share in enumerate(kind):
        a, b = runs(texts[2 * k]), runs(texts[2 * k + 1])
        true, linked = 5 * len(a & b) >= 4 * len(a | b), got[2 * k] == got[2 * k + 1]
        assert true or not linked
        if true:
            found.setdefault(share, []).append(linked)
    assert {0.815, 0.85} <= set(found) and not {0.7, 0.75, 0.785} & set(found)
    assert sum(map(sum, found.values())) >= 0.97 * sum(map(len, found.values()))


def test_a_repeated_line_does_not_link_texts(spark):
    rng = np.random.default_rng(9)
    line = " ".join(f"l{i}" for i in range(8)) + " "
    texts = [line * 50 + " ".join(f"v{i}" for i in rng.integers(0, 1 << 30, 200)) for _ in range(40)]
    got = simhash.copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len({r.group_id for r in got}) == 40


def test_links_behind_a_failed_edge_are_found(spark):
    """A chain of texts each alike with the next only: proposals beyond it fail, its links hold."""
    rng = np.random.default_rng(10)
    stream = [f"v{i}" for i in rng.integers(0, 1 << 30, 1100)]
    texts = [" ".join(stream[k : k + 500]) for k in range(0, 600, 40)] + [" ".join(stream[k : k + 500]) for k in (20, 60)]
    order = rng.permutation(len(texts))
    got = simhash.copy_groups(spark.createDataFrame([(int(i), texts[j]) for i, j in enumerate(order)], "doc_id long, text string")).collect()
    assert {r.group_id for r in got} == {0}


def test_blocks_of_a_group_lose_no_link_and_make_no_pairs(spark, monkeypatch):
    """Two chains that a text alike with none of their ends holds together in the proposals: blocks of
    three texts find the groups that all pairs give."""
    monkeypatch.setattr(simhash, "CELL_ITEMS", 3)
    rng = np.random.default_rng(12)
    stream = [f"v{i}" for i in rng.integers(0, 1 << 30, 1300)]
    texts = [" ".join(stream[k : k + 500]) for k in (*range(0, 320, 40), *range(400, 720, 40), 360)]
    texts = [texts[j] for j in rng.permutation(len(texts))]
    sets = [runs(t) for t in texts]
    want = list(range(len(texts)))
    for _ in texts:
        want = [min(want[j] for j in range(len(texts)) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for i in range(len(texts))]
    got = {r.doc_id: r.group_id for r in simhash.copy_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want
    items = spark.range(60).selectExpr("id as item", "id % 7 as label", "cast('' as binary) as payload", "0L as `group`")
    met = simhash.cells(items, spark.range(60).selectExpr("id as item", "'x' as text"))
    assert met.count() == 60 * 20 < 60 * 59 / 2 and met.groupBy("lo", "hi").count().agg({"count": "max"}).first()[0] < 30


def test_different_texts_under_one_key_are_judged_apart(spark):
    rng = np.random.default_rng(11)
    a, b, c = (" ".join(f"v{i}" for i in rng.integers(0, 1 << 30, 100)) for _ in range(3))
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (2, c), (2, c), (3, a)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in simhash.keep_one(df).collect()) == sorted([(1, a), (1, b), (2, c)])
