import hashlib
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from verdigris.llm import secret_scan as S
from verdigris.llm import trigrams as T

KEY = "AKIA" + "Z9" * 8
TEXTS = [
    "password: token=abcdefgh and ünï " + KEY,
    "password: secret : abcdefghijk",  # the failing match consumes what would match
    "PassWord='hunter2hunter2' API_KEY = \"0123456789\" apikey:short",
    "ſecret=abcdefghij toKen=abcdefghij",  # not ASCII letters
    "0123456789abcdef" * 2 + " " + "a" * 31 + " \U0001f600" + "f" * 40,
    "x-----BEGIN RSA PRIVATE KEY-----\nghp_" + "a" * 40 + " https://me:pass@host/ AKIASHORT",
    "xoxb-1234567890-x sk_live_" + "A" * 20 + " eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF",
    "",
    None,
    "token = " + "=" * 300_000,
    "secret=aaaaaaaa " * 20_000,
    "ab " * 100_000 + KEY,
    " " * 1_000_000,
    KEY,
    KEY,
]


def python_spans(text, rules):
    found = [(m.start(), i, r.kind, m.end()) for i, r in enumerate(rules) for m in re.finditer(r.pattern.replace("(?i:", "(?ai:"), text or "") if len(m.group(r.group)) >= r.least]
    return sorted(found)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "shadow", 1) for i, t in enumerate(TEXTS)] + [(None, KEY, "x", 2), (None, KEY, "x", 2), (13, KEY, "shadow", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, key int")


def test_spans_equal_brute_force(docs):
    rules = [*S.BASE, *S.ADDED]
    got = S.scan(docs, rules, block_rows=3).collect()
    want = [(r.doc_id, python_spans(r.text, rules)) for r in docs.collect()]
    assert sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in got), key=str) == sorted(want, key=str)


def test_report(docs):
    rows = {r.doc_id: r for r in S.report(docs).collect()}
    for i, text in enumerate(TEXTS):
        line = ",".join(f"{k}:{s}:{e}" for s, _, k, e in python_spans(text, S.BASE))
        assert rows[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest(), i
        assert [rows[i][f"n_{r.kind}"] for r in S.BASE] == [line.count(r.kind) for r in S.BASE]
    assert rows[7].spans == "" and rows[8].n_hex == 0
    assert S.report(docs.where("false")).count() == 0


def test_report_equals_sql(spark, docs):
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").where("length(text) < 10000 or text is null").toPandas()
    con.register("documents", documents.astype({"doc_id": "Int64"}))
    want = sorted(con.execute(S.duck_sql()).fetchall(), key=str)
    got = S.report(docs.where("length(text) < 10000 or text is null")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_queries_of_known_expressions():
    assert T.query("AKIA[A-Z0-9]+") == {frozenset({"aki", "kia"})}
    assert T.query("[0-9a-f]{32,}") == T.ALWAYS
    assert T.query("(?:abc|xyz)d?") == {frozenset({"abc"}), frozenset({"xyz"})}
    assert T.query("(abcd)*") == T.ALWAYS
    assert T.query("a[bc]d[ef]") == {frozenset({"abd", "bde"}), frozenset({"abd", "bdf"}), frozenset({"acd", "cde"}), frozenset({"acd", "cdf"})}
    assert T.query("ab.cde") == {frozenset({"cde"})}
    assert T.query("(?=abc)x") == T.ALWAYS


PARTS = st.recursive(
    st.sampled_from(["a", "b", "c", "ab", "abc", "[ab]", ".", "[^a]", "ca", "Ä"]),
    lambda x: st.one_of(st.lists(x, min_size=1, max_size=4).map("".join), st.tuples(x, x).map(lambda p: f"(?:{p[0]}|{p[1]})"), x.map(lambda p: f"(?:{p})?"), x.map(lambda p: f"(?:{p})+"), x.map(lambda p: f"(?:{p}){{2,3}}"), x.map(lambda p: f"(?:{p})*?")),
    max_leaves=8,
)


@settings(max_examples=400, deadline=None)
@given(PARTS, st.text(alphabet="abcABÄ", max_size=14))
def test_no_match_is_lost_by_a_query(pattern, text):
    if re.search(pattern, text, re.IGNORECASE):
        assert T.may_match(T.query(pattern), text)
