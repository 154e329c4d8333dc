"""Operator 11: secret scans with a trigram inverted index, in built-in functions only.

1. index(): the trigrams that the rules' queries name are taken from each text and grouped into
   postings, sorted arrays of row keys. Postings of other trigrams are never asked for, so none are
   made. Rows are dealt into blocks by a hash of their key, so a posting holds a block at most,
   however common its trigram is.
2. candidates(): every rule's Boolean trigram query (see trigrams.py) is evaluated by intersecting the
   postings of a branch, block by block; its branches are united.
3. scan(): the candidates' rules come to the texts by key and are run there. Rules without mandatory
   trigrams, such as runs of hexadecimal digits, are run on every text in the same pass.

A row's key is a hash of its id and text. Rows alike in both share one key and one result, and are
given back as often as they occur; the join by key is one that Spark splits where it is uneven. Two
rows that share a key by chance share candidates only, and every rule is run on the text itself.

Null and empty texts have no spans, and their digest is that of the empty text. Null and repeated ids
are carried through, other columns are ignored, an empty table gives an empty result. Texts of any
length are searched whole; positions come from prefix sums in two levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.llm import trigrams
from verdigris.sources.work import written

#: Rows of a block, which bounds a posting.
BLOCK_ROWS = 1 << 12
#: Spans that the first level of prefix sums adds up one by one.
STEP = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: an expression that Java, Python and RE2 read alike, the group that is measured
    (0: the whole match) and the least length of it. Shorter matches are dropped but do consume text."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds that are always looked for.
BASE = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]{32,}"),
]
#: Kinds that are added: well-known forms of keys.
ADDED = [
    Rule("private_key", "-----BEGIN (?:[A-Z0-9]{1,16} ){0,3}PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[0-9A-Za-z-]{10,}"),
    Rule("google", "AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", "[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", "eyJ[0-9A-Za-z_-]{8,}[.]eyJ[0-9A-Za-z_-]{8,}[.][0-9A-Za-z_-]{8,}"),
    Rule("url_password", "[a-z]{2,10}://[^\\x00-\\x20/:@]{1,64}:[^\\x00-\\x20/@]{1,64}@"),
]


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, key), null texts as empty ones."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("key", F.xxhash64(F.col("id").cast("string"), "text"))


def finder(wanted: set[str]) -> str:
    """An expression that finds the wanted trigrams at every place, in either case of letters, as group
    1. Classes of first, second and third letters turn most places away before the trigrams are tried,
    and these share their first letters."""
    escaped = lambda c: c if c.isalnum() else "\\" + c
    any_of = lambda cs: "[" + "".join(map(escaped, sorted(cs))) + "]"
    tree: dict[str, dict[str, set[str]]] = {}
    for x, y, z in sorted(wanted):
        tree.setdefault(x, {}).setdefault(y, set()).add(z)
    branches = [escaped(x) + "(?:" + "|".join(escaped(y) + any_of(zs) for y, zs in ys.items()) + ")" for x, ys in tree.items()]
    return f"(?i)(?={''.join(any_of({g[i] for g in wanted}) for i in range(3))})(?=({'|'.join(branches)}))"


def index(rows: DataFrame, wanted: set[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The inverted index (block, gram, postings) of keyed rows over the wanted trigrams."""
    blocks = max(1, -(-rows.count() // block_rows))
    found = F.expr(f"array_distinct(transform(regexp_extract_all(text, {quoted(finder(wanted))}, 1), g -> lower(g)))")
    each = rows.select("key", F.pmod("key", F.lit(blocks)).cast("int").alias("block"), F.explode(found).alias("gram"))
    return each.groupBy("block", "gram").agg(F.sort_array(F.collect_set("key")).alias("postings"))


def candidates(postings: DataFrame, queries: dict[str, trigrams.Query]) -> DataFrame:
    """(key, kinds): the rows that pass the query of each kind, by intersecting postings."""
    terms = [f"({quoted(kind)}, {b}, {len(branch)}, {quoted(gram)})" for kind, q in queries.items() for b, branch in enumerate(sorted(map(sorted, q))) for gram in branch]
    asked = postings.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(terms)} AS t(kind, branch, needed, gram)")
    lists = postings.join(asked, "gram").groupBy("block", "kind", "branch", "needed").agg(F.collect_list("postings").alias("lists"))
    common = F.expr("aggregate(slice(lists, 2, needed), lists[0], (x, y) -> array_intersect(x, y))")
    passed = lists.where("size(lists) = needed").select("kind", F.explode(common).alias("key"))
    return passed.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def prefix_sums(of: str) -> str:
    """SQL: the running sums of an array of whole numbers, in blocks of STEP and over the blocks."""
    blocks = f"transform(sequence(0, (size({of}) - 1) div {STEP}), b -> slice({of}, b * {STEP} + 1, {STEP}))"
    total = lambda x: f"aggregate({x}, 0L, (s, v) -> s + v)"
    sums = f"transform({blocks}, b -> {total('b')})"
    before = f"transform(array({sums}), all -> transform(all, (v, i) -> {total('slice(all, 1, i)')}))[0]"
    return f"if(size({of}) > 0, flatten(zip_with({blocks}, {before}, (b, o) -> transform(b, (v, i) -> o + {total('slice(b, 1, i + 1)')}))), cast(array() as array<bigint>))"


def spans_of(rows: DataFrame, rules: list[Rule], always: set[str]) -> DataFrame:
    """(id, spans): of each row, the spans {start, rank, kind, end} of all rules, in order of start and
    then of the rules. rows: (id, text, kinds), kinds being the candidates' rules."""
    none = "cast(array() as array<int>)"
    found, steps, made = ["id"], ["id"], []
    for i, r in enumerate(rules):
        p = quoted(r.pattern)
        run = "true" if r.kind in always else f"coalesce(array_contains(kinds, {quoted(r.kind)}), false)"
        found += [
            f"if({run}, transform(regexp_extract_all(text, {p}, 0), x -> length(x)), {none}) AS w{i}",
            f"if({run}, transform(split(text, {p}, -1), x -> length(x)), {none}) AS g{i}",
            f"if({run}, transform(regexp_extract_all(text, {p}, {r.group}), x -> length(x)), {none}) AS m{i}" if r.group else f"{none} AS m{i}",
        ]
        steps += [f"w{i}", f"m{i}", f"transform(w{i}, (x, j) -> cast(g{i}[j] + if(j > 0, w{i}[j - 1], 0) as bigint)) AS s{i}"]
        measured = f"m{i}[j]" if r.group else f"w{i}[j]"
        made.append(f"filter(transform(e{i}, (x, j) -> if({measured} >= {r.least}, named_struct('start', x, 'rank', {i}, 'kind', {quoted(r.kind)}, 'end', x + w{i}[j]), null)), x -> x IS NOT NULL)")
    ends = ["id"] + [f"{c}{i}" for i in range(len(rules)) for c in "wm"] + [f"{prefix_sums(f's{i}')} AS e{i}" for i in range(len(rules))]
    return rows.selectExpr(*found).selectExpr(*steps).selectExpr(*ends).selectExpr("id", f"array_sort(concat({', '.join(made)})) AS spans")


def scan(df: DataFrame, rules: list[Rule], *, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, spans array<struct<start, rank, kind, end>>) of each row: all spans of all rules, positions
    in code points, ends exclusive. Kinds have to differ."""
    queries = {r.kind: trigrams.query(r.pattern) for r in rules}
    always = {kind for kind, q in queries.items() if q == trigrams.ALWAYS}
    rows = keyed(df, id_col, text_col)
    asked = {kind: q for kind, q in queries.items() if kind not in always}
    if asked:
        postings = written(index(rows, {g for q in asked.values() for branch in q for g in branch}, block_rows), "postings")
        rows = rows.join(candidates(postings, asked), "key", "left")
    else:
        rows = rows.withColumn("kinds", F.array().cast("array<string>"))
    return spans_of(rows, rules, always).withColumnRenamed("id", id_col)


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(df: DataFrame, base: list[Rule] = BASE, added: list[Rule] = ADDED, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_<kind> of each base kind, base_sha256, spans): counts and digest of the base spans, and all
    spans as kind:start:end joined by commas."""
    found = scan(df, [*base, *added], id_col=id_col, text_col=text_col)
    basic = F.filter("spans", lambda s: s["rank"] < len(base))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.rank = {i})) as bigint)").alias(f"n_{r.kind}") for i, r in enumerate(base)]
    return found.select(id_col, *counts, F.sha2(told(basic), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def duck_sql(base: list[Rule] = BASE, added: list[Rule] = ADDED) -> str:
    """The report in DuckDB SQL, which runs every rule on every text."""
    spelled = lambda p: p.replace("(?i:password|passwd|secret|token|api_?key)", "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")")
    q = lambda p: "'" + spelled(p).replace("'", "''") + "'"
    rules, parts = [*base, *added], []
    for i, r in enumerate(rules):
        parts.append(
            f"SELECT key, {i} AS rank, '{r.kind}' AS kind, unnest(range(1, len(h) + 1)) AS j, h, g, m FROM (SELECT key, regexp_extract_all(t, {q(r.pattern)}) AS h, string_split_regex(t, {q(r.pattern)}) AS g, regexp_extract_all(t, {q(r.pattern)}, {r.group}) AS m FROM d) x{i}"
        )
    least = "CASE rank " + " ".join(f"WHEN {i} THEN {r.least}" for i, r in enumerate(rules)) + " END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS t FROM documents),
hits AS ({" UNION ALL ".join(parts)}),
placed AS (SELECT key, rank, kind, list_sum(list_transform(g[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:j - 1], lambda x: length(x))), 0) AS s, length(h[j]) AS n FROM hits WHERE length(m[j]) >= {least}),
lines AS (SELECT key, rank, s, concat(kind, ':', CAST(s AS bigint), ':', CAST(s + n AS bigint)) AS line FROM placed),
told AS (SELECT key, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{r.kind}" for i, r in enumerate(base))}, string_agg(line, ',' ORDER BY s, rank) FILTER (rank < {len(base)}) AS basic, string_agg(line, ',' ORDER BY s, rank) AS spans FROM lines GROUP BY key)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in base)}, sha256(coalesce(basic, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (key)
"""
