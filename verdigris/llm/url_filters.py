"""Operator 1: URL filters by a temporal list join.

A list holds dated entries (pattern, action, day). Each pattern's entries become validity
intervals: an entry holds from its day until the pattern's next one; `remove` ends what was
there. Every capture is judged by the entries active on the day it was fetched; of those that
match its URL the most specific wins. A pattern is a host suffix at label boundaries
(`example.org`), or a host and the leading segments of a path (`a.example.org/x/y`).

The as-of join is evaluated once for each distinct pattern and day that captures ask about, so
a host that holds a third of all captures costs one row a day; captures then look their answers
up by pattern and day. Only URLs and days are shuffled, never pages, and nothing is broadcast
but what Spark's own size check allows. Built-in functions only.

A URL of any length is looked up at the depths that listed patterns have, and at no others. Null URLs
and days are spread over the tasks. Null URLs, URLs without a host, and days that are null or no dates match nothing: verdict `none`.
Entries with a null pattern or action or without a date are ignored, as are actions other than block, allow and remove. Of
entries for one pattern and day block wins over allow, and allow over remove. Host and pattern
are compared in lower case, paths as they are. Repeated captures are judged one by one. Extra
columns of the captures are kept; those named verdict, pattern or valid_from are replaced.
An empty list gives `none` throughout, an empty table of captures an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm.common import free

PRIORITY = {"block": 1, "allow": 2, "remove": 3}
#: Parts that the captures of a pattern and day are split in where they look up the answer.
SALTS = 8


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and last dot; empty if there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(authority, r"^.*@|:[0-9]*$|\.$", ""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of entries (pattern, action, day); valid_to is null
    for the last."""
    known = entries.select(F.lower(F.regexp_extract("pattern", r"^[^/]*", 0)).alias("host"), F.regexp_replace("pattern", r"^[^/]*|/+$", "").alias("path"), "action", F.col("day").try_cast("date").alias("day"))
    known = known.where(F.col("day").isNotNull() & F.col("action").isin(*PRIORITY) & (F.col("host") != ""))
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv)), F.col("action"))
    one = known.groupBy(F.concat("host", "path").alias("pattern"), "day").agg(F.min_by("action", rank).alias("action"))
    later = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return one.select("pattern", "action", F.col("day").alias("valid_from"), later.alias("valid_to"))


def depths(held: DataFrame) -> tuple[list[int], list[int]]:
    """(how many labels listed hosts have, how many segments listed paths have), each number once."""
    host, path = F.substring_index("pattern", "/", 1), F.regexp_extract("pattern", "^[^/]*(/.*)?$", 1)
    segments = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    found = held.select(F.size(F.split(host, r"\.")).alias("labels"), segments.alias("segments")).distinct().collect()
    return sorted({r["labels"] for r in found if not r["segments"]}), sorted({r["segments"] for r in found if r["segments"]})


def candidates(url: Column, labels: list[int], segments: list[int]) -> Column:
    """The patterns of listed depths that could match a URL, the least specific first. A URL of any length
    has no more of them than there are depths."""
    host, path = host_of(url), F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    parts = F.split(host, r"\.")
    of = lambda sizes, whole: F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n <= F.size(whole))
    suffixes = F.transform(of(labels, parts), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    paths = F.transform(of(segments, path), lambda n: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, n), "/")))
    return F.concat(suffixes, paths)


def evaluate(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """Captures with verdict (block, allow or none), the pattern that gave it and since when."""
    held = intervals(entries)
    listed = held.select("pattern").distinct()
    asked = captures.select(F.col(url_col).alias("u"), F.col(day_col).try_cast("date").alias("d")).where((host_of(F.col("u")) != "") & F.col("d").isNotNull()).distinct()
    able = asked.select("u", "d", F.posexplode(candidates(F.col("u"), *depths(held))).alias("place", "pattern"))
    days = able.select("pattern", "d").distinct().join(listed, "pattern", "left_semi")
    active = days.join(held, "pattern").where((F.col("valid_from") <= F.col("d")) & (F.col("valid_to").isNull() | (F.col("d") < F.col("valid_to"))) & (F.col("action") != "remove"))
    answer = active.select("pattern", "d", "action", "valid_from", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    answers = able.withColumn("salt", F.pmod(F.xxhash64("u"), F.lit(SALTS))).join(answer, ["pattern", "d", "salt"])
    best = answers.groupBy("u", "d").agg(F.max(F.struct("place", "action", "pattern", "valid_from")).alias("best"))
    kept = [c for c in captures.columns if c not in ("verdict", "pattern", "valid_from")]
    url, day, best_url, best_day, found = (free(f"__{n}", captures.columns) for n in ("url", "day", "best_url", "best_day", "best"))
    # what asks nothing is spread by its other columns, as it would meet under one null key
    plain = [c for c, kind in captures.select(*kept).dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    alone = F.concat(F.lit("\0"), F.xxhash64(*plain).cast("string")) if plain else F.lit("\0")
    rows = captures.select(*kept, F.when(F.col(day_col).try_cast("date").isNull(), alone).otherwise(F.coalesce(F.col(url_col), alone)).alias(url), F.coalesce(F.col(day_col).try_cast("date"), F.lit("0001-01-01").cast("date")).alias(day))
    joined = rows.join(best.toDF(best_url, best_day, found), (F.col(url) == F.col(best_url)) & (F.col(day) == F.col(best_day)), "left")
    return joined.select(*kept, F.coalesce(f"{found}.action", F.lit("none")).alias("verdict"), F.col(f"{found}.pattern").alias("pattern"), F.col(f"{found}.valid_from").alias("valid_from"))


# --- the query's captures and list, which the page table lacks -------------------------------

FIRST_DAY = "2024-01-01"


def draw(x: Column) -> Column:
    """A number from 0 to 65535 that a text always has."""
    return F.conv(F.substring(F.md5(x), 1, 4), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched): a day of the year 2024 that follows from the page's id."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") * 37 % 365).cast("int")).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list of the pages' hosts, domains and first path segments, by fixed rules."""
    first = F.lit(FIRST_DAY).cast("date")
    seen = pages.select(host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), "^/([^/]+)", 1).alias("segment")).where("host <> ''").distinct()
    hosts = seen.select("host").distinct().withColumn("n", draw(F.col("host")))
    domains = hosts.select(F.substring_index("host", ".", -2).alias("host")).distinct().withColumn("n", draw(F.col("host")))
    sections = seen.where("segment <> ''").select(F.concat_ws("/", "host", "segment").alias("host")).withColumn("n", draw(F.col("host")))

    def entry(rows: DataFrame, where: str, action: str, day: str) -> DataFrame:
        return rows.where(where).select(F.col("host").alias("pattern"), F.lit(action).alias("action"), F.date_add(first, F.expr(day).cast("int")).alias("day"))

    parts = [
        entry(hosts, "n % 3 = 0", "block", "n % 200"),
        entry(hosts, "n % 6 = 0", "remove", "n % 200 + 40"),
        entry(hosts, "n % 30 = 0", "block", "n % 200 + 90"),
        entry(hosts, "n % 7 = 0", "allow", "n % 100"),
        entry(domains, "n >= 0", "block", "n % 150 + 100"),
        entry(domains, "n >= 0", "remove", "n % 150 + 160"),
        entry(sections, "n % 4 = 0", "block", "n % 150"),
        entry(sections, "n % 8 = 0", "allow", "n % 150 + 50"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SQL = """
WITH caps AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched,
         lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$|\\.$', '', 'g')) AS host,
         regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
seen AS (SELECT DISTINCT host, regexp_extract(path, '^/([^/]+)', 1) AS segment FROM caps WHERE host <> ''),
hosts AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS n FROM (SELECT DISTINCT host FROM seen)),
domains AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS n
  FROM (SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS host FROM hosts)),
sections AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INTEGER) AS n
  FROM (SELECT host || '/' || segment AS host FROM seen WHERE segment <> '')),
entries AS (
  SELECT host AS pattern, 'block' AS action, 1 AS rank, DATE '2024-01-01' + n % 200 AS day FROM hosts WHERE n % 3 = 0
  UNION ALL SELECT host, 'remove', 3, DATE '2024-01-01' + (n % 200 + 40) FROM hosts WHERE n % 6 = 0
  UNION ALL SELECT host, 'block', 1, DATE '2024-01-01' + (n % 200 + 90) FROM hosts WHERE n % 30 = 0
  UNION ALL SELECT host, 'allow', 2, DATE '2024-01-01' + n % 100 FROM hosts WHERE n % 7 = 0
  UNION ALL SELECT host, 'block', 1, DATE '2024-01-01' + (n % 150 + 100) FROM domains
  UNION ALL SELECT host, 'remove', 3, DATE '2024-01-01' + (n % 150 + 160) FROM domains
  UNION ALL SELECT host, 'block', 1, DATE '2024-01-01' + n % 150 FROM sections WHERE n % 4 = 0
  UNION ALL SELECT host, 'allow', 2, DATE '2024-01-01' + (n % 150 + 50) FROM sections WHERE n % 8 = 0),
one AS (SELECT pattern, day, arg_min(action, rank) AS action FROM entries GROUP BY pattern, day),
held AS (SELECT pattern, action, day AS valid_from, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS valid_to FROM one),
found AS (
  SELECT c.page_id, c.url, h.action, h.pattern, h.valid_from,
         row_number() OVER (PARTITION BY c.page_id, c.url ORDER BY length(h.pattern) DESC) AS place
  FROM caps c JOIN held h
    ON h.action <> 'remove' AND h.valid_from <= c.fetched AND (h.valid_to IS NULL OR c.fetched < h.valid_to)
   AND c.host <> ''
   AND (c.host = h.pattern OR ends_with(c.host, '.' || h.pattern) OR starts_with(c.host || c.path || '/', h.pattern || '/')))
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, coalesce(f.action, 'none') AS verdict,
       f.pattern AS pattern, CAST(f.valid_from AS VARCHAR) AS valid_from
FROM caps c LEFT JOIN found f ON f.page_id = c.page_id AND f.url = c.url AND f.place = 1
"""
