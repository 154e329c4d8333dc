"""Reports of any size, read in parts: XML by the tag of its entries, the others by line.

Spark's text source splits a file at any separator, so a report of gigabytes is read by many tasks.
Each record, an element or a line, is made a small report, and the dialect reads those as it reads
whole ones. Entries are numbered over all parts in two levels, so the rows are those of
reports.parse_all(). A task reads a part in its order, so within it they are numbered as they come: no
finding is moved. JSON documents have no such separator and stay one row a report.

An XML report has to close its root once, at its end: one that is cut off gives one parser finding, as
any unsound report does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.operators.findings import parser_failures, unsound_runs
from verdigris.sources.reports import DIALECTS, Dialect, parse, scanner_runs
from verdigris.sources.work import written

#: Of XML dialects: the element of an entry, which does not nest, and the root.
TAGS = {"spotbugs": ("BugInstance", "BugCollection"), "checkstyle": ("file", "checkstyle"), "pmd_xml": ("file", "pmd")}
PLACE = ["__file", "__block", "__row"]


def records(spark: SparkSession, pattern: str, separator: str) -> DataFrame:
    """(project, run_id, value, place columns): the records of files .../<project>/<run_id>/<file>."""
    raw = spark.read.option("lineSep", separator).text(pattern).select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row"))
    part = lambda i: F.regexp_replace(F.element_at(F.split("__file", "/"), F.lit(i)), "^[a-z_]+=", "")
    return raw.withColumns({"project": part(-3), "run_id": part(-2)})


def small_reports(spark: SparkSession, pattern: str, dialect: str, root: str = "", dialects: dict[str, Dialect] | None = None) -> tuple[DataFrame, DataFrame]:
    """(a small report for each record, the reports whose envelope is broken)."""
    known = dialects or DIALECTS
    form, tool = known[dialect].form, F.lit(known[dialect].tool or dialect).alias("tool")
    key = ["project", "run_id", tool, *PLACE]
    if form in ("lines", "text"):
        rows = records(spark, pattern, "\n")
        return rows.select(*key, F.regexp_replace("value", "\r$", "").alias("stdout"), F.lit("").alias("stderr"), F.lit(root).alias("root")), rows.select("project", "run_id", tool).limit(0)
    if dialect not in TAGS:
        raise ValueError(f"{dialect} reports are documents of JSON, which cannot be split")
    tag, outer = TAGS[dialect]
    ends = F.contains("value", F.lit(f"</{outer}>"))  # tried first, as few records have it and patterns take longer
    rows = records(spark, pattern, f"</{tag}>").withColumn("closing", ends & F.col("value").rlike(rf"</{outer}>\s*$"))
    body = F.regexp_extract(F.when(ends, F.regexp_replace("value", rf"</{outer}>\s*$", "")).otherwise(F.col("value")), rf"(?s)<{tag}[\s/>].*$", 0)
    text = F.concat(F.lit(f"<{outer}>"), body, F.when(F.col("closing") | (body == ""), "").otherwise(f"</{tag}>"), F.lit(f"</{outer}>"))
    # each part's last record first, by hashing: what a struct is taken of is sorted
    parts = rows.groupBy("project", "run_id", "__file", "__block").agg(F.count_if("closing").alias("n"), F.max("__row").alias("__last"), F.max(F.when(F.col("closing"), F.col("__row"))).alias("__closing"))
    closed = parts.groupBy("project", "run_id", "__file").agg(F.sum("n").alias("n"), F.max(F.struct("__block", F.col("__last").eqNullSafe(F.col("__closing")).alias("closing")))["closing"].alias("last"))
    broken = closed.where("n <> 1 OR NOT last").select("project", "run_id", tool).distinct()
    return rows.select(*key, text.alias("stdout"), F.lit("").alias("stderr"), F.lit(root).alias("root")), broken


def parse_large(spark: SparkSession, pattern: str, dialect: str, root: str = "", dialects: dict[str, Dialect] | None = None) -> DataFrame:
    """Findings of the reports that pattern names, as reports.parse_all() gives them."""
    known = dialects or DIALECTS
    small, broken = small_reports(spark, pattern, dialect, root, known)
    part = ["project", "run_id", "__file", "__block"]
    parsed = parse(small, {dialect: known[dialect]}, ["project", "run_id", *PLACE]).withColumn("__at", F.monotonically_increasing_id())
    found = written(parsed.drop("__row", "finding_ord"), "large")
    parts = found.groupBy(*part).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    earlier = Window.partitionBy("project", "run_id").orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    # written, so Spark knows how few these are before it plans the joins with them
    ahead = written(parts.select(*part, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift")), "parts")
    numbered = found.join(ahead, part).withColumn("finding_ord", F.col("__at") + F.col("__shift")).drop("__at", "__shift", "__file", "__block")
    cut_off = scanner_runs(written(broken, "broken")).withColumn("problem", F.lit("SCHEMA_ERROR"))
    bad = written(unsound_runs(found.select("project", "run_id", "scanner_ord", "problem").unionByName(cut_off.drop("tool"))), "unsound")
    tool = F.lit(known[dialect].tool or dialect).alias("tool")
    return parser_failures(bad.select("project", "run_id", "scanner_ord", tool), numbered.unionByName(cut_off, allowMissingColumns=True), bad)
