"""Aggregates of the report pages of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.functions.classify import CLASSES, CONTEXTS
from verdigris.schemas import SEVERITY_RANK, lookup

RUN = ["project", "run_id"]


def _top(rows: DataFrame, k: int, *order) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*RUN).orderBy(*order))).where(F.col("rank") <= k)


def affected_files(findings: DataFrame, k: int = 10) -> DataFrame:
    """The files of each run with most findings."""
    return _top(findings.where(F.col("file") != "").groupBy(*RUN, "file").agg(F.count("*").alias("count")), k, F.desc("count"), "file")


def rule_families(findings: DataFrame, k: int = 12) -> DataFrame:
    """The first parts of rule ids with most findings; backslashes split too, hyphens do not."""
    first = F.element_at(F.split(F.lower(text.strip(F.coalesce("rule_id", F.lit("unknown")))), r"[.:/_\\-]"), 1)
    return _top(findings.groupBy(*RUN, F.when(first == "", "unknown").otherwise(first).alias("rule_family")).agg(F.count("*").alias("count")), k, F.desc("count"), "rule_family")


def clusters(findings: DataFrame, k: int = 40) -> DataFrame:
    """Findings by severity, category and first two words, with the first three files seen."""
    words = F.substring_index(F.lower(text.strip(F.coalesce(F.when(F.col("normalized_message") != "", F.col("normalized_message")), "message", F.lit("")))), " ", 2)
    key = [*RUN, "severity", "category", "message_family"]
    files = findings.withColumn("message_family", F.when(words == "", "generic").otherwise(words)).groupBy(*key, "file").agg(F.count("*").alias("n"), F.min(F.struct("scanner_ord", "finding_ord")).alias("seen"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("seen", "file"))
    rows = files.withColumn("nth", nth).groupBy(*key).agg(F.sum("n").alias("count"), F.array_sort(F.collect_list(F.when((F.col("nth") <= 3) & (F.col("file") != ""), F.col("file")))).alias("example_files"))
    return _top(rows, k, lookup(F.col("severity"), SEVERITY_RANK, 9), F.desc("count"), "category", "message_family")


#: The groups that a report lists, with zero where there are none.
GROUPS = ["runtime", "tooling", "test_only", "false_positive"]


def security_group(security_class: Column) -> Column:
    """The group of a security class; unknown ones count as runtime."""
    return lookup(security_class, {"tooling_security": "tooling", "test_security": "test_only", "false_positive": "false_positive"}, "runtime")


def security_groups(findings: DataFrame) -> DataFrame:
    """Security findings of each run by group, zero where there are none; unknown classes count as
    runtime."""
    group = security_group(F.col("security_class"))
    sec = F.col("category") == "security"
    counted = findings.groupBy(*RUN).agg(*(F.count_if(sec & (group == g)).alias(g) for g in GROUPS))
    return counted.unpivot(RUN, GROUPS, "security_group", "count")


def security_summary(findings: DataFrame) -> DataFrame:
    """Security findings of each run by class and by context, zero where there are none."""
    sec, names = F.col("category") == "security", [*(("class", x) for x in CLASSES), *(("context", x) for x in CONTEXTS)]
    counted = findings.groupBy(*RUN).agg(*(F.count_if(sec & (F.coalesce(f"security_{kind}", F.lit("unclassified")) == x)).alias(f"{kind}:{x}") for kind, x in names))
    rows = counted.unpivot(RUN, [f"{kind}:{x}" for kind, x in names], "name", "count")
    return rows.select(*RUN, F.split_part("name", F.lit(":"), F.lit(1)).alias("kind"), F.split_part("name", F.lit(":"), F.lit(2)).alias("value"), "count")


# The rules of findings about reports.
PARSER_RULES = ["PARSER.MISSING_RULE_ID", "PARSER.INVALID_PATH", "PARSER.BAD_SEVERITY", "PARSER.SCHEMA_ERROR", "PARSER.OVERSIZE_PAYLOAD", "PARSER.UNHANDLED"]


def parser_summary(findings: DataFrame) -> DataFrame:
    """Parser findings of each run by scanner and rule, and over all scanners (scanner null)."""
    return findings.where("category = 'system/parser'").rollup(*RUN, "rule_id", "tool").agg(F.count("*").alias("count"), F.grouping_id().alias("level")).where("level <= 1").select(*RUN, "rule_id", F.col("tool").alias("scanner"), "count")


def parser_table(findings: DataFrame) -> DataFrame:
    """The parser findings of every run, zero-filled: each of PARSER_RULES and each other rule that the
    run has, over all scanners (scanner null) and for each scanner that any finding is about, which its
    symbol names."""
    scanner = F.coalesce(F.when(F.col("symbol") != "", F.col("symbol")), F.lit("unknown"))
    about = findings.where("category = 'system/parser'").select(*RUN, "rule_id", scanner.alias("scanner"))
    counted = about.groupBy(*RUN, "scanner", "rule_id").agg(F.count("*").alias("n"))
    rules = findings.select(*RUN).distinct().select(*RUN, F.explode(F.array(*map(F.lit, PARSER_RULES))).alias("rule_id")).union(about.select(*RUN, "rule_id")).distinct()
    every = rules.withColumn("scanner", F.lit(None).cast("string")).unionByName(rules.join(about.select(*RUN, "scanner").distinct(), RUN).select(*RUN, "rule_id", "scanner"))
    held = counted.unionByName(counted.groupBy(*RUN, "rule_id").agg(F.sum("n").alias("n")).withColumn("scanner", F.lit(None).cast("string")))
    same = (F.col("a.project") == F.col("b.project")) & (F.col("a.run_id") == F.col("b.run_id")) & (F.col("a.rule_id") == F.col("b.rule_id")) & F.col("a.scanner").eqNullSafe(F.col("b.scanner"))
    return every.alias("a").join(held.alias("b"), same, "left").select("a.project", "a.run_id", "a.rule_id", "a.scanner", F.coalesce("b.n", F.lit(0)).cast("long").alias("count"))


def raw_samples(findings: DataFrame, k: int = 25) -> DataFrame:
    """The compact form of a scanner's output: how much, which rules and files, the first findings."""
    key = [*RUN, "tool"]
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("finding_ord", "rule_id", "file", "message"))
    sample = F.struct("nth", "rule_id", "file", "line", "message")
    first = findings.withColumn("nth", nth).where(F.col("nth") <= k).groupBy(*key).agg(F.array_sort(F.collect_list(sample)).alias("samples"))
    counts = findings.groupBy(*key).agg(F.count("*").alias("finding_count"), F.count_distinct("rule_id").alias("rule_count"), F.count_distinct("file").alias("file_count"))
    return counts.join(first, key)


def samples(findings: DataFrame, k: int = 25) -> DataFrame:
    """The sampled findings one by one, by their place."""
    return raw_samples(findings, k).select(*RUN, "tool", F.inline("samples"))
