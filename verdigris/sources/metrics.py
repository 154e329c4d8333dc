"""Scalar metrics of reports that carry figures instead of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.schemas import round_half_up
from verdigris.sources.reports import json_document

KEY = ["project", "run_id", "tool"]
#: Tools whose reports carry figures.
SCALAR_DIALECTS = ["coverage", "go_coverage", "js_coverage", "jacoco", "pmd", "radon"]


def _map(**columns) -> F.Column:
    return F.map_filter(F.create_map(*(x for k, v in columns.items() for x in (F.lit(k), v.cast("double")))), lambda _, v: v.isNotNull())


def coverage(reports: DataFrame) -> DataFrame:
    """Percentages of coverage, go_coverage and js_coverage reports."""
    rows = reports.where(F.col("tool").isin("coverage", "go_coverage", "js_coverage")).withColumn("d", json_document(F.col("stdout")))
    get = lambda p: F.try_variant_get("d", p, "double")
    return rows.select(*KEY, _map(coverage_percent=F.coalesce(get("$.totals.percent_covered"), get("$.total.lines.pct")), branch_coverage_percent=get("$.total.branches.pct")).alias("scalar_metrics"))


def jacoco(reports: DataFrame) -> DataFrame:
    """Counters of JaCoCo reports, the modules' summed."""
    rows = reports.where("tool = 'jacoco'")
    pick = lambda kind, what: F.expr(f"aggregate(transform(xpath(stdout, '/report/counter[@type=\"{kind}\"]/@{what}'), x -> cast(x as double)), 0D, (a, b) -> a + b)")
    total = lambda kind: pick(kind, "missed") + pick(kind, "covered")
    share = lambda kind: F.when(total(kind) > 0, round_half_up(100 * pick(kind, "covered") / total(kind), 2))
    some = lambda kind: F.when(total(kind) > 0, total(kind))
    return rows.select(*KEY, _map(coverage_percent=share("LINE"), branch_coverage_percent=share("BRANCH"), class_count=some("CLASS"), method_count=some("METHOD")).alias("scalar_metrics"))


def duplication(reports: DataFrame) -> DataFrame:
    rows = reports.where("tool = 'pmd'").withColumn("d", json_document(F.col("stdout")))
    return rows.select(*KEY, _map(duplication_percent=F.try_variant_get("d", "$.duplication.percentDuplicatedLines", "double")).alias("scalar_metrics"))


def radon(reports: DataFrame) -> DataFrame:
    """Mean and worst complexity, their grade and ranks, and the mean maintainability index."""
    rows = reports.where("tool = 'radon'").withColumn("d", json_document(F.col("stdout")))
    blocks = F.flatten(F.transform(F.map_values(F.try_variant_get("d", "$.cc", "map<string,variant>")), lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))))
    index = F.flatten(F.transform(F.map_values(F.try_variant_get("d", "$.mi", "map<string,variant>")), lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    rows = rows.withColumns({"c": F.filter(F.transform(blocks, lambda b: F.try_variant_get(b, "$.complexity", "double")), lambda x: x.isNotNull()), "ranks": F.filter(F.transform(blocks, lambda b: F.upper(F.try_variant_get(b, "$.rank", "string"))), lambda x: x.isNotNull())})
    rows = rows.withColumn("m", F.filter(F.transform(index, lambda v: F.coalesce(F.try_variant_get(v, "$.mi", "double"), F.try_variant_get(v, "$", "double"))), lambda x: x.isNotNull()))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a))
    rows = rows.withColumns({"avg": mean("c"), "mi": mean("m")})
    grade = F.when(F.col("avg") <= 5, "A").when(F.col("avg") <= 10, "B").when(F.col("avg") <= 20, "C").when(F.col("avg") <= 30, "D").when(F.col("avg") <= 40, "E").when(F.col("avg").isNotNull(), "F")
    ranks = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("ranks")), lambda r: F.struct(r, F.size(F.filter("ranks", lambda x: x == r)))))
    return rows.select(*KEY, _map(avg_complexity=round_half_up(F.col("avg"), 2), worst_complexity=F.array_max("c"), maintainability_index=round_half_up(F.col("mi"), 2)).alias("scalar_metrics"), grade.alias("complexity_grade"), ranks.alias("rank_counts"))


def scalar_metrics(reports: DataFrame) -> DataFrame:
    """(project, run_id, tool, scalar_metrics) of every report with figures."""
    return coverage(reports).unionByName(jacoco(reports)).unionByName(duplication(reports)).unionByName(radon(reports).select(*KEY, "scalar_metrics")).where(F.size("scalar_metrics") > 0)
