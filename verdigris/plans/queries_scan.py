"""Queries over derived files and results of scanners: discovery, text rules, secrets, run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import baseline, discovery, findings as ops, results, scoring, secrets
from verdigris.sources import derived, metrics, text_rules
from verdigris.sources.samples import SCALARS
from verdigris.sources.work import written

RUN = ["project", "run_id"]
#: Rules of secrets that stand in for those of some derived findings, by the finding's number.
SECRET_RULES = ["private_key_material", "probable_secret_exposure", "historical_secret_exposure", "certificate_material", "credential_hardcoding", "weak_secret_management"]


def dealt(spark: SparkSession, d: str, samples: list[tuple[str, str]]) -> DataFrame:
    """Reports, one for each supplier: the samples (tool, text) in turn."""
    texts = spark.createDataFrame([(i, tool, text) for i, (tool, text) in enumerate(samples)], "i long, tool string, stdout string")
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("p"), F.col("s_suppkey") % 7).alias("project"), F.col("s_suppkey").cast("string").alias("run_id"), (F.col("s_suppkey") % len(samples)).cast("long").alias("i"))
    made = suppliers.join(texts, "i").select("project", "run_id", "tool", "stdout", F.lit("").alias("stderr"), F.lit("/work/p").alias("root"))
    return written(made, "reports")


def q_scalar_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Reports that carry figures, read into scalar metrics."""
    made = dealt(spark, d, [(tool, text) for tool, (text, _) in sorted(SCALARS.items())])
    found = metrics.scalar_metrics(made).select("project", "tool", F.explode("scalar_metrics").alias("name", "value"))
    return found.groupBy("project", "tool", "name", "value").agg(F.count("*").alias("count"))


def q_text_rules(spark: SparkSession, d: str) -> DataFrame:
    return text_rules.scan(derived.files(spark, d)).select("project", "file", "tool", "rule_id", "severity", "category", "language", "line", "message")


def q_file_counts(spark: SparkSession, d: str) -> DataFrame:
    return text_rules.file_counts(derived.files(spark, d))


def q_python_projects(spark: SparkSession, d: str) -> DataFrame:
    found = discovery.python(derived.files(spark, d))
    return found.select("project", "is_python", "python_framework", "framework_confidence", F.array_join("django_evidence", ",").alias("django_evidence"), "drf", "orm_patterns", "settings_hardening_markers", "template_count")


def q_javascript_projects(spark: SparkSession, d: str) -> DataFrame:
    found = discovery.javascript(derived.files(spark, d))
    return found.select("project", "key", "package_manager", F.array_join("js_frameworks", ",").alias("js_frameworks"), F.col("dependency_count").cast("long").alias("dependency_count"))


def q_infrastructure(spark: SparkSession, d: str) -> DataFrame:
    found = discovery.infrastructure(derived.files(spark, d))
    return found.select("project", "group", "kind", "count", F.array_join(F.slice("files", 1, 3), ",").alias("first_files"), F.size("files").cast("long").alias("listed"))


def q_languages(spark: SparkSession, d: str) -> DataFrame:
    found = discovery.languages(written(derived.files(spark, d), "files"))
    return found.select("project", F.array_join("language_hints", ",").alias("language_hints"), "primary_language", F.array_join("labels", ",").alias("labels"))


def q_language_histogram(spark: SparkSession, d: str) -> DataFrame:
    return discovery.language_histogram(discovery.languages(written(derived.files(spark, d), "files")))


def secret_findings(spark: SparkSession, d: str) -> DataFrame:
    """Derived findings, some of them with rules of secrets."""
    rows = derived.findings(spark, d)
    rule = F.element_at(F.array(*map(F.lit, SECRET_RULES)), (F.col("finding_ord") % 11 + 1).cast("int"))
    return rows.withColumn("rule_id", F.when(F.col("finding_ord") % 11 < 6, rule).otherwise(F.col("rule_id")))


def q_secrets(spark: SparkSession, d: str) -> DataFrame:
    from verdigris.plans.queries import NOW, entries

    # what counts of a payload is told before findings are moved, and alike findings are counted first
    by = [*RUN, "scanner_ord", "tool", "rule_id", "real", "fingerprint", "dedupe_key"]
    rows = ops.normalize(secret_findings(spark, d)).withColumn("real", secrets.is_real(F.col("raw_payload")))
    found = written(ops.counted(rows, by), "secrets")
    accepted = entries(found.select(F.lower(F.hex("fingerprint")).alias("fingerprint"))).withColumn("fingerprint", F.unhex("fingerprint"))
    counted = ops.told(found).select(*RUN, "fingerprint", "kept", "rule_id", "real", F.col("alike").alias("n"))
    return secrets.of_counted(counted, written(accepted, "entries"), F.expr(NOW))


def scan_results(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.results(spark, d)
    return rows.withColumn("scalar_metrics", F.when(F.col("scalar").isNotNull(), F.create_map("scalar", "scalar_value")))


def q_run_counters(spark: SparkSession, d: str) -> DataFrame:
    return scoring.run_counters(scan_results(spark, d))


def q_scalar_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return results.rolled_up(scan_results(spark, d))


def q_scanner_stats(spark: SparkSession, d: str) -> DataFrame:
    return results.stats(scan_results(spark, d)).groupBy(*RUN, "scanner", "success", "error_code").agg(F.sum("scanner_input_file_count").alias("scanner_input_file_count"))


def run_metrics(rows: DataFrame) -> DataFrame:
    """Metrics of the results' findings and scalars."""
    found = rows.where("severity is not null").groupBy(*RUN, F.col("scanner").alias("tool"), "category", "severity").agg(F.count("*").alias("count"), F.count("*").cast("double").alias("weighted_count"))
    return found.withColumn("score_hint", scoring.score_hint(F.col("tool"), F.col("category")))


def q_measured_categories(spark: SparkSession, d: str) -> DataFrame:
    found = results.measured_categories(run_metrics(scan_results(spark, d)))
    return found.select(*RUN, F.array_join("measured_categories", ",").alias("measured_categories"))


#: Counters that a run's number sets, as a stand-in for its baseline, secrets and history.
BY_RUN = {
    "baseline_expired_entries": "CASE WHEN run_no % 13 = 1 THEN run_no % 5 ELSE 0 END", "baseline_missing_owner_entries": "CASE WHEN run_no % 13 = 2 THEN 2 ELSE 0 END", "baseline_expiring_soon_entries": "CASE WHEN run_no % 13 = 3 THEN 3 ELSE 0 END",
    "real_secret_findings": "CASE WHEN run_no % 13 = 4 THEN 1 ELSE 0 END", "probable_secret_findings": "CASE WHEN run_no % 13 = 5 THEN 4 ELSE 0 END", "private_key_findings": "CASE WHEN run_no % 13 = 6 THEN 5 ELSE 0 END",
    "baseline_real_secret_entries": "CASE WHEN run_no % 13 = 7 THEN 6 ELSE 0 END", "history_scan_skipped": "CASE WHEN run_no % 13 = 8 THEN 1 ELSE 0 END", "history_scan_stale": "CASE WHEN run_no % 3 = 0 AND run_no % 13 > 8 THEN 1 ELSE 0 END",
    "history_scan_age_days": "CASE WHEN run_no % 2 = 0 THEN run_no * 2 END", "secret_scanner_unavailable_count": "CASE WHEN run_no % 13 = 9 THEN 2 ELSE 0 END",
}


def judged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of the derived results, judged with all counters of the policy."""
    rows = written(scan_results(spark, d), "results")
    measured = written(run_metrics(rows), "run-metrics")
    cards = scoring.score_cards(scoring.category_scores(measured))
    counters = scoring.run_counters(rows).drop("finding_count")
    numbers = rows.groupBy(*RUN).agg(F.min("run_no").alias("run_no")).selectExpr(*RUN, *(f"{sql} AS {name}" for name, sql in BY_RUN.items()))
    every = counters.join(numbers, RUN).join(cards, RUN, "left").join(scoring.security_counts(measured), RUN, "left")
    blank = {"overall_score": 100.0, "critical_security_findings": 0, "high_security_findings": 0}
    whole = every.fillna(blank)
    return scoring.policy(whole.withColumn("grade", F.coalesce("grade", scoring.grade(F.col("overall_score")))))


def q_policy_reasons(spark: SparkSession, d: str) -> DataFrame:
    """All reasons, violations and warnings of runs that pass, warn and fail."""
    return judged_runs(spark, d).select(*RUN, "overall_score", "status", F.array_join("reasons", ",").alias("reasons"), F.array_join("violations", ";").alias("violations"), F.array_join("warnings", ";").alias("warnings"))


def q_exit_codes(spark: SparkSession, d: str) -> DataFrame:
    return results.exit_codes(scan_results(spark, d), judged_runs(spark, d))


def q_summary_lines(spark: SparkSession, d: str) -> DataFrame:
    zero = {n: F.lit(0) for n in ("gross_findings", "scored_findings", "accepted_debt", "new_findings", "resolved_findings", "suppressed_count")}
    rows = judged_runs(spark, d).withColumns({**zero, "cache_hits": F.col("scanner_count") % 3, "cache_misses": F.lit(0), "report_root": F.lit("reports")})
    return results.summary_lines(rows)
