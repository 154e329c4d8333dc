"""Metrics, score cards and policy of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.schemas import DEPENDENCY_TOOLS, EXIT_CODES, PARSE_FAILURES, PARSER_CATEGORY, PARSER_MISSING, PATH_INVALID, SCALAR_SCANNERS, SEVERITIES, SEVERITY_PENALTY, category_rows, lookup, round_half_up

RUN = ["project", "run_id"]
#: Scalar metrics: category, and whether the value is a percentage.
SCALARS = {
    "coverage_percent": ("coverage", True), "branch_coverage_percent": ("coverage", True), "maintainability_index": ("maintainability", True),
    "duplication_percent": ("maintainability", True), "avg_complexity": ("complexity", False), "worst_complexity": ("complexity", False),
    "class_count": ("maintainability", False), "method_count": ("maintainability", False),
}


def score_hint(tool: Column, category: Column) -> Column:
    return (
        F.when(tool == "bandit", 1.5).when(tool.isin(DEPENDENCY_TOOLS), 1.4).when(tool == "coverage", 1.0)
        .when(category == "security", 1.2).when(category == "dead_code", 0.8).when(category == "lint", 0.75).otherwise(1.0)
    )


def finding_metrics(findings: DataFrame) -> DataFrame:
    """Count and weighted count of each run, tool, category and severity of classified findings; a row
    with `alike` stands for so many."""
    alike = F.col("alike") if "alike" in findings.columns else F.lit(1).cast("long")
    weight = F.when(F.col("category") == "security", F.greatest(F.lit(0.0), F.col("score_weight"))).otherwise(1.0)
    counted = findings.where(F.col("category") != PARSER_CATEGORY).groupBy(*RUN, "tool", "category", "severity").agg(F.sum(alike).alias("count"), round_half_up(F.sum(weight * alike), 6).alias("weighted_count"))
    return counted.withColumn("score_hint", score_hint(F.col("tool"), F.col("category")))


def scalar_metrics(results: DataFrame) -> DataFrame:
    """Metrics of scan results (project, run_id, tool, scalar_metrics map<string,double>) of the scanners
    whose scalars count."""
    return named_scalars(results.where(F.col("tool").isin(SCALAR_SCANNERS)))


def named_scalars(results: DataFrame) -> DataFrame:
    """Metrics of the scalars that have a category, of any scanner; percentages are kept within 0 and 100."""
    named = results.select(*RUN, "tool", F.explode("scalar_metrics").alias("name", "value")).where(F.col("value").isNotNull() & F.col("name").isin(*SCALARS))
    percent = F.col("name").isin([n for n, (_, p) in SCALARS.items() if p])
    clamped = F.when(percent, F.least(F.lit(100.0), F.greatest(F.lit(0.0), "value"))).otherwise(F.greatest(F.lit(0.0), "value"))
    return named.select(*RUN, "tool", lookup(F.col("name"), {n: c for n, (c, _) in SCALARS.items()}).alias("category"), F.lit("info").alias("severity"), F.lit(1).cast("long").alias("count"), F.lit(1.0).alias("weighted_count"), F.lit(1.0).alias("score_hint"), F.col("name").alias("scalar_name"), clamped.alias("scalar_value"))


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")


def category_scores(metrics: DataFrame) -> DataFrame:
    """Seven rows a run: score, findings and weight of each category; a coverage figure replaces
    what would be taken off for coverage. The last figure by tool holds if there are several."""
    scalar = F.col("scalar_name") if "scalar_name" in metrics.columns else F.lit(None).cast("string")
    value = F.col("scalar_value") if "scalar_value" in metrics.columns else F.lit(None).cast("double")
    coverage = scalar.eqNullSafe("coverage_percent")
    penalty = lookup(F.col("severity"), SEVERITY_PENALTY) * F.col("weighted_count") * F.col("score_hint")
    sums = metrics.groupBy(*RUN, "category").agg(
        F.sum(F.when(~coverage, F.col("count"))).alias("finding_count"), F.sum(F.when(~coverage, penalty)).alias("penalty"), F.max_by(F.when(coverage, value), F.when(coverage, F.col("tool"))).alias("fixed")
    )
    # a run has few categories, so its sums fit a map; those without findings are filled in from it
    held = sums.groupBy(*RUN).agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("category", F.lit("")), F.struct("finding_count", "penalty", "fixed")))).alias("m"))
    every = held.select(*RUN, "m", F.inline(category_rows())).select("*", F.element_at("m", F.col("category")).alias("s")).select("*", "s.*")
    score = F.coalesce("fixed", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - F.coalesce("penalty", F.lit(0.0)))))
    return every.select(*RUN, "category", "category_ord", "weight", F.coalesce("finding_count", F.lit(0)).cast("long").alias("finding_count"), score.alias("exact_score"), round_half_up(score, 2).alias("score"))


def score_cards(categories: DataFrame) -> DataFrame:
    """One row a run: overall score and grade."""
    total = categories.groupBy(*RUN).agg(round_half_up(F.sum(F.col("exact_score") * F.col("weight")), 2).alias("overall_score"), F.sum("finding_count").cast("long").alias("finding_count"))
    return total.withColumn("grade", grade(F.col("overall_score")))


#: The counters that a policy judges, besides score and metrics; a missing column counts as zero.
COUNTERS = [
    "scanner_failures", "parser_missing", "invalid_findings", "invalid_paths", "baseline_expired_entries", "baseline_missing_owner_entries", "baseline_expiring_soon_entries",
    "real_secret_findings", "probable_secret_findings", "private_key_findings", "baseline_real_secret_entries", "history_scan_skipped", "history_scan_stale", "secret_scanner_unavailable_count",
]


def security_counts(metrics: DataFrame) -> DataFrame:
    """Critical and high security findings of each run, whatever their weight."""
    sec = F.col("category") == "security"
    return metrics.groupBy(*RUN).agg(*(F.coalesce(F.sum(F.when(sec & (F.col("severity") == s), F.col("count"))), F.lit(0)).cast("long").alias(f"{s}_security_findings") for s in ("critical", "high")))


def policy(cards: DataFrame, *, warn_score: float = 80, fail_score: float = 60, high_limit: int = 3) -> DataFrame:
    """Adds status, reasons, violations and warnings to runs with overall_score, security counts and
    any of COUNTERS. Reasons come in a fixed order; a failing run keeps its warnings."""
    for name in COUNTERS:
        if name not in cards.columns:
            cards = cards.withColumn(name, F.lit(0))
    age = F.col("history_scan_age_days") if "history_scan_age_days" in cards.columns else F.lit(None).cast("int")
    n = lambda name: F.coalesce(F.col(name).cast("long"), F.lit(0))
    said = lambda text, name: F.concat(F.lit(text + " ("), n(name).cast("string"), F.lit(")"))
    days = F.concat(F.lit(" ("), age.cast("string"), F.lit(" days)"))
    stale = (
        F.when(age.isNull(), "history scan stale; historical secret exposure coverage is outdated")
        .when(age >= 365, F.concat(F.lit("history scan stale"), days, F.lit("; critical refresh overdue")))
        .when(age >= 180, F.concat(F.lit("history scan stale"), days, F.lit("; refresh strongly recommended")))
        .when(age >= 90, F.concat(F.lit("history scan stale"), days, F.lit("; refresh recommended")))
        .when(age >= 60, F.concat(F.lit("history scan aging"), days))
        .otherwise(F.concat(F.lit("history scan stale"), days))
    )
    score, high = F.col("overall_score"), F.col("high_security_findings")
    fails = {
        "critical_security_finding": (F.col("critical_security_findings") > 0, F.lit("critical security findings present")),
        "scanner_failure": (n("scanner_failures") > 0, F.lit("scanner failures present")),
        "parser_missing": (n("parser_missing") > 0, F.lit("parser registrations missing")),
        "invalid_findings": (n("invalid_findings") > 0, F.lit("invalid findings rejected")),
        "invalid_paths": (n("invalid_paths") > 0, F.lit("invalid finding paths rejected")),
        "low_score": (score < fail_score, F.lit(f"overall score below {fail_score:g}")),
        "real_secret_exposure": (n("real_secret_findings") > 0, said("real credential/secret exposure findings present", "real_secret_findings")),
        "private_key_material": (n("private_key_findings") > 0, said("private key material findings present", "private_key_findings")),
        "baseline_real_secret_prohibited": (n("baseline_real_secret_entries") > 0, said("baseline contains prohibited real-secret entries", "baseline_real_secret_entries")),
    }
    warns = {
        "probable_secret_exposure": (n("probable_secret_findings") > 0, said("probable secret exposure findings present", "probable_secret_findings")),
        "baseline_entry_expired": (n("baseline_expired_entries") > 0, said("baseline has expired entries", "baseline_expired_entries")),
        "baseline_entry_missing_owner": (n("baseline_missing_owner_entries") > 0, said("baseline has entries missing owner", "baseline_missing_owner_entries")),
        "baseline_entry_expiring": (n("baseline_expiring_soon_entries") > 0, said("baseline has entries expiring soon", "baseline_expiring_soon_entries")),
        "history_scan_skipped": (n("history_scan_skipped") > 0, F.lit("history scan skipped; historical secret exposure coverage is incomplete")),
        "history_scan_stale": (n("history_scan_stale") > 0, stale),
        "secret_scanner_unavailable": (n("secret_scanner_unavailable_count") > 0, said("secret scanners unavailable", "secret_scanner_unavailable_count")),
        "high_security_findings": (high > high_limit, F.concat(F.lit("high security findings exceed threshold ("), high.cast("string"), F.lit(f" > {high_limit})"))),
        "low_score": (score < warn_score, F.lit(f"overall score below {warn_score:g}")),
    }
    order = ["scanner_failure", "parser_missing", "invalid_findings", "invalid_paths", "baseline_entry_expired", "baseline_entry_missing_owner", "baseline_entry_expiring", "critical_security_finding", "high_security_findings", "low_score", "real_secret_exposure", "probable_secret_exposure", "private_key_material", "baseline_real_secret_prohibited", "history_scan_skipped", "history_scan_stale", "secret_scanner_unavailable"]
    held = {name: F.lit(False) for name in order}
    for rules in (fails, warns):
        for name, (flag, _) in rules.items():
            held[name] = held[name] | F.coalesce(flag, F.lit(False))
    listed = lambda rules: F.array_compact(F.array(*(F.when(flag, text) for flag, text in rules.values())))
    out = cards.withColumns({"violations": listed(fails), "warnings": listed(warns), "reasons": F.array_compact(F.array(*(F.when(held[name], name) for name in order)))})
    status = F.when(F.size("violations") > 0, "fail").when(F.size("warnings") > 0, "warn").otherwise("pass")
    return out.withColumn("status", status).withColumn("summary", lookup(F.col("status"), {"fail": "Quality policy failed", "warn": "Quality policy warning", "pass": "Quality policy passed"}))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings of each run by severity, zero where there are none."""
    return findings.groupBy(*RUN).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES))


def run_counters(results: DataFrame) -> DataFrame:
    """Counters of scan results (project, run_id, scanner, success, error_code, finding_count,
    invalid_finding_count)."""
    code, bad = F.col("error_code"), F.coalesce("invalid_finding_count", F.lit(0))
    missing, path = code.eqNullSafe(PARSER_MISSING), code.eqNullSafe(PATH_INVALID)
    parse = F.coalesce(code.isin(PARSE_FAILURES), F.lit(False))
    return results.groupBy(*RUN).agg(
        F.count("*").alias("scanner_count"), F.count_if("success").alias("successful_scanners"), F.count_if(~F.col("success")).alias("failed_scanners"), F.sum("finding_count").alias("finding_count"),
        F.sum(bad).alias("invalid_findings"), F.sum(F.when(path, F.when(bad > 0, bad).otherwise(1)).otherwise(0)).alias("invalid_paths"),
        F.count_if(parse & ~missing).alias("parse_failures"), F.count_if(missing).alias("parser_missing"), F.count_if(~missing & ~parse & ~F.col("success") & ~path).alias("scanner_failures"),
    )


def exit_code(policy_status: Column, scanner_failures: Column, parser_failures: Column, gate: bool) -> Column:
    """Scanner failures first, then parser failures, then, if the policy gates, its status."""
    code = F.when(scanner_failures > 0, EXIT_CODES["scanner_failure"]).when(parser_failures > 0, EXIT_CODES["parser_failure"])
    if gate:
        code = code.when(policy_status == "fail", EXIT_CODES["policy_fail"]).when(policy_status == "warn", EXIT_CODES["policy_warn"])
    return code.otherwise(EXIT_CODES["ok"])
