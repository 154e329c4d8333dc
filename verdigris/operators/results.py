"""Results of scanners: what a run's summary says of them.

A result is one row (project, run_id, scanner_ord, scanner, success, error_code, finding_count,
invalid_finding_count, input_files, scalar_metrics map<string,double>).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.scoring import exit_code
from verdigris.schemas import PARSE_FAILURES, PARSER_MISSING, SCANNER_ERRORS

RUN = ["project", "run_id"]


def rolled_up(results: DataFrame) -> DataFrame:
    """The scalar metrics of a run; of scanners that tell the same one, the last in order holds."""
    named = results.select(*RUN, "scanner_ord", F.explode("scalar_metrics").alias("name", "value"))
    return named.groupBy(*RUN, "name").agg(F.max_by("value", "scanner_ord").alias("value"))


def stats(results: DataFrame) -> DataFrame:
    """What the summary lists of each scanner."""
    return results.select(*RUN, "scanner", F.coalesce("input_files", F.lit(0)).cast("long").alias("scanner_input_file_count"), "success", "error_code")


def measured_categories(metrics: DataFrame) -> DataFrame:
    """The categories that a run has any metric of, in order."""
    return metrics.groupBy(*RUN).agg(F.array_sort(F.collect_set("category")).alias("measured_categories"))


def exit_codes(results: DataFrame, policies: DataFrame, gate: bool = True) -> DataFrame:
    """The exit code of each run with a policy status: scanner errors first, then parser errors, then,
    if the policy gates, its status."""
    code = F.col("error_code")
    failed = results.groupBy(*RUN).agg(F.count_if(code.isin(SCANNER_ERRORS)).alias("scanner"), F.count_if(F.coalesce(code.isin(PARSER_MISSING, *PARSE_FAILURES), F.lit(False)) | (F.coalesce("invalid_finding_count", F.lit(0)) > 0)).alias("parser"))
    return policies.join(failed, RUN).select(*RUN, "status", exit_code(F.col("status"), F.col("scanner"), F.col("parser"), gate).alias("exit_code"))


def summary_lines(summary: DataFrame) -> DataFrame:
    """The text that the command line shows for a run (scanner_count, successful_scanners,
    failed_scanners, overall_score, grade, status, reasons array, the baseline's counters,
    suppressed_count, cache_hits, cache_misses, report_root; and, if there, miss_reason_counts map and
    secrets_suppression_rate_percent)."""
    c = F.col
    # The words of the lines.
    reasons = F.when((c("cache_hits") + c("cache_misses") > 0) & (F.size("miss_reason_counts") > 0), F.concat(F.lit("Miss reasons: "), F.array_join(F.transform(F.array_sort(F.map_entries("miss_reason_counts")), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), " "))) if "miss_reason_counts" in summary.columns else F.lit(None)
    noise = F.concat(F.lit("Secret scanner noise suppression: "), c("secrets_suppression_rate_percent").cast("decimal(12,2)").cast("string"), F.lit("%")) if "secrets_suppression_rate_percent" in summary.columns else F.lit(None)
    text = F.concat_ws(
        "\n",
        F.format_string("Ran %d scanners for %s (%d succeeded, %d failed)", "scanner_count", "project", "successful_scanners", "failed_scanners"),
        F.concat(F.lit("Overall score: "), c("overall_score").cast("decimal(12,2)").cast("string")),
        F.concat(F.lit("Grade: "), F.coalesce("grade", F.lit("N/A"))),
        F.concat(F.lit("Policy status: "), F.upper(F.coalesce("status", F.lit("unknown")))),
        F.format_string(
            "Debt summary: gross=%d, scored=%d, accepted=%d, new=%d, resolved=%d, suppressed_duplicates=%d",
            *(F.coalesce(c(n).cast("long"), F.lit(0)) for n in ("gross_findings", "scored_findings", "accepted_debt", "new_findings", "resolved_findings", "suppressed_count")),
        ),
        F.when(c("cache_hits") + c("cache_misses") > 0, F.format_string("Java cache: %d hits / %d misses", "cache_hits", "cache_misses")),
        reasons.cast("string"),
        noise.cast("string"),
        F.when(c("status").isin("warn", "fail"), F.concat(F.lit("Policy reasons: "), F.array_join("reasons", ", "))),
        F.concat(F.lit("Report portal: "), "report_root", F.lit("/index.html")),
    )
    return summary.select(*RUN, text.alias("text"))

