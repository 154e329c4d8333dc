"""The engine's queries over the derived findings and the text tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import baseline, findings as ops, history, inventory, portal, recommend, scoring
from verdigris.plans import queries_extend, queries_scan
from verdigris.sources import derived, reports
from verdigris.sources.work import written

RUN = ["project", "run_id"]
#: The moment that baselines and retention are judged at.
NOW = "timestamp '2001-06-01 00:00:00'"


def normalized(spark: SparkSession, d: str) -> DataFrame:
    return ops.normalize(derived.findings(spark, d))


def classified(spark: SparkSession, d: str) -> DataFrame:
    return ops.classify(normalized(spark, d))


def identified(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """What tells findings apart, computed once and written."""
    return written(normalized(spark, d).select(*RUN, "scanner_ord", "finding_ord", "tool", "fingerprint", "dedupe_key", *more), "identified")


def clustered(spark: SparkSession, d: str, *more: str) -> DataFrame:
    """What clusters of findings are made of, computed once and written."""
    wanted = [*RUN, "scanner_ord", "finding_ord", "tool", "rule_id", "category", "severity", "file", "message", "normalized_message", "confidence", "security_class"]
    return written(classified(spark, d).select(*wanted, *more), "clustered")


def entries(rows: DataFrame) -> DataFrame:
    """A baseline for the findings whose fingerprint starts with 0 to 3; its digits set the rest."""
    digit = lambda at: F.conv(F.substring("fingerprint", at, 1), 16, 10).cast("int")
    some = rows.select("fingerprint").distinct().where(F.substring("fingerprint", 1, 1) < "4")
    expires = F.when(digit(3) >= 4, F.expr(NOW) + F.make_dt_interval(days=digit(3) * 4 - 30))
    return some.select("fingerprint", (digit(2) < 12).alias("accepted"), F.when(digit(4) < 12, "team").alias("owner"), expires.alias("expires_at"))


def left_over(rows: DataFrame) -> DataFrame:
    """The findings that dedupe and baseline leave, counted where they agree. What the joins and the
    baseline read is written once; so are the accepted fingerprints, whose size Spark then knows."""
    found = written(ops.counted(rows), "counted")
    accepted = entries(found.select(F.lower(F.hex("fingerprint")).alias("fingerprint"))).withColumn("fingerprint", F.unhex("fingerprint"))
    return baseline.apply(ops.kept(found), written(accepted, "entries"), F.expr(NOW))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Classified findings that dedupe and baseline leave, counted where they agree."""
    return left_over(classified(spark, d))


def cards_of(found: DataFrame) -> DataFrame:
    return scoring.score_cards(scoring.category_scores(scoring.finding_metrics(found)))


def cards(spark: SparkSession, d: str) -> DataFrame:
    return cards_of(scored(spark, d))


def judged(spark: SparkSession, d: str) -> DataFrame:
    return judged_of(scored(spark, d))


def judged_of(found: DataFrame) -> DataFrame:
    metrics = written(scoring.finding_metrics(found), "metrics")
    rows = scoring.score_cards(scoring.category_scores(metrics)).join(scoring.security_counts(metrics), RUN)
    return scoring.policy(rows)


def q_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = normalized(spark, d)
    return rows.select("project", "run_id", "finding_ord", "tool", "normalized_message", "fingerprint", "dedupe_key", "native_severity", "ownership", "ownership_confidence")


def q_classify(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("project", "run_id", "finding_ord", "tool", "file", "security_class", "security_context", "security_impact", "score_weight", "classification_reason", "classification_detail")


def q_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ops.dedupe(identified(spark, d)).select("project", "run_id", "finding_ord", "tool", "fingerprint", "kept", "duplicate_of")


def q_dedupe_summary(spark: SparkSession, d: str) -> DataFrame:
    return ops.dedupe_summary(ops.dedupe(identified(spark, d)))


def q_payload_budget(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.findings(spark, d).select(*RUN, *derived.ORDER)
    rows = ops.payload_budget(rows, per_finding=48, per_run=2000, order=derived.ORDER)
    return rows.groupBy(*RUN).agg(F.sum("payload_bytes").alias("payload_bytes"), F.sum("payload_used").alias("payload_used"), F.count_if("payload_truncated").alias("truncated"))


def q_severity_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each finding in the published order of its run: severity, category, file, rule and
    fingerprint. Findings that agree in all of these share a place."""
    rows = normalized(spark, d).select(*RUN, "finding_ord", "tool", "severity", "category", "file", "rule_id", F.unhex("fingerprint").alias("fingerprint"))
    return ops.published_places(written(rows, "published")).select(*RUN, "finding_ord", "tool", F.col("place").cast("int").alias("place"))


def q_baseline_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = identified(spark, d)
    return baseline.stats(rows, entries(rows), F.expr(NOW))


def q_baseline_apply(spark: SparkSession, d: str) -> DataFrame:
    rows = identified(spark, d)
    return baseline.apply(rows, entries(rows), F.expr(NOW)).groupBy(*RUN, "tool").agg(F.count("*").alias("new_findings"))


def q_metrics(spark: SparkSession, d: str) -> DataFrame:
    return scoring.finding_metrics(scored(spark, d))


def q_category_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.category_scores(scoring.finding_metrics(scored(spark, d))).select(*RUN, "category", "finding_count", "score", "weight")


def q_scorecard(spark: SparkSession, d: str) -> DataFrame:
    return cards(spark, d)


def q_policy(spark: SparkSession, d: str) -> DataFrame:
    return judged(spark, d).select(*RUN, "overall_score", "critical_security_findings", "high_security_findings", "status", F.array_join("reasons", ",").alias("reasons"), F.array_join("violations", ";").alias("violations"), F.array_join("warnings", ";").alias("warnings"), "summary")


def plan_columns(rows: DataFrame) -> DataFrame:
    return rows.select(*RUN, *recommend.KEY, "severity", "supporting_findings_count", "file_count", "priority_score", "priority_reason", "effort", "impact", "priority", "blast_radius", "title", "why", "recommended_fix", "where", F.array_join("example_files", ",").alias("example_files"), "rank")


def q_recommendations(spark: SparkSession, d: str) -> DataFrame:
    return plan_columns(recommend.recommendations(clustered(spark, d)))


def q_action_plan(spark: SparkSession, d: str) -> DataFrame:
    return recommend.action_plan(recommend.recommendations(clustered(spark, d))).select(*RUN, "list", "place", "title", "priority_score", "supporting_findings_count")


def q_executive_summary(spark: SparkSession, d: str) -> DataFrame:
    """What each run's plan says in one paragraph, with the run before it."""
    rows = clustered(spark, d, "score_weight", "fingerprint", "dedupe_key")
    plan = recommend.action_plan(recommend.recommendations(rows))
    found = recommend.summaries(history.trend(cards_of(left_over(rows))), plan, recommend.systemic(rows))
    return found.select(*RUN, "overall_score", "previous_score", "top_title", "quick_wins", "systemic", "executive_summary")


def q_systemic(spark: SparkSession, d: str) -> DataFrame:
    return recommend.systemic(clustered(spark, d)).select(*RUN, "severity", "supporting_findings_count", "file_count", "priority_score", "effort", "impact", "title")


def q_trend(spark: SparkSession, d: str) -> DataFrame:
    return history.trend(cards(spark, d)).select(*RUN, "overall_score", "previous_score", "trend_delta")


def q_latest(spark: SparkSession, d: str) -> DataFrame:
    return history.latest(judged(spark, d).select(*RUN, "overall_score", "grade", "status"))


def q_portfolio(spark: SparkSession, d: str) -> DataFrame:
    return history.portfolio(history.latest(judged(spark, d).select(*RUN, "overall_score", "status")))


def runs(spark: SparkSession, d: str) -> DataFrame:
    return derived.findings(spark, d).groupBy(*RUN).agg(F.count("*").alias("finding_count"))


def q_prune_keep(spark: SparkSession, d: str) -> DataFrame:
    return history.prune_keep(runs(spark, d), 10)


def q_prune_older(spark: SparkSession, d: str) -> DataFrame:
    began = F.make_timestamp(F.substring("run_id", 1, 4).cast("int"), F.substring("run_id", 7, 1).cast("int") * 3 - 2, F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return history.prune_older(runs(spark, d), F.expr(NOW), 400, began)


def q_severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.severity_counts(derived.findings(spark, d))


def q_affected_files(spark: SparkSession, d: str) -> DataFrame:
    return portal.affected_files(derived.findings(spark, d))


def q_rule_families(spark: SparkSession, d: str) -> DataFrame:
    return portal.rule_families(derived.findings(spark, d))


def q_portal_clusters(spark: SparkSession, d: str) -> DataFrame:
    return portal.clusters(normalized(spark, d)).withColumn("example_files", F.array_join("example_files", ","))


def q_security_groups(spark: SparkSession, d: str) -> DataFrame:
    return portal.security_groups(classified(spark, d))


def q_security_summary(spark: SparkSession, d: str) -> DataFrame:
    return portal.security_summary(classified(spark, d))


def q_parser_summary(spark: SparkSession, d: str) -> DataFrame:
    return portal.parser_summary(derived.findings(spark, d))


def q_raw_samples(spark: SparkSession, d: str) -> DataFrame:
    return portal.samples(derived.findings(spark, d), 5)


def files(spark: SparkSession, d: str) -> DataFrame:
    return derived.findings(spark, d).select("project", F.col("file").alias("path")).distinct()


def q_inventory(spark: SparkSession, d: str) -> DataFrame:
    return inventory.counts(files(spark, d), ["docs/m1*"])


def q_zones(spark: SparkSession, d: str) -> DataFrame:
    return inventory.zones(files(spark, d).withColumn("tracked", ~F.col("path").endswith("m2.py")), ["lib/**"], ["m2.*"])


def q_parse_reports(spark: SparkSession, d: str) -> DataFrame:
    """Findings written as reports in three dialects, an entry each, and read back, in one pass. Findings
    that agree in all that a report holds are counted first: equal reports read equally."""
    tools, c = ["ruff", "bandit", "opengrep"], F.col
    rows = derived.findings(spark, d).where(c("tool").isin(tools)).groupBy("project", "tool", "rule_id", "severity", "message", "file", "line").agg(F.count("*").alias("alike"))
    place = F.struct(F.struct(F.struct(c("file").alias("uri")).alias("artifactLocation"), F.struct(c("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    stdout = (
        F.when(c("tool") == "ruff", F.to_json(F.array(F.struct(c("rule_id").alias("code"), "message", c("file").alias("filename"), F.struct(c("line").alias("row")).alias("location")))))
        .when(c("tool") == "bandit", F.to_json(F.struct(F.array(F.struct(c("rule_id").alias("test_id"), c("message").alias("issue_text"), c("file").alias("filename"), c("line").alias("line_number"), F.upper("severity").alias("issue_severity"))).alias("results"))))
        .when(c("tool") == "opengrep", F.to_json(F.struct(F.array(F.struct(F.array(F.struct(c("rule_id").alias("ruleId"), F.struct(c("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("results"))).alias("runs"))))
    )
    made = rows.select("project", "alike", "tool", stdout.alias("stdout"), F.lit("").alias("stderr"), F.lit("").alias("root"))
    found = reports.parse(made, {t: reports.DIALECTS[t] for t in tools}, ["project", "alike"])
    return found.groupBy("project", "tool", "rule_id", "severity", "category", "file", "line").agg(F.sum("alike").alias("count"), F.sum(F.when(c("problem").isNotNull(), c("alike")).otherwise(0)).alias("problems"))


#: The JVM interprets methods of more bytes than this, and Spark's own limit is its class file's.
COMPILED = ("spark.sql.codegen.hugeMethodLimit", "65535", "8000")


def compiled(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query whose generated methods the JVM compiles; a session that has set the limit keeps its own."""

    @functools.wraps(query)
    def run(spark: SparkSession, d: str) -> DataFrame:
        name, default, limit = COMPILED
        if spark.conf.get(name) == default:
            spark.conf.set(name, limit)
        return query(spark, d)

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name[2:]: compiled(f) for name, f in [*globals().items(), *vars(queries_scan).items(), *vars(queries_extend).items()] if name.startswith("q_")}
