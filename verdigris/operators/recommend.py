"""Clusters of findings and the ranked plan of what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.schemas import PRIORITY_SEVERITY, lookup, round_half_up
from verdigris.sources.work import written

RUN = ["project", "run_id"]
KEY = ["category", "rule_family", "message_family", "file_pattern"]
RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
CLASS = {"runtime_security": "runtime", "tooling_security": "tooling", "test_security": "test_only", "false_positive": "false_positive"}
QUICK_HINTS = ["unused", "import", "dead", "type hint", "format"]
# Fixed texts of the published plan.
TITLES = {"complexity": "Complexity hotspots in related modules", "typing": "Typing gaps reduce static safety", "dead_code": "Dead code and unused symbols"}
FIXES = {
    "security": "Apply secure defaults, validate trust boundaries, and add regression tests for exploit paths.",
    "complexity": "Split high-complexity routines, reduce branch depth, and extract cohesive helpers.",
    "typing": "Add explicit type hints on public APIs and enable stricter type checks for affected modules.",
    "dead_code": "Remove unused imports, symbols, and dead branches, then rerun lint checks.",
}
OTHER_FIX = "Standardize remediation for this rule family and enforce with CI checks."


def confidence_weight(tool: Column, rule_id: Column, confidence: Column) -> Column:
    rule, by = F.lower(F.trim(rule_id)), F.lower(F.trim(tool))
    return (
        F.when(rule.isin("b105", "bandit:b105"), 0.25).when(rule.isin("b104", "b108", "bandit:b104", "bandit:b108"), 0.9).when(by.isin("pyright", "mypy", "typescript", "tsc"), 1.0)
        .when(confidence >= 0.85, 1.0).when(confidence >= 0.5, 0.5).when(confidence.isNotNull(), 0.25).otherwise(0.5)
    )


def keyed(findings: DataFrame) -> DataFrame:
    """Adds the cluster key to normalised and classified findings."""
    message = F.coalesce(F.when(F.col("normalized_message") != "", F.col("normalized_message")), "message")
    return findings.withColumns({"rule_family": text.rule_family(F.col("rule_id")), "message_family": text.message_family(message), "file_pattern": text.file_pattern(F.col("file"))})


def file_features(rows: DataFrame, key: list[str]) -> DataFrame:
    """What ranking needs of each file of a group, by security class and scanner. All that is added up is of
    fixed width, so Spark adds it up by hashing, map-side, without sorting the findings first."""
    cls = lookup(F.col("security_class"), CLASS, "runtime")
    return rows.groupBy(*key, "file", cls.alias("class"), "scanner_ord").agg(
        F.count("*").alias("n"), F.max(lookup(F.col("severity"), RANK, 1)).alias("rank"), F.sum("confidence").alias("confidence"),
        F.sum(confidence_weight(F.col("tool"), F.col("rule_id"), F.col("confidence"))).alias("trust"), F.min("finding_ord").alias("finding_ord"),
    )


def features(parts: DataFrame, key: list[str]) -> DataFrame:
    """What ranking needs of each group of findings, from the features of their files, whatever finer key
    these have: a row for each file of a group, with a counter for each security class."""
    place = F.struct("scanner_ord", "finding_ord")
    kinds = sorted({*CLASS.values(), "runtime"})
    files = parts.groupBy(*key, "file").agg(
        F.sum("n").alias("n"), F.max("rank").alias("rank"), F.sum("confidence").alias("confidence"), F.sum("trust").alias("trust"),
        *(F.sum(F.when(F.col("class") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in kinds), *(F.min(F.when(F.col("class") == k, place)).alias(f"first_{k}") for k in kinds),
    )
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("file"))
    first = lambda k: F.min(f"first_{k}")
    # the class with most findings, of several the one that is seen first
    classes = F.array(*(F.struct(F.sum(f"n_{k}").alias("n"), -first(k)["scanner_ord"], -first(k)["finding_ord"], F.lit(k).alias("class")) for k in kinds))
    return files.withColumn("nth", nth).groupBy(*key).agg(
        F.sum("n").alias("supporting_findings_count"), F.max("rank").alias("severity_rank"), (F.sum("confidence") / F.sum("n")).alias("mean_confidence"), (F.sum("trust") / F.sum("n")).alias("trust"),
        F.count_if(F.col("file") != "").alias("file_count"), F.array_sort(F.collect_list(F.when(F.col("nth") <= 3, F.col("file")))).alias("example_files"), F.array_max(classes)["class"].alias("dominant_class"),
    )


def described(groups: DataFrame) -> DataFrame:
    """Score, labels and texts of groups with features and the columns of KEY."""
    c, n, files = F.col("category"), F.col("supporting_findings_count"), F.col("file_count")
    severity = lookup(F.col("severity_rank"), {v: k for k, v in RANK.items()})
    security = c == "security"
    prevalence = F.when(n <= 1, 1.0).when(n <= 4, 1.2).when(n <= 9, 1.5).when(n <= 24, 2.0).otherwise(3.0)
    exploit = F.when(security, lookup(F.col("dominant_class"), {"runtime": 2.5, "tooling": 0.5, "test_only": 0.25, "false_positive": 0.1})).otherwise(lookup(c, {"typing": 1.2, "lint": 0.5, "dead_code": 0.3}, 0.6))
    trust = round_half_up(F.col("trust"), 3)
    cost = (
        F.when(c.isin("lint", "dead_code") & (n <= 8), 0.5).when((c == "typing") & (n <= 6) & (files <= 2), 1.0)
        .when(security, F.when((severity == "critical") & (n >= 10), 5.0).when(n <= 4, 1.0).otherwise(2.0))
        .when((n >= 20) | (files >= 8), 5.0).when((n >= 6) | (files >= 3), 2.0).otherwise(1.0)
    )
    score = round_half_up(lookup(severity, PRIORITY_SEVERITY) * prevalence * exploit * trust / cost, 1)
    reason = F.concat_ws(
        "|", F.when(security, F.concat("dominant_class", F.lit("_security"))).otherwise(c),
        F.when(prevalence >= 3, "very_high_prevalence").when(prevalence >= 2, "high_prevalence").when(prevalence >= 1.5, "moderate_prevalence").otherwise("isolated_prevalence"),
        F.when(trust >= 0.85, "high_confidence").when(trust < 0.5, "low_confidence").otherwise("medium_confidence"),
        F.when(cost <= 1, "low_cost").when(cost <= 2, "moderate_cost").otherwise("high_cost"),
    )
    blast = F.when((files >= 8) | (n >= 20), "systemic").when(files >= 3, "multi_file").when(files == 1, "single_file").otherwise("single_line")
    effort = (
        F.when(c.isin("dead_code", "lint", "typing") & (n <= 8) & severity.isin("low", "info", "medium"), "Small").when(n >= 20, "Huge")
        .when((severity == "critical") | security, F.when(n >= 5, "Large").otherwise("Medium")).when(n >= 10, "Large").otherwise("Medium")
    )
    impact = F.when(severity.isin("critical", "high") | (blast == "systemic"), "High").when((severity == "medium") | (blast == "multi_file"), "Medium").otherwise("Low")
    named = text.capitalize(severity)
    title = F.when(security, F.concat(F.lit("Security issue pattern: "), F.substring("message_family", 1, 45))).otherwise(F.coalesce(lookup(c, TITLES), F.concat(named, F.lit(" "), c, F.lit(" issue pattern"))))
    why = F.concat(named, F.lit(" "), F.replace(c, F.lit("_"), F.lit(" ")), F.lit(" findings with "), F.replace(blast, F.lit("_"), F.lit(" ")), F.lit(" impact increase delivery and reliability risk."))
    return groups.withColumns(
        {
            "severity": severity, "priority_score": score, "priority_reason": reason, "blast_radius": blast, "effort": effort, "impact": impact, "title": title, "why": why,
            "priority": F.when(score >= 120, "Critical").when(score >= 40, "High").when(score >= 10, "Medium").otherwise("Low"),
            "confidence_level": F.when(F.col("mean_confidence") >= 0.8, "high").when(F.col("mean_confidence") >= 0.5, "medium").otherwise("low"),
            "recommended_fix": lookup(c, FIXES, OTHER_FIX), "where": F.coalesce(F.try_element_at("example_files", F.lit(1)), F.lit("project-wide")),
        }
    )


def recommendations(findings: DataFrame) -> DataFrame:
    """Every cluster of every run, described and ranked; ties in the ranking go by cluster key."""
    ranked = described(features(file_features(keyed(findings), [*RUN, *KEY]), [*RUN, *KEY]))
    order = [F.desc("priority_score"), F.desc("severity_rank"), F.desc("supporting_findings_count"), "title", *KEY]
    return ranked.withColumn("rank", F.row_number().over(Window.partitionBy(*RUN).orderBy(*order)))


def action_plan(ranked: DataFrame) -> DataFrame:
    """The lists of the plan: best five, ten quick wins, five on security, five on architecture."""
    hint = F.lower(F.concat_ws("\n", "title", "recommended_fix")).rlike("|".join(QUICK_HINTS))
    quick = (F.col("effort") == "Small") & hint
    lists = {"top": (F.lit(True), 5), "quick_win": (quick, 10), "security": (F.col("category") == "security", 5), "architecture": (F.col("category").isin("complexity", "maintainability", "typing"), 5)}
    tagged = ranked.select("*", F.explode(F.array_compact(F.array(*(F.when(flag, name) for name, (flag, _) in lists.items())))).alias("list"))
    place = F.row_number().over(Window.partitionBy(*RUN, "list").orderBy("rank"))
    return tagged.withColumn("place", place).where(F.col("place") <= lookup(F.col("list"), {k: n for k, (_, n) in lists.items()}))


def systemic(findings: DataFrame) -> DataFrame:
    """One pooled row a run for clusters that span five files or hold ten findings."""
    parts = written(file_features(keyed(findings), [*RUN, *KEY]), "file-features")
    sizes = parts.groupBy(*RUN, *KEY, "file").agg(F.sum("n").alias("n")).groupBy(*RUN, *KEY).agg(F.sum("n").alias("n"), F.count_if(F.col("file") != "").alias("files"))
    spread = sizes.where("files >= 5 or n >= 10").select(*RUN, *KEY)
    pooled = features(parts.join(spread, [*RUN, *KEY], "left_semi"), RUN)
    named = pooled.withColumns({"category": F.lit("maintainability"), "rule_family": F.lit("systemic"), "message_family": F.lit("repeated-pattern"), "file_pattern": F.lit("project")})
    return described(named).withColumns({"title": F.lit("Repeated issue patterns across modules"), "recommended_fix": F.lit("Create one remediation checklist and apply it consistently across affected modules.")})


#: What ranking works with and a published plan leaves out.
INTERNAL = ["severity_rank", "trust", "mean_confidence", "dominant_class", "rank"]


def published(plan: DataFrame) -> DataFrame:
    """A plan without what only its ranking needs."""
    return plan.drop(*INTERNAL)


def summaries(cards: DataFrame, plan: DataFrame, pooled: DataFrame) -> DataFrame:
    """The executive summary of each run with overall_score and previous_score (see history.trend), from
    its action plan's lists and its systemic issues."""
    lists = plan.groupBy(*RUN).agg(F.max(F.when((F.col("list") == "top") & (F.col("place") == 1), F.col("title"))).alias("top_title"), F.count_if(F.col("list") == "quick_win").alias("quick_wins"))
    issues = pooled.groupBy(*RUN).agg(F.count("*").alias("systemic"))
    return summary_text(cards.join(lists, RUN, "left").join(issues, RUN, "left").fillna(0, ["quick_wins", "systemic"]))


def summary_text(plan: DataFrame) -> DataFrame:
    """Adds executive_summary to runs with overall_score, previous_score, top_title, quick_wins, systemic."""
    health = F.when(F.col("overall_score") >= 85, "Good").when(F.col("overall_score") >= 70, "Fair").otherwise("Needs Improvement")
    trend = F.when(F.coalesce("previous_score", F.lit(0.0)) != 0, F.concat(F.lit(" Score has "), F.when(F.col("overall_score") >= F.col("previous_score"), "improved").otherwise("declined"), F.lit(" since the previous run."))).otherwise("")
    return plan.withColumn(
        "executive_summary",
        F.concat(
            F.lit("Project health is "), health, F.lit(". The highest priority issue is "), F.coalesce("top_title", F.lit("no critical findings")), F.lit(". "), F.col("quick_wins").cast("string"),
            F.lit(" quick wins can be completed in under one hour. "), F.col("systemic").cast("string"), F.lit(" systemic maintainability concern(s) affect multiple modules."), trend,
        ),
    )
