"""Artifacts of Java builds: which runner builds a project, where its tools leave their reports, and the
findings of all modules together.

A build writes one report a module and tool. They are not joined to one text, which would grow with the
modules: each is read by itself, and the findings are numbered over the modules in the order of their
paths. As with any report, one unsound module's makes the tool's run unsound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.discovery import at_root, has, modules
from verdigris.operators.findings import PARSED, parser_failures, unsound_runs
from verdigris.operators.ordered import numbers
from verdigris.sources.reports import DIALECTS, parse
from verdigris.sources.work import written

# Where each runner's builds leave the reports of a tool, the first that is there holds.
ARTIFACTS = {
    "spotbugs": {"maven": ["target/spotbugsXml.xml"], "gradle": ["build/reports/spotbugs/main.xml", "build/reports/spotbugs/main/spotbugs.xml"]},
    "pmd": {"maven": ["target/pmd.xml", "target/site/pmd.xml"], "gradle": ["build/reports/pmd/main.xml"]},
    "checkstyle": {"maven": ["target/checkstyle-result.xml", "target/site/checkstyle-result.xml"], "gradle": ["build/reports/checkstyle/main.xml"]},
    "dependency_check": {"maven": ["target/dependency-check-report.json"], "gradle": ["build/reports/dependency-check-report.json"]},
    "jacoco": {"maven": ["target/site/jacoco/jacoco.xml"], "gradle": ["build/reports/jacoco/test/jacocoTestReport.xml"]},
}
GRADLE = ("build.gradle", "build.gradle.kts", "settings.gradle", "settings.gradle.kts", "gradlew")


def runners(files: DataFrame) -> DataFrame:
    """(project, runner, command): Maven where its files are at the root, else Gradle, by the project's own
    wrapper if it has one. Projects with neither have no row."""
    found = files.groupBy("project").agg(has(at_root("pom.xml", "mvnw")).alias("maven"), has(at_root("mvnw")).alias("mvnw"), has(at_root(*GRADLE)).alias("gradle"), has(at_root("gradlew")).alias("gradlew"))
    c = F.col
    command = F.when(c("maven"), F.when(c("mvnw"), "./mvnw").otherwise("mvn")).otherwise(F.when(c("gradlew"), "./gradlew").otherwise("gradle"))
    return found.where("maven OR gradle").select("project", F.when(c("maven"), "maven").otherwise("gradle").alias("runner"), command.alias("command"))


def artifacts(files: DataFrame) -> DataFrame:
    """(project, module_path, tool, path, text): of each module of a project (project, path, text) and each
    tool the report that its build has left. Texts are joined last, so they are moved once."""
    places = F.explode(F.array(*(F.struct(F.lit(tool).alias("tool"), F.lit(runner).alias("runner"), F.lit(i).alias("nth"), F.lit(path).alias("place")) for tool, of in ARTIFACTS.items() for runner, paths in of.items() for i, path in enumerate(paths))))
    wanted = modules(files).join(runners(files), "project").select("project", "module_path", F.col("runner").alias("by"), places.alias("p")).where("p.runner = by")
    path = F.concat(F.when(F.col("module_path") == ".", "").otherwise(F.concat("module_path", F.lit("/"))), "p.place")
    there = wanted.select("project", "module_path", "p.tool", "p.nth", path.alias("path")).join(files.select("project", "path"), ["project", "path"])
    first = there.groupBy("project", "module_path", "tool").agg(F.min_by("path", "nth").alias("path"))
    return first.join(files.select("project", "path", "text"), ["project", "path"]).select("project", "module_path", "tool", "path", "text")


def findings(found: DataFrame, run_id: str) -> DataFrame:
    """Findings of artifacts, over all modules of a project."""
    known = {name: d for name, d in DIALECTS.items() if (d.tool or name) in ARTIFACTS}
    reports = found.select("project", F.lit(run_id).alias("run_id"), "tool", F.col("text").alias("stdout"), F.lit("").alias("stderr"), F.lit("").alias("root"), "module_path")
    rows = written(parse(reports, known, ["project", "run_id", "module_path"]), "artifacts")
    numbered = numbers(rows, ["project", "run_id", "tool"], ["module_path", "finding_ord"], "__n").withColumn("finding_ord", F.col("__n") - 1).drop("__n", "module_path")
    # written, so Spark knows how few these are, and does not move all sound findings to join them
    bad = written(unsound_runs(rows), "unsound")
    return parser_failures(rows.join(bad.select(PARSED), PARSED, "left_semi").select(*PARSED, "tool").distinct(), numbered, bad)
