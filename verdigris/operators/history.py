"""Runs over time: trends, the latest run, retention, and the portfolio of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.schemas import round_half_up


def by_project():
    return Window.partitionBy("project")


def scan_time(scan_id: Column) -> Column:
    """The moment that a scan's name tells, in either of two forms; null if in neither."""
    return F.coalesce(F.try_to_timestamp(F.when(scan_id.rlike(r"^\d{4}-\d\d-\d\d_\d{6}$"), scan_id), F.lit("yyyy-MM-dd_HHmmss")), F.try_to_timestamp(F.when(scan_id.rlike(r"^\d{8}T\d{6}Z(_.*)?$"), F.substring(scan_id, 1, 15)), F.lit("yyyyMMdd'T'HHmmss")))


def trend(cards: DataFrame) -> DataFrame:
    """Adds previous_score and trend_delta to runs with project, run_id and overall_score."""
    previous = F.lag("overall_score").over(by_project().orderBy("run_id"))
    return cards.withColumn("previous_score", previous).withColumn("trend_delta", round_half_up(F.col("overall_score") - F.col("previous_score"), 2))


def latest(cards: DataFrame) -> DataFrame:
    """Each project's last run, by aggregation: no sort of the history is needed."""
    return cards.groupBy("project").agg(F.max_by(F.struct(*[c for c in cards.columns if c != "project"]), "run_id").alias("r")).select("project", "r.*")


def prune_keep(runs: DataFrame, keep: int) -> DataFrame:
    """Runs to delete so that each project keeps its last ones."""
    if keep < 1:
        raise ValueError("keep must be at least 1")
    return runs.withColumn("__n", F.row_number().over(by_project().orderBy(F.desc("run_id")))).where(F.col("__n") > keep).drop("__n")


def prune_older(runs: DataFrame, now: Column, days: int, at: Column | None = None) -> DataFrame:
    """Runs older than so many days, but never a project's last, nor one whose name tells no time."""
    if days < 1:
        raise ValueError("days must be at least 1")
    time = scan_time(F.col("run_id")) if at is None else at
    last = F.max("run_id").over(by_project())
    return runs.withColumn("__last", last).where((time < now - F.expr(f"interval {days} days")) & (F.col("run_id") != F.col("__last"))).drop("__last")


def portfolio(latest_runs: DataFrame) -> DataFrame:
    """One row over the projects' last runs: counts by policy status and the mean score."""
    return latest_runs.agg(F.count("*").alias("project_count"), *(F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("pass", "warn", "fail")), round_half_up(F.avg("overall_score"), 2).alias("average_score"))


def project_order(latest_runs: DataFrame) -> DataFrame:
    """Projects as the portal lists them: failing first, then by score and name."""
    rank = F.when(F.col("status") == "fail", 0).when(F.col("status") == "warn", 1).when(F.col("status") == "pass", 2).otherwise(3)
    return latest_runs.orderBy(rank, "overall_score", "project")


def local_time(moment: Column, zone: str) -> Column:
    """A moment as a report shows it, in the time of a zone."""
    return F.concat(F.date_format(F.from_utc_timestamp(moment, zone), "yyyy-MM-dd HH:mm"), F.lit(f" {zone}"))


def complete_runs(summary: DataFrame, score: DataFrame, policy: DataFrame, manifest: DataFrame) -> DataFrame:
    """Run history: runs with summary, score and policy, and a manifest if there is one."""
    key = ["project", "run_id"]
    return summary.join(score, key).join(policy, key).join(manifest, key, "left")
