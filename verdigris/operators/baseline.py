"""Accepted findings: what a baseline takes out of a run, and what is wrong with its entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN = ["project", "run_id"]


def states(entries: DataFrame, now: Column, soon_days: int = 14) -> DataFrame:
    """Adds active, expired, expiring_soon, missing_owner to entries (fingerprint, accepted, owner,
    expires_at). An entry without a date never expires; one expires at its very moment."""
    expires = F.col("expires_at")
    expired = F.coalesce(expires <= now, F.lit(False))
    soon = F.coalesce(~expired & (expires <= now + F.expr(f"interval {soon_days} days")), F.lit(False))
    return entries.withColumns({"active": ~expired, "expired": expired, "expiring_soon": soon, "missing_owner": F.col("accepted") & (F.trim(F.coalesce("owner", F.lit(""))) == "")})


def apply(findings: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """The findings that no active accepted entry covers."""
    accepted = states(entries, now).where("active and accepted").select("fingerprint").distinct()
    return findings.join(accepted, "fingerprint", "left_anti")


def stats(findings: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """Nine counters a run, for one baseline over all runs. Findings are first counted by
    fingerprint in the tasks, so a fingerprint that holds many findings is one row in the join."""
    marked = states(entries, now)
    accepted = marked.where("active and accepted").select("fingerprint").distinct()
    counted = findings.groupBy(*RUN, "fingerprint").agg(F.count("*").alias("n"))
    covered = counted.join(accepted.withColumn("hit", F.lit(True)), "fingerprint", "left")
    runs = covered.groupBy(*RUN).agg(F.sum("n").alias("gross_findings"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("accepted_debt"), F.count_if("hit").alias("hits"))
    totals = marked.agg(
        F.count_if("accepted").alias("accepted_entries"), F.count_if("expired").alias("expired_entries"), F.count_if("expiring_soon").alias("expiring_soon_entries"), F.count_if("missing_owner").alias("missing_owner_entries"),
        F.count_distinct(F.when(F.col("active") & F.col("accepted"), F.col("fingerprint"))).alias("active_fingerprints"),
    )
    known = {name: totals.select(name).scalar() for name in totals.columns}
    new = F.col("gross_findings") - F.col("accepted_debt")
    return runs.select(
        *RUN, "gross_findings", "accepted_debt", new.alias("new_findings"), (known["active_fingerprints"] - F.col("hits")).alias("resolved_findings"), new.alias("scored_findings"),
        *(known[name].alias(name) for name in ("accepted_entries", "expired_entries", "expiring_soon_entries", "missing_owner_entries")),
    )


def entries_for(findings: DataFrame, owner: str, note: str, created_at: Column, expires_at: Column) -> DataFrame:
    """A first baseline: one accepted entry for each finding's fingerprint."""
    return findings.select("fingerprint").distinct().select("fingerprint", F.lit(True).alias("accepted"), F.lit(owner).alias("owner"), F.lit(note).alias("note"), created_at.alias("created_at"), expires_at.alias("expires_at"))


def sample(entries: DataFrame, k: int = 5) -> DataFrame:
    """The first entries, as a dry run shows them."""
    return entries.orderBy("fingerprint").limit(k)


def read(spark, path: str) -> DataFrame:
    """Entries of a JSON file that is either a list of them or an object with `entries`."""
    one = "fingerprint string, accepted boolean, owner string, note string, created_at timestamp, expires_at timestamp"
    raw = spark.read.text(path, wholetext=True).select(F.trim("value").alias("value"))
    listed = F.when(F.col("value").startswith("["), F.from_json("value", f"array<struct<{one}>>")).otherwise(F.from_json("value", f"entries array<struct<{one}>>")["entries"])
    return raw.select(F.inline(listed)).withColumn("accepted", F.coalesce("accepted", F.lit(False)))
