"""Counters and sections of findings about secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.operators.baseline import states

RUN = ["project", "run_id"]
# The rules that each section of the report counts.
SECTIONS = {
    "historical_secret_exposure": ["historical_secret_exposure"],
    "key_material_exposure": ["private_key_material", "certificate_material"],
    "credential_management": ["credential_hardcoding", "weak_secret_management"],
}


def is_real(raw_payload: Column) -> Column:
    """Whether a payload marks its secret as real: a value that is there and neither false nor empty."""
    value = F.get_json_object(raw_payload, "$.secret_real")
    return F.coalesce(~value.isin("false", "", "0", "0.0", "[]", "{}"), F.lit(False))


def counters(deduped: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """One row a run of normalised findings with `kept`: secrets that dedupe and baseline leave, real
    secrets that the baseline accepts, and the sections, which count every finding.

    Findings are first counted by fingerprint in the tasks, so a fingerprint that holds many is
    one row in the join with the baseline."""
    counted = deduped.groupBy(*RUN, "fingerprint", "kept", "rule_id", is_real(F.col("raw_payload")).alias("real")).agg(F.count("*").alias("n"))
    return of_counted(counted, entries, now)


def of_counted(counted: DataFrame, entries: DataFrame, now: Column) -> DataFrame:
    """counters() of findings (project, run_id, fingerprint, kept, rule_id, real, n), n being how many they are."""
    active = states(entries, now).where("active and accepted").select("fingerprint").distinct().withColumn("covered", F.lit(True))
    c, of = F.col, lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0))
    rows = counted.join(active, "fingerprint", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    left = c("kept") & ~c("covered")
    real = of(left & c("real"))
    return rows.groupBy(*RUN).agg(
        real.alias("real_secret_findings"),
        of(left & (c("rule_id") == "private_key_material")).alias("private_key_findings"),
        of(left & (c("rule_id") == "probable_secret_exposure")).alias("probable_secret_findings"),
        of(c("kept") & c("covered") & c("real")).alias("baseline_real_secret_entries"),
        real.alias("secrets_hygiene"),
        *(of(c("rule_id").isin(rules)).alias(name) for name, rules in SECTIONS.items()),
    )
