"""Row operators and de-duplication of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.functions.classify import security_outcome, security_rule
from verdigris.operators.ordered import ranks, sums_before
from verdigris.schemas import PARSER_CATEGORY, SEVERITY_RANK, lookup

VERSION = "1"


def normalize(findings: DataFrame) -> DataFrame:
    """Adds what a published finding carries: normal message, identity, ownership, native severity.

    The normal message and the identity are columns of projections of their own, which the
    optimizer does not merge into the next: each is computed once."""
    c = F.col
    owner = text.ownership(c("file"))
    parts = findings.withColumn("normalized_message", text.normalize_message(c("message")))
    return parts.withColumn("__identity", text.identity(c("symbol"), c("normalized_message"), c("raw_payload"))).withColumns(
        {
            "native_severity": F.coalesce(F.get_json_object("raw_payload", "$.native_severity"), c("severity")),
            "fingerprint": text.fingerprint(c("tool"), c("rule_id"), c("file"), c("__identity")),
            "dedupe_key": text.fingerprint(F.lit("_"), c("rule_id"), c("file"), c("__identity")),
            "ownership": owner["ownership"],
            "ownership_confidence": owner["ownership_confidence"],
            "fingerprint_version": F.lit(VERSION),
            "message_normalizer_version": F.lit(VERSION),
        }
    ).drop("__identity")


def classify(findings: DataFrame) -> DataFrame:
    """Adds class, context, impact, weight and reason of security findings."""
    c = F.col
    ruled = findings.withColumn("__rule", security_rule(c("tool"), c("rule_id"), c("category"), c("file"), c("message"), c("raw_payload")))
    return ruled.withColumns(security_outcome(c("__rule"), c("message"))).drop("__rule")


def dedupe(findings: DataFrame, run: list[str] = ["project", "run_id"]) -> DataFrame:
    """Adds kept and duplicate_of to normalised findings.

    The first finding of a dedupe key in a run decides: those of its tool stay, those of other
    tools are its duplicates. The first is found by an aggregate that adds up map-side and is
    joined back, so a key that holds much of a run needs no task of its own. The least number of each
    key's tool is found before: by hashing, whereas Spark sorts what it takes a least struct of.
    """
    least = findings.groupBy(*run, "dedupe_key", "scanner_ord", "tool", "fingerprint").agg(F.min("finding_ord").alias("finding_ord"))
    order = [F.col(x) for x in ("scanner_ord", "finding_ord", "tool", "fingerprint")]
    first = least.groupBy(*run, "dedupe_key").agg(F.min(F.struct(*order)).alias("__first"))
    same = F.col("__first.tool") == F.col("tool")
    joined = findings.join(first, [*run, "dedupe_key"])
    return joined.select(*findings.columns, same.alias("kept"), F.when(~same, F.col("__first.fingerprint")).alias("duplicate_of"))


#: What dedupe, baseline and score know a finding by, besides its place in the report.
SCORED = ["project", "run_id", "scanner_ord", "tool", "category", "severity", "score_weight", "fingerprint", "dedupe_key"]


def counted(findings: DataFrame, by: list[str] = SCORED) -> DataFrame:
    """Classified findings that agree in all that is scored as one row, with the least number and `alike`,
    how many they are. Keys are moved as bytes, which are half as long as their digits."""
    return findings.withColumns({x: F.unhex(x) for x in ("fingerprint", "dedupe_key")}).groupBy(*by).agg(F.min("finding_ord").alias("finding_ord"), F.count("*").alias("alike"))


def told(found: DataFrame, run: list[str] = ["project", "run_id"]) -> DataFrame:
    """Adds `kept` to counted findings, as dedupe() does. A key has few of these, one for each tool and what
    else they are counted by, however many findings it has, so a window finds its first."""
    first = F.first("tool").over(Window.partitionBy(*run, "dedupe_key").orderBy("scanner_ord", "finding_ord", "tool", "fingerprint"))
    return found.withColumn("kept", first == F.col("tool"))


def kept(found: DataFrame, run: list[str] = ["project", "run_id"]) -> DataFrame:
    """What dedupe() keeps of counted findings."""
    return told(found, run).where("kept").drop("kept")


def dedupe_summary(deduped: DataFrame) -> DataFrame:
    """Findings, suppressed and net of each project, run and tool."""
    return deduped.groupBy("project", "run_id", "tool").agg(F.count("*").alias("total_findings"), F.count_if(~F.col("kept")).alias("suppressed_count"), F.count_if("kept").alias("net_findings"))


def payload_budget(findings: DataFrame, *, per_finding: int = 16_384, per_run: int = 10_485_760, order: list[str] | None = None) -> DataFrame:
    """Adds payload_bytes, payload_used and payload_truncated: findings draw on their run's budget in
    the order of the report, each within its own limit. The order has to tell a run's findings apart;
    what the findings before have drawn is a running sum in two levels, so no task holds a run."""
    size = F.octet_length("raw_payload").cast("long")
    drawn = sums_before(findings, ["project", "run_id"], order or ["scanner_ord", "finding_ord"], F.least(size, F.lit(per_finding)), "__drawn")
    allowed = F.least(F.lit(per_finding), F.greatest(F.lit(0), F.lit(per_run) - F.col("__drawn")))
    return drawn.withColumns({"payload_bytes": size, "__allowed": allowed}).withColumns({"payload_used": F.least("payload_bytes", "__allowed"), "payload_truncated": F.col("payload_bytes") > F.col("__allowed")}).drop("__allowed", "__drawn")


def publishing() -> list:
    """What findings are put in order by where they are published."""
    return [lookup(F.col("severity"), SEVERITY_RANK, 5), "category", "file", "rule_id", "fingerprint"]


def published_places(findings: DataFrame) -> DataFrame:
    """Adds each finding's place in the published order of its run; findings that agree share one."""
    return ranks(findings, ["project", "run_id"], publishing(), "place")


def published_order(findings: DataFrame) -> DataFrame:
    """Findings in the order in which they are published."""
    return findings.orderBy(*publishing())


#: What tells the scanner runs of a report apart.
PARSED = ["project", "run_id", "scanner_ord"]


def unsound_runs(rows: DataFrame) -> DataFrame:
    """(project, run_id, scanner_ord, problem) of scanner runs with any bad row."""
    return rows.where("problem is not null").groupBy(*PARSED).agg(F.max("problem").alias("problem"))


def parser_failures(runs: DataFrame, rows: DataFrame, bad: DataFrame | None = None) -> DataFrame:
    """Findings of scanner runs, all or nothing: a run with any bad row gets one parser finding.

    runs: (project, run_id, scanner_ord, tool); rows: findings with `problem`, null if sound; bad: their
    unsound_runs(), if these are known.
    """
    key = PARSED
    bad = unsound_runs(rows) if bad is None else bad
    sound = rows.join(bad.select(*key), key, "left_anti").drop("problem")
    made = runs.join(bad, key).select(
        *key, F.lit(0).cast("long").alias("finding_ord"), F.lit("verdigris").alias("tool"), F.concat(F.lit("PARSER."), "problem").alias("rule_id"), F.lit("medium").alias("severity"),
        F.lit(PARSER_CATEGORY).alias("category"), F.lit("general").alias("language"), F.concat(F.lit("scanners/"), "tool").alias("file"), F.col("tool").alias("symbol"),
        F.concat(F.lit("output of "), "tool", F.lit(" could not be read")).alias("message"), F.lit("Inspect scanner parser output and adapter contract.").alias("remediation"), F.lit(1.0).alias("confidence"), F.array(F.lit("system"), F.lit("parser")).alias("tags"),
    )
    return sound.unionByName(made, allowMissingColumns=True)
