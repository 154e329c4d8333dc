"""Run artifacts: tables of runs under manifests as the store, and JSON documents as exports."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from verdigris.operators import history
from verdigris.sources.work import moved

#: The version of what a run's artifacts hold.
SCHEMA_VERSION = "1"

RUN = ["project", "run_id"]


def publish(tables: dict[str, DataFrame], store: str, commit: str | None = None) -> str:
    """Adds runs to a store: the tables' files first, then a manifest of their runs, which is moved into
    place. Rows are dealt by run before they are written, so a run has a file or a few, not one of each
    task; a run that is large is split. Readers go by manifests only, so a commit is seen whole or not at all, whenever it ends; a
    run that is published again is replaced by the later commit, by name. Gives the commit's name."""
    spark, store = next(iter(tables.values())).sparkSession, store.rstrip("/")
    commit = commit or f"c{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    written = {}
    for name, rows in tables.items():
        path = f"{store}/data/{name}/commit={commit}"
        rows.hint("rebalance", *RUN).write.partitionBy(*RUN).parquet(path)
        written[name] = spark.read.schema(rows.schema).parquet(path)
    manifest_rows(written).write.parquet(f"{store}/staged/{commit}")
    moved(spark, f"{store}/staged/{commit}", f"{store}/manifests/commit={commit}")
    return commit


def manifest_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """One row a run: when it was made, what its tables hold, and of the tables scores and findings, if
    there, the score, the grade and the findings of four severities."""
    counted = None
    for name, rows in tables.items():
        part = rows.groupBy(*RUN).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(c for c in rows.columns if c not in RUN)).cast("decimal(38,0)")).cast("string").alias("digest")).withColumn("name", F.lit(name))
        counted = part if counted is None else counted.unionByName(part)
    runs = counted.groupBy(*RUN).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", F.struct(F.col("n").alias("rows"), "digest"))))).alias("tables"))
    if "scores" in tables:
        runs = runs.join(tables["scores"].select(*RUN, F.col("overall_score").alias("score"), "grade"), RUN, "left")
    if "findings" in tables:
        severities = ["critical", "high", "medium", "low"]
        runs = runs.join(tables["findings"].groupBy(*RUN).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in severities)), RUN, "left").fillna(0, severities)
    return runs.withColumns({"generated_at": F.current_timestamp(), "report_path": F.concat(F.lit("projects/"), "project", F.lit("/runs/"), "run_id", F.lit("/report.html")), "schema_version": F.lit(SCHEMA_VERSION)})


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """A partitioned table, its partition columns as the texts that they were written as."""
    found = spark.read.parquet(path).schema
    for field in found:
        if field.name in ("commit", *RUN):
            field.dataType = StringType()
    return spark.read.schema(found).parquet(path)


def manifests(spark: SparkSession, store: str) -> DataFrame:
    """The manifest of each run: the last that was committed."""
    rows = read_partitioned(spark, f"{store.rstrip('/')}/manifests")
    return rows.groupBy(*RUN).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in RUN]), "commit").alias("m")).select(*RUN, "m.*")


def load(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A stored table's committed rows; filters on project and run_id prune partitions."""
    rows = read_partitioned(spark, f"{store.rstrip('/')}/data/{name}")
    return rows.join(manifests(spark, store).select(*RUN, "commit"), [*RUN, "commit"], "left_semi").drop("commit")


def verified(spark: SparkSession, store: str) -> DataFrame:
    """(project, run_id, name, told, found): tables of committed runs whose rows are not those that the
    manifest tells."""
    told = manifests(spark, store).select(*RUN, "commit", F.explode("tables").alias("name", "t")).select(*RUN, "name", "t")
    names = [r["name"] for r in told.select("name").distinct().collect()]
    found = None
    for name in names:
        rows = load(spark, store, name)
        part = rows.groupBy(*RUN).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*sorted(c for c in rows.columns if c not in RUN)).cast("decimal(38,0)")).cast("string").alias("digest")).withColumn("name", F.lit(name))
        found = part if found is None else found.unionByName(part)
    both = told.join(found, [*RUN, "name"], "left")
    return both.where(~(F.col("t.rows").eqNullSafe(F.col("n")) & F.col("t.digest").eqNullSafe(F.col("digest")))).select(*RUN, "name", F.col("t.rows").alias("told"), F.col("n").alias("found"))


def runs(spark: SparkSession, store: str) -> DataFrame:
    """History of the runs that have score and policy, with their manifests' counts."""
    return load(spark, store, "scores").join(load(spark, store, "policies").select(*RUN, "status", "reasons"), RUN)


def latest(spark: SparkSession, store: str) -> DataFrame:
    """The view that a `latest` pointer gives."""
    return history.latest(runs(spark, store))


def export_json(rows: DataFrame, path: str) -> None:
    """One JSON line a row, keys in the order of the columns."""
    rows.write.mode("overwrite").json(path)


def digests(summaries: DataFrame, findings: DataFrame) -> DataFrame:
    """(project, run_id, report_sha256): a digest of each run's summary and findings.

    Each finding gives a digest of its JSON; the sorted digests of a run are digested in blocks by
    their first two digits, so no task holds more than a 256th of a run."""
    rows = findings.select(*RUN, F.sha2(F.to_json(F.struct(*sorted(c for c in findings.columns if c not in RUN))), 256).alias("d"))
    joined = lambda x: F.sha2(F.array_join(F.array_sort(F.collect_list(x)), "\n"), 256)
    blocks = rows.groupBy(*RUN, F.substring("d", 1, 2).alias("block")).agg(joined("d").alias("d"))
    whole = blocks.groupBy(*RUN).agg(joined(F.concat_ws(":", "block", "d")).alias("d"))
    told = summaries.select(*RUN, F.to_json(F.struct(*sorted(c for c in summaries.columns if c not in RUN))).alias("summary"))
    return told.join(whole, RUN, "left").select(*RUN, F.sha2(F.concat_ws("\n", "summary", F.coalesce("d", F.lit(""))), 256).alias("report_sha256"))


def allocate(run_id: str, taken: set[str]) -> str:
    """The run's name, with a numbered suffix if it is taken."""
    if run_id not in taken:
        return run_id
    n = 1
    while f"{run_id}_{n:02d}" in taken:
        n += 1
    return f"{run_id}_{n:02d}"
