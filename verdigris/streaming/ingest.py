"""Findings from a stream of reports: an extension, as batch runs need no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.findings import classify, normalize
from verdigris.sources.reports import DIALECTS, REPORT, parse

ARRIVAL = f"{REPORT}, arrived timestamp"


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """Reports as JSON lines that land in a folder."""
    return spark.readStream.schema(ARRIVAL).json(folder)


def findings(landed: DataFrame, tools: list[str], late: str = "1 hour") -> DataFrame:
    """Classified findings of sound entries, each fingerprint of a run once within the watermark."""
    known = {name: d for name, d in DIALECTS.items() if (d.tool or name) in tools}
    parts = parse(landed, known, ["project", "run_id", "arrived"]).where("problem is null").drop("problem")
    rows = classify(normalize(parts)).withWatermark("arrived", late)
    return rows.dropDuplicatesWithinWatermark(["project", "run_id", "fingerprint"])


def counts(rows: DataFrame, width: str = "10 minutes") -> DataFrame:
    """Findings by project, severity and time."""
    return rows.groupBy(F.window("arrived", width), "project", "severity").count()


def to_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a Parquet table, once each, until what has landed is taken in."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("project").trigger(availableNow=True).start()
