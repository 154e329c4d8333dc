"""Rule-id prefixes that decide severity and category; the longest that fits holds.

A dialect holds its table as a ladder of expressions; a table of any size, such as a loaded file's or
one of a store, is joined to the distinct rules.
"""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the dialects.
RUFF = {
    "severity": {"S": "high", "SEC": "high", "F821": "high", "F823": "high", "F824": "high", "F82": "high", "I": "low", "W": "low", "D": "low", "Q": "low", "COM": "low", "ISC": "low"},
    "category": {"S": "security", "SEC": "security", "F401": "dead_code", "F841": "dead_code", "ERA": "dead_code", "C90": "maintainability", "PLR": "maintainability", "SIM": "maintainability"},
    "default": ("medium", "lint"),
}
OPENGREP = {
    "severity": {"SEC": "high", "S": "high", "JAVA.SEC": "high", "JAVA.INJ": "high", "SPRING.SEC": "high", "SPRING.ACT": "high", "CPLX": "medium", "STYLE": "low"},
    "category": {"SEC": "security", "S": "security", "JAVA.SEC": "security", "JAVA.INJ": "security", "SPRING.SEC": "security", "SPRING.PERSIST": "security", "SPRING.ACT": "security", "SPRING.API": "lint", "SPRING.VAL": "maintainability", "DEAD": "dead_code", "CPLX": "complexity", "MAINT": "maintainability", "TYP": "typing"},
    "default": ("medium", "lint"),
}
OPENGREP_JS = {
    "severity": {"SEC": "high", "INJ": "high", "AUTH": "high", "XSS": "high"},
    "category": {"SEC": "security", "INJ": "security", "AUTH": "security", "XSS": "security", "TS": "typing", "PERF": "maintainability", "DEAD": "dead_code"},
    "default": ("medium", "lint"),
}
OPENGREP_INFRA = {
    "severity": {"INF.SEC": "high", "INF.EXPOSURE": "high", "INF.SECRETS": "high", "INF.ISOLATION": "medium", "INF.IAC": "medium", "INF.SHELL": "low"},
    "category": {"INF.SEC": "security", "INF.EXPOSURE": "security", "INF.SECRETS": "security", "INF.ISOLATION": "maintainability", "INF.IAC": "maintainability", "INF.SHELL": "lint"},
    "default": ("medium", "security"),
}
SPRING = {
    "severity": {"SPRING.SEC": "high", "SPRING.VAL": "medium", "SPRING.PERSIST": "high", "SPRING.API": "medium", "SPRING.ACT": "high"},
    "category": {"SPRING.SEC": "security", "SPRING.VAL": "maintainability", "SPRING.PERSIST": "security", "SPRING.API": "lint", "SPRING.ACT": "security"},
    "posture": {"SPRING.SEC": "security_posture", "SPRING.VAL": "validation_hygiene", "SPRING.PERSIST": "persistence_safety", "SPRING.API": "api_contract_hygiene", "SPRING.ACT": "actuator_exposure"},
    "default": ("medium", "maintainability"),
}
ESLINT = {
    "severity": {"SEC": "high", "XSS": "high", "AUTH": "high", "PERF": "medium", "TS": "medium"},
    "category": {"SEC": "security", "XSS": "security", "AUTH": "security", "TS": "typing", "PERF": "maintainability", "COMPLEX": "complexity", "DEAD": "dead_code"},
    "default": ("medium", "lint"),
}


def longest_prefix(rule: str, table: dict[str, str], default: str | None) -> str:
    """A SQL ladder over prefixes, longest first: a table this small needs no join."""
    if not table:
        return "NULL" if default is None else repr(default)
    steps = " ".join(f"WHEN startswith(upper({rule}), '{p}') THEN '{v}'" for p, v in sorted(table.items(), key=lambda x: -len(x[0])))
    return f"CASE {steps} ELSE {'NULL' if default is None else repr(default)} END"


def load(path: str) -> dict:
    """A mapping from a TOML file: its defaults, and a table of prefixes for each thing mapped."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    defaults = found.pop("defaults", {})
    tables = {name.removesuffix("_prefixes"): {str(k).upper(): str(v) for k, v in table.items()} for name, table in found.items() if name.endswith("_prefixes")}
    return {"severity": {}, "category": {}} | tables | {"default": (defaults.get("severity", "medium"), defaults.get("category", "lint"))}


def table(spark: SparkSession, loaded: dict) -> DataFrame:
    """(thing, prefix, value) of a loaded mapping, the default as the empty prefix."""
    rows = [(thing, prefix, value) for thing, found in loaded.items() if thing != "default" for prefix, value in found.items()]
    rows += [(thing, "", value) for thing, value in zip(("severity", "category"), loaded["default"])]
    return spark.createDataFrame(rows, "thing string, prefix string, value string")


def joined(findings: DataFrame, prefixes: DataFrame, things: list[str], rule: str = "rule_id") -> DataFrame:
    """Adds each thing's value of the longest of its prefixes (thing, prefix, value) that starts the rule,
    in any case of letters; null if none does. Each distinct rule looks its own prefixes up by equality,
    the longest of those found holds, and the findings are joined to that."""
    lengths = F.expr("transform(sequence(0, length(r)), n -> left(r, n))")
    rules = findings.select(F.upper(rule).alias("r")).distinct().where("r IS NOT NULL")
    known = prefixes.select("thing", F.upper("prefix").alias("prefix"), "value")
    hits = rules.select("r", F.explode(lengths).alias("prefix")).join(known, "prefix")
    best = hits.groupBy("r").agg(*(F.max_by(F.when(F.col("thing") == t, F.col("value")), F.when(F.col("thing") == t, F.length("prefix"))).alias(f"__{t}") for t in things))
    kept = [c for c in findings.columns if c not in things]
    return findings.join(best, F.upper(rule) == F.col("r"), "left").select(*kept, *(F.col(f"__{t}").alias(t) for t in things))
