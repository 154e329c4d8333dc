"""Profiles, scanners and the readers of their reports, as tables that can be added to."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.classify import CLASSES, CONTEXTS, OUTCOMES
from verdigris.operators.findings import VERSION
from verdigris.schemas import PARSER_MISSING, SCALAR_SCANNERS, SCANNERS
from verdigris.sources import mappings, reports
from verdigris.sources.metrics import SCALAR_DIALECTS
from verdigris.sources.reports import DIALECTS, Dialect, Reader


@dataclass(frozen=True)
class Profile:
    """What a kind of project is scanned and reported with."""

    name: str
    scanners: tuple[str, ...]
    metric_providers: tuple[str, ...] = ("scalar", "findings")
    cards: tuple[str, ...] = ("framework_cards",)
    policy_extensions: tuple[str, ...] = ()
    cache_behavior: str = "partial"

    @property
    def parsers(self) -> tuple[str, ...]:
        return tuple(f"{s}_parser" for s in self.scanners)


# The built-in profiles.
PROFILES = [
    Profile("django", ("django_check_deploy", "django_settings_scan", "django_template_scan", "django_orm_health"), ("findings",), policy_extensions=("django_hardening",), cache_behavior="stateless"),
    Profile("go", ("go_vet", "staticcheck", "govulncheck", "go_coverage", "opengrep_go"), cards=("framework_cards", "security_focus"), policy_extensions=("go_vuln_hardening",)),
    Profile("infrastructure", ("opengrep_infra", "dockerfile_scan", "compose_scan", "quadlet_scan", "reverse_proxy_scan", "terraform_scan", "shellcheck"), cards=("container_hardening", "reverse_proxy_posture", "infrastructure_exposure", "secrets_hygiene", "runtime_isolation", "iac_safety", "shell_hygiene"), policy_extensions=("infrastructure_baseline",), cache_behavior="stateless"),
    Profile("java", ("spotbugs", "pmd", "checkstyle", "errorprone", "jacoco", "dependency_check", "opengrep_java"), cards=("java_metrics", "java_cache", "framework_cards"), policy_extensions=("spring_posture",), cache_behavior="aggressive"),
    Profile("javascript", ("eslint", "npm_audit", "js_coverage", "opengrep_js"), policy_extensions=("frontend_supply_chain",)),
    Profile("php", ("phpstan", "composer_audit", "opengrep_php", "phpcs"), cards=("framework_cards", "security_focus"), policy_extensions=("php_supply_chain",)),
    Profile("python", ("ruff", "pyright", "coverage", "radon", "vulture", "bandit", "opengrep"), cards=("metric_cards", "dedupe", "baseline"), cache_behavior="stateless"),
    Profile("secrets", ("secrets_heuristic", "gitleaks", "trufflehog", "git_history_secrets"), ("findings",), cards=("secrets_hygiene",), cache_behavior="stateless"),
    Profile("typescript", ("eslint", "typescript_diagnostics", "npm_audit", "js_coverage", "opengrep_js"), policy_extensions=("frontend_supply_chain", "typescript_strictness")),
]


class DuplicateError(ValueError):
    """A second reader for a scanner that has one."""


@dataclass
class Registry:
    """Profiles by name, and the reader of each scanner: dialects, in one or several forms, or a Python
    function. parse() and outcomes() dispatch to what is registered, built-in or a user's own."""

    profiles: dict[str, Profile] = field(default_factory=dict)
    readers: dict[str, str] = field(default_factory=dict)
    dialects: dict[str, Dialect] = field(default_factory=dict)
    functions: dict[str, Reader] = field(default_factory=dict)

    def add_profile(self, profile: Profile) -> None:
        self.profiles[profile.name] = profile

    def add_reader(self, name: str, *scanners: str, dialects: dict[str, Dialect] | None = None, function: Reader | None = None) -> None:
        """A reader for scanners: dialects by name, each for the scanner that it names as its tool or is
        named after, or a function. Without either, the scanner's output carries no findings."""
        for scanner in scanners:
            if scanner in self.readers:
                raise DuplicateError(f"{scanner} is read by {self.readers[scanner]} already")
        stray = {d.tool or n for n, d in (dialects or {}).items()} - set(scanners)
        if stray:
            raise ValueError(f"{name} has dialects of {sorted(stray)}, which it is not registered for")
        self.readers |= {scanner: name for scanner in scanners}
        self.dialects |= dialects or {}
        if function:
            self.functions |= {scanner: function for scanner in scanners}

    def use_mapping(self, dialect: str, path: str) -> None:
        """Has a dialect go by the prefixes of a TOML file from now on."""
        self.dialects[dialect] = reports.with_mapping(self.dialects[dialect], mappings.load(path))

    def reader(self, scanner: str) -> str:
        """The reader of a scanner, or the name that one would have."""
        return self.readers.get(scanner, f"{scanner}_parser")

    def unread(self, scanners: list[str]) -> list[str]:
        """The scanners, in order, whose reports nothing reads."""
        return [s for s in scanners if s not in self.readers]

    def parse(self, found: DataFrame) -> DataFrame:
        """Findings of reports by the registered readers, and a parser finding for each unsound report."""
        return reports.parse_all(found, dialects=self.dialects, functions=self.functions)


def builtin() -> Registry:
    """The registry of all that the engine brings."""
    made = Registry()
    for profile in PROFILES:
        made.add_profile(profile)
    for tool in dict.fromkeys([*(d.tool or name for name, d in DIALECTS.items()), *SCALAR_DIALECTS]):
        made.add_reader(f"{tool}_parser", tool, dialects={name: d for name, d in DIALECTS.items() if (d.tool or name) == tool})
    return made


def reader_rows(spark: SparkSession, registry: Registry) -> DataFrame:
    """(tool, reader) of all that is registered."""
    return spark.createDataFrame(sorted(registry.readers.items()), "tool string, reader string")


def outcomes(found: DataFrame, registry: Registry) -> DataFrame:
    """The result of reading each report (project, run_id, tool): success, error_code, how many findings
    it gave and whether it was unsound, the reader it has or would have, and what to do if it has none."""
    rows = reports.entries_of(found, registry.dialects, registry.functions).groupBy("project", "run_id", "tool").agg(F.count("*").alias("n"), F.max("problem").alias("problem"))
    every = found.select("project", "run_id", "tool").distinct().join(reader_rows(found.sparkSession, registry), "tool", "left").join(rows, ["project", "run_id", "tool"], "left")
    unread, bad = F.col("reader").isNull(), F.col("problem").isNotNull()
    expected = F.coalesce("reader", F.concat("tool", F.lit("_parser")))
    return every.select(
        "project", "run_id", "tool", (~unread).alias("success"), F.when(unread, PARSER_MISSING).alias("error_code"), F.when(unread, 0).when(bad, 1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("finding_count"),
        F.when(bad & ~unread, 1).otherwise(0).cast("long").alias("invalid_finding_count"), F.col("problem"), expected.alias("expected_parser"), F.when(unread, F.format_string("Register parser '%s' for scanner '%s'.", expected, F.col("tool"))).alias("remediation"),
    )


def conflicts(registrations: DataFrame) -> DataFrame:
    """(tool, reader, registered): registrations (tool, reader, place) that come after another reader of
    their scanner, with the one that holds it."""
    first = registrations.groupBy("tool").agg(F.min_by("reader", "place").alias("registered"))
    return registrations.join(first, "tool").where(F.col("reader") != F.col("registered")).select("tool", "reader", "registered")


def profile_rows(spark: SparkSession, registry: Registry | None = None) -> DataFrame:
    """The profiles as a table, in order of their names."""
    found = registry or builtin()
    rows = [(p.name, list(p.scanners), list(p.parsers), list(p.metric_providers), list(p.cards), list(p.policy_extensions), p.cache_behavior) for _, p in sorted(found.profiles.items())]
    return spark.createDataFrame(rows, "name string, scanners array<string>, parsers array<string>, metric_providers array<string>, cards array<string>, policy_extensions array<string>, cache_behavior string")


def project_profiles(named: DataFrame, registry: Registry | None = None) -> DataFrame:
    """The profile blocks of projects (project, name); a name without a profile has none."""
    return named.join(profile_rows(named.sparkSession, registry), "name").select("project", "name", "scanners", "parsers", "metric_providers", "cards", "policy_extensions", "cache_behavior")


def scanner_rows(spark: SparkSession, registry: Registry | None = None) -> DataFrame:
    """The scanners with their order, reader, whether there is one, and whether their scalars count."""
    found = registry or builtin()
    return spark.createDataFrame([(i, s, found.reader(s), s in found.readers, s in SCALAR_SCANNERS) for i, s in enumerate(SCANNERS)], "scanner_ord int, scanner string, reader string, is_read boolean, has_scalars boolean")


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """What is asked for by name and is not there."""
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti")


def contract() -> dict:
    """The enumerations that a classification may hold, as they are exported."""
    return {"classifier_name": "verdigris", "classifier_version": VERSION, "reason_codes": [o[4] for o in OUTCOMES], "security_classes": CLASSES, "security_contexts": CONTEXTS}


def export_contract(path: str) -> None:
    """The contract as a JSON file."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(contract(), f, indent=2)
        f.write("\n")


def with_order(findings: DataFrame) -> DataFrame:
    """Findings with the order of their scanner; unknown ones come last."""
    place = F.create_map(*(x for i, s in enumerate(SCANNERS) for x in (F.lit(s), F.lit(i))))
    return findings.withColumn("scanner_ord", F.coalesce(F.element_at(place, F.col("tool")), F.lit(len(SCANNERS))))
