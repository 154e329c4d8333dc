"""Types, enumerations and weights of the findings model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One row a finding. scanner_ord and finding_ord carry the order in which findings were reported.
FINDING = """project string, run_id string, scanner_ord int, finding_ord long, tool string, rule_id string,
severity string, category string, language string, file string, line int, column int, symbol string,
message string, remediation string, confidence double, tags array<string>, raw_payload string"""

# Fixed values of the model.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SCORE_CATEGORIES = ["security", "typing", "lint", "maintainability", "complexity", "dead_code", "coverage"]
PARSER_CATEGORY = "system/parser"
LANGUAGES = ["python", "java", "php", "go", "javascript", "typescript", "general"]

SEVERITY_PENALTY = {"critical": 18.0, "high": 10.0, "medium": 5.0, "low": 2.0, "info": 0.0}
CATEGORY_WEIGHT = {"security": 0.30, "typing": 0.10, "lint": 0.15, "maintainability": 0.15, "complexity": 0.10, "dead_code": 0.10, "coverage": 0.10}
SEVERITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4, "informational": 4}
PRIORITY_SEVERITY = {"critical": 100.0, "high": 40.0, "medium": 10.0, "low": 2.0, "info": 0.5}
DEPENDENCY_TOOLS = ["dependency_check", "spotbugs", "npm_audit", "django_check_deploy", "composer_audit", "govulncheck"]
EXIT_CODES = {"ok": 0, "policy_warn": 1, "policy_fail": 2, "config_error": 3, "scanner_failure": 4, "parser_failure": 5, "internal_error": 6, "interrupted": 7}
#: What a scanner's result may fail with.
SCANNER_ERRORS = ["scanner_contract_violation", "scanner_binary_missing", "scanner_config_error", "scanner_nonzero_exit", "scanner_timeout"]
PARSER_MISSING, PARSE_FAILURES, PATH_INVALID = "scanner_parser_missing", ["scanner_parse_error", "scanner_output_invalid"], "finding_path_invalid"

#: Scanners in the order of registration, which is their scanner_ord.
SCANNERS = [
    "ruff", "pyright", "phpstan", "composer_audit", "phpcs", "opengrep_php", "go_vet", "staticcheck", "govulncheck",
    "go_coverage", "opengrep_go", "coverage", "radon", "vulture", "bandit", "opengrep", "opengrep_infra",
    "dockerfile_scan", "compose_scan", "quadlet_scan", "reverse_proxy_scan", "terraform_scan", "shellcheck",
    "django_check_deploy", "django_settings_scan", "django_template_scan", "django_orm_health", "spotbugs", "pmd",
    "checkstyle", "errorprone", "jacoco", "dependency_check", "opengrep_java", "eslint", "typescript_diagnostics",
    "npm_audit", "js_coverage", "opengrep_js", "gitleaks", "trufflehog", "secrets_heuristic", "git_history_secrets",
]
#: Scanners whose scalar metrics count.
SCALAR_SCANNERS = ["coverage", "radon", "jacoco", "pmd", "js_coverage", "go_coverage", "dockerfile_scan", "compose_scan", "quadlet_scan", "reverse_proxy_scan", "terraform_scan"]

# The scanners that the built-in metric providers name. Go coverage is among the scalars, as
# it counts towards the score here.
FINDING_PROVIDER_SCANNERS = [
    "ruff", "bandit", "pyright", "vulture", "spotbugs", "pmd", "checkstyle", "errorprone", "dependency_check", "opengrep_java", "opengrep_infra", "dockerfile_scan", "compose_scan", "quadlet_scan", "reverse_proxy_scan",
    "terraform_scan", "shellcheck", "django_check_deploy", "django_settings_scan", "django_template_scan", "django_orm_health", "eslint", "typescript_diagnostics", "npm_audit", "opengrep_js", "gitleaks", "trufflehog", "secrets_heuristic", "git_history_secrets",
]
SCALAR_PROVIDER_SCANNERS = SCALAR_SCANNERS


def lookup(key: Column, table: dict, default=None) -> Column:
    """A small fixed table as an expression."""
    found = F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def category_rows() -> Column:
    """The seven score categories as an array of structs."""
    return F.array(*(F.struct(F.lit(i).alias("category_ord"), F.lit(c).alias("category"), F.lit(CATEGORY_WEIGHT[c]).alias("weight")) for i, c in enumerate(SCORE_CATEGORIES)))


def round_half_up(x: Column, digits: int) -> Column:
    """Round a double; values within a billionth of a tie count as the tie and go up."""
    return F.round(x + F.lit(1e-9), digits)
