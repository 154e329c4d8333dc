"""Security classification of findings: the first rule that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that the classification must share with the reports it is held against.
HARMLESS_LITERALS = ["", '""', "(", ")", "NOT", "AND", "OR"]
DOCUMENTATION_PREFIXES = ["docs/", "documentation/", "designdocuments/", "readme/"]
TOOLING_PREFIXES = ["tools/", "scripts/", "dev/", "maintenance/"]
RUNTIME_PREFIXES = ["src/", "app/", "services/", "api/", "middleware/"]
INTERPOLATION = [r"\{.*input.*\}", r"\{[a-zA-Z_][a-zA-Z0-9_\.]*\}", r"%\s*\w+", r"\.format\(", r"\bf['\"]", r"run\s*\(\s*f['\"]", r"sys\.argv", r"request\.", r"input\("]


def quoted_literal(message: Column) -> Column:
    """The first part in single quotes, else the first in double quotes; null without either."""
    return F.when(message.rlike("'[^']*'"), F.regexp_extract(message, "'([^']*)'", 1)).when(message.rlike('"[^"]*"'), F.regexp_extract(message, '"([^"]*)"', 1))


def starts_with_any(path: Column, prefixes: list[str]) -> Column:
    held = path.startswith(prefixes[0])
    for p in prefixes[1:]:
        held = held | path.startswith(p)
    return held


CLASSES = ["runtime_security", "tooling_security", "test_security", "false_positive", "unknown"]
CONTEXTS = ["runtime", "tool", "test", "config", "dependency", "unknown"]

#: Class, context, impact, weight and reason of each rule, in the order in which rules are tried.
OUTCOMES = [
    ("not_security", "unknown", "none", 1.0, "non_security_category"),
    ("false_positive", "unknown", "none", 0.0, "bandit_b105_token_literal"),
    ("test_security", "test", "low", 0.1, "bandit_b310_test_urlopen"),
    ("test_security", "test", "low", 0.1, "path_test"),
    ("false_positive", "unknown", "none", 0.0, "path_documentation"),
    ("runtime_security", "runtime", "high", 1.0, "bandit_b603_shell_true"),
    ("runtime_security", "runtime", "high", 1.0, "heuristic_interpolated_command"),
    ("tooling_security", "tool", "medium", 0.25, "bandit_b404_tool_subprocess"),
    ("tooling_security", "tool", "medium", 0.25, "bandit_b603_tool_subprocess"),
    ("tooling_security", "tool", "medium", 0.25, "path_tooling"),
    ("runtime_security", "runtime", "high", 1.0, "path_runtime"),
    ("unknown", "unknown", "medium", 1.0, "default_unknown"),
]
TOKEN, SHELL, COMMAND, DEFAULT = 1, 5, 6, 11
ESCALATED = "tooling path escalated due to command execution exploitability signals"


def security_rule(tool: Column, rule_id: Column, category: Column, file: Column, message: Column, raw_payload: Column) -> Column:
    """The place in OUTCOMES of the first rule that holds."""
    path, rule = F.lower(file), F.upper(rule_id)
    text = F.lower(F.concat_ws("\n", message, raw_payload))
    bandit = tool == "bandit"
    is_test = path.startswith("tests/") | path.endswith("smoke_test.py")
    is_doc = path.isin("readme", "readme.md") | starts_with_any(path, DOCUMENTATION_PREFIXES)
    shell = (text.contains("shell=true") | text.contains("shell = true")) & (rule == "B603")
    command = text.contains("os.system(") | text.contains("subprocess.popen(") | text.rlike("|".join(INTERPOLATION))
    in_tooling = F.when(bandit & rule.isin("B404", "B603"), F.when(shell, SHELL).when(command, COMMAND).when(rule == "B404", 7).otherwise(8)).otherwise(9)
    return (
        F.when(category != "security", 0)
        .when(bandit & (rule == "B105") & F.coalesce(quoted_literal(message).isin(HARMLESS_LITERALS), F.lit(False)), TOKEN)
        .when(is_test, F.when(bandit & (rule == "B310"), 2).otherwise(3))
        .when(is_doc, 4)
        .when(starts_with_any(path, TOOLING_PREFIXES), in_tooling)
        .when(starts_with_any(path, RUNTIME_PREFIXES), 10)
        .otherwise(DEFAULT)
    )


def security_outcome(rule: Column, message: Column) -> dict[str, Column]:
    """The columns of a classification by the rule's place in OUTCOMES; the table is one constant."""
    names = ["security_class", "security_context", "security_impact", "score_weight", "classification_reason"]
    out = {name: F.element_at(F.array(*(F.lit(o[k]) for o in OUTCOMES)), rule + 1) for k, name in enumerate(names)}
    detail = F.when(rule == TOKEN, F.concat(F.lit("suspicious literal token: "), quoted_literal(message))).when(rule.isin(SHELL, COMMAND), ESCALATED).when(rule == DEFAULT, "no explicit path/rule heuristic matched")
    return out | {"classification_rule_id": out["classification_reason"], "classification_detail": detail}
