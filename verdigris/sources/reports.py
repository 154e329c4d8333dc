"""Scanner reports in their own dialects, read into findings.

A report is one row: (project, run_id, tool, stdout, stderr, root). A dialect says where its
entries are and how each field follows from an entry, in SQL over VARIANT; so a wrong type shows
as itself instead of as null. A report with any unsound entry yields one parser finding and
nothing else (see operators.findings.parser_failures). Report files come in by whole-text reads.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from verdigris.operators.findings import PARSED, parser_failures, unsound_runs
from verdigris.schemas import SCANNERS
from verdigris.sources import mappings as M
from verdigris.sources.work import written

#: A reader of one's own: (stdout, stderr, root) -> findings as dictionaries.
Reader = Callable[[str, str, str], Iterable[dict]]

REPORT = "project string, run_id string, tool string, stdout string, stderr string, root string"


def s(path: str, of: str = "r") -> str:
    """SQL: a text that is not empty. It is looked up once, whereas nullif() does so twice."""
    return f"get(filter(array(try_variant_get({of}, '{path}', 'string')), t -> t <> ''), 0)"


def n(path: str, of: str = "r") -> str:
    return f"try_variant_get({of}, '{path}', 'int')"


def items(path: str, of: str = "doc") -> str:
    return f"try_variant_get({of}, '{path}', 'array<variant>')"


def entries(path: str, of: str = "doc") -> str:
    """Entries of an object as variants {k, v}, in the order of keys."""
    return f"transform(array_sort(map_entries(try_variant_get({of}, '{path}', 'map<string,variant>')), (x, y) -> if(x.key < y.key, -1, if(x.key > y.key, 1, 0))), x -> to_variant_object(named_struct('k', x.key, 'v', x.value)))"


def severity_of(x: str, table: dict[str, str], default: str) -> str:
    return f"coalesce(element_at(map({', '.join(f"'{k}', '{v}'" for k, v in table.items())}), lower(trim({x}))), '{default}')"


TEXT_SEVERITY = {"critical": "critical", "high": "high", "low": "low", "info": "info"}
AUDIT_SEVERITY = {"critical": "critical", "high": "high", "moderate": "medium", "medium": "medium", "low": "low", "info": "info"}


@dataclass(frozen=True)
class Dialect:
    rows: str
    file: str
    rule: str
    message: str
    line: str = "cast(null as int)"
    column: str = "cast(null as int)"
    severity: str = "'medium'"
    category: str = "'security'"
    language: str = "'general'"
    confidence: str = "1.0D"
    tags: str = "cast(array() as array<string>)"
    payload: str = "to_json(r)"
    #: Which form the report has: json, lines (of JSON), xml (with its schema), text.
    form: str = "json"
    schema: str = ""
    #: Paths that must be whole numbers, if there at all; texts that must be there.
    whole: tuple[str, ...] = ()
    needed: tuple[str, ...] = ()
    #: Whether the entries must be there, and whether a bad line spoils a report in lines.
    required: bool = False
    strict: bool = False
    tool: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


def sarif(rule_default: str, severity: str, category: str, language: str, tags: str | None = None) -> Dialect:
    place = "$.locations[0].physicalLocation"
    return Dialect(
        rows=f"flatten(transform({items('$.runs')}, x -> coalesce(try_variant_get(x, '$.results', 'array<variant>'), array())))", required=True, file=s(f"{place}.artifactLocation.uri"),
        rule=f"coalesce({s('$.ruleId')}, '{rule_default}')", message=f"coalesce({s('$.message.text')}, {s('$.message.markdown')}, '')", line=n(f"{place}.region.startLine"), column=n(f"{place}.region.startColumn"),
        severity=severity, category=category, language=language, whole=(f"{place}.region.startLine", f"{place}.region.startColumn"), tags=tags or "cast(array() as array<string>)",
    )


def mapped(table: dict) -> dict[str, str]:
    """Severity and category of an entry by its rule, which the other fields know as rule_id."""
    return {"severity": M.longest_prefix("rule_id", table["severity"], table["default"][0]), "category": M.longest_prefix("rule_id", table["category"], table["default"][1])}


def with_mapping(d: Dialect, table: dict) -> Dialect:
    """A dialect whose severities and categories follow from a table of prefixes, as mappings.load()
    gives it; where that names posture, so do its tags."""
    posture = {"tags": f"array_compact(array({M.longest_prefix('rule_id', table['posture'], None)}))"} if table.get("posture") else {}
    return replace(d, **mapped(table), **posture)


def listed(category: str, language: str, rows: str = items("$.findings")) -> Dialect:
    """Rule hits {rule_id, file, line, message, severity} of the built-in text rules."""
    return Dialect(rows, s("$.file"), s("$.rule_id"), s("$.message"), n("$.line"), severity=severity_of(s("$.severity"), TEXT_SEVERITY, "medium"), category=f"'{category}'", language=f"'{language}'", whole=("$.line",), needed=("$.rule_id", "$.file", "$.message"))


def lines_of(pattern: str, names: list[str], source: str = "stdout") -> str:
    """Lines that a pattern matches, as variants with a text for each group."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    groups = ", ".join(f"'{name}', regexp_extract(l, '{p}', {i + 1})" for i, name in enumerate(names))
    return f"transform(filter(split({source}, '\\\\r?\\\\n'), l -> l rlike '{p}'), l -> to_variant_object(named_struct({groups})))"


SUFFIX = "CASE WHEN lower(r_file) rlike '[.]tsx?$' THEN 'typescript' ELSE 'javascript' END"
CODE = s("$.code")
BOTH = "concat_ws('\\n', stdout, stderr)"
ERRORPRONE_TEXT = lines_of(r"(?i)^\s*([^\s:]+\.java):(\d+):\s*(warning|error):\s*(.+?)(?:\s+\[([^\]]+)\])?$", ["file", "line", "severity", "message", "rule"], "concat_ws('\\n', stdout, stderr)")
TSC_TEXT = f"concat({lines_of(r'^(.+?)\((\d+),(\d+)\):\s*error\s*(TS\d+):\s*(.+)$', ['file', 'line', 'column', 'code', 'message'], BOTH)}, {lines_of(r'(?i)^error\s+(TS\d+):\s*(.+?)\s+at\s+(.+?):(\d+):(\d+)$', ['code', 'message', 'file', 'line', 'column'], BOTH)})"
DJANGO_TEXT = "split(concat_ws('\\n', try_variant_get(doc, '$.stdout', 'string'), try_variant_get(doc, '$.stderr', 'string')), '\\n')"
FILE_MESSAGES = f"flatten(transform({entries('$.files')}, f -> transform(coalesce(try_variant_get(f, '$.v.messages', 'array<variant>'), array()), m -> to_variant_object(named_struct('k', variant_get(f, '$.k', 'variant'), 'v', m)))))"
NESTED = lambda outer, inner, key: f"flatten(transform({outer}, f -> transform(coalesce(try_variant_get(f, '{inner}', 'array<variant>'), array()), m -> to_variant_object(named_struct('k', try_variant_get(f, '{key}', 'variant'), 'v', m)))))"
PMD_CATEGORY = "CASE WHEN lower({0}) LIKE '%security%' THEN 'security' WHEN lower({0}) LIKE '%unused%' THEN 'dead_code' WHEN lower({0}) LIKE '%cyclo%' OR lower({0}) LIKE '%complexity%' THEN 'complexity' WHEN lower({0}) LIKE '%design%' OR lower({0}) LIKE '%simplify%' THEN 'maintainability' ELSE 'lint' END"
AUDIT = "doc2"
ESLINT_LEVEL = M.longest_prefix("rule_id", M.ESLINT["severity"], "medium")
SECRET = f"upper(coalesce({s('$.RuleID')}, {s('$.rule')}, ''))"
VERIFIED = "coalesce(try_variant_get(r, '$.Verified', 'boolean'), false)"

DIALECTS: dict[str, Dialect] = {
    "ruff": Dialect(items("$"), s("$.filename"), CODE, s("$.message"), n("$.location.row"), n("$.location.column"), **mapped(M.RUFF), language="'python'", required=True, whole=("$.location.row", "$.location.column"), needed=("$.filename", "$.code", "$.message")),
    "pyright": Dialect(
        items("$.generalDiagnostics"), s("$.file"), f"coalesce({s('$.rule')}, 'pyright')", s("$.message"), n("$.range.start.line") + " + 1", n("$.range.start.character") + " + 1", required=True, language="'python'", needed=("$.file", "$.message"),
        severity=severity_of(s("$.severity"), {"error": "high", "warning": "medium", "information": "info", "info": "info"}, "low"), category=f"CASE WHEN lower({s('$.rule')}) LIKE '%import%' THEN 'typing' WHEN lower({s('$.rule')}) LIKE '%unused%' THEN 'dead_code' ELSE 'typing' END",
    ),
    "phpstan": Dialect(FILE_MESSAGES, s("$.k"), f"upper(coalesce({s('$.v.identifier')}, 'PHPSTAN.GENERIC'))", s("$.v.message"), f"coalesce({n('$.v.line')}, 1)", category="'maintainability'", language="'php'", payload="to_json(variant_get(r, '$.v', 'variant'))"),
    "composer_audit": Dialect(
        f"CASE WHEN {items('$.advisories')} IS NOT NULL THEN {items('$.advisories')} ELSE flatten(transform(map_values(try_variant_get(doc, '$.advisories', 'map<string,variant>')), v -> coalesce(try_variant_get(v, '$', 'array<variant>'), array(v)))) END", "'composer.lock'",
        f"concat('COMPOSER.AUDIT.', coalesce({s('$.cve')}, {s('$.advisoryId')}, 'UNKNOWN'))", f"coalesce({s('$.title')}, concat('Vulnerability in ', coalesce({s('$.packageName')}, {s('$.package')}, 'unknown')))", "1", language="'php'",
        severity=f"CASE WHEN lower(coalesce({s('$.severity')}, {s('$.cvss')}, 'medium')) LIKE '%critical%' THEN 'critical' WHEN lower(coalesce({s('$.severity')}, {s('$.cvss')}, 'medium')) LIKE '%high%' THEN 'high' WHEN lower(coalesce({s('$.severity')}, {s('$.cvss')}, 'medium')) LIKE '%low%' THEN 'low' ELSE 'medium' END",
    ),
    "phpcs": Dialect(FILE_MESSAGES, s("$.k"), f"coalesce({s('$.v.source')}, 'PHPCS.GENERIC')", s("$.v.message"), f"coalesce({n('$.v.line')}, 1)", n("$.v.column"), severity=f"CASE WHEN lower(coalesce({s('$.v.type')}, 'warning')) = 'warning' THEN 'medium' ELSE 'high' END", category="'lint'", language="'php'", payload="to_json(variant_get(r, '$.v', 'variant'))"),
    "opengrep_php": sarif("OPENGREP_PHP", f"CASE WHEN upper(rule_id) LIKE 'SEC%' OR upper(rule_id) LIKE '%SQL%' THEN 'high' WHEN upper(rule_id) LIKE 'STYLE%' THEN 'low' ELSE 'medium' END", f"CASE WHEN upper(rule_id) LIKE 'SEC%' OR upper(rule_id) LIKE '%XSS%' OR upper(rule_id) LIKE '%SQL%' THEN 'security' WHEN upper(rule_id) LIKE 'DEAD%' THEN 'dead_code' ELSE 'maintainability' END", "'php'"),
    "go_vet": Dialect(lines_of(r"^([^:]*\.go):(\d+):(\d+):\s*(.*?)\s*$", ["file", "line", "column", "message"], BOTH), s("$.file"), "'GO.VET'", s("$.message"), n("$.line"), n("$.column"), category="'maintainability'", language="'go'", form="text"),
    "staticcheck": Dialect("lines", s("$.location.file"), f"concat('STATICCHECK.', coalesce({s('$.code')}, 'STATICCHECK'))", f"coalesce({s('$.message')}, 'Staticcheck issue')", f"coalesce({n('$.location.line')}, 1)", n("$.location.column"), category="'maintainability'", language="'go'", form="lines"),
    "govulncheck": Dialect("filter(lines, x -> try_variant_get(x, '$.vuln', 'variant') IS NOT NULL)", "'go.mod'", f"concat('GOVULNCHECK.', upper(coalesce({s('$.vuln.osv')}, 'UNKNOWN')))", f"coalesce({s('$.vuln.summary')}, 'Go vulnerability detected')", "1", severity="'high'", language="'go'", form="lines"),
    "opengrep_go": sarif("OPENGREP_GO", "'medium'", "'maintainability'", "'go'"),
    "vulture": Dialect(items("$"), s("$.filename"), "'VULTURE_UNUSED'", f"concat('Unused ', coalesce({s('$.type')}, {s('$.typ')}, 'symbol'), ': ', coalesce({s('$.name')}, '<unknown>'), coalesce(concat(' (size=', {s('$.size')}, ')'), ''))", n("$.first_line"), severity="'low'", category="'dead_code'", language="'python'", required=True, needed=("$.filename",), whole=("$.first_line",)),
    "bandit": Dialect(items("$.results"), s("$.filename"), s("$.test_id"), s("$.issue_text"), n("$.line_number"), severity=severity_of(s("$.issue_severity"), {"high": "high", "low": "low"}, "medium"), language="'python'", required=True, needed=("$.filename", "$.test_id", "$.issue_text"), whole=("$.line_number",)),
    "opengrep": sarif("OPENGREP", **mapped(M.OPENGREP), language="'python'"),
    "opengrep_infra": sarif("OPENGREP_INFRA", **mapped(M.OPENGREP_INFRA), language="'general'"),
    "opengrep_java": sarif("OPENGREP_JAVA", **mapped(M.SPRING), language="'java'", tags=f"array_compact(array({M.longest_prefix('rule_id', M.SPRING['posture'], None)}))"),
    "opengrep_js": sarif("OPENGREP_JS", **mapped(M.OPENGREP_JS), language=SUFFIX),
    "shellcheck": Dialect(items("$"), s("$.file"), f"coalesce(concat('SHELLCHECK.SC', {n('$.code')}), 'SHELLCHECK.UNKNOWN')", s("$.message"), n("$.line"), severity=severity_of(s("$.level"), {"error": "high", "warning": "medium", "info": "low"}, "info"), category="'lint'", required=True, whole=("$.line",), needed=("$.file", "$.message")),
    "spotbugs": Dialect(
        "filter(coalesce(try_variant_get(doc, '$.BugInstance', 'array<variant>'), array()), x -> try_variant_get(x, '$.SourceLine[0]._sourcepath', 'string') IS NOT NULL)", s("$.SourceLine[0]._sourcepath"), f"coalesce({s('$._type')}, 'SPOTBUGS')", f"coalesce(trim({s('$.LongMessage')}), {s('$._type')}, 'SPOTBUGS')", n("$.SourceLine[0]._start"), language="'java'",
        severity=f"CASE WHEN {n('$._rank')} <= 4 THEN 'high' WHEN {n('$._rank')} <= 9 THEN 'medium' ELSE 'low' END", category=f"CASE WHEN upper({s('$._type')}) LIKE '%SECURITY%' THEN 'security' ELSE 'maintainability' END", form="xml",
        schema="BugInstance array<struct<_type:string,_rank:string,LongMessage:string,SourceLine:array<struct<_sourcepath:string,_start:string>>>>",
    ),
    "checkstyle": Dialect(
        NESTED(items("$.file"), "$.error", "$._name"), s("$.k"), f"coalesce({s('$.v._source')}, 'CHECKSTYLE')", f"coalesce({s('$.v._message')}, {s('$.v._source')}, 'CHECKSTYLE')", n("$.v._line"), n("$.v._column"), language="'java'", form="xml",
        severity=severity_of(s("$.v._severity"), {"error": "medium", "warning": "low", "info": "info", "ignore": "info"}, "medium"), category=f"CASE WHEN lower({s('$.v._source')}) LIKE '%imports%' OR lower({s('$.v._source')}) LIKE '%unused%' THEN 'dead_code' ELSE 'lint' END", schema="file array<struct<_name:string,error:array<struct<_line:string,_column:string,_severity:string,_message:string,_source:string>>>>",
    ),
    "pmd": Dialect(NESTED(items("$.files"), "$.violations", "$.filename"), s("$.k"), f"coalesce({s('$.v.rule')}, 'PMD')", f"coalesce({s('$.v.description')}, {s('$.v.rule')}, 'PMD')", n("$.v.beginline"), n("$.v.begincolumn"), language="'java'", severity=f"CASE WHEN {n('$.v.priority')} IS NULL THEN 'medium' WHEN {n('$.v.priority')} <= 2 THEN 'high' WHEN {n('$.v.priority')} <= 3 THEN 'medium' ELSE 'low' END", category=PMD_CATEGORY.format("rule_id")),
    "pmd_xml": Dialect(
        NESTED(items("$.file"), "$.violation", "$._name"), s("$.k"), f"coalesce({s('$.v._rule')}, {s('$.v._ruleset')}, 'PMD')", f"coalesce(nullif(trim({s('$.v._VALUE')}), ''), {s('$.v._rule')}, {s('$.v._ruleset')}, 'PMD')", n("$.v._beginline"), n("$.v._begincolumn"), language="'java'", form="xml", tool="pmd",
        severity=f"CASE WHEN {n('$.v._priority')} IS NULL THEN 'medium' WHEN {n('$.v._priority')} <= 2 THEN 'high' WHEN {n('$.v._priority')} <= 3 THEN 'medium' ELSE 'low' END", category=PMD_CATEGORY.format("rule_id"), schema="file array<struct<_name:string,violation:array<struct<_VALUE:string,_rule:string,_ruleset:string,_beginline:string,_begincolumn:string,_priority:string>>>>",
    ),
    "errorprone": Dialect(f"coalesce({items('$')}, {ERRORPRONE_TEXT})", f"coalesce({s('$.file')}, {s('$.path')})", f"coalesce({s('$.rule')}, {s('$.rule_id')}, 'ERROR_PRONE')", s("$.message"), n("$.line"), n("$.column"), language="'java'", form="text", severity=severity_of(s("$.severity"), {"error": "high", "warning": "medium"}, "info"), category=f"CASE WHEN lower(coalesce({s('$.rule')}, {s('$.rule_id')})) LIKE '%null%' OR lower(coalesce({s('$.rule')}, {s('$.rule_id')})) LIKE '%injection%' THEN 'security' ELSE 'maintainability' END"),
    "dependency_check": Dialect(
        NESTED(items("$.dependencies"), "$.vulnerabilities", "$.fileName"), f"coalesce({s('$.k')}, 'pom.xml')", f"coalesce({s('$.v.name')}, {s('$.v.source')}, 'DEPENDENCY_CHECK')", f"trim(coalesce({s('$.v.description')}, {s('$.v.notes')}, {s('$.v.name')}, 'DEPENDENCY_CHECK'))", language="'java'",
        severity="CASE WHEN lower(" + s("$.v.severity") + ") IN ('critical', 'high', 'low', 'info') THEN lower(" + s("$.v.severity") + ") WHEN lower(" + s("$.v.severity") + ") IN ('medium', 'moderate') THEN 'medium' WHEN try_variant_get(r, '$.v.cvssv3.baseScore', 'double') >= 9 THEN 'critical' WHEN try_variant_get(r, '$.v.cvssv3.baseScore', 'double') >= 7 THEN 'high' WHEN try_variant_get(r, '$.v.cvssv3.baseScore', 'double') >= 4 THEN 'medium' WHEN try_variant_get(r, '$.v.cvssv3.baseScore', 'double') IS NOT NULL THEN 'low' ELSE 'medium' END",
    ),
    "eslint": Dialect(
        NESTED(items("$"), "$.messages", "$.filePath"), s("$.k"), f"coalesce({s('$.v.ruleId')}, 'ESLINT.UNKNOWN')", s("$.v.message"), n("$.v.line"), n("$.v.column"), required=True, whole=("$.v.line", "$.v.column"), needed=("$.k", "$.v.message"), language=SUFFIX, payload="to_json(variant_get(r, '$.v', 'variant'))",
        severity=f"CASE WHEN {n('$.v.severity')} >= 2 THEN CASE WHEN {ESLINT_LEVEL} IN ('high', 'critical') THEN 'high' ELSE 'medium' END WHEN {n('$.v.severity')} = 1 THEN CASE WHEN {ESLINT_LEVEL} = 'low' THEN 'low' ELSE 'medium' END ELSE {ESLINT_LEVEL} END", category=mapped(M.ESLINT)["category"],
    ),
    "typescript_diagnostics": Dialect(f"coalesce({items('$.diagnostics')}, {TSC_TEXT})", s("$.file"), f"CASE WHEN startswith(coalesce({CODE}, 'TS0000'), 'TS') THEN coalesce({CODE}, 'TS0000') ELSE concat('TS', {CODE}) END", s("$.message"), n("$.line"), n("$.column"), form="text", language="'typescript'", severity=f"CASE WHEN {CODE} IN ('TS2307', 'TS7006', 'TS2322') THEN 'high' ELSE 'medium' END", category=f"CASE WHEN {CODE} LIKE 'TS7%' OR {CODE} LIKE 'TS2%' THEN 'typing' ELSE 'lint' END"),
    "npm_audit": Dialect(
        f"CASE WHEN size({entries('$.vulnerabilities', AUDIT)}) > 0 THEN {entries('$.vulnerabilities', AUDIT)} WHEN size({entries('$.advisories', AUDIT)}) > 0 THEN {entries('$.advisories', AUDIT)} WHEN try_variant_get(doc2, '$.data.advisory', 'variant') IS NOT NULL THEN array(parse_json(concat('{{\"k\":null,\"v\":', to_json(variant_get(doc2, '$.data.advisory', 'variant')), '}}'))) WHEN coalesce(try_variant_get(doc, '$.tool', 'string'), 'npm') IN ('npm', 'pnpm', 'yarn') THEN array() END",
        "'package.json'",
        f"concat('NPM.AUDIT.', upper(CASE WHEN try_variant_get(r, '$.v.module_name', 'string') IS NOT NULL THEN coalesce(array_join(try_variant_get(r, '$.v.cves', 'array<string>'), ','), {s('$.v.cves')}, {s('$.k')}, {s('$.v.id')}, {s('$.v.module_name')}) ELSE coalesce({s('$.v.via[0].source')}, {s('$.v.via[0]')}, {s('$.k')}) END))",
        f"CASE WHEN try_variant_get(r, '$.v.module_name', 'string') IS NOT NULL THEN coalesce({s('$.v.title')}, concat('Vulnerability in ', {s('$.v.module_name')})) ELSE coalesce({s('$.v.title')}, {s('$.v.via[0].title')}, {s('$.v.via[0].name')}, concat('Vulnerability in dependency: ', {s('$.k')})) END",
        "1", severity=severity_of(s("$.v.severity"), AUDIT_SEVERITY, "medium"), language="'javascript'", required=True, payload="to_json(variant_get(r, '$.v', 'variant'))",
    ),
    "gitleaks": Dialect(
        items("$"), f"coalesce({s('$.File')}, {s('$.file')})", f"CASE WHEN {SECRET} LIKE '%PRIVATE%' AND {SECRET} LIKE '%KEY%' THEN 'private_key_material' WHEN {SECRET} LIKE '%CERT%' THEN 'certificate_material' ELSE 'real_secret_exposure' END", f"coalesce({s('$.Description')}, {s('$.description')}, 'Secret detected')", f"coalesce({n('$.StartLine')}, {n('$.line')})",
        severity=f"CASE WHEN {SECRET} LIKE '%PRIVATE%' AND {SECRET} LIKE '%KEY%' THEN 'critical' ELSE 'high' END", confidence="0.98D", tags="array('real_secret', 'secrets_profile', 'verified')", required=True,
    ),
    "trufflehog": Dialect(
        "lines", "coalesce(" + s("$.SourceMetadata.Data.Filesystem.file") + ", " + s("$.SourceMetadata.Data.Filesystem.path") + ", 'unknown')", f"CASE WHEN {VERIFIED} THEN 'real_secret_exposure' ELSE 'probable_secret_exposure' END", f"concat(CASE WHEN {VERIFIED} THEN 'Verified' ELSE 'Unverified' END, ' credential detector hit: ', coalesce({s('$.DetectorName')}, {s('$.DetectorType')}, 'trufflehog'))", n("$.SourceMetadata.Data.Filesystem.line"),
        severity=f"CASE WHEN {VERIFIED} THEN 'high' ELSE 'medium' END", confidence=f"CASE WHEN {VERIFIED} THEN 0.98D ELSE 0.7D END", tags=f"CASE WHEN {VERIFIED} THEN array('real_secret', 'verified', 'secrets_profile') ELSE array('unverified', 'probable', 'secrets_profile') END", form="lines", strict=True,
    ),
    "django_check_deploy": Dialect(
        f"array_distinct(transform(filter({DJANGO_TEXT}, l -> l rlike '\\\\([A-Za-z0-9_.-]+\\\\)\\\\s*.+'), l -> to_json(named_struct('rule', upper(regexp_extract(l, '\\\\(([A-Za-z0-9_.-]+)\\\\)\\\\s*(.+)', 1)), 'message', trim(regexp_extract(l, '\\\\(([A-Za-z0-9_.-]+)\\\\)\\\\s*(.+)', 2))))))", "'manage.py'", f"concat('DJG.CHECK.', {s('$.rule')})", s("$.message"), "1", language="'python'", extra={"texts": "true"},
        severity=f"CASE WHEN {s('$.rule')} LIKE '%W001%' OR {s('$.rule')} LIKE '%CRITICAL%' THEN 'high' WHEN {s('$.rule')} LIKE '%W004%' OR {s('$.rule')} LIKE '%W008%' THEN 'medium' ELSE 'low' END",
    ),
    **{t: listed("security", "general") for t in ("dockerfile_scan", "compose_scan", "quadlet_scan", "reverse_proxy_scan", "terraform_scan")},
    **{t: listed("security", "python") for t in ("django_settings_scan", "django_template_scan")},
    "django_orm_health": listed("maintainability", "python"),
}


def json_document(text: Column) -> Column:
    """A report's JSON as VARIANT; lines before the first that opens an object or list are skipped."""
    body = F.regexp_replace(F.trim(text), r"^(?s)(?![\[{]).*?\r?\n(?=\s*[\[{])", "")
    return F.try_parse_json(F.trim(body))


def normal_path(path: Column, root: Column) -> Column:
    """A path under the root, without it; null if it leads outside. Links are not followed."""
    base = F.regexp_replace(F.coalesce(root, F.lit("")), "/+$", "")
    inside = F.when(F.startswith(path, F.concat(base, F.lit("/"))) & (base != ""), F.substr(path, F.length(base) + 2)).otherwise(path)
    parts = F.filter(F.split(inside, "/"), lambda p: (p != "") & (p != "."))
    sound = ~F.startswith(inside, F.lit("/")) & ~F.array_contains(parts, "..") & ~F.contains(path, F.lit("\0"))
    return F.when(sound, F.array_join(parts, "/"))


def halved(of: str, runs: list[tuple[object, str]]) -> str:
    """SQL: of runs (first value, SQL) in the order of their values the one that `of` lies in, found by
    halving: a CASE over dozens tries them one by one, for every entry."""
    if len(runs) == 1:
        return runs[0][1]
    mid = len(runs) // 2
    return f"if({of} < {runs[mid][0]!r}, {halved(of, runs[:mid])}, {halved(of, runs[mid:])})"


def by_dialect(dialects: dict[str, Dialect], of: Callable[[str, Dialect], str | None], default: str = "NULL") -> str:
    """SQL: a choice among the dialects, which `dialect` tells by place; neighbours with the same
    expression share a branch."""
    runs: list[tuple[object, str]] = []
    for place, (name, d) in enumerate(dialects.items()):
        sql = of(name, d)
        if not runs or runs[-1][1] != (sql or default):
            runs.append((place, sql or default))
    return halved("dialect", runs) if runs else default


def chosen_dialect(dialects: dict[str, Dialect]) -> str:
    """SQL: the place of a report's dialect: its tool's, or of several the one in the report's form."""
    of_tool: dict[str, list[str]] = {}
    for name, d in dialects.items():
        of_tool.setdefault(d.tool or name, []).append(name)
    places, runs = {name: i for i, name in enumerate(dialects)}, []
    for tool, names in sorted(of_tool.items()):
        steps = []
        for name in sorted(names, key=lambda x: dialects[x].form != "xml"):
            is_xml = " AND startswith(trim(stdout), '<')" if len(names) > 1 and dialects[name].form == "xml" else ""
            steps.append(f"WHEN tool = {tool!r}{is_xml} THEN {places[name]}")
        runs.append((tool, f"CASE {' '.join(steps)} END"))
    return halved("tool", runs) if runs else "cast(NULL AS int)"


def json_sql(text: str) -> str:
    """A report's JSON as VARIANT; lines before the first that opens an object or list are skipped."""
    return f"element_at(transform(array(trim({text})), t -> try_parse_json(if(startswith(t, '[') OR startswith(t, '{{'), t, trim(regexp_replace(t, '^(?s)(?![\\\\[{{]).*?\\\\r?\\\\n(?=\\\\s*[\\\\[{{])', ''))))), 1)"


def xml_sql(schema: str) -> str:
    """A report's XML as VARIANT, null if it is broken."""
    read = f"from_xml(stdout, '{schema}, _corrupt_record string', map('mode', 'PERMISSIVE', 'columnNameOfCorruptRecord', '_corrupt_record'))"
    return f"element_at(transform(array({read}), x -> if(x._corrupt_record IS NULL, try_parse_json(to_json(x)), NULL)), 1)"


#: Characters beyond which a report is not looked at for being plain XML.
PLAIN = 1 << 20
#: Patterns of a value and of white space in plain XML: nothing in a value is escaped, trimmed or not allowed.
INNER = r"""[^"<>&\p{Cntrl}\uFFFE\uFFFF]"""
VALUE, GAP = f"(?! ){INNER}++(?<! )", r"[ \t\r\n]*+"


def plain_parts(of: StructType) -> tuple[list[str], list[str], dict[str, StructType]] | None:
    """The attributes, the texts and the repeated elements that an element holds, in the schema's order; None
    if there are others."""
    attributes = [f.name for f in of if f.name.startswith("_")]
    kids = {f.name: f.dataType.elementType for f in of if isinstance(f.dataType, ArrayType) and isinstance(f.dataType.elementType, StructType)}
    texts = [f.name for f in of if f.name not in attributes and f.name not in kids]
    sound = all(isinstance(of[x].dataType, StringType) for x in [*attributes, *texts]) and [f.name for f in of] == [*attributes, *texts, *kids] and "_VALUE" not in attributes
    return (attributes, texts, kids) if sound else None


def plain_element(name: str, of: StructType) -> str | None:
    """A pattern of an element in plain XML: known attributes and elements only, once and in the schema's
    order, one blank before each attribute. All attributes must be there if it holds elements, else one."""
    held = plain_parts(of)
    if not held or not held[0]:
        return None
    attributes, texts, kids = held
    inner = {k: plain_element(k, x) for k, x in kids.items()}
    if None in inner.values():
        return None
    listed = "".join(f'(?: {a[1:]}="{VALUE}"){"" if texts or kids else "?+"}' for a in attributes)
    if not (texts or kids):
        return f"<{name}(?= [A-Za-z]){listed} ?+/>"
    return f"<{name}{listed}>{GAP}{''.join(f'(?:<{t}>{VALUE}</{t}>{GAP})?+' for t in texts)}{''.join(f'(?:{x}{GAP})*+' for x in inner.values())}</{name}>"


def plain_struct(text: str, of: StructType, depth: int = 0) -> str:
    """SQL: an element in plain XML as from_xml() reads it, from its text after the name; fields in the order
    of their names, as VARIANT has them."""
    attributes, texts, kids = plain_parts(of)
    between = lambda x, start, end: f"if(contains({x}, '{start}'), substring_index(substring_index({x}, '{start}', -1), '{end}', 1), NULL)"
    head, x = f"h{depth}", f"x{depth}"
    fields = {a: between(head, f' {a[1:]}="', '"') for a in attributes} | {t: between(text, f"<{t}>", f"</{t}>") for t in texts}
    for k, inner in kids.items():
        each = f"transform(slice(split({text}, '<{k}(?= )'), 2, {1 << 30}), {x} -> {plain_struct(x, inner, depth + 1)})"
        fields[k] = f"get(filter(array({each}), y -> size(y) > 0), 0)"
    made = f"named_struct({', '.join(f"'{name}', {sql}" for name, sql in sorted(fields.items()))})"
    return f"element_at(transform(array(substring_index({text}, '>', 1)), {head} -> {made}), 1)" if attributes else made


def typed_sql(sql: str, known: set[str]) -> str | None:
    """SQL over VARIANT as SQL over structs with texts, if all of its names are known and it can be."""

    def path(found: re.Match) -> str:
        at, kind = found[1], found[3]
        for name, index in re.findall(r"\.(\w+)|\[(\d+)\]", found[2]):
            at = f"{at}.{name}" if name else f"get({at}, {index})"
            if name and name not in known:
                return "variant"
        return f"try_cast({at} AS int)" if kind == "int" else at

    typed = re.sub(r"try_variant_get\((\w+), '\$((?:\.\w+|\[\d+\])+)', '(string|int|variant|array<variant>)'\)", path, sql)
    typed = typed.replace("to_variant_object(", "(")
    return None if "variant" in typed else typed


def plain_xml(d: Dialect) -> tuple[str, str] | None:
    """(SQL: whether a report is plain XML, SQL: the finding columns of its entries) of an XML dialect, if it
    can be told. Most reports are plain, and are read at a third of the time by searching texts; others,
    with escapes, comments, other elements or whatever else XML has, are left to from_xml()."""
    if d.form != "xml" or d.extra:
        return None
    of = StructType.fromDDL(d.schema)
    held = plain_parts(of)
    if not held or held[0] or held[1] or len(held[2]) != 1:
        return None
    ((name, inner),) = held[2].items()
    element = plain_element(name, inner)
    known = set(re.findall(r"(\w+):", d.schema)) | {name, "k", "v"}
    rows, fields = typed_sql(d.rows, known), typed_sql(entry_sql(d), known)
    if not (element and rows and fields):
        return None
    is_plain = f"length(stdout) < {PLAIN} AND stdout rlike r'^<([A-Za-z]+)>{GAP}(?:{element}{GAP})++</\\1>{GAP}$'"
    read = f"element_at(transform(array({plain_struct('stdout', of)}), doc -> transform(filter({rows}, r -> r IS NOT NULL), (r, at) -> {fields})), 1)"
    return is_plain, read


def entry_sql(d: Dialect) -> str:
    """SQL: the finding columns of an entry r, the at-th of its report."""
    bad = [f"coalesce(schema_of_variant(try_variant_get(r, '{p}', 'variant')) NOT IN ('BIGINT', 'VOID'), false)" for p in d.whole] + [f"coalesce(schema_of_variant(try_variant_get(r, '{p}', 'variant')) <> 'STRING', true)" for p in d.needed]
    fields = {"at": "cast(at as bigint)", "r_file": "r_file", "bad": " OR ".join(bad) or "false", "rule_id": "rule_id", "severity": d.severity, "category": d.category, "language": d.language, "line": d.line, "column": d.column, "message": d.message, "confidence": f"cast({d.confidence} as double)", "tags": d.tags, "raw_payload": d.payload}
    entry = "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in fields.items()) + ")"
    return f"element_at(transform(array({d.file}), r_file -> element_at(transform(array({d.rule}), rule_id -> {entry}), 1)), 1)"


def fields_sql(d: Dialect) -> str:
    """SQL: the finding columns of each entry of a report in a dialect; an unsound report has one entry."""
    return f"transform(if(broken, array(cast(NULL AS variant)), filter(found, r -> r IS NOT NULL)), (r, at) -> {entry_sql(d)})"


def read_entries(reports: DataFrame, dialects: dict[str, Dialect], key: list[str]) -> DataFrame:
    """(key, root, tool, broken, finding columns): the entries of every report that has a dialect. A report's
    dialect is chosen once for its entries and once for all fields of these, and one explode makes rows
    of them. An unsound report gives one row. The fields are computed within a lambda, as what a dozen
    dialects' fields would generate is too long for one method of the JVM."""
    dialects = dict(sorted(dialects.items(), key=lambda x: x[1].form))
    hidden = lambda sql: F.expr(f"element_at(transform(array(0), one -> {sql}), 1)")  # noqa: E731  out of generated code
    rows = reports.withColumn("dialect", hidden(chosen_dialect(dialects))).where("dialect IS NOT NULL")
    rows = rows.where(F.trim(hidden(by_dialect(dialects, lambda _, d: "concat_ws('', stdout, stderr)" if d.form == "text" else "stdout"))) != "")
    plain = {name: found for name, d in dialects.items() if (found := plain_xml(d))}
    rows = rows.withColumn("plain", hidden(f"coalesce({by_dialect(dialects, lambda n, _: plain[n][0] if n in plain else 'false')}, false)"))
    rows = rows.withColumn("doc", hidden(by_dialect(dialects, lambda n, d: f"if(plain, NULL, {xml_sql(d.schema)})" if n in plain else xml_sql(d.schema) if d.form == "xml" else json_sql("stdout") if d.form != "lines" else None)))
    rows = rows.withColumn("doc2", hidden(by_dialect(dialects, lambda n, d: f"coalesce({json_sql("try_variant_get(doc, '$.stdout', 'string')")}, doc)" if "doc2" in d.rows else None)))
    rows = rows.withColumn("__l", hidden(by_dialect(dialects, lambda _, d: "filter(split(stdout, '\\r?\\n'), x -> trim(x) <> '')" if d.form == "lines" else None)))
    rows = rows.withColumn("lines", F.expr("filter(transform(__l, x -> try_parse_json(x)), x -> x IS NOT NULL)") if any(d.form == "lines" for d in dialects.values()) else F.lit(None).cast("array<variant>"))
    rows = rows.withColumn("found", hidden(by_dialect(dialects, lambda _, d: f"transform({d.rows}, x -> try_parse_json(x))" if d.extra else d.rows)))
    unsound = lambda _, d: " OR ".join(["doc IS NULL"] * (d.form in ("json", "xml")) + ["size(lines) < size(__l)"] * d.strict + ["found IS NULL"] * d.required) or "false"
    rows = rows.withColumn("broken", hidden(f"NOT plain AND coalesce({by_dialect(dialects, unsound)}, false)"))
    whole = by_dialect(dialects, lambda n, d: f"if(plain, {plain[n][1]}, {fields_sql(d)})" if n in plain else fields_sql(d))
    tool = by_dialect(dialects, lambda n, d: f"'{d.tool or n}'")
    return rows.select(*key, "root", hidden(tool).alias("tool"), "broken", F.explode(F.expr(whole)).alias("e")).select(*key, "root", "tool", "broken", "e.*")


def findings_of(each: DataFrame, key: list[str]) -> DataFrame:
    """Findings of entries, with `problem` where an entry or its report is unsound."""
    path = normal_path(F.col("r_file"), F.col("root"))
    problem = F.when(F.col("broken") | F.col("bad") | F.col("r_file").isNull(), "SCHEMA_ERROR").when(path.isNull(), "INVALID_PATH")
    return each.select(
        *key, scanner_place().alias("scanner_ord"), F.col("at").alias("finding_ord"), "tool", "rule_id", "severity", "category", "language", path.alias("file"), "line", "column", F.lit(None).cast("string").alias("symbol"), "message",
        F.lit(None).cast("string").alias("remediation"), "confidence", "tags", "raw_payload", problem.alias("problem"),
    )


def parse(reports: DataFrame, dialect: str | dict[str, Dialect], key: list[str] | None = None) -> DataFrame:
    """Findings of the reports in one dialect, or in any of several, with `problem` where an entry or a
    report is unsound. The reports are read once, however many dialects there are."""
    key = key or ["project", "run_id"]
    dialects = {dialect: DIALECTS[dialect]} if isinstance(dialect, str) else dialect
    return findings_of(read_entries(reports, dialects, key), key)


def parse_all(reports: DataFrame, tools: list[str] | None = None, dialects: dict[str, Dialect] | None = None, functions: dict[str, Reader] | None = None) -> DataFrame:
    """Findings of all reports, sound ones whole, and a parser finding for each unsound report. The
    reports are read once, and what they hold is written before it is judged, as is which runs are unsound:
    so Spark knows how few these are before it plans the join with them. Reports of a tool that neither a dialect nor a function reads give nothing: see plans.registry.outcomes."""
    known = {name: d for name, d in (DIALECTS if dialects is None else dialects).items() if tools is None or (d.tool or name) in tools}
    found = written(entries_of(reports, known, {t: f for t, f in (functions or {}).items() if tools is None or t in tools}), "parsed")
    bad = written(unsound_runs(found), "unsound")
    return parser_failures(found.join(bad.select(PARSED), PARSED, "left_semi").select(*PARSED, "tool").distinct(), found, bad)


def entries_of(reports: DataFrame, dialects: dict[str, Dialect], functions: dict[str, Reader]) -> DataFrame:
    """Findings with `problem`, by dialects and, for tools that have one, by functions."""
    rows = parse(reports.where(~F.col("tool").isin(list(functions))) if functions else reports, dialects)
    return rows.unionByName(parse_by_functions(reports, functions)) if functions else rows


class OutputInvalid(ValueError):
    """A report is not in the form that its reader knows."""


def parse_by_functions(reports: DataFrame, functions: dict[str, Reader]) -> DataFrame:
    """Findings of reports that Python functions read, with `problem`: OutputInvalid is a SCHEMA_ERROR,
    any other exception UNHANDLED, a path that leads outside INVALID_PATH. A function gets stdout, stderr
    and root, and gives findings as dictionaries; one without rule_id, file or message is unsound."""
    texts, numbers = ["rule_id", "severity", "category", "language", "file", "symbol", "message", "remediation", "raw_payload"], ["line", "column"]
    schema = f"project string, run_id string, tool string, root string, at long, {', '.join(f'{x} string' for x in texts)}, {', '.join(f'{x} int' for x in numbers)}, confidence double, tags array<string>, problem string"
    names = [x.strip().split()[0] for x in schema.split(", ")]

    def batch_of(part: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.get(name) for x in part], arrow[name]) for name in names], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # findings of several reports, as a batch for each costs more than reading it
        for batch in batches:
            for row in batch.to_pylist():
                kept, out = {k: row[k] for k in ("project", "run_id", "tool", "root")}, []
                try:
                    for at, found in enumerate(functions[row["tool"]](row["stdout"] or "", row["stderr"] or "", row["root"] or "")):
                        sound = all(isinstance(found.get(x), str) for x in ("rule_id", "file", "message"))
                        out.append(kept | {"at": at, **found, "problem": None if sound else "SCHEMA_ERROR"})
                except Exception as e:  # whatever a user's reader raises is a finding about the report
                    out = [kept | {"at": 0, "problem": "SCHEMA_ERROR" if isinstance(e, OutputInvalid) else "UNHANDLED"}]
                held += out
                whole = len(held) - len(held) % 1024
                for start in range(0, whole, 1024):
                    yield batch_of(held[start : start + 1024])
                held = held[whole:] if whole else held
        if held:
            yield batch_of(held)

    arrow = {name: pa.string() for name in names} | {"at": pa.int64(), "line": pa.int32(), "column": pa.int32(), "confidence": pa.float64(), "tags": pa.list_(pa.string())}
    rows = reports.where(F.col("tool").isin(list(functions))).select("project", "run_id", "tool", "stdout", "stderr", "root").mapInArrow(read, schema)
    path = normal_path(F.col("file"), F.col("root"))
    defaults = {"severity": "medium", "category": "lint", "language": "general"}
    return rows.select(
        "project", "run_id", scanner_place().alias("scanner_ord"), F.col("at").alias("finding_ord"), "tool", "rule_id", *(F.coalesce(x, F.lit(v)).alias(x) for x, v in defaults.items()), path.alias("file"), "line", "column", "symbol", "message", "remediation",
        F.coalesce("confidence", F.lit(1.0)).alias("confidence"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("raw_payload", F.lit("{}")).alias("raw_payload"), F.coalesce("problem", F.when(path.isNull(), "INVALID_PATH")).alias("problem"),
    )


def scanner_place() -> Column:
    """The order of a report's scanner; those that are not built in come last."""
    order = F.create_map(*(x for i, t in enumerate(SCANNERS) for x in (F.lit(t), F.lit(i + 1))))
    return F.coalesce(F.element_at(order, F.col("tool")), F.lit(len(SCANNERS) + 1))


def scanner_runs(reports: DataFrame) -> DataFrame:
    """(project, run_id, scanner_ord, tool) of the reports."""
    return reports.select("project", "run_id", scanner_place().alias("scanner_ord"), "tool").distinct()


def read(spark: SparkSession, pattern: str) -> DataFrame:
    """Report files laid out as .../<project>/<run_id>/<tool>.<ext>, one row a file."""
    raw = spark.read.text(pattern, wholetext=True).select("value", F.split(F.col("_metadata.file_path"), "/").alias("p"))
    part = lambda i: F.element_at("p", F.lit(i))
    return raw.select(part(-3).alias("project"), part(-2).alias("run_id"), F.regexp_replace(part(-1), r"\.[^.]*$", "").alias("tool"), F.col("value").alias("stdout"), F.lit("").alias("stderr"), F.lit("").alias("root"))
