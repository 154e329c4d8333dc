"""DuckDB SQL for the queries over derived files and results."""

from __future__ import annotations

from verdigris.functions.text import glob_to_regex
from verdigris.operators import discovery as D
from verdigris.plans.queries_scan import BY_RUN, SECRET_RULES
from verdigris.schemas import CATEGORY_WEIGHT, SEVERITY_PENALTY
from verdigris.sources import text_rules as T
from verdigris.sources.reports import DIALECTS
from verdigris.sources.samples import SCALARS
from verdigris.sources.derived import DUCK_SQL, FILE_RULES, RESULT_RULES


def q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def globs(names) -> str:
    return "regexp_matches(name, " + q("|".join(f"(?:{glob_to_regex(g)})" for g in names)) + ")"


def reads(tool: str) -> str:
    held = globs(T.FILES[tool])
    return f"({held} AND regexp_matches(file, {q(T.TEMPLATES)}) AND NOT regexp_matches(lower(file), '/test|/doc|/example'))" if tool == "django_template_scan" else held


def newlines(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def rule(r: T.Rule) -> str:
    found = f"regexp_matches(text, {q(r.pattern)})"
    if r.cleared_by:
        found = f"({found} AND NOT regexp_matches(text, {q(r.cleared_by)}))"
    before = "regexp_extract(text, " + q(rf"(?s)\A(.*?)(?:(?-s){r.pattern})") + ", 1)"
    line = newlines(before) + " + 1" if r.located and not r.negated else "1"
    return f"SELECT project, file, {', '.join(f'{q(v)} AS {n}' for n, v in (('tool', r.tool), ('rule_id', r.rule_id), ('severity', r.severity), ('category', r.category), ('language', r.language)))}, CAST({line} AS INTEGER) AS line, {q(r.message)} AS message FROM files WHERE {reads(r.tool)} AND {'NOT ' if r.negated else ''}{found}"


FORM = T.FORM_RULE
# RE2 knows no back references: quotes are told one by one
EVIDENCE = r"(?i)\{%\s*csrf_token\s*%\}|\{\{\s*csrf_token\s*\}\}|<input[^>]*type\s*=\s*""" + '"hidden"' + r"[^>]*name\s*=\s*" + '"csrf_token"' + r"|\{\{[^}]*csrf[^}]*\(\s*\)\s*\}\}"
FORMS = f"""SELECT project, file, '{FORM.tool}' AS tool, '{FORM.rule_id}' AS rule_id, '{FORM.severity}' AS severity, '{FORM.category}' AS category, '{FORM.language}' AS language,
    CAST({newlines('substr(text, 1, strpos(text, form) - 1)')} + 1 AS INTEGER) AS line, {q(FORM.message)} AS message
  FROM (SELECT *, unnest(regexp_extract_all(text, {q(FORM.pattern)})) AS form FROM files WHERE {reads(FORM.tool)})
  WHERE regexp_matches(form, '(?i)<form\\b[^>]*\\bmethod\\s*=\\s*("\\s*post\\s*"|''\\s*post\\s*'')[^>]*>') AND NOT regexp_matches(form, {q(EVIDENCE)})"""

SEEN = "NOT list_has_any(string_split(file, '/'), [" + ", ".join(map(q, D.IGNORED_PARTS)) + "])"
SOURCE = f"({SEEN} AND ends_with(file, '.py'))"
ANY = lambda flag: f"coalesce(bool_or({flag}), false)"
SIGNAL = lambda name: ANY(f"{SOURCE} AND regexp_matches(text, {q(D.PYTHON_SIGNALS[name])})")
SCRIPT = f"{SEEN} AND regexp_matches(name, '\\.[jt]sx?$')"

PENALTY = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_PENALTY.items()) + " END"
HINT = "CASE WHEN category = 'security' THEN 1.2 WHEN category = 'dead_code' THEN 0.8 WHEN category = 'lint' THEN 0.75 ELSE 1.0 END"
NUMBER = lambda name, said: f"CASE WHEN {name} > 0 THEN '{said} (' || {name} || ')' END"
AGE = "history_scan_age_days"
STALE = f"""CASE WHEN {AGE} IS NULL THEN 'history scan stale; historical secret exposure coverage is outdated' WHEN {AGE} >= 365 THEN 'history scan stale (' || {AGE} || ' days); critical refresh overdue'
  WHEN {AGE} >= 180 THEN 'history scan stale (' || {AGE} || ' days); refresh strongly recommended' WHEN {AGE} >= 90 THEN 'history scan stale (' || {AGE} || ' days); refresh recommended'
  WHEN {AGE} >= 60 THEN 'history scan aging (' || {AGE} || ' days)' ELSE 'history scan stale (' || {AGE} || ' days)' END"""
REASONS = {
    "scanner_failure": "scanner_failures > 0", "parser_missing": "parser_missing > 0", "invalid_findings": "invalid_findings > 0", "invalid_paths": "invalid_paths > 0", "baseline_entry_expired": "baseline_expired_entries > 0",
    "baseline_entry_missing_owner": "baseline_missing_owner_entries > 0", "baseline_entry_expiring": "baseline_expiring_soon_entries > 0", "critical_security_finding": "crit > 0", "high_security_findings": "high > 3", "low_score": "overall_score < 80",
    "real_secret_exposure": "real_secret_findings > 0", "probable_secret_exposure": "probable_secret_findings > 0", "private_key_material": "private_key_findings > 0", "baseline_real_secret_prohibited": "baseline_real_secret_entries > 0",
    "history_scan_skipped": "history_scan_skipped > 0", "history_scan_stale": "history_scan_stale > 0", "secret_scanner_unavailable": "secret_scanner_unavailable_count > 0",
}

PARTS = {
    "files": f"SELECT project, path AS file, regexp_extract(path, '[^/]*$') AS name, text FROM ({FILE_RULES.format(text='varchar')})",
    "results": RESULT_RULES.format(text="varchar"),
    "rm": f"SELECT project, run_id, scanner AS tool, category, severity, count(*) AS count, {HINT} AS score_hint FROM results WHERE severity IS NOT NULL GROUP BY ALL",
    "rdim": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST({w} AS DOUBLE))" for c, w in CATEGORY_WEIGHT.items()) + ") t(category, weight)",
    "rcs": f"""SELECT r.project, r.run_id, r.category, r.weight, greatest(0.0, least(100.0, 100.0 - coalesce(sum(CAST({PENALTY} AS DOUBLE) * count * CAST(score_hint AS DOUBLE)), 0.0))) AS exact_score
      FROM (SELECT DISTINCT project, run_id, rdim.category, weight FROM rm, rdim) r LEFT JOIN rm USING (project, run_id, category) GROUP BY 1, 2, 3, 4""",
    "rcard": "SELECT project, run_id, round(sum(exact_score * weight) + 1e-9, 2) AS overall_score FROM rcs GROUP BY 1, 2",
    "rsec": "SELECT project, run_id, coalesce(sum(count) FILTER (category = 'security' AND severity = 'critical'), 0) AS crit, coalesce(sum(count) FILTER (category = 'security' AND severity = 'high'), 0) AS high FROM rm GROUP BY 1, 2",
    "rcount": """SELECT project, run_id, count(*) AS scanner_count, count(*) FILTER (success) AS successful_scanners, count(*) FILTER (NOT success) AS failed_scanners, CAST(sum(finding_count) AS BIGINT) AS finding_count,
      CAST(sum(coalesce(invalid_finding_count, 0)) AS BIGINT) AS invalid_findings, CAST(sum(CASE WHEN error_code = 'finding_path_invalid' THEN greatest(1, coalesce(invalid_finding_count, 0)) ELSE 0 END) AS BIGINT) AS invalid_paths,
      count(*) FILTER (error_code IN ('scanner_parse_error', 'scanner_output_invalid')) AS parse_failures, count(*) FILTER (error_code = 'scanner_parser_missing') AS parser_missing,
      count(*) FILTER (NOT success AND coalesce(error_code, '') NOT IN ('scanner_parse_error', 'scanner_output_invalid', 'scanner_parser_missing', 'finding_path_invalid')) AS scanner_failures FROM results GROUP BY 1, 2""",
    "rnum": "SELECT project, run_id, " + ", ".join(f"{sql} AS {name}" for name, sql in BY_RUN.items()) + " FROM (SELECT project, run_id, min(run_no) AS run_no FROM results GROUP BY 1, 2)",
    "rall": "SELECT rcount.*, rnum.* EXCLUDE (project, run_id), coalesce(overall_score, 100.0) AS overall_score, coalesce(crit, 0) AS crit, coalesce(high, 0) AS high FROM rcount JOIN rnum USING (project, run_id) LEFT JOIN rcard USING (project, run_id) LEFT JOIN rsec USING (project, run_id)",
    "rpol": f"""SELECT *, CASE WHEN violations <> '' THEN 'fail' WHEN warnings <> '' THEN 'warn' ELSE 'pass' END AS status FROM (SELECT *,
      concat_ws(',', {', '.join(f"CASE WHEN {sql} THEN '{name}' END" for name, sql in REASONS.items())}) AS reasons,
      concat_ws(';', CASE WHEN crit > 0 THEN 'critical security findings present' END, CASE WHEN scanner_failures > 0 THEN 'scanner failures present' END, CASE WHEN parser_missing > 0 THEN 'parser registrations missing' END,
        CASE WHEN invalid_findings > 0 THEN 'invalid findings rejected' END, CASE WHEN invalid_paths > 0 THEN 'invalid finding paths rejected' END, CASE WHEN overall_score < 60 THEN 'overall score below 60' END,
        {NUMBER('real_secret_findings', 'real credential/secret exposure findings present')}, {NUMBER('private_key_findings', 'private key material findings present')}, {NUMBER('baseline_real_secret_entries', 'baseline contains prohibited real-secret entries')}) AS violations,
      concat_ws(';', {NUMBER('probable_secret_findings', 'probable secret exposure findings present')}, {NUMBER('baseline_expired_entries', 'baseline has expired entries')}, {NUMBER('baseline_missing_owner_entries', 'baseline has entries missing owner')},
        {NUMBER('baseline_expiring_soon_entries', 'baseline has entries expiring soon')}, CASE WHEN history_scan_skipped > 0 THEN 'history scan skipped; historical secret exposure coverage is incomplete' END, CASE WHEN history_scan_stale > 0 THEN {STALE} END,
        {NUMBER('secret_scanner_unavailable_count', 'secret scanners unavailable')}, CASE WHEN high > 3 THEN 'high security findings exceed threshold (' || high || ' > 3)' END, CASE WHEN overall_score < 80 THEN 'overall score below 80' END) AS warnings FROM rall)""",
    "pyf": f"""SELECT project, {ANY("file IN ('pyproject.toml', 'requirements.txt', 'manage.py')")} AS is_python, {ANY("file = 'requirements.txt' AND contains(lower(text), 'django')")} AS in_req, {SIGNAL('django_import')} AS imports,
      {SIGNAL('drf')} AS drf, {SIGNAL('orm_patterns')} AS orm, {ANY(f"{SEEN} AND name = 'settings.py'")} AS in_settings, {ANY(f"{SEEN} AND name = 'settings.py' AND regexp_matches(text, {q(D.SETTINGS_SIGNAL)})")} AS hardening,
      CAST({SIGNAL('fastapi_import')} AS INT) + CAST({SIGNAL('fastapi_app')} AS INT) + CAST({SIGNAL('fastapi_router')} AS INT) AS fastapi, CAST({SIGNAL('flask_import')} AS INT) + CAST({SIGNAL('flask_app')} AS INT) + CAST({SIGNAL('flask_blueprint')} AS INT) AS flask,
      count(*) FILTER ({SEEN} AND ends_with(file, '.html') AND regexp_matches(file, '(^|/)templates/')) AS templates FROM files GROUP BY project""",
    "jsf": f"""SELECT project, max(text) FILTER (file = 'package.json') AS manifest, {ANY(f"{SCRIPT} AND regexp_matches(name, '[.]tsx?$')")} AS ts, {ANY(f"{SCRIPT} AND regexp_matches(name, '[.]jsx?$')")} AS js FROM files GROUP BY project""",
    "jsd": """SELECT project, ts, list_distinct(list_concat(coalesce(json_keys(manifest, '$.dependencies'), []), coalesce(json_keys(manifest, '$.devDependencies'), []))) AS deps FROM jsf WHERE manifest IS NOT NULL AND (ts OR js)""",
    "inf": " UNION ALL ".join(f"SELECT project, '{g}' AS \"group\", '{next(k for k, v in D.INFRASTRUCTURE_KINDS.items() if g in v)}' AS kind, file FROM files WHERE {SEEN} AND {globs(names)}" for g, names in D.INFRASTRUCTURE.items()),
    "lang": """SELECT project, concat_ws(',', CASE WHEN is_python THEN 'python' END, CASE WHEN ts THEN 'typescript' END, CASE WHEN ts IS NOT NULL THEN 'javascript' END, CASE WHEN infra THEN 'general' END) AS language_hints, CASE WHEN is_python THEN 'python' END AS primary_language,
      concat_ws(',', CASE WHEN infra THEN 'general' END, CASE WHEN NOT ts THEN 'javascript' END, 'python', CASE WHEN ts THEN 'typescript' END) AS labels
      FROM pyf LEFT JOIN (SELECT project, ts FROM jsd) USING (project) LEFT JOIN (SELECT project, true AS infra FROM inf GROUP BY 1) USING (project)""",
}
FRAMEWORKS = ", ".join(f"CASE WHEN list_has_any(deps, [{', '.join(map(q, marks))}]) THEN '{name}' END" for name, marks in D.JS_FRAMEWORKS.items())
RULED = f"CASE WHEN finding_ord % 11 < 6 THEN ([{', '.join(map(q, SECRET_RULES))}])[finding_ord % 11 + 1] ELSE rule_id END"

def value(x) -> str:
    return "NULL" if x is None else q(x) if isinstance(x, str) else str(x)


def told(rows: list[tuple], names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) t({names})"


FIGURES = told([(i, tool, name, figure) for i, (tool, (_, found)) in enumerate(sorted(SCALARS.items())) for name, figure in found.items()], "i, tool, name, value")

FINAL = {
    "scalar_metrics": f"SELECT 'p' || (s_suppkey % 7) AS project, tool, name, CAST(value AS DOUBLE) AS value, count(*) AS count FROM supplier JOIN {FIGURES} ON s_suppkey % {len(SCALARS)} = i GROUP BY ALL",
    "text_rules": " UNION ALL ".join(map(rule, T.RULES)) + f" UNION ALL {FORMS}",
    "file_counts": "SELECT project, " + ", ".join(f"count(*) FILTER ({reads(tool)}) AS {name}" for tool, name in T.COUNTS.items()) + " FROM files GROUP BY project",
    "python_projects": """SELECT project, is_python, CASE WHEN dj THEN 'django' WHEN fastapi > 0 THEN 'fastapi' WHEN flask > 0 THEN 'flask' ELSE 'generic' END AS python_framework,
      CAST(round(CASE WHEN dj THEN 0.98 WHEN fastapi > 0 THEN 0.55 + 0.15 * fastapi WHEN flask > 0 THEN 0.55 + 0.15 * flask ELSE 0.4 END, 2) AS DOUBLE) AS framework_confidence,
      CASE WHEN dj THEN concat_ws(',', CASE WHEN imports THEN 'django_imports' END, CASE WHEN in_req THEN 'requirements.txt' END, CASE WHEN in_settings THEN 'settings.py' END) END AS django_evidence,
      dj AND drf AS drf, dj AND orm AS orm_patterns, dj AND hardening AS settings_hardening_markers, CAST(CASE WHEN dj THEN templates ELSE 0 END AS BIGINT) AS template_count FROM (SELECT *, in_req OR imports AS dj FROM pyf)""",
    "javascript_projects": f"SELECT project, CASE WHEN ts THEN 'typescript' ELSE 'javascript' END AS key, 'unknown' AS package_manager, concat_ws(',', {FRAMEWORKS}) AS js_frameworks, len(deps) AS dependency_count FROM jsd",
    "infrastructure": 'SELECT project, "group", kind, count(*) AS count, array_to_string(list_slice(list_sort(list(file)), 1, 3), \',\') AS first_files, least(100, count(*)) AS listed FROM inf GROUP BY ALL',
    "languages": "SELECT * FROM lang",
    "language_histogram": "SELECT language, count(*) AS projects FROM (SELECT unnest(string_split(labels, ',')) AS language FROM lang) GROUP BY 1",
    "secrets": """SELECT project, run_id, CAST(sum(CASE WHEN kept AND NOT covered AND real THEN 1 ELSE 0 END) AS BIGINT) AS real_secret_findings, CAST(sum(CASE WHEN kept AND NOT covered AND rule_id = 'private_key_material' THEN 1 ELSE 0 END) AS BIGINT) AS private_key_findings,
      CAST(sum(CASE WHEN kept AND NOT covered AND rule_id = 'probable_secret_exposure' THEN 1 ELSE 0 END) AS BIGINT) AS probable_secret_findings, CAST(sum(CASE WHEN kept AND covered AND real THEN 1 ELSE 0 END) AS BIGINT) AS baseline_real_secret_entries,
      CAST(sum(CASE WHEN kept AND NOT covered AND real THEN 1 ELSE 0 END) AS BIGINT) AS secrets_hygiene, count(*) FILTER (rule_id = 'historical_secret_exposure') AS historical_secret_exposure,
      count(*) FILTER (rule_id IN ('private_key_material', 'certificate_material')) AS key_material_exposure, count(*) FILTER (rule_id IN ('credential_hardcoding', 'weak_secret_management')) AS credential_management
      FROM (SELECT d.*, fingerprint IN (SELECT fingerprint FROM active) AS covered, coalesce(json_extract_string(raw_payload, '$.secret_real') = 'true', false) AS real FROM d) GROUP BY 1, 2""",
    "run_counters": "SELECT * FROM rcount",
    "scalar_roll_up": "SELECT project, run_id, scalar AS name, arg_max(scalar_value, scanner_ord) AS value FROM results WHERE scalar IS NOT NULL GROUP BY 1, 2, 3",
    "scanner_stats": "SELECT project, run_id, scanner, success, error_code, CAST(sum(input_files) AS BIGINT) AS scanner_input_file_count FROM results GROUP BY ALL",
    "measured_categories": "SELECT project, run_id, array_to_string(list_sort(list(DISTINCT category)), ',') AS measured_categories FROM rm GROUP BY 1, 2",
    "policy_reasons": "SELECT project, run_id, overall_score, status, reasons, violations, warnings FROM rpol",
    "exit_codes": """SELECT project, run_id, status, CASE WHEN failed > 0 THEN 4 WHEN unread > 0 THEN 5 WHEN status = 'fail' THEN 2 WHEN status = 'warn' THEN 1 ELSE 0 END AS exit_code FROM rpol JOIN (
      SELECT project, run_id, count(*) FILTER (error_code = 'scanner_timeout') AS failed, count(*) FILTER (error_code IN ('scanner_parser_missing', 'scanner_parse_error') OR coalesce(invalid_finding_count, 0) > 0) AS unread FROM results GROUP BY 1, 2) USING (project, run_id)""",
    "summary_lines": """SELECT project, run_id, concat_ws(chr(10), 'Ran ' || scanner_count || ' scanners for ' || project || ' (' || successful_scanners || ' succeeded, ' || failed_scanners || ' failed)', 'Overall score: ' || printf('%.2f', overall_score),
      'Grade: ' || CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END, 'Policy status: ' || upper(status),
      'Debt summary: gross=0, scored=0, accepted=0, new=0, resolved=0, suppressed_duplicates=0', CASE WHEN scanner_count % 3 > 0 THEN 'Java cache: ' || (scanner_count % 3) || ' hits / 0 misses' END,
      CASE WHEN status <> 'pass' THEN 'Policy reasons: ' || replace(reasons, ',', ', ') END, 'Report portal: reports/index.html') AS text FROM rpol""",
}
#: Parts that a query has in a form of its own.
OWN = {"secrets": {"f": f"SELECT * REPLACE ({RULED} AS rule_id) FROM ({DUCK_SQL})"}}
