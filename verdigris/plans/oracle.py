"""DuckDB SQL for the engine's queries, put together from named parts."""

from __future__ import annotations

import re

from verdigris.functions.classify import CLASSES, CONTEXTS, DOCUMENTATION_PREFIXES, HARMLESS_LITERALS, INTERPOLATION, RUNTIME_PREFIXES, TOOLING_PREFIXES
from verdigris.plans import oracle_extend, oracle_scan
from verdigris.schemas import CATEGORY_WEIGHT, DEPENDENCY_TOOLS, SEVERITY_PENALTY
from verdigris.sources.derived import DUCK_SQL, ORDER

NOW = "TIMESTAMP '2001-06-01 00:00:00'"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def case(column: str, table: dict, default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v) if isinstance(v, str) else v}" for k, v in table.items()) + f" ELSE {default} END"


def prefixed(column: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {quoted(p)})" for p in prefixes) + ")"


def regex(x: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"
    return x


NORMAL = regex(
    "replace(replace(lower(trim(message)), '\"', ''''), '\\', '/')",
    (r"\bline\s+\d+\b", "line <n>"),
    (r"\b0x[0-9a-fA-F]+\b", "0x<hex>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b(?:/[\w./-]+|[a-zA-Z]:\\[\\\w .-]+)\b", "<path>"),
    *((rf"[{c}]{{2,}}", c) for c in "!?.,:;"),
    (r"\s+", " "),
)
MATERIAL = """{tool} || '|' || rule_id || '|' || file || '|' || CASE WHEN coalesce(trim(symbol), '') <> '' THEN trim(symbol)
  ELSE normalized_message || coalesce('|' || sha256(nullif(trim(json_extract_string(raw_payload, '$.snippet')), '')), '') END"""
BANDIT = lambda *rules: f"tool = 'bandit' AND upper(rule_id) IN ({', '.join(map(quoted, rules))})"
LITERAL = "CASE WHEN regexp_matches(message, '''[^'']*''') THEN regexp_extract(message, '''([^'']*)''', 1) WHEN regexp_matches(message, '\"[^\"]*\"') THEN regexp_extract(message, '\"([^\"]*)\"', 1) END"
TEXT = "lower(message || chr(10) || raw_payload)"
SHELL = f"(({TEXT} LIKE '%shell=true%' OR {TEXT} LIKE '%shell = true%') AND upper(rule_id) = 'B603')"
COMMAND = f"({TEXT} LIKE '%os.system(%' OR {TEXT} LIKE '%subprocess.popen(%' OR regexp_matches({TEXT}, {quoted('|'.join(INTERPOLATION))}))"
RULE = f"""CASE WHEN category <> 'security' THEN 1
  WHEN {BANDIT('B105')} AND coalesce({LITERAL} IN ({', '.join(map(quoted, HARMLESS_LITERALS))}), false) THEN 2
  WHEN starts_with(lower(file), 'tests/') OR ends_with(lower(file), 'smoke_test.py') THEN CASE WHEN {BANDIT('B310')} THEN 3 ELSE 4 END
  WHEN lower(file) IN ('readme', 'readme.md') OR {prefixed('lower(file)', DOCUMENTATION_PREFIXES)} THEN 5
  WHEN {prefixed('lower(file)', TOOLING_PREFIXES)} THEN CASE
    WHEN {BANDIT('B404', 'B603')} AND {SHELL} THEN 6 WHEN {BANDIT('B404', 'B603')} AND {COMMAND} THEN 7
    WHEN {BANDIT('B404')} THEN 8 WHEN {BANDIT('B603')} THEN 9 ELSE 10 END
  WHEN {prefixed('lower(file)', RUNTIME_PREFIXES)} THEN 11 ELSE 12 END"""
OUTCOMES = {
    1: ("not_security", "unknown", "none", 1.0, "non_security_category"), 2: ("false_positive", "unknown", "none", 0.0, "bandit_b105_token_literal"), 3: ("test_security", "test", "low", 0.1, "bandit_b310_test_urlopen"),
    4: ("test_security", "test", "low", 0.1, "path_test"), 5: ("false_positive", "unknown", "none", 0.0, "path_documentation"), 6: ("runtime_security", "runtime", "high", 1.0, "bandit_b603_shell_true"),
    7: ("runtime_security", "runtime", "high", 1.0, "heuristic_interpolated_command"), 8: ("tooling_security", "tool", "medium", 0.25, "bandit_b404_tool_subprocess"), 9: ("tooling_security", "tool", "medium", 0.25, "bandit_b603_tool_subprocess"),
    10: ("tooling_security", "tool", "medium", 0.25, "path_tooling"), 11: ("runtime_security", "runtime", "high", 1.0, "path_runtime"), 12: ("unknown", "unknown", "medium", 1.0, "default_unknown"),
}
VALUES = ", ".join(f"({k}, {', '.join(quoted(x) if isinstance(x, str) else f'CAST({x} AS DOUBLE)' for x in v)})" for k, v in OUTCOMES.items())
DIGIT = lambda at: f"CAST('0x' || substr(fingerprint, {at}, 1) AS INTEGER)"
HINT = f"CASE WHEN tool = 'bandit' THEN 1.5 WHEN tool IN ({', '.join(map(quoted, DEPENDENCY_TOOLS))}) THEN 1.4 WHEN tool = 'coverage' THEN 1.0 WHEN category = 'security' THEN 1.2 WHEN category = 'dead_code' THEN 0.8 WHEN category = 'lint' THEN 0.75 ELSE 1.0 END"
STRIPPED = "lower(trim(coalesce(nullif(normalized_message, ''), message)))"
FAMILY = regex(STRIPPED, (r"\d+", "#"), (r"['\"`].*?['\"`]", "<x>"), (r"\s+", " "))

PARTS = {
    "f": DUCK_SQL,
    "n0": f"SELECT *, {NORMAL} AS normalized_message FROM f",
    "n": f"""SELECT *, sha256({MATERIAL.format(tool='tool')}) AS fingerprint, sha256({MATERIAL.format(tool="'_'")}) AS dedupe_key,
      coalesce(json_extract_string(raw_payload, '$.native_severity'), severity) AS native_severity,
      CASE WHEN regexp_matches(lower(file), '/vendor/|/node_modules/|/third_party/|/[.]venv/') THEN 'third_party' WHEN regexp_matches(lower(file), '/dist/|/build/|/generated/|_generated') THEN 'generated' ELSE 'first_party' END AS ownership
      FROM n0""",
    "outcomes": f"SELECT * FROM (VALUES {VALUES}) t(rule_no, security_class, security_context, security_impact, score_weight, classification_reason)",
    "c": f"""SELECT n.*, o.*, CASE rule_no WHEN 2 THEN 'suspicious literal token: ' || {LITERAL}
        WHEN 6 THEN 'tooling path escalated due to command execution exploitability signals' WHEN 7 THEN 'tooling path escalated due to command execution exploitability signals'
        WHEN 12 THEN 'no explicit path/rule heuristic matched' END AS classification_detail
      FROM (SELECT *, {RULE} AS rule_at FROM n) n JOIN outcomes o ON rule_at = rule_no""",
    "d": """SELECT c.*, first_tool = tool AS kept, CASE WHEN first_tool <> tool THEN first_fingerprint END AS duplicate_of
      FROM (SELECT *, first_value(tool) OVER w AS first_tool, first_value(fingerprint) OVER w AS first_fingerprint FROM c
            WINDOW w AS (PARTITION BY project, run_id, dedupe_key ORDER BY scanner_ord, finding_ord, tool, fingerprint)) c""",
    "e": f"""SELECT fingerprint, {DIGIT(2)} < 12 AS accepted, CASE WHEN {DIGIT(4)} < 12 THEN 'team' END AS owner,
        CASE WHEN {DIGIT(3)} >= 4 THEN {NOW} + to_days({DIGIT(3)} * 4 - 30) END AS expires_at
      FROM (SELECT DISTINCT fingerprint FROM n WHERE substr(fingerprint, 1, 1) < '4')""",
    "active": f"SELECT fingerprint FROM e WHERE accepted AND (expires_at IS NULL OR expires_at > {NOW})",
    "s": "SELECT * FROM d WHERE kept AND fingerprint NOT IN (SELECT fingerprint FROM active)",
    "m": f"""SELECT project, run_id, tool, category, severity, count(*) AS count,
        round(sum(CASE WHEN category = 'security' THEN greatest(0.0, score_weight) ELSE 1.0 END) + 1e-9, 6) AS weighted_count, CAST({HINT} AS DOUBLE) AS score_hint
      FROM s WHERE category <> 'system/parser' GROUP BY project, run_id, tool, category, severity""",
    "dim": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', CAST({w} AS DOUBLE))" for c, w in CATEGORY_WEIGHT.items()) + ") t(category, weight)",
    "cs": f"""SELECT r.project, r.run_id, r.category, r.weight, CAST(coalesce(sum(count), 0) AS BIGINT) AS finding_count,
        greatest(0.0, least(100.0, 100.0 - coalesce(sum({case('severity', SEVERITY_PENALTY)} * weighted_count * score_hint), 0.0))) AS exact_score
      FROM (SELECT DISTINCT project, run_id, dim.category, weight FROM m, dim) r LEFT JOIN m USING (project, run_id, category) GROUP BY 1, 2, 3, 4""",
    "card": """SELECT *, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade
      FROM (SELECT project, run_id, round(sum(exact_score * weight) + 1e-9, 2) AS overall_score, CAST(sum(finding_count) AS BIGINT) AS finding_count FROM cs GROUP BY 1, 2)""",
    "sec": """SELECT project, run_id, CAST(coalesce(sum(count) FILTER (category = 'security' AND severity = 'critical'), 0) AS BIGINT) AS crit,
        CAST(coalesce(sum(count) FILTER (category = 'security' AND severity = 'high'), 0) AS BIGINT) AS high FROM m GROUP BY 1, 2""",
    "pol": """SELECT *, CASE WHEN crit > 0 OR overall_score < 60 THEN 'fail' WHEN high > 3 OR overall_score < 80 THEN 'warn' ELSE 'pass' END AS status FROM card JOIN sec USING (project, run_id)""",
    "k": f"""SELECT *, CASE WHEN regexp_extract(string_split_regex(lower(trim(rule_id)), '[.:/_\\-]')[1], '^[a-z]+') <> '' THEN regexp_extract(string_split_regex(lower(trim(rule_id)), '[.:/_\\-]')[1], '^[a-z]+')
        ELSE left(string_split_regex(lower(trim(rule_id)), '[.:/_\\-]')[1], 12) END AS rule_family,
        array_to_string(list_slice(string_split({FAMILY}, ' '), 1, 2), ' ') AS message_family, string_split(file, '/')[1] AS file_pattern,
        CASE security_class WHEN 'tooling_security' THEN 'tooling' WHEN 'test_security' THEN 'test_only' WHEN 'false_positive' THEN 'false_positive' ELSE 'runtime' END AS class,
        CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS srank,
        CASE WHEN lower(rule_id) = 'b105' THEN 0.25 WHEN lower(rule_id) IN ('b104', 'b108') THEN 0.9 WHEN tool = 'pyright' THEN 1.0 WHEN confidence >= 0.85 THEN 1.0 WHEN confidence >= 0.5 THEN 0.5 ELSE 0.25 END AS trust
      FROM c""",
}


def cluster_parts(key: str, source: str, name: str, fixed: str = "") -> dict[str, str]:
    """Features and description of groups of k by a key."""
    category = fixed or "category"
    return {
        f"{name}_class": f"""SELECT {key}, arg_max(class, (n, -so, -fo)) AS dominant FROM (
          SELECT {key}, class, count(*) AS n, min((scanner_ord, finding_ord))[1] AS so, min((scanner_ord, finding_ord))[2] AS fo FROM {source} GROUP BY {key}, class) GROUP BY {key}""",
        f"{name}_g": f"""SELECT {key}, CAST(count(*) AS BIGINT) AS n, max(srank) AS srank, sum(trust) / count(*) AS trust, count(DISTINCT file) AS files, list_slice(list_sort(list(DISTINCT file)), 1, 3) AS examples FROM {source} GROUP BY {key}""",
        f"{name}_h": f"""SELECT *, {category} AS cat, CASE srank WHEN 5 THEN 'critical' WHEN 4 THEN 'high' WHEN 3 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END AS severity,
          CASE WHEN n <= 1 THEN 1.0 WHEN n <= 4 THEN 1.2 WHEN n <= 9 THEN 1.5 WHEN n <= 24 THEN 2.0 ELSE 3.0 END AS prevalence, round(trust + 1e-9, 3) AS conf,
          CASE WHEN {category} = 'security' THEN CASE dominant WHEN 'runtime' THEN 2.5 WHEN 'tooling' THEN 0.5 WHEN 'test_only' THEN 0.25 ELSE 0.1 END ELSE CASE {category} WHEN 'typing' THEN 1.2 WHEN 'lint' THEN 0.5 WHEN 'dead_code' THEN 0.3 ELSE 0.6 END END AS exploit,
          CASE WHEN {category} IN ('lint', 'dead_code') AND n <= 8 THEN 0.5 WHEN {category} = 'typing' AND n <= 6 AND files <= 2 THEN 1.0
               WHEN {category} = 'security' THEN CASE WHEN srank = 5 AND n >= 10 THEN 5.0 WHEN n <= 4 THEN 1.0 ELSE 2.0 END
               WHEN n >= 20 OR files >= 8 THEN 5.0 WHEN n >= 6 OR files >= 3 THEN 2.0 ELSE 1.0 END AS cost,
          CASE WHEN files >= 8 OR n >= 20 THEN 'systemic' WHEN files >= 3 THEN 'multi_file' WHEN files = 1 THEN 'single_file' ELSE 'single_line' END AS blast_radius
          FROM {name}_g JOIN {name}_class USING ({key})""",
        f"{name}": f"""SELECT *, round(CAST(CASE srank WHEN 5 THEN 100.0 WHEN 4 THEN 40.0 WHEN 3 THEN 10.0 WHEN 2 THEN 2.0 ELSE 0.5 END AS DOUBLE) * CAST(prevalence AS DOUBLE) * CAST(exploit AS DOUBLE) * CAST(conf AS DOUBLE) / CAST(cost AS DOUBLE) + 1e-9, 1) AS priority_score,
          CASE WHEN cat IN ('dead_code', 'lint', 'typing') AND n <= 8 AND srank <= 3 THEN 'Small' WHEN n >= 20 THEN 'Huge' WHEN srank = 5 OR cat = 'security' THEN CASE WHEN n >= 5 THEN 'Large' ELSE 'Medium' END WHEN n >= 10 THEN 'Large' ELSE 'Medium' END AS effort,
          CASE WHEN srank >= 4 OR blast_radius = 'systemic' THEN 'High' WHEN srank = 3 OR blast_radius = 'multi_file' THEN 'Medium' ELSE 'Low' END AS impact,
          CASE WHEN cat = 'security' THEN dominant || '_security' ELSE cat END || '|' || CASE WHEN prevalence >= 3 THEN 'very_high_prevalence' WHEN prevalence >= 2 THEN 'high_prevalence' WHEN prevalence >= 1.5 THEN 'moderate_prevalence' ELSE 'isolated_prevalence' END
            || '|' || CASE WHEN conf >= 0.85 THEN 'high_confidence' WHEN conf < 0.5 THEN 'low_confidence' ELSE 'medium_confidence' END || '|' || CASE WHEN cost <= 1 THEN 'low_cost' WHEN cost <= 2 THEN 'moderate_cost' ELSE 'high_cost' END AS priority_reason,
          upper(left(severity, 1)) || substr(severity, 2) AS named FROM {name}_h""",
    }


PARTS |= cluster_parts("project, run_id, category, rule_family, message_family, file_pattern", "k", "r")
PARTS["ranked"] = """SELECT *, row_number() OVER (PARTITION BY project, run_id ORDER BY priority_score DESC, srank DESC, n DESC, title, category, rule_family, message_family, file_pattern) AS rank FROM (
  SELECT *, CASE category WHEN 'security' THEN 'Security issue pattern: ' || left(message_family, 45) WHEN 'complexity' THEN 'Complexity hotspots in related modules' WHEN 'typing' THEN 'Typing gaps reduce static safety'
    WHEN 'dead_code' THEN 'Dead code and unused symbols' ELSE named || ' ' || category || ' issue pattern' END AS title,
    CASE category WHEN 'security' THEN 'Apply secure defaults, validate trust boundaries, and add regression tests for exploit paths.' WHEN 'complexity' THEN 'Split high-complexity routines, reduce branch depth, and extract cohesive helpers.'
    WHEN 'typing' THEN 'Add explicit type hints on public APIs and enable stricter type checks for affected modules.' WHEN 'dead_code' THEN 'Remove unused imports, symbols, and dead branches, then rerun lint checks.'
    ELSE 'Standardize remediation for this rule family and enforce with CI checks.' END AS fix FROM r)"""
PARTS["spread"] = """SELECT k.* FROM k JOIN (SELECT project, run_id, category, rule_family, message_family, file_pattern FROM k GROUP BY ALL HAVING count(DISTINCT file) >= 5 OR count(*) >= 10) USING (project, run_id, category, rule_family, message_family, file_pattern)"""
PARTS |= cluster_parts("project, run_id", "spread", "y", "'maintainability'")
PARTS["path"] = "SELECT DISTINCT project, file AS path FROM f"
PARTS["runs"] = "SELECT project, run_id, count(*) AS finding_count FROM f GROUP BY 1, 2"

ACTION = """SELECT project, run_id, list, place, title, priority_score, n AS supporting_findings_count FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY project, run_id, list ORDER BY rank) AS INTEGER) AS place FROM (
    SELECT *, 'top' AS list, 5 AS most FROM ranked
    UNION ALL SELECT *, 'quick_win', 10 FROM ranked WHERE effort = 'Small' AND regexp_matches(lower(title || chr(10) || fix), 'unused|import|dead|type hint|format')
    UNION ALL SELECT *, 'security', 5 FROM ranked WHERE category = 'security'
    UNION ALL SELECT *, 'architecture', 5 FROM ranked WHERE category IN ('complexity', 'maintainability', 'typing'))) WHERE place <= most"""
RUN = "project, run_id"
FINAL = {
    "normalize": "SELECT project, run_id, finding_ord, tool, normalized_message, fingerprint, dedupe_key, native_severity, ownership, CAST(CASE ownership WHEN 'third_party' THEN 0.98 WHEN 'generated' THEN 0.9 ELSE 0.95 END AS DOUBLE) AS ownership_confidence FROM n",
    "classify": "SELECT project, run_id, finding_ord, tool, file, security_class, security_context, security_impact, score_weight, classification_reason, classification_detail FROM c",
    "dedupe": "SELECT project, run_id, finding_ord, tool, fingerprint, kept, duplicate_of FROM d",
    "dedupe_summary": "SELECT project, run_id, tool, count(*) AS total_findings, count(*) FILTER (NOT kept) AS suppressed_count, count(*) FILTER (kept) AS net_findings FROM d GROUP BY ALL",
    "payload_budget": f"""SELECT project, run_id, CAST(sum(size) AS BIGINT) AS payload_bytes, CAST(sum(least(size, allowed)) AS BIGINT) AS payload_used, count(*) FILTER (size > allowed) AS truncated FROM (
      SELECT *, least(48, greatest(0, 2000 - coalesce(sum(least(size, 48)) OVER (PARTITION BY project, run_id ORDER BY {', '.join(c + ' NULLS FIRST' for c in ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS allowed
      FROM (SELECT *, strlen(raw_payload) AS size FROM f)) GROUP BY ALL""",
    "severity_order": "SELECT project, run_id, finding_ord, tool, CAST(rank() OVER (PARTITION BY project, run_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, category, file, rule_id, fingerprint) AS INTEGER) AS place FROM n",
    "baseline_stats": f"""SELECT project, run_id, count(*) AS gross_findings, count(a.fingerprint) AS accepted_debt, count(*) - count(a.fingerprint) AS new_findings,
      (SELECT count(*) FROM active) - count(DISTINCT a.fingerprint) AS resolved_findings, count(*) - count(a.fingerprint) AS scored_findings, (SELECT count(*) FROM e WHERE accepted) AS accepted_entries,
      (SELECT count(*) FROM e WHERE expires_at <= {NOW}) AS expired_entries, (SELECT count(*) FROM e WHERE expires_at > {NOW} AND expires_at <= {NOW} + INTERVAL 14 DAY) AS expiring_soon_entries,
      (SELECT count(*) FROM e WHERE accepted AND owner IS NULL) AS missing_owner_entries FROM n LEFT JOIN active a USING (fingerprint) GROUP BY project, run_id""",
    "baseline_apply": "SELECT project, run_id, tool, count(*) AS new_findings FROM n WHERE fingerprint NOT IN (SELECT fingerprint FROM active) GROUP BY ALL",
    "metrics": "SELECT * FROM m",
    "category_scores": "SELECT project, run_id, category, finding_count, round(exact_score + 1e-9, 2) AS score, weight FROM cs",
    "scorecard": "SELECT * FROM card",
    "policy": """SELECT project, run_id, overall_score, crit AS critical_security_findings, high AS high_security_findings, status,
      concat_ws(',', CASE WHEN crit > 0 THEN 'critical_security_finding' END, CASE WHEN high > 3 THEN 'high_security_findings' END, CASE WHEN overall_score < 80 THEN 'low_score' END) AS reasons,
      concat_ws(';', CASE WHEN crit > 0 THEN 'critical security findings present' END, CASE WHEN overall_score < 60 THEN 'overall score below 60' END) AS violations,
      concat_ws(';', CASE WHEN high > 3 THEN 'high security findings exceed threshold (' || high || ' > 3)' END, CASE WHEN overall_score < 80 THEN 'overall score below 80' END) AS warnings,
      CASE status WHEN 'fail' THEN 'Quality policy failed' WHEN 'warn' THEN 'Quality policy warning' ELSE 'Quality policy passed' END AS summary FROM pol""",
    "recommendations": """SELECT project, run_id, category, rule_family, message_family, file_pattern, severity, n AS supporting_findings_count, files AS file_count, priority_score, priority_reason, effort, impact,
      CASE WHEN priority_score >= 120 THEN 'Critical' WHEN priority_score >= 40 THEN 'High' WHEN priority_score >= 10 THEN 'Medium' ELSE 'Low' END AS priority, blast_radius, title, named || ' ' || replace(category, '_', ' ') || ' findings with ' || replace(blast_radius, '_', ' ') || ' impact increase delivery and reliability risk.' AS why, fix AS recommended_fix, examples[1] AS "where", array_to_string(examples, ',') AS example_files, CAST(rank AS INTEGER) AS rank FROM ranked""",
    "action_plan": ACTION,
    "executive_summary": f"""SELECT project, run_id, overall_score, previous_score, top_title, coalesce(quick_wins, 0) AS quick_wins, coalesce(systemic, 0) AS systemic,
      'Project health is ' || CASE WHEN overall_score >= 85 THEN 'Good' WHEN overall_score >= 70 THEN 'Fair' ELSE 'Needs Improvement' END || '. The highest priority issue is ' || coalesce(top_title, 'no critical findings') || '. ' || coalesce(quick_wins, 0)
      || ' quick wins can be completed in under one hour. ' || coalesce(systemic, 0) || ' systemic maintainability concern(s) affect multiple modules.'
      || CASE WHEN coalesce(previous_score, 0) = 0 THEN '' WHEN overall_score >= previous_score THEN ' Score has improved since the previous run.' ELSE ' Score has declined since the previous run.' END AS executive_summary
      FROM (SELECT project, run_id, overall_score, lag(overall_score) OVER (PARTITION BY project ORDER BY run_id) AS previous_score FROM card) t
      LEFT JOIN (SELECT project, run_id, max(title) FILTER (list = 'top' AND place = 1) AS top_title, CAST(count(*) FILTER (list = 'quick_win') AS BIGINT) AS quick_wins FROM ({ACTION}) GROUP BY ALL) a USING (project, run_id)
      LEFT JOIN (SELECT project, run_id, CAST(count(*) AS BIGINT) AS systemic FROM y GROUP BY ALL) s2 USING (project, run_id)""",
    "systemic": "SELECT project, run_id, severity, n AS supporting_findings_count, files AS file_count, priority_score, effort, impact, 'Repeated issue patterns across modules' AS title FROM y",
    "trend": "SELECT project, run_id, overall_score, previous_score, round(overall_score - previous_score + 1e-9, 2) AS trend_delta FROM (SELECT *, lag(overall_score) OVER (PARTITION BY project ORDER BY run_id) AS previous_score FROM card)",
    "latest": "SELECT project, run_id, overall_score, grade, status FROM pol QUALIFY row_number() OVER (PARTITION BY project ORDER BY run_id DESC) = 1",
    "portfolio": "SELECT count(*) AS project_count, count(*) FILTER (status = 'pass') AS pass_count, count(*) FILTER (status = 'warn') AS warn_count, count(*) FILTER (status = 'fail') AS fail_count, round(avg(overall_score) + 1e-9, 2) AS average_score FROM (SELECT * FROM pol QUALIFY row_number() OVER (PARTITION BY project ORDER BY run_id DESC) = 1)",
    "prune_keep": "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY project ORDER BY run_id DESC) > 10",
    "prune_older": f"""SELECT project, run_id, finding_count FROM (SELECT *, max(run_id) OVER (PARTITION BY project) AS last FROM runs)
      WHERE run_id <> last AND make_timestamp(CAST(substr(run_id, 1, 4) AS BIGINT), CAST(substr(run_id, 7, 1) AS BIGINT) * 3 - 2, 1, 0, 0, 0) < {NOW} - INTERVAL 400 DAY""",
    "severity_counts": "SELECT project, run_id, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITY_PENALTY) + " FROM f GROUP BY ALL",
    "affected_files": "SELECT project, run_id, file, count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id ORDER BY count DESC, file) AS rank FROM (SELECT project, run_id, file, count(*) AS count FROM f GROUP BY ALL)) WHERE rank <= 10",
    "rule_families": "SELECT project, run_id, rule_family, count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id ORDER BY count DESC, rule_family) AS rank FROM (SELECT project, run_id, string_split_regex(lower(rule_id), '[.:/_]')[1] AS rule_family, count(*) AS count FROM f GROUP BY ALL)) WHERE rank <= 12",
    "portal_clusters": """SELECT project, run_id, severity, category, message_family, CAST(count AS BIGINT) AS count, example_files, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY project, run_id ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, count DESC, category, message_family) AS rank FROM (
        SELECT project, run_id, severity, category, message_family, sum(n) AS count, array_to_string(list_sort(list(file) FILTER (nth <= 3)), ',') AS example_files FROM (
          SELECT *, row_number() OVER (PARTITION BY project, run_id, severity, category, message_family ORDER BY so, fo, file) AS nth FROM (
            SELECT project, run_id, severity, category, array_to_string(list_slice(string_split(lower(trim(normalized_message)), ' '), 1, 2), ' ') AS message_family, file, count(*) AS n,
              min((scanner_ord, finding_ord))[1] AS so, min((scanner_ord, finding_ord))[2] AS fo FROM n GROUP BY ALL)) GROUP BY ALL)) WHERE rank <= 40""",
    "security_groups": "SELECT project, run_id, g AS security_group, count(*) FILTER (category = 'security' AND grp = g) AS count FROM (SELECT *, CASE security_class WHEN 'tooling_security' THEN 'tooling' WHEN 'test_security' THEN 'test_only' WHEN 'false_positive' THEN 'false_positive' ELSE 'runtime' END AS grp FROM c), (SELECT unnest(['runtime', 'tooling', 'test_only', 'false_positive']) AS g) GROUP BY ALL",
    "security_summary": f"""SELECT project, run_id, 'class' AS kind, v AS value, count(*) FILTER (category = 'security' AND security_class = v) AS count FROM c, (SELECT unnest([{', '.join(map(quoted, CLASSES))}]) AS v) GROUP BY ALL
      UNION ALL SELECT project, run_id, 'context', v, count(*) FILTER (category = 'security' AND security_context = v) FROM c, (SELECT unnest([{', '.join(map(quoted, CONTEXTS))}]) AS v) GROUP BY ALL""",
    "parser_summary": "SELECT project, run_id, rule_id, tool AS scanner, count(*) AS count FROM f WHERE category = 'system/parser' GROUP BY GROUPING SETS ((project, run_id, rule_id, tool), (project, run_id, rule_id))",
    "raw_samples": "SELECT project, run_id, tool, CAST(nth AS INTEGER) AS nth, rule_id, file, line, message FROM (SELECT *, row_number() OVER (PARTITION BY project, run_id, tool ORDER BY finding_ord, rule_id, file, message) AS nth FROM f) WHERE nth <= 5",
    "inventory": """SELECT project, count(*) AS files_seen, count(*) FILTER (NOT x AND NOT t AND NOT g) AS first_party, count(*) FILTER (NOT x AND t) AS third_party, count(*) FILTER (NOT x AND NOT t AND g) AS generated, count(*) FILTER (x) AS excluded
      FROM (SELECT *, starts_with(path, 'docs/m1') AS x, regexp_matches(path, 'node_modules/|vendor/|third_party/') AS t, regexp_matches(path, '/generated/|/dist/|/build/|_generated') AS g FROM path) GROUP BY project""",
    "zones": """SELECT project, count(*) FILTER (s) AS tracked, count(*) FILTER (NOT tr AND NOT deny) AS ignored_sensitive, count(*) FILTER (s AND starts_with(path, 'docs/')) AS docs, count(*) FILTER (s AND path LIKE '%fixtures/%') AS fixtures,
      count(*) FILTER (s AND regexp_matches(path, 'node_modules/|vendor/|third_party/')) AS third_party, count(*) FILTER (s AND regexp_matches(path, '/generated/|/dist/|/build/|_generated')) AS generated, count(*) FILTER (deny) AS excluded
      FROM (SELECT *, tr AND NOT deny AS s FROM (SELECT *, NOT ends_with(path, 'm2.py') AS tr, starts_with(path, 'lib/') AS deny FROM path)) GROUP BY project""",
    "parse_reports": f"""SELECT project, tool, rule_id, sev AS severity, cat AS category, file, line, count(*) AS count, CAST(0 AS BIGINT) AS problems FROM (
      SELECT *, CASE tool WHEN 'bandit' THEN CASE severity WHEN 'high' THEN 'high' WHEN 'low' THEN 'low' ELSE 'medium' END
          WHEN 'ruff' THEN CASE WHEN starts_with(rule_id, 'S') THEN 'high' WHEN starts_with(rule_id, 'W') THEN 'low' ELSE 'medium' END ELSE 'medium' END AS sev,
        CASE tool WHEN 'bandit' THEN 'security' WHEN 'ruff' THEN CASE WHEN rule_id = 'F401' THEN 'dead_code' WHEN starts_with(rule_id, 'S') THEN 'security' WHEN starts_with(rule_id, 'C90') THEN 'maintainability' ELSE 'lint' END ELSE 'lint' END AS cat
      FROM f WHERE tool IN ('ruff', 'bandit', 'opengrep')) GROUP BY ALL""",
}


def sql() -> dict[str, str]:
    """Each query with the parts that it needs, in order."""
    out = {}
    for name, final in (FINAL | oracle_scan.FINAL | oracle_extend.FINAL).items():
        known = PARTS | oracle_scan.PARTS | oracle_extend.PARTS | oracle_scan.OWN.get(name, {})
        needed, todo = set(), [final]
        while todo:
            found = {p for p in re.findall(r"(?:FROM|JOIN|,)\s+(\w+)", todo.pop()) if p in known} - needed
            needed |= found
            todo += [known[p] for p in found]
        parts = ",\n".join(f"{p} AS ({known[p]})" for p in known if p in needed)
        out[name] = f"WITH {parts}\n{final}" if parts else final
    return out
