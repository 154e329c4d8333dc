"""DuckDB SQL for the queries of queries_extend. It reads order lines, never the reports or files that the
queries make of them."""

from __future__ import annotations

from verdigris.schemas import DEPENDENCY_TOOLS
from verdigris.sources.derived import DJANGO_RULES, FILE_RULES, JAVA_RULES
from verdigris.sources.made_reports import expected_sql

#: A team's reports: entries, and which report is unsound and why. The greatest problem holds.
TEAM = """SELECT k, k % 4 AS kind, nr, file, text, level, 'p' || (k % 5) AS project, CAST(k AS varchar) AS run_id, ['team_lint', 'team_text', 'ruff', 'unheard_of'][CAST(k % 4 + 1 AS int)] AS tool,
    CASE WHEN k % 4 = 0 AND k % 47 = 3 AND nr = 1 THEN 'SCHEMA_ERROR' WHEN k % 4 = 0 AND k % 53 = 5 AND nr = 1 THEN 'SCHEMA_ERROR' WHEN k % 4 = 1 AND k % 43 = 2 AND nr = 1 THEN 'SCHEMA_ERROR' WHEN k % 4 = 1 AND k % 41 = 1 AND nr = 1 THEN 'UNHANDLED'
      WHEN starts_with(file, '../') THEN 'INVALID_PATH' END AS problem
  FROM (SELECT l_orderkey AS k, CAST(l_linenumber AS int) AS nr, CASE WHEN l_orderkey % 61 = 7 AND l_linenumber = 1 THEN '../' ELSE 'src/' END || l_suppkey || '.py' AS file, 'part ' || l_partkey AS text, l_partkey % 3 AS level FROM lineitem) x"""
#: Reports whose function or form fails as a whole show no other problem.
JUDGED = """SELECT project, run_id, tool, kind, k, count(*) AS entries, CASE WHEN kind = 1 AND bool_or(k % 43 = 2 AND nr = 1) THEN 'SCHEMA_ERROR' WHEN kind = 1 AND bool_or(k % 41 = 1 AND nr = 1) THEN 'UNHANDLED'
    WHEN kind = 0 AND bool_or(k % 47 = 3 AND nr = 1) THEN 'SCHEMA_ERROR' ELSE max(problem) END AS problem FROM team GROUP BY project, run_id, tool, kind, k"""
PARTS = {"team": TEAM, "judged": JUDGED}

FINDING = """SELECT t.project, t.run_id, t.tool, CASE t.kind WHEN 0 THEN 'TEAM.c' || level WHEN 1 THEN 'TEXT.1' ELSE 'F401' END AS rule_id, CASE t.kind WHEN 0 THEN CASE level WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END WHEN 1 THEN 'low' ELSE 'medium' END AS severity,
    CASE t.kind WHEN 0 THEN 'lint' WHEN 1 THEN 'typing' ELSE 'dead_code' END AS category, file, nr AS line, text AS message FROM team t JOIN judged j USING (k) WHERE j.problem IS NULL AND t.kind < 3"""
HINT = f"CASE WHEN tool IN ({', '.join(repr(t) for t in DEPENDENCY_TOOLS)}) THEN 1.4 WHEN tool = 'bandit' THEN 1.5 WHEN category = 'security' THEN 1.2 WHEN category = 'dead_code' THEN 0.8 WHEN category = 'lint' THEN 0.75 ELSE 1.0 END"
PARTS |= {
    "pr": "SELECT project, run_id, CASE tool WHEN 'pyright' THEN 'pmd' WHEN 'npm_audit' THEN 'team_audit' ELSE tool END AS tool, category, severity, score_weight FROM c",
    "prun": "SELECT project, run_id, tool, count(*) AS n FROM pr GROUP BY ALL",
    "pmet": f"""SELECT project, run_id, tool, category, severity, count, weighted_count, CAST({HINT} AS DOUBLE) AS score_hint, CAST(NULL AS varchar) AS scalar_name, CAST(NULL AS DOUBLE) AS scalar_value FROM (
        SELECT project, run_id, tool, category, severity, count(*) AS count, round(sum(CASE WHEN category = 'security' THEN greatest(0.0, score_weight) ELSE 1.0 END) + 1e-9, 6) AS weighted_count
        FROM pr JOIN prun USING (project, run_id, tool) WHERE n % 7 <> 0 AND tool <> 'opengrep' AND category <> 'system/parser' GROUP BY ALL) q
      UNION ALL SELECT project, run_id, tool, category, severity, count(*), CAST(2.0 * count(*) AS DOUBLE), CAST(1.0 AS DOUBLE), NULL, NULL FROM pr JOIN prun USING (project, run_id, tool) WHERE n % 7 <> 0 AND tool = 'opengrep' AND severity = 'critical' AND category <> 'system/parser' GROUP BY ALL
      UNION ALL SELECT project, run_id, tool, 'maintainability', 'info', 1, 1.0, 1.0, 'duplication_percent', CAST(least(100, n % 150) AS DOUBLE) FROM prun WHERE n % 7 <> 0 AND tool = 'pmd'
      UNION ALL SELECT project, run_id, tool, 'coverage', 'info', 1, 1.0, 1.0, 'coverage_percent', CAST(n % 90 AS DOUBLE) FROM prun WHERE n % 7 <> 0 AND tool = 'pmd'""",
    "pscore": """SELECT x.project, x.run_id, w.weight, coalesce(sum(count) FILTER (scalar_name IS DISTINCT FROM 'coverage_percent'), 0) AS found,
        coalesce(max(scalar_value) FILTER (scalar_name = 'coverage_percent'), greatest(0.0, least(100.0, 100.0 - coalesce(sum(CASE severity WHEN 'critical' THEN 18.0 WHEN 'high' THEN 10.0 WHEN 'medium' THEN 5.0 WHEN 'low' THEN 2.0 ELSE 0.0 END * weighted_count * score_hint) FILTER (scalar_name IS DISTINCT FROM 'coverage_percent'), 0.0)))) AS score
      FROM (SELECT DISTINCT project, run_id FROM pmet) x CROSS JOIN (VALUES ('security', 0.30), ('typing', 0.10), ('lint', 0.15), ('maintainability', 0.15), ('complexity', 0.10), ('dead_code', 0.10), ('coverage', 0.10)) w(category, weight)
      LEFT JOIN pmet ON pmet.project = x.project AND pmet.run_id = x.run_id AND pmet.category = w.category GROUP BY x.project, x.run_id, w.category, w.weight""",
    "sev": "SELECT project, run_id, file, severity FROM c",
}
PAGE = 500
TOLD = "(SELECT string_agg(reason || '=' || n, ' ' ORDER BY reason) FROM (SELECT left(o_orderpriority, 1) || '_hash_changed' AS reason, count(*) AS n FROM cached z WHERE z.o_orderkey % 2 = 1 AND z.project = {0}.project AND z.run_id = {0}.run_id{1} GROUP BY 1) q)"
PARTS["zin"] = f"SELECT *, NOT ends_with(path, '.key') AND project <> 'p3' AS tracked FROM (SELECT project, path || CASE WHEN ends_with(path, 'settings.py') THEN '.key' ELSE '' END AS path FROM ({FILE_RULES.format(text='varchar')}) x) y"
PARTS["win"] = "SELECT * FROM (VALUES ('ruff', '[.]py$'), ('gitleaks', ''), ('eslint', '[.](js|jsx|ts|tsx)$'), ('opengrep_infra', '')) v(scanner, pattern)"
PARTS["jf"] = f"SELECT *, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS folder, regexp_extract(path, '[^/]*$') AS name FROM ({JAVA_RULES.format(text='varchar')}) x"
PARTS["jb"] = """SELECT project, folder, name, text FROM jf WHERE name IN ('pom.xml', 'build.gradle', 'build.gradle.kts', 'settings.gradle', 'settings.gradle.kts')"""
PARTS["jfw"] = """SELECT * FROM (VALUES (1, 'spring', '(?i)org[.]springframework'), (2, 'spring_boot', '(?i)spring-boot|org[.]springframework[.]boot'), (3, 'micronaut', '(?i)io[.]micronaut'), (4, 'quarkus', '(?i)io[.]quarkus'), (5, 'jakarta_ee', '(?i)jakarta[.][a-z0-9_.-]+')) v(nth, framework, pattern)"""
PARTS["jhit"] = "SELECT jb.project, folder, name, nth, framework FROM jb JOIN jfw ON regexp_matches(text, pattern)"
PARTS["df"] = f"SELECT *, NOT starts_with(path, 'node_modules/') AS seen, regexp_extract(path, '[^/]*$') AS name FROM ({DJANGO_RULES.format(text='varchar')}) x"
PARTS["dj"] = """SELECT project, bool_or(path = 'manage.py') AS manage_py, bool_or(path = 'manage.py' AND contains(lower(text), 'django')) AS in_manage, bool_or(path = 'requirements.txt' AND contains(lower(text), 'django')) AS in_req, bool_or(path = 'pyproject.toml' AND contains(lower(text), 'django')) AS in_toml,
    bool_or(seen AND ends_with(path, '.py') AND contains(text, 'from django')) AS imports, bool_or(seen AND name = 'settings.py') AS settings, bool_or(seen AND name = 'settings.py' AND contains(text, 'DEBUG =')) AS hard, count(*) FILTER (seen AND path LIKE '%/templates/%.html') AS templates,
    bool_or(seen AND name = 'consumers.py' AND contains(text, 'rest_framework')) AS drf, bool_or(seen AND name = 'consumers.py' AND (contains(text, 'channels') OR contains(text, 'daphne'))) AS channels, bool_or(seen AND name = 'consumers.py' AND contains(text, 'models.')) AS orm,
    string_agg(path, ',' ORDER BY path) FILTER (seen AND name = 'settings.py' AND nth <= 50) AS files FROM (SELECT *, row_number() OVER (PARTITION BY project, seen AND name = 'settings.py' ORDER BY path) AS nth FROM df) y GROUP BY project"""
PARTS["cached"] = "SELECT *, 'p' || (o_custkey % 7) AS project, 'r' || (o_custkey % 31) AS run_id, ['pmd', 'spotbugs', 'checkstyle'][CAST(o_orderkey % 3 + 1 AS int)] AS tool FROM orders"
PARTS["ptab"] = "SELECT project, CAST(CAST(run_id AS bigint) % 40 AS varchar) AS run_id, tool, kind, problem, entries FROM judged"

FINAL = {
    "parse_dialects": expected_sql(),
    "own_readers": f"""{FINDING} UNION ALL SELECT project, run_id, 'verdigris', 'PARSER.' || problem, 'medium', 'system/parser', 'scanners/' || tool, NULL, NULL FROM judged WHERE problem IS NOT NULL AND kind < 3""",
    "reader_outcomes": """SELECT project, run_id, tool, kind < 3 AS success, CASE WHEN kind = 3 THEN 'scanner_parser_missing' END AS error_code, CAST(CASE WHEN kind = 3 THEN 0 WHEN problem IS NOT NULL THEN 1 ELSE entries END AS BIGINT) AS finding_count,
      CAST(CASE WHEN kind < 3 AND problem IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS invalid_finding_count, CASE WHEN kind < 3 THEN problem END AS problem, CASE kind WHEN 0 THEN 'team_lint_reader' WHEN 1 THEN 'team_text_reader' WHEN 2 THEN 'ruff_parser' ELSE 'unheard_of_parser' END AS expected_parser,
      CASE WHEN kind = 3 THEN 'Register parser ''unheard_of_parser'' for scanner ''unheard_of''.' END AS remediation FROM judged""",
    "reader_conflicts": """SELECT tool, reader, registered, count(*) AS count FROM (SELECT p_brand AS tool, 'reader_' || (p_size % 3) AS reader, first_value('reader_' || (p_size % 3)) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS registered FROM part) x WHERE reader <> registered GROUP BY ALL""",
    "own_scanner": """SELECT project, CAST(k % 8 AS varchar) AS run_id, tool, 'TEAM.c' || level AS rule_id, CASE level WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'medium' END AS severity, file, count(*) AS count, min(nr) AS first_line
      FROM team WHERE kind = 0 AND problem IS NULL GROUP BY ALL""",
    "large_reports": """SELECT 'p' || (l_orderkey % 3) AS project, 'r' || (l_orderkey % 2) AS run_id, row_number() OVER (PARTITION BY l_orderkey % 3, l_orderkey % 2 ORDER BY l_orderkey * 8 + l_linenumber, '<file name="src/' || l_suppkey || '.java">' || chr(10) || '<error line="' || l_linenumber || '" severity="' || CASE WHEN l_partkey % 2 = 0 THEN 'error' ELSE 'warning' END || '" message="part ' || l_partkey || '" source="') - 1 AS finding_ord, CASE WHEN l_partkey % 3 = 0 THEN 'x.UnusedImports' ELSE 'x.Brace' END AS rule_id,
      CASE WHEN l_partkey % 2 = 0 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN l_partkey % 3 = 0 THEN 'dead_code' ELSE 'lint' END AS category, 'src/' || l_suppkey || '.java' AS file, CAST(l_linenumber AS int) AS line, 'part ' || l_partkey AS message FROM lineitem""",
    "java_projects": """SELECT m.project, is_java, greatest(modules, 1) AS module_count, modules > 1 AS multi_module, coalesce(fw, '') AS java_frameworks, spring_component_annotations, spring_security_annotations, spring_validation_annotations, spring_jpa_annotations, actuator,
        CASE WHEN mvn THEN 'maven' WHEN gr THEN 'gradle' END AS runner, CASE WHEN mvn THEN CASE WHEN mvnw THEN './mvnw' ELSE 'mvn' END WHEN gr THEN CASE WHEN grw THEN './gradlew' ELSE 'gradle' END END AS command
      FROM (SELECT project, count(DISTINCT folder) FILTER (name IN ('pom.xml', 'build.gradle', 'build.gradle.kts')) AS modules, bool_or(path IN ('pom.xml', 'mvnw', 'build.gradle', 'gradlew')) AS is_java, bool_or(path IN ('pom.xml', 'mvnw')) AS mvn, bool_or(path = 'mvnw') AS mvnw, bool_or(path IN ('build.gradle', 'gradlew')) AS gr, bool_or(path = 'gradlew') AS grw,
          count(*) FILTER (ends_with(path, '.java') AND contains(text, '@RestController')) AS spring_component_annotations, count(*) FILTER (ends_with(path, '.java') AND contains(text, '@PreAuthorize')) AS spring_security_annotations,
          count(*) FILTER (ends_with(path, '.java') AND contains(text, '@Valid')) AS spring_validation_annotations, count(*) FILTER (ends_with(path, '.java') AND contains(text, '@Entity')) AS spring_jpa_annotations, bool_or(ends_with(path, '.java') AND contains(text, '/actuator')) AS actuator FROM jf GROUP BY project) m
      LEFT JOIN (SELECT project, string_agg(framework, ',' ORDER BY nth) AS fw FROM (SELECT DISTINCT project, nth, framework FROM jhit) u GROUP BY project) h USING (project)""",
    "java_evidence": """SELECT project, framework, string_agg(name, ',' ORDER BY place) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY project, framework ORDER BY folder, list_position(['pom.xml', 'build.gradle', 'build.gradle.kts', 'settings.gradle', 'settings.gradle.kts'], name)) AS place FROM jhit) q WHERE place <= 20 GROUP BY project, framework""",
    "java_artifacts": """SELECT project, row_number() OVER (PARTITION BY project ORDER BY module, bug) - 1 AS finding_ord, 'spotbugs' AS tool, 'T' || (l_partkey % 4) AS rule_id, CASE WHEN l_suppkey % 15 <= 4 THEN 'high' WHEN l_suppkey % 15 <= 9 THEN 'medium' ELSE 'low' END AS severity, 'src/' || l_suppkey || '.java' AS file, CAST(l_linenumber AS int) AS line, 'part ' || l_partkey AS message
      FROM (SELECT *, 'p' || (l_orderkey % 5) AS project, 'm' || l_orderkey AS module, '<BugInstance type="T' || (l_partkey % 4) || '" rank="' || (l_suppkey % 15) || '"><LongMessage>part ' || l_partkey || '</LongMessage><SourceLine sourcepath="src/' || l_suppkey || '.java" start="' || l_linenumber || '"' AS bug FROM lineitem) q""",
    "django_projects": """SELECT project, concat_ws(',', CASE WHEN imports THEN 'django_imports' END, CASE WHEN in_manage THEN 'manage.py' END, CASE WHEN in_toml THEN 'pyproject.toml' END, CASE WHEN in_req THEN 'requirements.txt' END, CASE WHEN settings THEN 'settings.py' END) AS django_evidence, drf, channels, orm AS orm_patterns,
      hard AS settings_hardening_markers, manage_py, CAST(templates AS BIGINT) AS template_count, coalesce(files, '') AS settings_files FROM dj WHERE in_manage OR in_req OR in_toml OR imports""",
    "project_profiles": """SELECT project, name, scanners, cards, cache_behavior FROM (
        SELECT project, 'python' AS name FROM df WHERE path IN ('manage.py', 'requirements.txt', 'pyproject.toml') GROUP BY ALL UNION ALL SELECT project, 'django' FROM dj WHERE in_manage OR in_req OR in_toml OR imports
        UNION ALL SELECT project, 'java' FROM jf WHERE path IN ('pom.xml', 'mvnw', 'build.gradle', 'gradlew') GROUP BY ALL) n
      JOIN (VALUES ('python', 'ruff,pyright,coverage,radon,vulture,bandit,opengrep', 'metric_cards,dedupe,baseline', 'stateless'), ('django', 'django_check_deploy,django_settings_scan,django_template_scan,django_orm_health', 'framework_cards', 'stateless'),
        ('java', 'spotbugs,pmd,checkstyle,errorprone,jacoco,dependency_check,opengrep_java', 'java_metrics,java_cache,framework_cards', 'aggressive')) v(name, scanners, cards, cache_behavior) USING (name)""",
    "mapped_rules": """SELECT project, tool, rule_id, severity AS was, CASE WHEN rule_id = 'B105' THEN 'critical' WHEN starts_with(rule_id, 'B1') THEN 'medium' WHEN starts_with(rule_id, 'B') THEN 'low' WHEN starts_with(rule_id, 'GEN') THEN 'high' WHEN starts_with(rule_id, 'S') THEN 'high' ELSE 'info' END AS severity,
      CASE WHEN starts_with(rule_id, 'B') THEN 'security' WHEN starts_with(rule_id, 'GEN.2') THEN 'complexity' WHEN starts_with(rule_id, 'F4') THEN 'dead_code' ELSE 'lint' END AS category, count(*) AS count FROM f GROUP BY ALL""",
    "remapped_dialect": f"""SELECT rule_id, CASE WHEN rule_id = 'S101' THEN 'high' ELSE 'info' END AS severity, CASE WHEN rule_id = 'F401' THEN 'dead_code' ELSE 'lint' END AS category, count(*) AS count FROM ({expected_sql()}) x WHERE tool = 'ruff' GROUP BY ALL""",
    "provider_metrics": "SELECT * FROM pmet",
    "provider_scorecard": """SELECT *, CASE WHEN overall_score >= 90 THEN 'A' WHEN overall_score >= 80 THEN 'B' WHEN overall_score >= 70 THEN 'C' WHEN overall_score >= 60 THEN 'D' ELSE 'F' END AS grade FROM (
      SELECT project, run_id, round(CAST(sum(score * CAST(weight AS DOUBLE)) AS DOUBLE) + 1e-9, 2) AS overall_score, CAST(sum(found) AS BIGINT) AS finding_count FROM pscore GROUP BY ALL) x""",
    "run_manifests": """SELECT project, run_id, CASE WHEN project = 'p1' AND card.grade IS NOT NULL THEN 'X' ELSE card.grade END AS grade, critical, high, medium, low, n AS told, '/projects/' || project || '/runs/' || run_id || '/report.html' AS report_path, n AS found
      FROM (SELECT project, run_id, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low
        FROM f WHERE project <> 'p1' OR tool = 'ruff' GROUP BY ALL) x LEFT JOIN card USING (project, run_id)""",
    "site_pages": f"""SELECT 'projects/' || project || '/runs/' || run_id || '/' || p || '.html' AS path, p AS kind, CAST(NULL AS BIGINT) AS listed FROM (SELECT project, run_id, unnest(['report', 'details']) AS p FROM card) r
      UNION ALL SELECT 'projects/' || project || '/runs/' || run_id || '/security' || CASE WHEN sheet = 1 THEN '' ELSE '-' || sheet END || '.html', 'security', count(*) FROM (
        SELECT project, run_id, (row_number() OVER (PARTITION BY project, run_id) - 1) // {PAGE} + 1 AS sheet FROM c WHERE category = 'security') s GROUP BY project, run_id, sheet
      UNION ALL SELECT 'projects/' || project || '/index.html', 'project', count(*) FROM card GROUP BY project UNION ALL SELECT 'index.html', 'index', NULL""",
    "module_cache_keys": f"""SELECT project AS module_id, sha256('spotbugs|' || project || '|' || string_agg(path || ':' || sha256(text || chr(10)), '|' ORDER BY path)) AS cache_key, count(*) AS input_count FROM ({FILE_RULES.format(text='varchar')}) x GROUP BY project""",
    "parser_table": """SELECT r.project, r.run_id, 'PARSER.' || r.rule_id AS rule_id, r.scanner, CAST(count(j.problem) AS BIGINT) AS count FROM (
    SELECT project, run_id, rule_id, scanner FROM (SELECT DISTINCT project, run_id, unnest(['MISSING_RULE_ID', 'INVALID_PATH', 'BAD_SEVERITY', 'SCHEMA_ERROR', 'OVERSIZE_PAYLOAD', 'UNHANDLED']) AS rule_id FROM ptab WHERE kind < 3) a
    JOIN (SELECT DISTINCT project, run_id, tool AS scanner FROM ptab WHERE problem IS NOT NULL AND kind < 3 UNION SELECT DISTINCT project, run_id, NULL FROM ptab WHERE kind < 3) b USING (project, run_id)) r
  LEFT JOIN (SELECT * FROM ptab WHERE kind < 3) j ON r.project = j.project AND r.run_id = j.run_id AND r.rule_id = j.problem AND (r.scanner IS NULL OR r.scanner = j.tool) GROUP BY ALL""",
    "cache_summary": f"""SELECT project, run_id, CAST(sum(o_orderkey % 5) AS BIGINT) AS cached_modules, CAST(sum(o_orderkey % 4) AS BIGINT) AS cache_hits, CAST(sum(o_orderkey % 2) AS BIGINT) AS cache_misses,
      CASE WHEN sum(o_orderkey % 4 + o_orderkey % 2) > 0 THEN round(sum(o_orderkey % 4) / sum(o_orderkey % 4 + o_orderkey % 2) * 100, 2) END AS hit_rate_percent, coalesce({TOLD.format('t', '')}, '') AS reasons,
      (SELECT string_agg(tool || '/' || hits || '/' || misses || '/' || reasons, ';' ORDER BY tool) FROM (SELECT v.tool, sum(o_orderkey % 4) AS hits, sum(o_orderkey % 2) AS misses, coalesce({TOLD.format('v', ' AND z.tool = v.tool')}, '') AS reasons FROM cached v WHERE v.project = t.project AND v.run_id = t.run_id GROUP BY v.tool, v.project, v.run_id) g) AS tools,
      max(strftime(o_orderdate, '%Y-%m-%d')) AS last_cache_update FROM cached t GROUP BY project, run_id""",
    "scanner_inputs": """SELECT project, scanner, count(*) AS files FROM zin CROSS JOIN win WHERE regexp_matches(regexp_extract(path, '[^/]*$'), pattern)
      AND (tracked OR (scanner = 'gitleaks' AND ends_with(path, '.key')) OR (project = 'p3' AND (scanner <> 'gitleaks' OR NOT EXISTS (SELECT 1 FROM zin q WHERE q.project = 'p3' AND ends_with(q.path, '.key'))))) GROUP BY ALL""",
}
