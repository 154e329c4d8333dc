"""Rules on the text of files, as row expressions: no file is capped or cut."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import glob_to_regex


@dataclass(frozen=True)
class Rule:
    """A pattern in files whose names globs name; negated rules fire where it is missing."""

    tool: str
    rule_id: str
    severity: str
    pattern: str
    message: str
    negated: bool = False
    #: Whether the line where the first match starts is told; else it is line 1.
    located: bool = False
    category: str = "security"
    language: str = "general"
    #: A pattern that clears the file.
    cleared_by: str = ""


# The names of the files that each tool reads, its rules, and their messages.
FILES = {
    "dockerfile_scan": ("Dockerfile", "Containerfile"),
    "compose_scan": ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"),
    "quadlet_scan": ("*.container", "*.kube", "*.volume", "*.network"),
    "reverse_proxy_scan": ("*traefik*.yml", "*traefik*.yaml", "nginx.conf", "*.nginx.conf", "httpd.conf", "apache2.conf"),
    "terraform_scan": ("*.tf",),
    "django_settings_scan": ("settings.py",),
    "django_orm_health": ("*.py",),
    "django_template_scan": ("*.html",),
}
RULES = [
    Rule("dockerfile_scan", "INF.CONTAINER.USER_ROOT", "high", r"(?mi)^\s*USER\s+root\b", "Container runs as root"),
    Rule("dockerfile_scan", "INF.CONTAINER.HEALTHCHECK_MISSING", "low", r"(?mi)^\s*HEALTHCHECK\b", "Missing HEALTHCHECK", negated=True),
    Rule("dockerfile_scan", "INF.CONTAINER.ADD_USAGE", "low", r"(?mi)^\s*ADD\s+", "Prefer COPY over ADD"),
    Rule("compose_scan", "INF.COMPOSE.PRIVILEGED", "high", r"(?mi)^\s*privileged:\s*true\b", "Privileged container enabled"),
    Rule("compose_scan", "INF.COMPOSE.PORT_EXPOSED", "medium", r"(?mi)^\s*ports:\s*$", "Ports exposed to host"),
    Rule("compose_scan", "INF.COMPOSE.HOST_NETWORK", "high", r"(?mi)^\s*network_mode:\s*host\b", "Host network mode enabled"),
    Rule("quadlet_scan", "INF.QUADLET.PORT_EXPOSED", "medium", r"(?mi)^\s*PublishPort\s*=\s*", "Published port in quadlet"),
    Rule("quadlet_scan", "INF.QUADLET.ROOT_USER", "high", r"(?mi)^\s*User\s*=\s*root\b", "Quadlet configured with root user"),
    Rule("reverse_proxy_scan", "INF.PROXY.LEGACY_TLS", "high", r"(?i)ssl_protocols\s+TLSv1\b", "Legacy TLS protocol enabled"),
    Rule("reverse_proxy_scan", "INF.PROXY.SERVER_TOKENS", "low", r"(?i)server_tokens\s+on\b", "Server version disclosure enabled"),
    Rule("reverse_proxy_scan", "INF.PROXY.INSECURE_UPSTREAM_TLS", "high", r"(?i)insecureSkipVerify\s*:\s*true\b", "Insecure upstream TLS verify disabled"),
    Rule("terraform_scan", "INF.TF.OPEN_WORLD", "high", r"(?mi)0\.0\.0\.0/0", "Open world CIDR detected"),
    Rule("terraform_scan", "INF.TF.PUBLIC_RESOURCE", "medium", r"(?mi)public\s*=\s*true\b", "Public resource exposure"),
    Rule("terraform_scan", "INF.TF.ENCRYPTION_DISABLED", "high", r"(?mi)encrypted\s*=\s*false\b", "Encryption disabled"),
    Rule("django_settings_scan", "DJG.SET.DEBUG_TRUE", "high", r"(?m)^\s*DEBUG\s*=\s*True\b", "DEBUG should be False in production", located=True, language="python"),
    Rule("django_settings_scan", "DJG.SET.ALLOWED_HOSTS_EMPTY", "medium", r"(?m)^\s*ALLOWED_HOSTS\s*=\s*\[\s*\]\s*$", "ALLOWED_HOSTS is empty", located=True, language="python"),
    Rule("django_settings_scan", "DJG.SET.SECURE_PROXY_SSL_HEADER_MISSING", "low", r"SECURE_PROXY_SSL_HEADER", "SECURE_PROXY_SSL_HEADER not configured", negated=True, language="python"),
    Rule("django_orm_health", "DJG.ORM.RAW_SQL_USAGE", "medium", r"\.raw\(", "Raw SQL usage detected; verify parameterization", located=True, category="maintainability", language="python"),
    Rule("django_orm_health", "DJG.ORM.RELATED_FETCH_MISSING", "low", r"\.all\(\)", "QuerySet iteration without select_related/prefetch_related", located=True, category="maintainability", language="python", cleared_by=r"(?:select|prefetch)_related\("),
    Rule("django_template_scan", "DJG.TPL.AUTOESCAPE_OFF", "high", r"(?i)\{%\s*autoescape\s+off\s*%\}", "Template disables autoescape", located=True, language="python"),
]
FORM_RULE = Rule("django_template_scan", "DJG.TPL.CSRF_TOKEN_MISSING", "medium", r"(?is)<form\b[^>]*>.*?</form\s*>", "POST form appears without CSRF protection", located=True, language="python")
#: The method of a form, in quotes that match; and what shows that a form is protected.
FORM_METHOD = r"(?i)\bmethod\s*=\s*([\"'])?\s*([a-zA-Z]+)\s*\1"
CSRF_EVIDENCE = [
    r"\{%\s*csrf_token\s*%\}",
    r"\{\{\s*csrf_token\s*\}\}",
    r"\{\{\s*csrf_input\s*\(\s*\)\s*\}\}",
    r"<input[^>]*type\s*=\s*([\"'])hidden\1[^>]*name\s*=\s*([\"'])csrf_token\2",
    r"<input[^>]*name\s*=\s*([\"'])csrf_token\1[^>]*type\s*=\s*([\"'])hidden\2",
    r"\{%\s*include\s+[\"'][^\"']*csrf[^\"']*[\"']",
    r"\{%\s*from\s+[\"'][^\"']+[\"']\s+import\s+[^%]*csrf",
    r"\{\{[^}]*csrf[^}]*\(\s*\)\s*\}\}",
]
#: Templates lie under a folder of this name; parts of a path that exempt one.
TEMPLATES = r"(^|/)templates/"
EXEMPT = ["/test", "/doc", "/example"]
#: The scalar metrics that count the files read.
COUNTS = {"dockerfile_scan": "dockerfile_count", "compose_scan": "compose_file_count", "quadlet_scan": "quadlet_count", "reverse_proxy_scan": "proxy_config_count", "terraform_scan": "terraform_file_count"}


def reads(tool: str, path: Column) -> Column:
    """Whether a tool reads the file of a path."""
    name = F.substring_index(path, "/", -1)
    held = name.rlike("|".join(f"(?:{glob_to_regex(g)})" for g in FILES[tool]))
    if tool != "django_template_scan":
        return held
    lowered = F.lower(path)
    return held & path.rlike(TEMPLATES) & ~(lowered.contains(EXEMPT[0]) | lowered.contains(EXEMPT[1]) | lowered.contains(EXEMPT[2]))


def java(pattern: str) -> str:
    """The pattern with lines ending in a line feed only."""
    return f"(?d){pattern}"


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_of(text: Column, pattern: str) -> Column:
    """The line where the first match of a pattern starts; null if there is none."""
    before = F.regexp_extract(text, rf"(?s)\A(.*?)(?:(?-s){java(pattern)})", 1)
    return F.when(F.regexp_like(text, F.lit(java(pattern))), newlines(before) + 1)


def open_forms(text: Column) -> Column:
    """The lines where the forms start that post without protection."""
    pattern = java(FORM_RULE.pattern)
    forms, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    opening = lambda form: F.regexp_extract(form, r"(?is)<form\b([^>]*)>", 1)
    posts = lambda form: F.lower(F.regexp_extract(opening(form), FORM_METHOD, 2)) == "post"
    protected = lambda form: any_of([F.regexp_like(form, F.lit(f"(?i){p}")) for p in CSRF_EVIDENCE])
    lines = lambda parts, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda sofar, x: sofar + newlines(x))
    found = F.transform(forms, lambda form, i: F.struct(form.alias("form"), (lines(gaps, i + 1) + lines(forms, i) + 1).alias("line")))
    return F.transform(F.filter(found, lambda x: posts(x["form"]) & ~protected(x["form"])), lambda x: x["line"])


def any_of(flags: list[Column]) -> Column:
    held = flags[0]
    for flag in flags[1:]:
        held = held | flag
    return held


def hit(r: Rule, line: Column) -> Column:
    return F.struct(*(F.lit(x).alias(n) for n, x in (("tool", r.tool), ("rule_id", r.rule_id), ("severity", r.severity), ("category", r.category), ("language", r.language), ("message", r.message))), line.alias("line"))


def scan(files: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Hits of the rules in files (project, path, text): tool, rule_id, severity, file, line, message."""
    text, path, hits = F.coalesce("text", F.lit("")), F.col("path"), []
    for r in rules:
        found = F.regexp_like(text, F.lit(java(r.pattern)))
        if r.cleared_by:
            found = found & ~F.regexp_like(text, F.lit(r.cleared_by))
        line = line_of(text, r.pattern) if r.located and not r.negated else F.lit(1)
        hits.append(F.when(reads(r.tool, path) & (~found if r.negated else found), hit(r, line)))
    forms = F.when(reads(FORM_RULE.tool, path), F.transform(open_forms(text), lambda line: hit(FORM_RULE, line)))
    every = F.concat(F.array_compact(F.array(*hits)), F.coalesce(forms, F.filter(F.array(hit(FORM_RULE, F.lit(1))), lambda x: F.lit(False))))
    return files.select("project", path.alias("file"), F.explode(every).alias("h")).select("project", "file", "h.*")


def file_counts(files: DataFrame) -> DataFrame:
    """The files that each of the infrastructure tools reads, one scalar metric each, a row a project."""
    return files.groupBy("project").agg(*(F.count_if(reads(tool, F.col("path"))).alias(name) for tool, name in COUNTS.items()))
