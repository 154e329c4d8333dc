"""Files of projects: ownership, scan zones, languages and frameworks, and what a scanner gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import matches_any

# Fixed values.
SENSITIVE = [".env", ".env.*", "*.pem", "*.key", "*.p12", "*.pfx", "*.crt", "*.csr", "*.jks", "*.kdbx", "*.ovpn", "*.mobileconfig", "secrets.*", "credentials.*", "oauth*.json", "service-account*.json", "id_rsa", "id_ed25519", "*.sqlite", "*.db"]
JUNK = [".venv/**", "venv/**", "node_modules/**", "vendor/**", "dist/**", "build/**", ".cache/**", ".pytest_cache/**", ".mypy_cache/**", ".ruff_cache/**", ".scan-cache/**", "reports/**", "site/**", "coverage/**", "htmlcov/**", ".git/**", "target/**", ".gradle/**", ".next/**", ".nuxt/**"]
ALWAYS_EXCLUDED = [".venv/**", ".git/**", ".pytest_cache/**", ".ruff_cache/**"]
LANGUAGE_GLOBS = {"general": ["*"], "python": ["*.py"], "php": ["*.php"], "javascript": ["*.js", "*.jsx"], "typescript": ["*.ts", "*.tsx"], "java": ["*.java"], "go": ["*.go"], "yaml": ["*.yml", "*.yaml"], "terraform": ["*.tf", "*.tfvars"]}


def counts(files: DataFrame, excludes: list[str] = []) -> DataFrame:
    """Files of each project (project, path): seen, first and third party, generated, excluded."""
    path = F.lower("path")
    out = matches_any(F.col("path"), [*excludes, *ALWAYS_EXCLUDED])
    third = path.rlike(r"node_modules/|vendor/|third_party/|\.venv/")
    made = path.rlike("/generated/|/dist/|/build/|_generated")
    kinds = {"first_party": ~out & ~third & ~made, "third_party": ~out & third, "generated": ~out & ~third & made, "excluded": out}
    return files.groupBy("project").agg(F.count("*").alias("files_seen"), *(F.count_if(flag).alias(name) for name, flag in kinds.items()))


def effective_patterns(add: list[str] = [], remove: list[str] = []) -> list[str]:
    """The sensitive patterns, less some, with others after them, each once."""
    return list(dict.fromkeys([p for p in SENSITIVE if p not in remove] + add))


def zones(files: DataFrame, excludes: list[str] = [], sensitive: list[str] = SENSITIVE) -> DataFrame:
    """Zone counts of each project's files (project, path, tracked)."""
    path, tracked = F.col("path"), F.col("tracked")
    deny = matches_any(path, [*excludes, *JUNK])
    name = F.substring_index(path, "/", -1)
    scanned, low = tracked & ~deny, F.lower(path)
    kinds = {
        "tracked": scanned, "ignored_sensitive": ~tracked & ~deny & (matches_any(name, sensitive) | matches_any(path, sensitive)), "docs": scanned & path.rlike("^(docs|documentation|Documentation)/"),
        "fixtures": scanned & path.rlike("(^|/)fixtures/"), "third_party": scanned & low.rlike("node_modules/|vendor/|third_party/"),
        "generated": scanned & low.rlike("/generated/|/dist/|/build/|_generated"), "excluded": deny,
    }
    return files.groupBy("project").agg(*(F.count_if(flag).alias(zone) for zone, flag in kinds.items()))


#: Scanners that look for secrets and so read sensitive files that are not tracked, too.
SECRET_SCANNERS = ["gitleaks", "trufflehog", "secrets_heuristic"]


def zoned(files: DataFrame, excludes: list[str] = [], sensitive: list[str] = SENSITIVE) -> DataFrame:
    """Adds the zone of files (project, path, tracked) that scanners choose by: tracked, ignored_sensitive
    or null."""
    deny = matches_any(F.col("path"), [*excludes, *JUNK])
    name = F.substring_index("path", "/", -1)
    secret = matches_any(name, sensitive) | matches_any(F.col("path"), sensitive)
    return files.withColumn("zone", F.when(F.col("tracked") & ~deny, "tracked").when(~F.col("tracked") & ~deny & secret, "ignored_sensitive"))


def scanner_inputs(files: DataFrame, scanners: DataFrame, excludes: list[str] = []) -> DataFrame:
    """(project, scanner, path): for each scanner (scanner, languages array) the files it reads. Files
    with a zone (see zoned()) are chosen by it: tracked ones, for scanners of secrets the sensitive ones
    too; a project without any such file gives all of its files."""
    language = F.array_compact(F.array(*(F.when(matches_any(F.col("path"), globs), name) for name, globs in LANGUAGE_GLOBS.items())))
    able = files.where(~matches_any(F.col("path"), excludes))
    if "zone" not in files.columns:
        able = able.withColumn("zone", F.lit("tracked"))
    able = able.select("project", "path", "zone", F.explode(language).alias("language"))
    secret = F.col("scanner").isin(SECRET_SCANNERS)
    wanted = scanners.select("scanner", secret.alias("secret"), F.explode("languages").alias("language"))
    rows = able.join(wanted, "language")
    fits = (F.col("zone") == "tracked") | (F.col("secret") & (F.col("zone") == "ignored_sensitive"))
    if "zone" in files.columns:
        some = files.groupBy("project").agg(F.max(F.col("zone") == "tracked").alias("__some"), F.max(F.col("zone").isin("tracked", "ignored_sensitive")).alias("__secret"))
        rows = rows.join(some, "project")
        fits = F.coalesce(fits, F.lit(False)) | ~F.coalesce(F.when(F.col("secret"), F.col("__secret")).otherwise(F.col("__some")), F.lit(False))
    return rows.where(fits).select("project", "scanner", "path").distinct()


def with_zones(counted: DataFrame, zoned: DataFrame) -> DataFrame:
    """The inventory of each project with the counts of its zones, which hold where both have one."""
    both = [c for c in counted.columns if c in zoned.columns and c != "project"]
    return counted.drop(*both).join(zoned, "project", "left")


def enabled(scanners: DataFrame, languages: Column, allow: list[str] | None = None, deny: list[str] = []) -> DataFrame:
    """Scanners (scanner, languages) that share a language, are allowed and are not denied."""
    held = F.arrays_overlap(F.col("languages"), languages) & ~F.col("scanner").isin(deny)
    return scanners.where(held & F.col("scanner").isin(allow) if allow is not None else held)
