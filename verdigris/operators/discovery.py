"""What a project is made of, told from its files (project, path, text): languages, frameworks with
confidence, modules, infrastructure. Flags of files add up map-side; no file is capped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import glob_to_regex
from verdigris.schemas import lookup

# Names, markers and patterns that discovery goes by.
IGNORED_PARTS = [".git", ".venv", "venv", "node_modules", ".pytest_cache", ".mypy_cache", ".ruff_cache", "dist", "build", "site-packages"]
PYTHON_MARKERS = ["pyproject.toml", "requirements.txt", "manage.py"]
JAVA_MARKERS = ["pom.xml", "mvnw", "build.gradle", "build.gradle.kts", "gradlew", "settings.gradle", "settings.gradle.kts"]
JAVA_MODULES = ["pom.xml", "build.gradle", "build.gradle.kts"]
JAVA_BUILD_FILES = [*JAVA_MODULES, "settings.gradle", "settings.gradle.kts"]
PYTHON_SIGNALS = {
    "django_import": r"(?i)\b(from\s+django\b|import\s+django\b|django\.)",
    "drf": r"(?i)\b(rest_framework|from\s+rest_framework|import\s+rest_framework)\b",
    "channels": r"(?i)\b(channels|daphne|asgi\.py|ProtocolTypeRouter)\b",
    "orm_patterns": r"(?i)\b(models\.|Model\)|select_related\(|prefetch_related\(|db_index=)",
    "fastapi_import": r"(?i)\b(from\s+fastapi\s+import|import\s+fastapi\b)",
    "fastapi_app": r"\bFastAPI\s*\(",
    "fastapi_router": r"\bAPIRouter\s*\(",
    "flask_import": r"(?i)\b(from\s+flask\s+import|import\s+flask\b)",
    "flask_app": r"\bFlask\s*\(",
    "flask_blueprint": r"\bBlueprint\s*\(",
}
SETTINGS_SIGNAL = r"(?i)\b(DEBUG\s*=|ALLOWED_HOSTS\s*=|SECURE_[A-Z_]+\s*=|CSRF_COOKIE_SECURE\s*=|SESSION_COOKIE_SECURE\s*=)"
JAVA_FRAMEWORKS = {
    "spring": r"(?i)org\.springframework(?:\.boot)?",
    "spring_boot": r"(?i)(spring-boot|org\.springframework\.boot)",
    "micronaut": r"(?i)io\.micronaut",
    "quarkus": r"(?i)io\.quarkus",
    "jakarta_ee": r"(?i)jakarta\.[a-z0-9_.-]+",
}
SPRING_ANNOTATIONS = {
    "spring_component_annotations": r"@(?:RestController|Controller|Service|Component|Repository)\b",
    "spring_security_annotations": r"@(?:PreAuthorize|Secured|RolesAllowed)\b",
    "spring_validation_annotations": r"@(?:Valid|Validated)\b",
    "spring_jpa_annotations": r"@(?:Entity|Table|ManyToOne|OneToMany)\b",
}
SPRING_INDICATORS = {"security_modules": ["spring-security", "@enablewebsecurity"], "actuator": ["spring-boot-starter-actuator", "/actuator"], "jpa_hibernate": ["hibernate", "@entity"]}
JS_FRAMEWORKS = {"angular": ["@angular/core"], "nextjs": ["next"], "node": ["express", "koa", "fastify", "hapi"], "nuxt": ["nuxt"], "react": ["react", "react-dom", "next"], "svelte": ["svelte", "@sveltejs/kit"], "vue": ["vue", "nuxt"]}
JS_DEPENDENCIES = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
INFRASTRUCTURE = {
    "dockerfiles": ("Dockerfile", "Containerfile"),
    "compose": ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml"),
    "quadlets": ("*.container", "*.kube", "*.volume", "*.network"),
    "traefik": ("*traefik*.yml", "*traefik*.yaml", "*traefik*.toml"),
    "apache": ("httpd.conf", "apache2.conf", "*.apache.conf"),
    "nginx": ("nginx.conf", "*.nginx.conf"),
    "terraform": ("*.tf", "*.tfvars"),
    "shell": ("*.sh",),
}
INFRASTRUCTURE_KINDS = {"containers": ["dockerfiles"], "orchestration": ["compose", "quadlets"], "reverse_proxy": ["apache", "nginx", "traefik"], "shell": ["shell"], "terraform": ["terraform"]}
CONFIG_MARKERS = [
    "pyproject.toml", "ruff.toml", ".ruff.toml", "pyrightconfig.json", ".bandit", "setup.cfg", "tox.ini", "eslint.config.js", "eslint.config.cjs", "eslint.config.mjs", "eslint.config.ts", "tsconfig.json", "pom.xml",
    "build.gradle", "build.gradle.kts", "checkstyle.xml", "spotbugs-exclude.xml", "phpstan.neon", "phpstan.neon.dist", "psalm.xml", "composer.json", "go.mod", ".golangci.yml", ".golangci.yaml",
]
#: Files of a group that a report names.
NAMED = 100


def named(globs: tuple[str, ...]) -> Column:
    """Whether a file's name matches any of the globs."""
    return F.substring_index("path", "/", -1).rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs))


def ignored() -> Column:
    return F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, IGNORED_PARTS)))


def listed(files: DataFrame) -> DataFrame:
    """The files that discovery looks at: none with an ignored part in its path."""
    return files.where(~ignored())


def at_root(*names: str) -> Column:
    return F.col("path").isin(*names)


def any_match(files: DataFrame, pattern: str) -> DataFrame:
    """Whether any file of a project matches a pattern."""
    return files.groupBy("project").agg(F.coalesce(F.bool_or(F.regexp_like("text", F.lit(pattern))), F.lit(False)).alias("matched"))


def has(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))


def chosen(flags: dict[str, Column]) -> Column:
    """The names whose flags hold, as an array."""
    return F.array_compact(F.array(*(F.when(flag, name) for name, flag in flags.items())))


def python(files: DataFrame) -> DataFrame:
    """Framework of each project with its confidence, and what is known of Django."""
    c, text = F.col, F.coalesce("text", F.lit(""))
    seen = ~ignored()
    source, settings = seen & c("path").endswith(".py"), seen & named(("settings.py",))
    django = F.lower(text).contains("django")
    rows = files.groupBy("project").agg(
        has(at_root("manage.py")).alias("manage_py"), has(at_root("manage.py") & django).alias("in_manage"), has(at_root("requirements.txt") & django).alias("in_requirements"), has(at_root("pyproject.toml") & django).alias("in_pyproject"),
        has(at_root(*PYTHON_MARKERS)).alias("is_python"), has(settings).alias("in_settings"), has(settings & F.regexp_like(text, F.lit(SETTINGS_SIGNAL))).alias("settings_hardening_markers"),
        F.count_if(seen & c("path").endswith(".html") & c("path").rlike("(^|/)templates/")).alias("template_count"),
        *(has(source & F.regexp_like(text, F.lit(p))).alias(name) for name, p in PYTHON_SIGNALS.items()),
    )
    count = lambda kind: sum((c(n).cast("int") for n in PYTHON_SIGNALS if n.startswith(kind + "_")), F.lit(0))
    is_django = c("in_manage") | c("in_requirements") | c("in_pyproject") | c("django_import")
    fastapi, flask = count("fastapi"), count("flask")
    told = lambda name: F.coalesce(is_django & c(name), F.lit(False))
    return rows.select(
        "project", "is_python",
        F.when(is_django, "django").when(fastapi > 0, "fastapi").when(flask > 0, "flask").otherwise("generic").alias("python_framework"),
        F.round(F.when(is_django, 0.98).when(fastapi > 0, 0.55 + 0.15 * fastapi).when(flask > 0, 0.55 + 0.15 * flask).otherwise(0.4), 2).alias("framework_confidence"),
        F.when(is_django, chosen({"django_imports": c("django_import"), "manage.py": c("in_manage"), "pyproject.toml": c("in_pyproject"), "requirements.txt": c("in_requirements"), "settings.py": c("in_settings")})).alias("django_evidence"),
        *(told(n).alias(n) for n in ("drf", "channels", "orm_patterns", "settings_hardening_markers", "manage_py")), F.when(is_django, c("template_count")).otherwise(0).alias("template_count"),
    )


def java(files: DataFrame) -> DataFrame:
    """Modules, frameworks and Spring's traces of each project. A build file counts in a module's
    folder only, or at the root of a project without modules."""
    c, text, name = F.col, F.coalesce("text", F.lit("")), F.substring_index("path", "/", -1)
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    lower, build, source = F.lower(text), name.isin(JAVA_BUILD_FILES), c("path").endswith(".java")
    folders = files.groupBy("project", folder.alias("folder")).agg(
        has(name.isin(JAVA_MODULES)).alias("module"), has(at_root(*JAVA_MARKERS)).alias("is_java"),
        *(has(build & F.regexp_like(text, F.lit(p))).alias(n) for n, p in JAVA_FRAMEWORKS.items()),
        *(F.count_if(source & F.regexp_like(text, F.lit(p))).alias(n) for n, p in SPRING_ANNOTATIONS.items()),
        *(has(source & (lower.contains(words[0]) | lower.contains(words[1]))).alias(n) for n, words in SPRING_INDICATORS.items()),
        has(source & (text.contains("@valid") | text.contains("@validated"))).alias("validation"),
    )
    counts = F.count_if("module")
    rows = folders.groupBy("project").agg(
        has(c("is_java")).alias("is_java"), counts.alias("modules"), *(F.when(counts > 0, has(c("module") & c(n))).otherwise(has((c("folder") == ".") & c(n))).alias(n) for n in JAVA_FRAMEWORKS),
        *(F.sum(n).alias(n) for n in SPRING_ANNOTATIONS), *(has(c(n)).alias(n) for n in [*SPRING_INDICATORS, "validation"]),
    )
    return rows.select("project", "is_java", F.greatest("modules", F.lit(1)).alias("module_count"), (c("modules") > 1).alias("multi_module"), chosen({n: c(n) for n in JAVA_FRAMEWORKS}).alias("java_frameworks"), *SPRING_ANNOTATIONS, *SPRING_INDICATORS, "validation")


#: Settings files that a Django project's block lists.
SETTINGS_LISTED = 50


def settings_files(files: DataFrame) -> DataFrame:
    """(project, settings_files): the first settings files of each project by path."""
    found = listed(files).where(named(("settings.py",))).select("project", "path")
    nth = F.row_number().over(Window.partitionBy("project").orderBy("path"))
    return found.withColumn("nth", nth).where(F.col("nth") <= SETTINGS_LISTED).groupBy("project").agg(F.array_sort(F.collect_list("path")).alias("settings_files"))


def profile_names(languages: DataFrame, frameworks: DataFrame) -> DataFrame:
    """(project, name): the profiles that hold for a project, by its language hints and, for Django, by
    its framework; files of infrastructure have a profile of their own."""
    hint = languages.select("project", F.explode("language_hints").alias("hint")).select("project", F.when(F.col("hint") == "general", "infrastructure").otherwise(F.col("hint")).alias("name"))
    return hint.unionByName(frameworks.where("python_framework = 'django'").select("project", F.lit("django").alias("name"))).distinct()


#: Build files that a report names as the evidence of a framework.
EVIDENCE = 20


def java_evidence(files: DataFrame) -> DataFrame:
    """(project, framework, evidence): the names of the build files that tell a framework, in the order of
    modules and of JAVA_BUILD_FILES, the first EVIDENCE of them. As in java(), a build file counts in a
    module's folder, or at the root of a project without modules."""
    c, text, name = F.col, F.coalesce("text", F.lit("")), F.substring_index("path", "/", -1)
    rows = files.where(name.isin(JAVA_BUILD_FILES)).join(modules(files).select("project", "module_path"), "project")
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    own = rows.where(folder == c("module_path")).select("project", "module_path", name.alias("name"), F.explode(chosen({n: F.regexp_like(text, F.lit(p)) for n, p in JAVA_FRAMEWORKS.items()})).alias("framework"))
    place = F.array_position(F.array(*map(F.lit, JAVA_BUILD_FILES)), c("name"))
    nth = F.row_number().over(Window.partitionBy("project", "framework").orderBy("module_path", place))
    first = own.withColumn("nth", nth).where(c("nth") <= EVIDENCE)
    return first.groupBy("project", "framework").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "name"))), lambda x: x["name"]).alias("evidence"))


def modules(files: DataFrame) -> DataFrame:
    """(project, module_path, module_name, module_id): the folders of build files, or the project's root."""
    folder = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).otherwise(".")
    found = files.where(F.substring_index("path", "/", -1).isin(JAVA_MODULES)).select("project", folder.alias("module_path")).distinct()
    bare = files.select("project").distinct().join(found, "project", "left_anti").withColumn("module_path", F.lit("."))
    at = F.col("module_path")
    return found.unionByName(bare).select("project", "module_path", F.when(at == ".", F.col("project")).otherwise(F.replace(at, F.lit("/"), F.lit("-"))).alias("module_name"), F.substring(F.sha2(at, 256), 1, 12).alias("module_id"))


def javascript(files: DataFrame) -> DataFrame:
    """Package manager, dependencies and frameworks of projects with a sound package.json and any
    script; others have no row."""
    c, seen = F.col, ~ignored()
    manifest = F.when(at_root("package.json"), c("text"))
    rows = files.groupBy("project").agg(
        F.max(manifest).alias("manifest"), has(at_root("pnpm-lock.yaml")).alias("pnpm"), has(at_root("yarn.lock")).alias("yarn"), has(at_root("package-lock.json")).alias("npm"),
        (has(at_root("tsconfig.json")) | has(seen & named(("*.ts", "*.tsx")))).alias("has_typescript"), has(seen & named(("*.js", "*.jsx"))).alias("has_javascript"),
    )
    sound = rows.where(F.try_parse_json("manifest").isNotNull() & F.ltrim("manifest").startswith("{") & (c("has_typescript") | c("has_javascript")))
    kinds = F.from_json("manifest", ", ".join(f"{k} map<string,string>" for k in JS_DEPENDENCIES))
    empty = F.array().cast("array<string>")
    names = F.array_distinct(F.concat(*(F.coalesce(F.map_keys(kinds[k]), empty) for k in JS_DEPENDENCIES)))
    deps = sound.withColumn("deps", names)
    return deps.select(
        "project", F.when(c("has_typescript"), "typescript").otherwise("javascript").alias("key"), F.when(c("pnpm"), "pnpm").when(c("yarn"), "yarn").when(c("npm"), "npm").otherwise("unknown").alias("package_manager"),
        chosen({n: F.arrays_overlap("deps", F.array(*map(F.lit, marks))) for n, marks in JS_FRAMEWORKS.items()}).alias("js_frameworks"), F.size("deps").alias("dependency_count"), "has_typescript", "has_javascript",
    )


def php_and_go(files: DataFrame) -> DataFrame:
    """Frameworks of PHP and Go with their confidence, and how many sources there are."""
    c, text, seen = F.col, F.coalesce("text", F.lit("")), ~ignored()
    composer, mod = at_root("composer.json"), at_root("go.mod")
    like = lambda where, pattern: has(where & F.regexp_like(text, F.lit(f"(?i){pattern}")))
    laravel = {"laravel": like(composer, "laravel|illuminate/"), "symfony": like(composer, "symfony/"), "wordpress": like(composer, "wordpress|wp-")}
    marks = {"laravel": has(at_root("artisan")), "symfony": has(at_root("bin/console")), "wordpress": has(at_root("wp-config.php"))}
    go = {"gin": like(mod, r"github\.com/gin-gonic/gin"), "echo": like(mod, r"github\.com/labstack/echo"), "fiber": like(mod, r"github\.com/gofiber/fiber")}
    first = lambda flags, other: F.coalesce(*(F.when(flag, name) for name, flag in flags.items()), F.lit(other))
    rows = files.groupBy("project").agg(
        F.count_if(seen & c("path").endswith(".php")).alias("php_file_count"), F.count_if(seen & c("path").endswith(".go")).alias("go_file_count"), has(at_root("composer.json", "composer.lock")).alias("composer"), has(at_root("go.mod", "go.sum")).alias("go_mod"),
        F.coalesce(first(laravel, None), first(marks, "generic_php")).alias("php_framework"), first(go, "stdlib").alias("go_framework"),
    )
    is_php, is_go = c("composer") | (c("php_file_count") > 0), c("go_mod") | (c("go_file_count") > 0)
    return rows.select(
        "project", is_php.alias("is_php"), F.when(is_php, c("php_framework")).alias("php_framework"), F.when(is_php, F.when(c("php_framework") == "generic_php", 0.5).otherwise(0.9)).alias("php_confidence"), "php_file_count",
        is_go.alias("is_go"), F.when(is_go, c("go_framework")).alias("go_framework"), F.when(is_go, F.when(c("go_framework") == "stdlib", 0.5).otherwise(0.9)).alias("go_confidence"), "go_file_count",
    )


def infrastructure(files: DataFrame) -> DataFrame:
    """(project, group, count, files, kind): infrastructure files of each group, the first by name listed."""
    groups = chosen({g: named(globs) for g, globs in INFRASTRUCTURE.items()})
    rows = listed(files).select("project", "path", F.explode(groups).alias("group")).distinct()
    nth = F.row_number().over(Window.partitionBy("project", "group").orderBy("path"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= NAMED).groupBy("project", "group").agg(F.array_sort(F.collect_list("path")).alias("files"))
    counts = rows.groupBy("project", "group").agg(F.count("*").alias("count"))
    kind = lookup(F.col("group"), {g: kind for kind, groups in INFRASTRUCTURE_KINDS.items() for g in groups})
    return counts.join(first, ["project", "group"]).withColumn("kind", kind)


def config_markers(files: DataFrame) -> DataFrame:
    """Whether a project's root holds a configuration that any scanner knows."""
    return files.groupBy("project").agg(has(at_root(*CONFIG_MARKERS) | F.col("path").rlike(r"^\.eslintrc[^/]*$")).alias("has_config_marker"))


def languages(files: DataFrame) -> DataFrame:
    """(project, language_hints, primary_language, labels): languages in the order in which they are
    looked for, the first of the four main ones, and the labels of the portal."""
    flags = python(files).select("project", "is_python").join(java(files).select("project", "is_java"), "project").join(php_and_go(files).select("project", "is_php", "is_go"), "project")
    flags = flags.join(javascript(files).select("project", "key"), "project", "left").join(infrastructure(files).groupBy("project").agg(F.lit(True).alias("general")), "project", "left")
    c = F.col
    script, typed, general = c("key").isNotNull(), c("key").eqNullSafe("typescript"), F.coalesce("general", F.lit(False))
    main = {"python": c("is_python"), "java": c("is_java"), "php": c("is_php"), "go": c("is_go")}
    hints = chosen({**main, "typescript": typed, "javascript": script, "general": general})
    labels = chosen({"general": general, "go": c("is_go"), "java": c("is_java"), "javascript": script & ~typed, "php": c("is_php"), "python": F.lit(True), "typescript": typed})
    return flags.select("project", hints.alias("language_hints"), F.try_element_at(chosen(main), F.lit(1)).alias("primary_language"), labels.alias("labels"))


def language_histogram(labelled: DataFrame) -> DataFrame:
    """Projects by language label."""
    return labelled.select(F.explode("labels").alias("language")).groupBy("language").agg(F.count("*").alias("projects"))
