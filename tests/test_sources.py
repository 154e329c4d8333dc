import hashlib
import json

import pytest
from pyspark.sql import functions as F

from verdigris.functions.redact import canonical, redact, redacted
from verdigris.operators import cache, discovery, inventory, secrets
from verdigris.plans import registry
from verdigris.schemas import SCANNERS
from verdigris.sources import metrics, text_rules
from verdigris.sources.reports import REPORT


def test_redaction(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    mixed = "abcdefghijklmnopqrstuvwxyz012345"
    payload = {"monkey": "x", "a": [{"token": 5}, mixed, "aaaa"], "u": "123e4567-e89b-12d3-a456-426614174000", "p": "-----BEGIN X-----\nq\n-----END X-----", "n": 1.5, "z": None}
    want = {"monkey": f"<redacted_sha256:{sha('x')}>", "a": [{"token": "<redacted>"}, f"<redacted_entropy_sha256:{sha(mixed)}>", "aaaa"], "u": "<uuid>", "p": "<redacted_pem>", "n": 1.5, "z": None}
    assert redacted(payload) == want
    df = spark.createDataFrame([(json.dumps(payload),), (None,), ("broken",)], "p string")
    assert [r[0] for r in df.select(redact(df.p)).collect()] == [canonical(want), None, "{}"]


def test_text_rules(spark):
    files = [
        ("p", "svc/Dockerfile", "FROM x\nUSER root\nADD a b\n"), ("p", "Dockerfile", "FROM x\nUSER rooted\nHEALTHCHECK CMD y\n"), ("p", "compose.yml", "services:\n  a:\n    privileged: true\n    ports:\n"), ("p", "x/compose.yaml", "ports: [1]\nnetwork_mode: hosted\n#privileged: true"),
        ("p", "a/settings.py", "x = 1\nDEBUG = True\nALLOWED_HOSTS = []\n"), ("p", "a.kube", "User = root\n"), ("p", "a.pod", "User=root\n"), ("p", "main.tf", 'cidr = "0.0.0.0/0"\n'), ("p", "app/models.py", "a\nq = M.objects.all()\n"), ("p", "app/views.py", "q = M.objects.all()\nx.select_related('y')"),
        ("p", "t/templates/page.html", '<p>\n<form method="post"><input></form>\n<form>csrf</form>\n<FORM METHOD=\'POST\'>csrf</FORM >'), ("p", "t/templates/a/safe.html", '<form method="POST">{% csrf_token %}</form><form method=post></form>{%autoescape OFF%}'),
        ("p", "t/page.html", '<form method="post"></form>'), ("p", "x/tests/templates/x.html", '<form method="post"></form>'), ("p", "nginx.conf", "ssl_protocols TLSv1 TLSv1.2;"), ("p", "n.conf", "ssl_protocols TLSv1;"), ("p", "none.txt", None), ("p", "e/Containerfile", None),
    ]
    df = spark.createDataFrame(files, "project string, path string, text string")
    got = {(r.rule_id, r.file, r.line) for r in text_rules.scan(df).collect()}
    assert got == {
        ("INF.CONTAINER.USER_ROOT", "svc/Dockerfile", 1), ("INF.CONTAINER.HEALTHCHECK_MISSING", "svc/Dockerfile", 1), ("INF.CONTAINER.ADD_USAGE", "svc/Dockerfile", 1), ("INF.CONTAINER.HEALTHCHECK_MISSING", "e/Containerfile", 1), ("INF.COMPOSE.PRIVILEGED", "compose.yml", 1), ("INF.COMPOSE.PORT_EXPOSED", "compose.yml", 1),
        ("DJG.SET.DEBUG_TRUE", "a/settings.py", 2), ("DJG.SET.ALLOWED_HOSTS_EMPTY", "a/settings.py", 3), ("DJG.SET.SECURE_PROXY_SSL_HEADER_MISSING", "a/settings.py", 1), ("INF.QUADLET.ROOT_USER", "a.kube", 1), ("INF.TF.OPEN_WORLD", "main.tf", 1), ("DJG.ORM.RELATED_FETCH_MISSING", "app/models.py", 2),
        ("DJG.TPL.CSRF_TOKEN_MISSING", "t/templates/page.html", 2), ("DJG.TPL.CSRF_TOKEN_MISSING", "t/templates/page.html", 4), ("DJG.TPL.AUTOESCAPE_OFF", "t/templates/a/safe.html", 1), ("INF.PROXY.LEGACY_TLS", "nginx.conf", 1),
    }
    (counts,) = text_rules.file_counts(df).collect()
    assert (counts.dockerfile_count, counts.compose_file_count, counts.quadlet_count, counts.proxy_config_count, counts.terraform_file_count) == (3, 2, 1, 1, 1)


def test_scalar_metrics(spark):
    jacoco = '<report><counter type="LINE" missed="20" covered="80"/><counter type="BRANCH" missed="1" covered="3"/><counter type="CLASS" missed="5" covered="15"/></report>'
    rows = [
        ("coverage", json.dumps({"totals": {"percent_covered": 81.5}})), ("js_coverage", json.dumps({"total": {"lines": {"pct": 87.5}, "branches": {"pct": 72}}})), ("jacoco", jacoco), ("pmd", json.dumps({"duplication": {"percentDuplicatedLines": 12.5}})),
        ("radon", json.dumps({"cc": {"a.py": [{"complexity": 2, "rank": "A"}, {"complexity": 20, "rank": "C"}]}, "mi": {"a.py": {"mi": 70}, "b.py": 78}})),
    ]
    df = spark.createDataFrame([("p", "r", t, o, "", "") for t, o in rows], REPORT)
    got = {r.tool: r.scalar_metrics for r in metrics.scalar_metrics(df).collect()}
    assert got == {"coverage": {"coverage_percent": 81.5}, "js_coverage": {"coverage_percent": 87.5, "branch_coverage_percent": 72.0}, "jacoco": {"coverage_percent": 80.0, "branch_coverage_percent": 75.0, "class_count": 20.0}, "pmd": {"duplication_percent": 12.5}, "radon": {"avg_complexity": 11.0, "worst_complexity": 20.0, "maintainability_index": 74.0}}
    (r,) = metrics.radon(df).collect()
    assert (r.complexity_grade, r.rank_counts) == ("C", {"A": 1, "C": 1})


def test_inventory(spark):
    files = spark.createDataFrame([("p", "manage.py", ""), ("p", "src/a.py", "from django import x"), ("p", "web/package.json", '{"react": 1}'), ("p", "node_modules/x.js", ""), ("p", ".env", ""), ("p", "k/id_rsa", ""), ("p", "docs/a.md", "")], "project string, path string, text string")
    (c,) = inventory.counts(files).collect()
    assert (c.files_seen, c.third_party, c.first_party) == (7, 1, 6)
    zoned = inventory.zones(files.withColumn("tracked", ~files.path.isin(".env", "k/id_rsa")))
    (z,) = zoned.collect()
    assert (z.tracked, z.ignored_sensitive, z.docs, z.excluded) == (4, 2, 1, 1)
    (both,) = inventory.with_zones(inventory.counts(files), zoned).collect()
    assert (both.files_seen, both.excluded, both.third_party, both.ignored_sensitive) == (7, 1, z.third_party, 2)
    scanners = spark.createDataFrame([("ruff", ["python"]), ("any", ["general"])], "scanner string, languages array<string>")
    assert {(r.scanner, r.path) for r in inventory.scanner_inputs(files, scanners).collect() if r.scanner == "ruff"} == {("ruff", "manage.py"), ("ruff", "src/a.py")}
    assert inventory.effective_patterns(["x"], [".env"])[-1] == "x"


FILES = [
    ("dj", "manage.py", "os.environ['DJANGO_SETTINGS_MODULE']"), ("dj", "s/settings.py", "DEBUG = 1"), ("dj", "s/a.py", "import rest_framework"), ("dj", "templates/x/a.html", ""), ("dj", "venv/b.py", "from channels import x"),
    ("fa", "requirements.txt", "x"), ("fa", "a.py", "from fastapi import FastAPI\napp = FastAPI()"), ("fl", "pyproject.toml", ""), ("fl", "a.py", "import flask\nb = Blueprint('x')\nc = Flask ('y')"), ("ge", "a.py", "x"),
    ("ja", "pom.xml", "<a>org.springframework.boot</a>"), ("ja", "m/build.gradle", "io.quarkus"), ("ja", "n/settings.gradle", "io.micronaut"), ("ja", "m/A.java", "@RestController @Valid // Hibernate"), ("ja", "m/B.java", "@Service @EnableWebSecurity"), ("ja", "b/deploy.sh", ""),
    ("js", "package.json", '{"dependencies": {"next": "1", "left": "2"}, "devDependencies": {"next": "1", "koa": {"x": 1}}}'), ("js", "yarn.lock", ""), ("js", "a.tsx", ""), ("js", "node_modules/x.sh", ""), ("bad", "package.json", "{oops"), ("bad", "a.js", ""), ("bad", ".eslintrc.json", ""),
    ("php", "composer.json", '{"require": {"symfony/x": 1}}'), ("php2", "a/b.php", ""), ("php2", "artisan", ""), ("go", "go.mod", "github.com/labstack/echo"), ("go", "a.go", None),
]


def test_discovery(spark):
    files = spark.createDataFrame(FILES, "project string, path string, text string")
    rows = lambda df: {r.project: r for r in df.collect()}
    py = rows(discovery.python(files))
    assert {p: (r.python_framework, r.framework_confidence, r.is_python) for p, r in py.items() if p in ("dj", "fa", "fl", "ge")} == {"dj": ("django", 0.98, True), "fa": ("fastapi", 0.85, True), "fl": ("flask", 1.0, True), "ge": ("generic", 0.4, False)}
    assert py["dj"].django_evidence == ["manage.py", "settings.py"] and (py["dj"].drf, py["dj"].channels, py["dj"].manage_py, py["dj"].settings_hardening_markers, py["dj"].template_count) == (True, False, True, True, 1)
    ja = rows(discovery.java(files))["ja"]
    assert (ja.module_count, ja.multi_module, ja.java_frameworks, ja.spring_component_annotations, ja.spring_validation_annotations, ja.security_modules, ja.jpa_hibernate, ja.actuator) == (2, True, ["spring", "spring_boot", "quarkus"], 2, 1, True, True, False)
    mods = {(r.project, r.module_path, r.module_name) for r in discovery.modules(files).collect()}
    assert {("ja", ".", "ja"), ("ja", "m", "m"), ("go", ".", "go")} <= mods and ("ja", "n", "n") not in mods
    js = rows(discovery.javascript(files))
    assert set(js) == {"js"} and (js["js"].key, js["js"].package_manager, js["js"].js_frameworks, js["js"].dependency_count) == ("typescript", "yarn", ["nextjs", "node", "react"], 3)
    other = rows(discovery.php_and_go(files))
    assert [(other[p].php_framework, other[p].php_confidence, other[p].php_file_count) for p in ("php", "php2")] == [("symfony", 0.9, 0), ("laravel", 0.9, 1)]
    assert (other["go"].go_framework, other["go"].go_confidence, other["go"].is_php, other["ge"].go_framework) == ("echo", 0.9, False, None)
    infra = {(r.project, r.group, r.kind, tuple(r.files)) for r in discovery.infrastructure(files).collect()}
    assert infra == {("ja", "shell", "shell", ("b/deploy.sh",))}
    marked = rows(discovery.config_markers(files))
    assert [marked[p].has_config_marker for p in ("bad", "fl", "ge", "php")] == [True, True, False, True]
    known = rows(discovery.languages(files))
    assert (known["ja"].language_hints, known["ja"].primary_language, known["js"].labels, known["js"].primary_language) == (["java", "general"], "java", ["python", "typescript"], None)
    assert {r.language: r.projects for r in discovery.language_histogram(discovery.languages(files)).collect()}["python"] == 10
    assert rows(discovery.any_match(files, "Blueprint"))["fl"].matched and not rows(discovery.any_match(files, "Blueprint"))["ge"].matched


def test_cache(spark):
    old = spark.createDataFrame([("m", "pom.xml", "1"), ("m", "A.java", "1"), ("n", "B.java", "1")], "module string, path string, digest string")
    new = spark.createDataFrame([("m", "pom.xml", "2"), ("m", "C.java", "1"), ("n", "B.java", "1")], "module string, path string, digest string")
    assert [(r.module, r.reasons) for r in cache.miss_reasons(old, new).collect()] == [("m", ["descriptor_hash_changed", "source_hash_changed"])]
    keys = {r.module_id: r.cache_key for r in cache.cache_keys(old.withColumnRenamed("module", "module_id"), "pmd").collect()}
    assert keys == {"n": hashlib.sha256(b"pmd|n|B.java:1").hexdigest(), "m": hashlib.sha256(b"pmd|m|A.java:1|pom.xml:1").hexdigest()}


def test_cache_upkeep(spark):
    now = F.lit("2020-03-01 00:00:00").cast("timestamp")
    modules = spark.createDataFrame([("p", "1", "m"), ("p", "2", "n")], "project string, module_id string, module_name string")
    rows = [("p", "1", "pmd", "2020-02-20", "hit", ["a/x"]), ("p", "1", "jacoco", "2019-01-01", "miss", ["a/y"]), ("p", "9", "pmd", "2020-02-20", "hit", []), ("p", "2", "pmd", None, "other", None)]
    manifests = spark.createDataFrame(rows, "project string, module_id string, tool string, created string, last_status string, artifact_paths array<string>").withColumn("created_at", F.col("created").cast("timestamp"))
    assert {(r.module_id, r.tool, r.reason) for r in cache.pruned(manifests, modules, now).collect()} == {("1", "jacoco", "age"), ("9", "pmd", "orphan")}
    assert [tuple(r) for r in cache.totals(manifests).collect()] == [("p", 2, 1, 66.67)]
    assert {(r.module_id, r.tool) for r in cache.cleared(manifests, modules, module_name="m").collect()} == {("1", "pmd"), ("1", "jacoco")}
    assert {(r.module_id, r.tool) for r in cache.cleared(manifests, modules, tool="pmd").collect()} == {("1", "pmd"), ("2", "pmd")}
    assert {r.tool for r in cache.known_tools(manifests).collect()} == {"pmd", "jacoco"}
    artifacts = spark.createDataFrame([("p", "a/x", "a", 3), ("p", "a/z", "a", 4)], "project string, path string, folder string, bytes long")
    assert [r.path for r in cache.unreferenced(artifacts, manifests).collect()] == ["a/z"]
    assert [tuple(r) for r in cache.folder_sizes(artifacts).collect()] == [("p", "a", 7, 2)]
    entry = "struct<timestamp: string, status: string, reasons: array<string>, previous_cache_key: string, current_cache_key: string>"
    history = spark.createDataFrame([([(f"2020-02-{d:02d} 00:00:00", "miss", [], None, "k") for d in range(1, 13)] + [("none", "hit", [], None, "k")],)], f"decision_history array<{entry}>")
    decision = F.struct(F.lit("2020-03-01").alias("timestamp"), F.lit("hit").alias("status"), F.array(F.lit("r")).alias("reasons"), F.lit("a").alias("previous_cache_key"), F.lit("b").alias("current_cache_key"))
    (r,) = cache.saved(history, decision).collect()
    assert len(r.decision_history) == 10 and r.decision_history[-1].current_cache_key == "b" and r.last_status == "hit"
    (r,) = history.select(cache.trimmed(F.col("decision_history"), now, 20, 4).alias("h")).collect()
    assert [x.timestamp[:10] for x in r.h] == ["2020-02-10", "2020-02-11", "2020-02-12", "none"]
    results = spark.createDataFrame([("p", "r", "pmd", 2, 3, 1, {"b": 1, "a": 2}, "2020"), ("p", "r", "x", 1, 0, 0, {"a": 1}, ""), ("p", "q", "x", None, None, None, None, None)], "project string, run_id string, tool string, cached_modules long, cache_hits long, cache_misses long, miss_reason_counts map<string,long>, last_cache_update string")
    got = {r.run_id: r for r in cache.roll_up(results).collect()}
    assert (got["r"].cached_modules, got["r"].hit_rate_percent, got["r"].miss_reason_counts, got["r"].last_cache_update) == (3, 75.0, {"a": 3, "b": 1}, "2020") and got["q"].hit_rate_percent is None


def test_registry(spark, tmp_path):
    found = registry.builtin()
    assert len(found.profiles) == 9 and found.reader("ruff") == "ruff_parser" and found.reader("own") == "own_parser"
    assert found.unread(SCANNERS) == ["secrets_heuristic", "git_history_secrets"]
    with pytest.raises(registry.DuplicateError):
        found.add_reader("mine", "ruff")
    found.add_reader("mine", "own")
    found.add_profile(registry.Profile("own", ("own",)))
    assert [r.name for r in registry.profile_rows(spark, found).collect()] == sorted([p.name for p in registry.PROFILES] + ["own"])
    rows = registry.scanner_rows(spark, found)
    assert rows.count() == 43 and rows.where("not is_read").count() == 2
    assert [r.name for r in registry.missing(spark.createDataFrame([("own",), ("gone",)], "name string"), registry.profile_rows(spark, found), "name").collect()] == ["gone"]
    registry.export_contract(str(tmp_path / "c.json"))
    told = json.loads((tmp_path / "c.json").read_text())
    assert len(told["reason_codes"]) == len(set(told["reason_codes"])) == 12 and told["security_contexts"][3] == "config"
    ordered = registry.with_order(spark.createDataFrame([("ruff",), ("none",)], "tool string")).collect()
    assert {r.tool: r.scanner_ord for r in ordered} == {"ruff": 0, "none": 43}


def test_secrets(spark):
    rows = [("p", "r", "f1", True, "x", '{"secret_real": true}'), ("p", "r", "f1", False, "x", '{"secret_real": true}'), ("p", "r", "f2", True, "private_key_material", '{"secret_real": 1}'), ("p", "r", "f3", True, "x", '{"secret_real": ""}'), ("p", "r", "f4", False, "certificate_material", None)]
    deduped = spark.createDataFrame(rows, "project string, run_id string, fingerprint string, kept boolean, rule_id string, raw_payload string")
    entries = spark.createDataFrame([("f1", True, "o", None)], "fingerprint string, accepted boolean, owner string, expires_at timestamp")
    (r,) = secrets.counters(deduped, entries, F.lit("2020-01-01").cast("timestamp")).collect()
    assert (r.real_secret_findings, r.private_key_findings, r.baseline_real_secret_entries, r.key_material_exposure, r.secrets_hygiene) == (1, 1, 1, 2, 1)
