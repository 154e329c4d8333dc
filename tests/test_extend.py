"""What users add to the engine, and what is written and read in parts."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import cache, findings as ops, inventory, ordered, portal, providers, scoring
from verdigris.plans import registry
from verdigris.sources import artifacts, hashing, large, mappings, pages, reports, scanners
from verdigris.sources.samples import CASES

RUN = ["project", "run_id"]


def test_sums_and_ranks_in_two_levels(spark):
    rng = random.Random(1)
    rows = [("p", "a" if i % 3 else "b", i, rng.choice([None, "x", "y", "z"]), rng.choice([None, 1, 5, 9])) for i in range(500)] + [("q", "a", 1, "x", 4)]
    frame = spark.createDataFrame(rows, "project string, run_id string, at int, word string, n long").repartition(7)
    got = {(r.project, r.run_id, r["at"]): (r.before, r.rank) for r in ordered.ranks(ordered.sums_before(frame, RUN, ["at"], F.col("n"), "before"), RUN, [F.col("word")], "rank").collect()}
    assert len(got) == 501
    for project, run, at, word, _ in rows:
        mine = [r for r in rows if r[:2] == (project, run)]
        key = lambda w: (w is not None, w or "")
        assert got[project, run, at] == (sum(r[4] or 0 for r in mine if r[2] < at), 1 + sum(key(r[3]) < key(word) for r in mine))
    assert ordered.ranks(frame.limit(0), RUN, ["word"], "rank").count() == 0


def test_numbers_tell_equal_rows_apart_and_join_no_rows(spark):
    rows = [("p", "a", i % 7) for i in range(300)] + [("p", "b", None)] * 40 + [("q", "a", 1)]
    frame = spark.createDataFrame(rows, "project string, run_id string, word int").repartition(5)
    got = {}
    for r in ordered.numbers(frame, RUN, ["word"], "n").collect():
        got.setdefault((r.project, r.run_id), []).append((r.n, -1 if r.word is None else r.word))
    for found in got.values():
        assert [n for n, _ in sorted(found)] == list(range(1, len(found) + 1)) and [w for _, w in sorted(found)] == sorted(w for _, w in found)
    assert {k: len(v) for k, v in got.items()} == {("p", "a"): 300, ("p", "b"): 40, ("q", "a"): 1}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(ordered.numbers(frame, RUN, ["word"], "n")).count("Join ") == 1  # that of the ranges' counts
    assert "Join LeftOuter" in plan(ordered.ranks(frame, RUN, ["word"], "n"))  # which never broadcasts the rows


def test_payload_budget_in_the_order_of_the_report(spark):
    rows = [("p", "r", 1, i, "x" * n) for i, n in enumerate([5, 20, 0, 7, 9, 3])] + [("p", "s", 1, 0, "ü" * 8), ("p", "s", 2, 0, None)]
    frame = spark.createDataFrame(rows, "project string, run_id string, scanner_ord int, finding_ord long, raw_payload string")
    got = [(r.payload_bytes, r.payload_used, r.payload_truncated) for r in ops.payload_budget(frame, per_finding=10, per_run=25).orderBy(*RUN, "scanner_ord", "finding_ord").collect()]
    assert got == [(5, 5, False), (20, 10, True), (0, 0, False), (7, 7, False), (9, 3, True), (3, 0, True), (16, 10, True), (None, 10, None)]


REPORT = "project string, run_id string, tool string, stdout string, stderr string, root string"


def test_all_dialects_in_one_scan(spark):
    rows = [("p", f"r{i}", reports.DIALECTS[name].tool or name, text, "", "/work/p") for i, (name, (text, _)) in enumerate(sorted(CASES.items()))]
    frame = spark.createDataFrame(rows, REPORT)
    got = {}
    for r in reports.parse(frame, reports.DIALECTS).orderBy("finding_ord").collect():
        assert r.problem is None
        got.setdefault(r.run_id, []).append((r.rule_id, r.severity, r.category, r.file, r.line, r.message))
    assert got == {f"r{i}": found for i, (_, (_, found)) in enumerate(sorted(CASES.items()))}
    frame.write.mode("overwrite").parquet(path := spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:") + "/one_scan")
    plan = reports.parse(spark.read.parquet(path), reports.DIALECTS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Generate") >= 1


def test_readers_of_ones_own(spark):
    made = registry.builtin()
    made.add_reader("mine", "my_lint", dialects={"my_lint": reports.Dialect(reports.items("$.rows"), reports.s("$.f"), reports.s("$.r"), reports.s("$.m"), required=True)})

    def read(stdout, stderr, root):
        if stdout == "bad":
            raise reports.OutputInvalid(stdout)
        yield {"rule_id": "X", "file": stdout, "message": stderr, "line": 1 // len(stderr)}

    made.add_reader("yours", "other", function=read)
    with pytest.raises(registry.DuplicateError):
        made.add_reader("again", "ruff")
    with pytest.raises(ValueError):
        made.add_reader("stray", "new_tool", dialects={"elsewhere": reports.Dialect("doc", "''", "''", "''")})
    rows = [("p", "1", "my_lint", '{"rows":[{"f":"a","r":"R","m":"t"}]}'), ("p", "2", "my_lint", "{}"), ("p", "3", "other", "src/x"), ("p", "4", "other", "bad"), ("p", "5", "other", "../x"), ("p", "6", "nobody", "?"), ("p", "7", "other", "y"), ("p", "8", "ruff", "[]")]
    frame = spark.createDataFrame([(*r, "" if r[1] == "7" else "said", "/root") for r in rows], REPORT)
    got = sorted((r.run_id, r.tool, r.rule_id, r.file) for r in made.parse(frame).collect())
    assert got == [("1", "my_lint", "R", "a"), ("2", "verdigris", "PARSER.SCHEMA_ERROR", "scanners/my_lint"), ("3", "other", "X", "src/x"), ("4", "verdigris", "PARSER.SCHEMA_ERROR", "scanners/other"), ("5", "verdigris", "PARSER.INVALID_PATH", "scanners/other"), ("7", "verdigris", "PARSER.UNHANDLED", "scanners/other")]
    told = {r.run_id: (r.success, r.error_code, r.finding_count, r.invalid_finding_count, r.expected_parser) for r in registry.outcomes(frame, made).collect()}
    assert told["6"] == (False, "scanner_parser_missing", 0, 0, "nobody_parser") and told["8"] == (True, None, 0, 0, "ruff_parser") and told["4"] == (True, None, 1, 1, "yours")
    assert made.parse(frame.limit(0)).count() == 0


def test_scanner_of_ones_own_is_a_data_source(spark):
    class Walker(scanners.Scanner):
        name = "walker"

        def pieces(self):
            return ["one", "two", "late", "gone"]

        def scan(self, piece):
            if piece == "late":
                raise TimeoutError(piece)
            if piece == "gone":
                raise FileNotFoundError(piece)
            yield {"project": self.options["project"], "run_id": "r", "stdout": f'[{{"code":"F401","message":"m","filename":"{piece}.py"}}]', "tool": "ruff"}

    class Absent(Walker):
        name = "absent"

        def available(self):
            return False

    scanners.register(spark, Walker, Absent)
    found = spark.read.format("walker").option("project", "p").load()
    assert found.rdd.getNumPartitions() == 4
    assert sorted((r.piece, r.success, r.error_code) for r in found.collect()) == [(0, True, None), (1, True, None), (2, False, "scanner_timeout"), (3, False, "scanner_binary_missing")]
    assert sorted(r.file for r in reports.parse_all(found.where("success")).collect()) == ["one.py", "two.py"]
    assert [(r.success, r.error_code, r.tool) for r in spark.read.format("absent").load().collect()] == [(False, "scanner_binary_missing", "absent")]


def test_landed_reports_are_cut_at_lines(spark, tmp_path):
    lines = [json.dumps({"i": i, "text": "ü" * (i % 50)}, ensure_ascii=False) for i in range(300)]
    (tmp_path / "p" / "r").mkdir(parents=True)
    (tmp_path / "p" / "r" / "a.txt").write_text("\n".join(lines), encoding="utf-8")
    scanners.register(spark, scanners.LineReports)
    for size in (1, 7, 100, 10**6):
        rows = spark.read.format("line_reports").options(path=str(tmp_path), piece_bytes=max(size, 40)).load().collect()
        assert [x for r in sorted(rows, key=lambda r: r.piece) for x in r.stdout.splitlines()] == lines and all(r.success for r in rows)


def test_many_pieces_are_few_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scanners, "PARTITIONS", 3)
    for name in "ab":
        (tmp_path / "p" / name).mkdir(parents=True)
        (tmp_path / "p" / name / "x.txt").write_text("".join(f"{name}{i}\n" for i in range(200)))
    scanners.register(spark, scanners.LineReports)
    found = spark.read.format("line_reports").options(path=str(tmp_path), piece_bytes=40).load()
    rows = sorted(found.collect(), key=lambda r: r.piece)
    assert found.rdd.getNumPartitions() == 3 and len(rows) > 40 and [r.piece for r in rows] == list(range(len(rows)))
    assert [x for r in rows for x in r.stdout.splitlines()] == [f"{name}{i}" for name in "ab" for i in range(200)]


def checkstyle(n):
    return '<?xml version="1.0"?>\n<checkstyle>\n' + "\n".join(f'<file name="src/f{i}.java">\n<error line="{i}" severity="warning" message="m {i}" source="x.Brace"/>\n</file>' if i % 7 else f'<file name="e{i}"/>' for i in range(n)) + "\n</checkstyle>\n"


def test_large_reports_equal_small_ones(spark, tmp_path):
    texts = {("p", "r1"): checkstyle(3000), ("p", "r2"): checkstyle(8), ("q", "r1"): checkstyle(50)[:-60], ("q", "r2"): "<checkstyle></checkstyle>"}
    for (project, run), text in texts.items():
        (tmp_path / project / run).mkdir(parents=True)
        (tmp_path / project / run / "checkstyle.xml").write_text(text)
    want = reports.parse_all(spark.createDataFrame([(*k, "checkstyle", v, "", "") for k, v in texts.items()], REPORT))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert large.records(spark, f"{tmp_path}/*/*/*.xml", "</file>").rdd.getNumPartitions() > 30
        got = large.parse_large(spark, f"{tmp_path}/*/*/*.xml", "checkstyle")
        columns = [*RUN, "scanner_ord", "finding_ord", "tool", "rule_id", "severity", "file", "line", "message"]
        assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, want.select(columns).collect()), key=str)
        assert [(r.run_id, r.rule_id) for r in got.where("project = 'q'").collect()] == [("r1", "PARSER.SCHEMA_ERROR")]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(ValueError):
        large.small_reports(spark, str(tmp_path), "ruff")


def test_large_reports_in_lines(spark, tmp_path):
    (tmp_path / "p" / "r").mkdir(parents=True)
    (tmp_path / "p" / "r" / "x.txt").write_text("# pkg\n" + "".join(f"a/b{i}.go:{i}:4: bad thing {i}\n" for i in range(500)))
    got = large.parse_large(spark, f"{tmp_path}/*/*/*.txt", "go_vet").orderBy("finding_ord").collect()
    assert [(r.finding_ord, r.file, r.line) for r in got] == [(i, f"a/b{i}.go", i) for i in range(500)]


def test_providers_are_chosen_by_kind(spark):
    tools = ["ruff", "pmd", "coverage", "unknown", "mine"]
    held = providers.builtin()
    held.add(providers.Provider("own", providers.OWN, lambda results, found: results.select(*RUN, "tool", F.lit("security").alias("category"), F.lit("critical").alias("severity"), F.lit(2).cast("long").alias("count"), F.lit(2.0).alias("weighted_count"), F.lit(1.0).alias("score_hint")), frozenset(["mine"])), first=True)
    with pytest.raises(ValueError):
        held.add(held.held[0])
    results = spark.createDataFrame([("p", "r", t, True, {"coverage_percent": 50.0}) for t in tools] + [("p", "r", "bandit", False, None)], "project string, run_id string, tool string, success boolean, scalar_metrics map<string,double>")
    chosen = {}
    for r in held.selection(results).collect():
        chosen.setdefault(r.tool, set()).add(r.provider)
    # coverage has a scalar provider, and the last one takes findings of any scanner
    assert chosen == {"ruff": {"known_findings"}, "pmd": {"known_findings", "scalars"}, "coverage": {"scalars", "findings"}, "unknown": {"findings"}, "mine": {"own"}, "bandit": {"known_findings"}}
    found = spark.createDataFrame([("p", "r", t, "lint", "low", 1.0) for t in [*tools, "bandit"]], "project string, run_id string, tool string, category string, severity string, score_weight double")
    metrics = held.extract(results, found)
    assert sorted((r.tool, r.category, r["count"], r.scalar_name) for r in metrics.collect() if r.tool in ("mine", "pmd", "bandit")) == [("mine", "security", 2, None), ("pmd", "coverage", 1, "coverage_percent"), ("pmd", "lint", 1, None)]
    with_own = scoring.score_cards(scoring.category_scores(metrics)).first().overall_score
    without = scoring.score_cards(scoring.category_scores(providers.builtin().extract(results, found))).first().overall_score
    assert with_own < without


def test_a_commit_that_is_killed_leaves_the_old_run(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    table = lambda n: {"findings": spark.createDataFrame([("p", "007", f"f{i}", "high") for i in range(n)] + [("q", "1", "g", "low")], "project string, run_id string, name string, severity string")}
    artifacts.publish(table(3), store)
    with monkeypatch.context() as m:
        m.setattr(artifacts, "moved", lambda *a: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            artifacts.publish(table(9), store)
    assert artifacts.load(spark, store, "findings").where("project = 'p'").count() == 3
    artifacts.publish({"findings": table(5)["findings"].where("project = 'p'")}, store)
    rows = artifacts.load(spark, store, "findings")
    assert (rows.where("project = 'p' and run_id = '007'").count(), rows.where("project = 'q'").count()) == (5, 1)
    told = {r.project: (r.tables["findings"]["rows"], r.high, r.low) for r in artifacts.manifests(spark, store).collect()}
    assert told == {"p": (5, 5, 0), "q": (1, 0, 1)} and artifacts.verified(spark, store).count() == 0


def test_a_site_is_published_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "site")
    frame = lambda *rows: spark.createDataFrame(rows, "path string, content string").repartition(3)
    told = pages.write_site(frame(("index.html", "<p>ü</p>"), ("projects/a/index.html", "a")), root)
    assert told["files"] == 2 and told["bytes"] == len("<p>ü</p>".encode()) + 1
    with pytest.raises(Exception, match="outside"):
        pages.write_site(frame(("index.html", "new"), ("../evil.html", "x")), root)
    assert pages.current(root) == told and {r.path: r.content for r in pages.read_site(spark, root).collect()} == {"index.html": "<p>ü</p>", "projects/a/index.html": "a"}
    assert told["version"] in (tmp_path / "site" / "index.html").read_text()
    assert [p.name for p in (tmp_path / "site").iterdir() if p.name.startswith("v-")] == [told["version"]]


def test_four_kinds_of_pages(spark, monkeypatch):
    monkeypatch.setattr(pages, "PAGE_ROWS", 2)
    cards = spark.createDataFrame([("a", "r1", 80.0, "B", "warn", ["low"], None, None), ("a", "r2", 90.0, "A", "pass", [], 80.0, 10.0), ("b", "r1", 40.0, "F", "fail", [], None, None), ("c", "r1", 95.0, "A", "pass", [], None, None)], "project string, run_id string, overall_score double, grade string, status string, reasons array<string>, previous_score double, trend_delta double")
    finding = lambda run, i, cat, sev, cls: ("a", run, 1, i, "t", f"R.{i}", sev, cat, f"src/f{i}.py", i, f"<b>m{i}</b>", f"m{i}", cls, 1.0, "")
    rows = [finding("r2", i, "security", "high" if i else "critical", "runtime_security" if i < 4 else "test_security") for i in range(5)] + [finding("r1", 9, "lint", "low", None)]
    found = spark.createDataFrame(rows, "project string, run_id string, scanner_ord int, finding_ord long, tool string, rule_id string, severity string, category string, file string, line int, message string, normalized_message string, security_class string, score_weight double, symbol string")
    plan = spark.createDataFrame([("a", "r2", "top", 1, "Fix it", 9.0, "High", "Small", 5, "why so", "do so", "src")], "project string, run_id string, list string, place int, title string, priority_score double, priority string, effort string, supporting_findings_count long, why string, recommended_fix string, where string")
    got = {r.path: r.content for r in pages.pages(pages.blocks(cards, found, plan)).collect()}
    runs = [f"projects/{p}/runs/{r}" for p, r in (("a", "r1"), ("a", "r2"), ("b", "r1"), ("c", "r1"))]
    assert set(got) == {"index.html", "index-2.html", *(f"projects/{p}/index.html" for p in "abc"), *(f"{r}/{k}.html" for r in runs for k in ("report", "details")), *(f"projects/a/runs/r2/{k}.html" for k in ("security", "security-2", "security-3"))}
    assert got["index.html"].index(">b<") < got["index.html"].index(">a<") and ">c<" in got["index-2.html"]
    assert got["projects/a/index.html"].index(">r2<") < got["projects/a/index.html"].index(">r1<")
    assert "Fix it" in got["projects/a/runs/r2/report.html"] and "do so" in got["projects/a/runs/r2/report.html"]
    assert "&lt;b&gt;m0&lt;/b&gt;" in got["projects/a/runs/r2/security.html"] and "test_only" in got["projects/a/runs/r2/security-3.html"] and "<b>" not in got["projects/a/runs/r2/details.html"]
    assert "security-3.html" in got["projects/a/runs/r2/details.html"]


def test_rows_that_agree_in_the_order_fill_pages_too(spark, monkeypatch):
    monkeypatch.setattr(pages, "PAGE_ROWS", 4)
    frame = spark.createDataFrame([("p", "r", 1, i // 3) for i in range(10)], "project string, run_id string, scanner_ord int, finding_ord long")
    got = sorted((r.place, r.sheet, r.finding_ord) for r in pages.numbered(frame, RUN, ["scanner_ord", "finding_ord"]).collect())
    assert got == [(i, i // 4 + 1, i // 3) for i in range(10)]


def test_file_digests_of_any_size(spark, tmp_path):
    contents = {"a.bin": b"x" * 10, "d/b.bin": bytes(range(256)) * 9000, "d/c.bin": b""}
    for name, data in contents.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: (r.bytes, r.digest) for r in hashing.file_digests(spark, str(tmp_path), whole=1000).collect()}
    assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}


def test_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"d{i}" / "e").mkdir(parents=True)
        (tmp_path / f"d{i}" / "e" / "x.txt").write_text(str(i))
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "_hidden" / "y.txt").write_text("y")
    (tmp_path / "d0" / "loop").symlink_to(tmp_path)
    monkeypatch.setattr(hashing.os, "scandir", lambda *a: pytest.fail("the driver lists a folder"))
    monkeypatch.setattr(hashing.fs, "FileSelector", lambda *a, **k: pytest.fail("the driver lists a folder"))
    got = {r.path: (r.bytes, r.digest) for r in hashing.file_digests(spark, str(tmp_path), glob="*.txt").collect()}
    assert got == {f"d{i}/e/x.txt": (len(str(i)), hashlib.sha256(str(i).encode()).hexdigest()) for i in range(40)}


def test_a_changed_mapping_file_changes_what_is_read(spark, tmp_path):
    path, made = tmp_path / "m.toml", registry.builtin()
    frame = spark.createDataFrame([("p", "r", "ruff", '[{"code":"S101","message":"m","filename":"a"},{"code":"S2","message":"m","filename":"a"}]', "", "")], REPORT)
    read = lambda: [(r.severity, r.category) for r in made.parse(frame).orderBy("finding_ord").collect()]
    assert read() == [("high", "security")] * 2
    path.write_text('[severity_prefixes]\nS = "info"\nS10 = "critical"\n')
    made.use_mapping("ruff", str(path))
    assert read() == [("critical", "lint"), ("info", "lint")]
    rows = spark.createDataFrame([("s101", "old"), ("zz", "old"), (None, "old")], "rule_id string, severity string")
    got = mappings.joined(rows, mappings.table(spark, mappings.load(str(path))), ["severity", "category"]).collect()
    assert sorted(map(tuple, got), key=str) == [("s101", "critical", "lint"), ("zz", "medium", "lint"), (None, None, None)]


def test_cache_roll_up_by_tool(spark):
    rows = [("p", "r", "pmd", 1, 2, 0, None, "t1"), ("p", "r", "pmd", 1, 0, 1, {"a": 1}, ""), ("p", "r", "spotbugs", 1, 0, 2, {"a": 1, "b": 2}, "t3"), ("p", "s", "pmd", 0, 0, 0, {}, None)]
    frame = spark.createDataFrame(rows, "project string, run_id string, tool string, cached_modules long, cache_hits long, cache_misses long, miss_reason_counts map<string,long>, last_cache_update string")
    got = {r.run_id: r for r in cache.roll_up(frame).collect()}
    assert (got["r"].cache_hits, got["r"].cache_misses, got["r"].hit_rate_percent, got["r"].miss_reason_counts, got["r"].last_cache_update) == (2, 3, 40.0, {"a": 2, "b": 2}, "t3")
    assert [(t.tool, t.hits, t.misses, t.miss_reason_counts) for t in got["r"].tools] == [("pmd", 2, 1, {"a": 1}), ("spotbugs", 0, 2, {"a": 1, "b": 2})]
    assert got["s"].hit_rate_percent is None and got["s"].miss_reason_counts == {}


def test_secret_scanners_read_sensitive_files_too(spark):
    files = spark.createDataFrame([("p", "a.py", True), ("p", ".env", False), ("p", "b.txt", False), ("p", "node_modules/x.js", True), ("q", "only.txt", False)], "project string, path string, tracked boolean")
    wanted = spark.createDataFrame([("gitleaks", ["general"]), ("opengrep_infra", ["general"])], "scanner string, languages array<string>")
    got = sorted(map(tuple, inventory.scanner_inputs(inventory.zoned(files), wanted).collect()))
    assert got == [("p", "gitleaks", ".env"), ("p", "gitleaks", "a.py"), ("p", "opengrep_infra", "a.py"), ("q", "gitleaks", "only.txt"), ("q", "opengrep_infra", "only.txt")]


def test_parser_table_is_zero_filled(spark):
    rows = [("p", "r", "system/parser", "PARSER.UNHANDLED", "ruff"), ("p", "r", "system/parser", "PARSER.OTHER", None), ("p", "s", "lint", "X", None)]
    found = portal.parser_table(spark.createDataFrame(rows, "project string, run_id string, category string, rule_id string, symbol string")).collect()
    counts = {(r.run_id, r.scanner, r.rule_id): r["count"] for r in found}
    assert len(counts) == len(found) == 7 * 3 + 6 and sum(counts.values()) == 4
    assert counts["r", "ruff", "PARSER.UNHANDLED"] == counts["r", None, "PARSER.UNHANDLED"] == counts["r", "unknown", "PARSER.OTHER"] == 1 and counts["s", None, "PARSER.BAD_SEVERITY"] == 0


def test_what_is_listed_and_enabled(spark):
    from verdigris.operators import history

    key = lambda *pairs: spark.createDataFrame([(p, r, f"{p}{r}") for p, r in pairs], "project string, run_id string, v string")
    runs = history.complete_runs(key(("p", "1"), ("p", "2"), ("q", "1")), key(("p", "1"), ("p", "2")).withColumnRenamed("v", "s"), key(("p", "1"), ("q", "1"), ("p", "2")).withColumnRenamed("v", "o"), key(("p", "1")).withColumnRenamed("v", "m"))
    assert sorted((r.run_id, r.m) for r in runs.collect()) == [("1", "p1"), ("2", None)]
    known = spark.createDataFrame([("ruff", ["python"]), ("eslint", ["javascript", "typescript"]), ("gitleaks", ["general"])], "scanner string, languages array<string>")
    wanted = F.array(F.lit("python"), F.lit("typescript"))
    assert sorted(r.scanner for r in inventory.enabled(known, wanted).collect()) == ["eslint", "ruff"]
    assert [r.scanner for r in inventory.enabled(known, wanted, ["ruff", "gitleaks"]).collect()] == ["ruff"] and inventory.enabled(known, wanted, None, ["ruff", "eslint"]).count() == 0
    found = spark.createDataFrame([("low", "a", "f", "r", "1"), ("critical", "z", "f", "r", "2"), ("odd", "a", "f", "r", "3"), ("critical", "b", "g", "r", "4"), ("critical", "b", "f", "s", "5")], "severity string, category string, file string, rule_id string, fingerprint string")
    assert [r.fingerprint for r in ops.published_order(found).collect()] == ["5", "4", "2", "1", "3"]


def test_java_runners_and_artifacts(spark):
    from verdigris.operators import discovery
    from verdigris.sources import java_artifacts

    bug = lambda n: f'<BugCollection><BugInstance type="T{n}" rank="1"><LongMessage>m</LongMessage><SourceLine sourcepath="A.java" start="{n}"/></BugInstance></BugCollection>'
    files = [
        ("m", "mvnw", ""), ("m", "a/pom.xml", "io.micronaut"), ("m", "b/pom.xml", "org.springframework.boot"), ("m", "a/target/spotbugsXml.xml", bug(1)), ("m", "b/target/spotbugsXml.xml", bug(2)), ("m", "b/target/site/pmd.xml", "late"), ("m", "b/target/pmd.xml", "<pmd></pmd>"),
        ("g", "build.gradle", "jakarta.ee"), ("g", "gradlew", ""), ("g", "build/reports/spotbugs/main/spotbugs.xml", bug(3)), ("g", "target/spotbugsXml.xml", bug(4)), ("n", "README", ""),
        ("u", "pom.xml", ""), ("u", "x/pom.xml", ""), ("u", "target/spotbugsXml.xml", bug(5)), ("u", "x/target/spotbugsXml.xml", "<BugCollection><BugInst"),
    ]
    frame = spark.createDataFrame(files, "project string, path string, text string")
    assert sorted(map(tuple, java_artifacts.runners(frame).collect())) == [("g", "gradle", "./gradlew"), ("m", "maven", "./mvnw"), ("u", "maven", "mvn")]
    left = java_artifacts.artifacts(frame)
    assert sorted((r.project, r.module_path, r.tool, r.path) for r in left.where("project <> 'u'").collect()) == [("g", ".", "spotbugs", "build/reports/spotbugs/main/spotbugs.xml"), ("m", "a", "spotbugs", "a/target/spotbugsXml.xml"), ("m", "b", "pmd", "b/target/pmd.xml"), ("m", "b", "spotbugs", "b/target/spotbugsXml.xml")]
    got = sorted((r.project, r.finding_ord, r.rule_id) for r in java_artifacts.findings(left, "r").collect())
    assert got == [("g", 0, "T3"), ("m", 0, "T1"), ("m", 1, "T2"), ("u", 0, "PARSER.SCHEMA_ERROR")]
    assert {(r.project, r.framework): r.evidence for r in discovery.java_evidence(frame).collect()} == {("m", "micronaut"): ["pom.xml"], ("m", "spring"): ["pom.xml"], ("m", "spring_boot"): ["pom.xml"], ("g", "jakarta_ee"): ["build.gradle"]}


def test_findings_of_large_reports_are_numbered_where_they_are_read(spark, tmp_path, monkeypatch):
    """No finding is moved: what tells its number is how many the parts before have."""
    (tmp_path / "p" / "r").mkdir(parents=True)
    files = [f'<file name="src/{k}.java">\n<error line="{k}" severity="error" message="m" source="x"/>\n<error line="1" severity="error" message="n" source="x"/></file>' for k in range(300)]
    (tmp_path / "p" / "r" / "a.xml").write_text(f"<checkstyle>{''.join(files)}</checkstyle>")
    names, real = [], large.written
    monkeypatch.setattr(large, "written", lambda df, name: names.append(name) or real(df, name))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = large.parse_large(spark, f"{tmp_path}/*/*/*.xml", "checkstyle")
        rows = sorted((r.finding_ord, r.file, r.message) for r in got.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert rows == [(2 * k + j, f"src/{k}.java", "mn"[j]) for k in range(300) for j in range(2)]
    assert names == ["large", "parts", "broken", "unsound"]
