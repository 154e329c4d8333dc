import pytest

from verdigris.operators import baseline, findings as ops, history, recommend, scoring
from verdigris.functions import text
from pyspark.sql import functions as F

CASES = [
    (("bandit", "B105", "lint", "src/a.py", "m", "{}"), "not_security", "non_security_category", 1.0),
    (("bandit", "B105", "security", "tests/a.py", "password: ''", "{}"), "false_positive", "bandit_b105_token_literal", 0.0),
    (("bandit", "B105", "security", "src/a.py", 'password: "NOT"', "{}"), "false_positive", "bandit_b105_token_literal", 0.0),
    (("bandit", "B105", "security", "src/a.py", "password: 'hunter2'", "{}"), "runtime_security", "path_runtime", 1.0),
    (("bandit", "B310", "security", "tests/a.py", "m", "{}"), "test_security", "bandit_b310_test_urlopen", 0.1),
    (("ruff", "S1", "security", "x/smoke_test.py", "m", "{}"), "test_security", "path_test", 0.1),
    (("ruff", "S1", "security", "README.md", "m", "{}"), "false_positive", "path_documentation", 0.0),
    (("ruff", "S1", "security", "docs/a.md", "m", "{}"), "false_positive", "path_documentation", 0.0),
    (("bandit", "B603", "security", "tools/a.py", "uses shell=True", "{}"), "runtime_security", "bandit_b603_shell_true", 1.0),
    (("bandit", "B404", "security", "tools/a.py", "m", '{"code":"os.system(x)"}'), "runtime_security", "heuristic_interpolated_command", 1.0),
    (("bandit", "B404", "security", "scripts/a.py", "m", "{}"), "tooling_security", "bandit_b404_tool_subprocess", 0.25),
    (("bandit", "B603", "security", "dev/a.py", "m", "{}"), "tooling_security", "bandit_b603_tool_subprocess", 0.25),
    (("ruff", "S1", "security", "maintenance/a.py", "m", "{}"), "tooling_security", "path_tooling", 0.25),
    (("ruff", "S1", "security", "api/a.py", "m", "{}"), "runtime_security", "path_runtime", 1.0),
    (("ruff", "S1", "security", "lib/a.py", "m", "{}"), "unknown", "default_unknown", 1.0),
]


def test_classification(spark):
    rows = [(i, *c[0]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "i int, tool string, rule_id string, category string, file string, message string, raw_payload string")
    got = ops.classify(df).orderBy("i").collect()
    assert [(r.security_class, r.classification_reason, r.score_weight) for r in got] == [c[1:] for c in CASES]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(text.normalize_message(F.lit('  Bad "X" at LINE 12,, 0xFF  '))) == "bad 'x' at line <n>, 0x<hex>"
    assert value(text.normalize_message(F.lit("open /etc/passwd"))) == "open /etc<path>"
    assert [value(text.rule_family(F.lit(x))) for x in ("B105", "SEC.SQL-1", "9x1", " ", "TS2322")] == ["b", "sec", "9x1", "unknown", "ts"]
    assert [value(text.message_family(F.lit(x))) for x in ("Found 12 'a b' x", "", "one")] == ["found #", "generic", "one"]
    assert [value(text.file_pattern(F.lit(x))) for x in ("src/a", "", "/x", "a")] == ["src", "project", "/", "a"]
    assert [value(text.matches_any(F.lit(p), ["docs/**", "*.py", "a[!b]c"])) for p in ("docs/x/y", "q/w.py", "abc", "axc", "x")] == [True, True, False, True, False]
    assert value(text.high_entropy(F.lit("abcdefghijklmnopqrstuvwx"))) and not value(text.high_entropy(F.lit("a" * 30)))
    assert [value(text.lenient_int(F.lit(x))) for x in ("5", "5.9", "x", None)] == [5, 5, 0, 0]


def card(spark, **over):
    row = {"overall_score": 95.0, "critical_security_findings": 0, "high_security_findings": 0} | over
    return scoring.policy(spark.createDataFrame([tuple(row.values())], list(row))).first()


@pytest.mark.parametrize("over, status, reasons", [
    ({}, "pass", []), ({"overall_score": 79.9}, "warn", ["low_score"]), ({"overall_score": 59.0}, "fail", ["low_score"]), ({"high_security_findings": 3}, "pass", []), ({"high_security_findings": 4}, "warn", ["high_security_findings"]),
    ({"critical_security_findings": 1, "scanner_failures": 2, "baseline_expired_entries": 1}, "fail", ["scanner_failure", "baseline_entry_expired", "critical_security_finding"]),
    ({"history_scan_stale": 1, "history_scan_age_days": 200, "secret_scanner_unavailable_count": 1}, "warn", ["history_scan_stale", "secret_scanner_unavailable"]),
    ({"private_key_findings": 1, "real_secret_findings": 1, "baseline_real_secret_entries": 1, "probable_secret_findings": 1}, "fail", ["real_secret_exposure", "probable_secret_exposure", "private_key_material", "baseline_real_secret_prohibited"]),
])
def test_policy(spark, over, status, reasons):
    r = card(spark, **over)
    assert (r.status, r.reasons) == (status, reasons)
    if "history_scan_stale" in over:
        assert r.warnings[0] == "history scan stale (200 days); refresh strongly recommended"


def test_dedupe_keeps_the_first_tool(spark):
    rows = [("p", "r", o, i, t, "K", f) for o, i, t, f in [(1, 1, "a", "f1"), (1, 2, "a", "f2"), (2, 1, "b", "f3"), (3, 1, "a", "f4")]]
    df = spark.createDataFrame(rows, "project string, run_id string, scanner_ord int, finding_ord long, tool string, dedupe_key string, fingerprint string").repartition(3)
    got = {r.fingerprint: (r.kept, r.duplicate_of) for r in ops.dedupe(df).collect()}
    assert got == {"f1": (True, None), "f2": (True, None), "f3": (False, "f1"), "f4": (True, None)}


def test_coverage_replaces_the_score(spark):
    rows = [("p", "r", "coverage", "coverage", "info", 1, 1.0, 1.0, "coverage_percent", 40.0), ("p", "r", "bandit", "security", "high", 2, 2.0, 1.5, None, None)]
    metrics = spark.createDataFrame(rows, "project string, run_id string, tool string, category string, severity string, count long, weighted_count double, score_hint double, scalar_name string, scalar_value double")
    scores = scoring.category_scores(metrics)
    assert {r.category: r.score for r in scores.collect() if r.score < 100} == {"coverage": 40.0, "security": 70.0}
    assert scoring.score_cards(scores).first().overall_score == 85.0


def test_baseline_states_and_files(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"entries": [{"fingerprint": "a", "accepted": true, "owner": " ", "expires_at": "2024-01-10T00:00:00Z"}, {"fingerprint": "b", "accepted": true, "owner": "x"}]}')
    (tmp_path / "c.json").write_text('[{"fingerprint": "c", "accepted": false, "expires_at": "2024-01-01T00:00:00Z"}]')
    entries = baseline.read(spark, f"{tmp_path}/b.json").unionByName(baseline.read(spark, f"{tmp_path}/c.json"))
    got = {r.fingerprint: (r.active, r.expired, r.expiring_soon, r.missing_owner) for r in baseline.states(entries, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert got == {"a": (True, False, True, True), "b": (True, False, False, False), "c": (False, True, False, False)}


def test_scan_times(spark):
    df = spark.createDataFrame([("2024-01-02_030405",), ("20240102T030405Z_01",), ("2024-01-02_030405_01",), ("x",)], "s string")
    assert [r[0] is not None for r in df.select(history.scan_time(F.col("s"))).collect()] == [True, True, False, False]


def test_plan_is_the_same_in_any_order(spark):
    rows = [("p", "r", 1, i, "ruff", f"F{i % 3}", "low", "lint", f"src/a{i % 4}.py", "unused import", "unused import", 1.0, "not_security") for i in range(12)]
    schema = "project string, run_id string, scanner_ord int, finding_ord long, tool string, rule_id string, severity string, category string, file string, message string, normalized_message string, confidence double, security_class string"
    plans = [sorted(map(str, recommend.action_plan(recommend.recommendations(spark.createDataFrame(r, schema).repartition(n))).collect())) for r, n in ((rows, 1), (rows[::-1], 3))]
    assert plans[0] == plans[1] and len(plans[0]) > 0


def test_plan_summary_and_first_baseline(spark):
    plan = spark.createDataFrame([(90.0, 80.0, "t", 2, 1), (75.0, None, None, 0, 0), (10.0, 20.0, "u", 1, 1)], "overall_score double, previous_score double, top_title string, quick_wins int, systemic int")
    said = [r.executive_summary for r in recommend.summary_text(plan).collect()]
    assert said[0].startswith("Project health is Good. The highest priority issue is t. 2 quick wins") and said[0].endswith("Score has improved since the previous run.")
    assert "Fair" in said[1] and "no critical findings" in said[1] and "Score has" not in said[1] and said[2].endswith("declined since the previous run.")
    rows = spark.createDataFrame([("f",), ("f",), ("g",)], "fingerprint string")
    got = baseline.entries_for(rows, "o", "n", F.lit("2020-01-01").cast("timestamp"), F.lit(None).cast("timestamp")).collect()
    assert sorted((r.fingerprint, r.accepted, r.owner, r.note) for r in got) == [("f", True, "o", "n"), ("g", True, "o", "n")]
