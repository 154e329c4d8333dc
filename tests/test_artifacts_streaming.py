import json

from pyspark.sql import functions as F

from verdigris.operators import baseline, history, recommend, scoring
from verdigris.operators.findings import classify, normalize
from verdigris.operators.history import trend
from verdigris.sources import artifacts, derived, mappings
from verdigris.streaming import ingest

D = "/root/testdata/sf0.001"


def test_store_and_portal(spark, tmp_path):
    rows = classify(normalize(derived.findings(spark, D))).where("project in ('p1', 'p2') and run_id >= '2000-q1'").cache()
    metrics = scoring.finding_metrics(rows)
    judged = trend(scoring.policy(scoring.score_cards(scoring.category_scores(metrics)).join(scoring.security_counts(metrics), ["project", "run_id"]))).cache()
    store, tables = str(tmp_path / "store"), {"scores": judged.select("project", "run_id", "overall_score", "grade"), "policies": judged.select("project", "run_id", "status", "reasons")}
    for _ in range(2):  # publishing again replaces, never doubles
        artifacts.publish(tables, store)
    assert artifacts.runs(spark, store).count() == judged.count() and artifacts.verified(spark, store).count() == 0
    last = artifacts.latest(spark, store)
    assert {r.project: r.run_id for r in last.collect()} == {r.project: r.m for r in judged.groupBy("project").agg({"run_id": "max"}).toDF("project", "m").collect()}
    artifacts.export_json(judged.select("project", "run_id", "status"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == judged.count()
    assert [artifacts.allocate("r", t) for t in (set(), {"r"}, {"r", "r_01"})] == ["r", "r_01", "r_02"]


def test_stream_takes_each_finding_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    report = lambda run, line: {"project": "p", "run_id": run, "tool": "bandit", "stdout": json.dumps({"results": [{"filename": "src/a.py", "test_id": "B105", "issue_text": "m", "line_number": line}]}), "stderr": "", "root": "", "arrived": "2024-01-01T00:00:00Z"}
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(report("r1", x)) for x in (1, 2)) + "\n" + json.dumps(report("r2", 1)))
    rows = ingest.findings(ingest.reports(spark, str(tmp_path / "in")), ["bandit"])
    ingest.to_table(rows, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.run_id, r.rule_id, r.security_class) for r in got) == [("r1", "B105", "runtime_security"), ("r2", "B105", "runtime_security")]


def test_digests_tell_reports_apart(spark):
    summary = spark.createDataFrame([("p", "r", 1), ("p", "s", 1), ("p", "t", 1), ("p", "u", 1)], "project string, run_id string, score int")
    rows = [("p", "r", "a", 1), ("p", "r", "b", 2), ("p", "s", "b", 2), ("p", "s", "a", 1), ("p", "t", "a", 1)]
    findings = spark.createDataFrame(rows, "project string, run_id string, rule string, line int")
    got = {r.run_id: r.report_sha256 for r in artifacts.digests(summary, findings.repartition(3)).collect()}
    assert got["r"] == got["s"] and len({got[k] for k in "rtu"}) == 3 and all(len(x) == 64 for x in got.values())


def test_times_plans_and_samples(spark):
    one = spark.range(1)
    assert one.select(history.local_time(F.lit("2024-07-01 10:00:00").cast("timestamp"), "Europe/Paris")).first()[0] == "2024-07-01 12:00 Europe/Paris"
    plan = spark.createDataFrame([("t", 1.0, 2, 3)], "title string, priority_score double, rank int, severity_rank int")
    assert recommend.published(plan).columns == ["title", "priority_score"]
    entries = spark.createDataFrame([(f"f{i}",) for i in range(9)], "fingerprint string")
    assert [r.fingerprint for r in baseline.sample(entries).collect()] == ["f0", "f1", "f2", "f3", "f4"]


def test_mappings_from_files(spark, tmp_path):
    (tmp_path / "m.toml").write_text('[defaults]\nseverity = "low"\n[severity_prefixes]\nS = "high"\n"SE.x" = "info"\n[posture_prefixes]\nA = "b"\n')
    found = mappings.load(str(tmp_path / "m.toml"))
    assert found == {"severity": {"S": "high", "SE.X": "info"}, "category": {}, "posture": {"A": "b"}, "default": ("low", "lint")}
    rows = spark.createDataFrame([("se.x1",), ("s1",), ("q",)], "rule string")
    assert [r[0] for r in rows.select(F.expr(mappings.longest_prefix("rule", found["severity"], found["default"][0]))).collect()] == ["info", "high", "low"]
