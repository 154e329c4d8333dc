"""What the steps that many queries share cost: how often they run, and what they sort."""

import contextlib
import glob
import hashlib
import io
import random

import pyarrow as pa
from pyspark.sql import functions as F

from verdigris.operators import findings as ops, ordered, recommend, scoring, secrets
from verdigris.plans import queries, queries_extend, queries_scan
from verdigris.sources import artifacts, derived, java_artifacts, reports

D = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def test_an_executive_summary_classifies_once(spark, monkeypatch):
    calls, real = [], queries.classified
    monkeypatch.setattr(queries, "classified", lambda *a: calls.append(1) or real(*a))
    queries.q_executive_summary(spark, D)
    assert len(calls) == 1


def test_features_of_files_are_added_up_by_hashing(spark):
    rows = queries.clustered(spark, D)
    found = plan_of(recommend.file_features(recommend.keyed(rows), [*recommend.RUN, *recommend.KEY]))
    assert "HashAggregate" in found and "SortAggregate" not in found


def test_dedupe_adds_up_by_hashing_first(spark):
    """The least struct, which Spark sorts for, is taken of what has been added up by hashing."""
    found = plan_of(ops.dedupe(queries.identified(spark, D)))
    assert found.rindex("HashAggregate") > found.rindex("SortAggregate")


def test_a_dialect_is_found_by_halving(spark):
    """Its choice takes a few comparisons of numbers, not one with the name of each dialect."""
    sql = reports.halved("x", [(i, f"'v{i}'") for i in range(37)])
    got = spark.range(37).selectExpr("cast(id as int) AS x").selectExpr("x", f"{sql} AS v").collect()
    assert [r.v for r in got] == [f"v{r.x}" for r in got]
    chosen = reports.by_dialect(reports.DIALECTS, lambda _, d: d.rule)
    assert " IN (" not in chosen and chosen.count("dialect <") < len(reports.DIALECTS)


def test_unsound_reports_are_written_before_they_are_joined(spark, monkeypatch):
    """So Spark knows how few they are, and does not move all sound findings to join them."""
    names, real = [], reports.written
    monkeypatch.setattr(reports, "written", lambda df, name: names.append(name) or real(df, name))
    rows = [("p", f"r{i}", "bandit", '{"results":[]}' if i % 2 else "broken", "", "") for i in range(4)] + [("p", "r1", "ruff", '[{"code":"F401","message":"m","filename":"a.py","location":{"row":1}}]', "", "")]
    found = reports.parse_all(spark.createDataFrame(rows, reports.REPORT))
    assert sorted((r.run_id, r.tool, r.rule_id) for r in found.collect()) == [("r0", "verdigris", "PARSER.SCHEMA_ERROR"), ("r1", "ruff", "F401"), ("r2", "verdigris", "PARSER.SCHEMA_ERROR")]
    assert names == ["parsed", "unsound"]


def test_findings_of_several_reports_share_a_batch(spark, monkeypatch):
    """What a function reads leaves Python in full batches, not in one for each report."""
    rows = [{"project": "p", "run_id": f"r{i}", "tool": "mine", "stdout": "x" * (i % 3), "stderr": "", "root": ""} for i in range(3000)]
    frame, held = spark.createDataFrame([], reports.REPORT), []
    real = type(frame).mapInArrow
    monkeypatch.setattr(type(frame), "mapInArrow", lambda df, read, *more: held.append(read) or real(df, read, *more))
    reports.parse_by_functions(frame, {"mine": lambda out, err, root: [{"rule_id": "R", "file": "a", "message": c} for c in out]})
    made = list(held[0](iter([pa.RecordBatch.from_pylist(rows)])))
    assert [(x["run_id"], x["at"]) for b in made for x in b.to_pylist()] == [(f"r{i}", at) for i in range(3000) for at in range(i % 3)]
    assert len(made) == 3


def test_rows_that_agree_share_a_rank_across_ranges_and_batches(spark):
    """Ranges part equal rows by chance and Arrow cuts them into batches; nothing is joined but what is told of ranges."""
    rows = [("p", "a", None if i % 5 == 0 else float("nan") if i % 5 == 1 else 2.0 if i < 900 else float(i % 7)) for i in range(1200)] + [("q", "a", 2.0)] * 3 + [("q", "b", 1.0)]
    frame = spark.createDataFrame(rows, "project string, run_id string, value double").repartition(5)
    place = {None: -1.0}
    for adaptive, size in (("false", "16"), ("true", "10000")):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = ordered.ranks(frame, ["project", "run_id"], ["value"], "rank").collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert len(got) == len(rows)
        as_number = lambda v: place[None] if v is None else 1e9 if v != v else v
        for run in (("p", "a"), ("q", "a"), ("q", "b")):
            values = sorted(as_number(v) for *r, v in rows if tuple(r) == run)
            assert {(as_number(r.value), r["rank"]) for r in got if (r.project, r.run_id) == run} == {(v, values.index(v) + 1) for v in values}


def test_places_move_findings_once(spark, monkeypatch):
    """The findings are dealt by range and written; no key of theirs is counted or joined back."""
    names, real = [], ordered.written
    monkeypatch.setattr(ordered, "written", lambda df, name: names.append((name, plan_of(df).count("Exchange rangepartitioning"), plan_of(df).count("Join"))) or real(df, name))
    queries.q_severity_order(spark, D)
    assert [n for n, *_ in names] == ["ranges", "spans"] and names[0][1:] == (1, 0)
    assert "repartition" not in derived.findings(spark, D)._jdf.queryExecution().logical().toString().split("\n")[0].lower()


def test_findings_are_counted_before_they_are_scored(spark):
    """Alike findings are one row; what dedupe keeps of them, and its metrics, are those of all findings."""
    rng, sha = random.Random(2), lambda x: hashlib.sha256(x.encode()).hexdigest()
    rows = []
    for i in range(800):
        tool, what = rng.choice(["ruff", "bandit", "eslint"]), rng.randrange(12)
        rows.append(("p", f"r{i % 2}", rng.choice([1, 2]), i, tool, rng.choice(["security", "lint"]), rng.choice(["high", "low"]), rng.choice([0.0, 0.1, 1.0]), sha(f"{tool}{what}"), sha(f"_{what}")))
    frame = spark.createDataFrame(rows, "project string, run_id string, scanner_ord int, finding_ord long, tool string, category string, severity string, score_weight double, fingerprint string, dedupe_key string").repartition(3)
    found = ops.counted(frame)
    assert found.count() < 800 and found.agg(F.sum("alike")).first()[0] == 800
    assert ops.kept(found).agg(F.sum("alike")).first()[0] < 800
    metrics = lambda df: sorted(map(str, scoring.finding_metrics(df).collect()))
    assert metrics(ops.kept(found)) == metrics(ops.dedupe(frame).where("kept"))


def test_equal_reports_are_read_once(spark, monkeypatch):
    """All dialects in one pass, and a report that several findings share once, standing for all of them."""
    held, real = [], reports.parse
    monkeypatch.setattr(reports, "parse", lambda made, *more: held.append(made) or real(made, *more))
    found = queries.q_parse_reports(spark, D)
    all_of = derived.findings(spark, D).where("tool IN ('ruff', 'bandit', 'opengrep')").count()
    assert len(held) == 1 and held[0].agg(F.sum("alike")).first()[0] == all_of == found.agg(F.sum("count")).first()[0]
    assert held[0].count() < all_of


def test_a_run_is_published_in_few_files(spark, tmp_path):
    """Not in one of each task."""
    frame = spark.range(900).select(F.lit("p").alias("project"), F.concat(F.lit("r"), F.col("id") % 3).alias("run_id"), "id").repartition(9)
    artifacts.publish({"findings": frame.withColumn("severity", F.lit("low"))}, f"file://{tmp_path}/store", "c1")
    assert len(glob.glob(f"{tmp_path}/store/data/findings/commit=c1/project=p/run_id=*/*.parquet")) == 3
    assert artifacts.load(spark, f"file://{tmp_path}/store", "findings").count() == 900


def test_secrets_are_counted_before_they_are_written(spark, monkeypatch):
    """A finding's payload and the digits of its keys are not moved, and alike findings are one row."""
    held, real = {}, queries_scan.written
    monkeypatch.setattr(queries_scan, "written", lambda df, name: held.setdefault(name, real(df, name)))
    got = queries_scan.q_secrets(spark, "/root/testdata/sf0.01")
    kinds = dict(held["secrets"].dtypes)
    assert "raw_payload" not in kinds and kinds["fingerprint"] == kinds["dedupe_key"] == "binary"
    rows = ops.normalize(queries_scan.secret_findings(spark, "/root/testdata/sf0.01"))
    assert held["secrets"].agg(F.sum("alike")).first()[0] == rows.count() > held["secrets"].count()
    want = secrets.counters(ops.dedupe(rows), queries.entries(rows), F.expr(queries.NOW))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_unsound_artifacts_are_written_before_they_are_joined(spark, monkeypatch):
    names, real = [], java_artifacts.written
    monkeypatch.setattr(java_artifacts, "written", lambda df, name: names.append(name) or real(df, name))
    bug = '<BugCollection><BugInstance type="T" rank="1"><LongMessage>m</LongMessage><SourceLine sourcepath="A.java" start="1"/></BugInstance></BugCollection>'
    left = [("p", "mvnw", ""), ("q", "mvnw", "")] + [(p, f"m{k}/{at}", text) for p in "pq" for k in range(2) for at, text in (("pom.xml", ""), ("target/spotbugsXml.xml", "<Bug" if p == "q" and k else bug), ("target/site/pmd.xml", "x"))]
    files = spark.createDataFrame(left, "project string, path string, text string")
    found = java_artifacts.findings(java_artifacts.artifacts(files).where("tool = 'spotbugs'"), "r1")
    assert sorted((r.project, r.tool, r.rule_id, r.finding_ord) for r in found.collect()) == [("p", "spotbugs", "T", 0), ("p", "spotbugs", "T", 1), ("q", "verdigris", "PARSER.SCHEMA_ERROR", 0)]
    assert names == ["artifacts", "unsound"]


def test_a_site_classifies_once(spark, monkeypatch):
    calls, real = [], queries.classified
    monkeypatch.setattr(queries, "classified", lambda *a: calls.append(1) or real(*a))
    assert queries_extend.site(spark, D).count() > 100 and len(calls) == 1
