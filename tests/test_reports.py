"""Each dialect from an inline report."""

import json
import random

import pytest

from verdigris.sources import reports as R
from verdigris.sources.samples import CASES

J = json.dumps


def frame(spark, rows):
    return spark.createDataFrame([("p", "r", t, out, err, "/work/p") for t, out, err in rows], R.REPORT)


def test_every_dialect_has_a_case():
    assert set(CASES) == set(R.DIALECTS)


@pytest.mark.parametrize("name", sorted(CASES))
def test_dialect(spark, name):
    text, want = CASES[name]
    tool = R.DIALECTS[name].tool or name
    got = R.parse(frame(spark, [(tool, text, "")]), name).orderBy("finding_ord").collect()
    assert [r.problem for r in got] == [None] * len(want)
    assert [(r.rule_id, r.severity, r.category, r.file, r.line, r.message) for r in got] == want
    assert R.parse(frame(spark, [(tool, "  ", "")]), name).count() == 0


@pytest.mark.parametrize("tool, text, problem", [
    ("bandit", "{broken", "SCHEMA_ERROR"), ("bandit", J({"results": {}}), "SCHEMA_ERROR"), ("bandit", J({"results": [{"filename": "a", "test_id": "B1", "issue_text": "t", "line_number": "x"}]}), "SCHEMA_ERROR"),
    ("ruff", J([{"code": 5, "message": "m", "filename": "a"}]), "SCHEMA_ERROR"), ("ruff", J([{"code": "E", "message": "m", "filename": "../a"}]), "INVALID_PATH"), ("ruff", J([{"code": "E", "message": "m", "filename": "/etc/passwd"}]), "INVALID_PATH"),
    ("trufflehog", "{}\nbroken", "SCHEMA_ERROR"), ("checkstyle", "<checkstyle><file", "SCHEMA_ERROR"),
])
def test_unsound_reports(spark, tool, text, problem):
    rows = R.parse(frame(spark, [(tool, text, "")]), tool).collect()
    assert problem in {r.problem for r in rows}


def test_one_bad_entry_spoils_its_report_only(spark):
    bad = J([{"code": "F401", "message": "m", "filename": "a.py"}, {"code": "F401", "message": "m", "filename": "../b.py"}])
    rows = R.parse_all(frame(spark, [("ruff", bad, ""), ("bandit", CASES["bandit"][0], "")]), ["ruff", "bandit"]).collect()
    assert sorted((r.tool, r.rule_id, r.category) for r in rows) == [("bandit", "B105", "security"), ("verdigris", "PARSER.INVALID_PATH", "system/parser")]


def test_reading_files(spark, tmp_path):
    (tmp_path / "p1" / "r1").mkdir(parents=True)
    (tmp_path / "p1" / "r1" / "bandit.json").write_text(CASES["bandit"][0])
    (r,) = R.parse(R.read(spark, f"{tmp_path}/*/*/*.json"), "bandit").collect()
    assert (r.project, r.run_id, r.rule_id, r.file) == ("p1", "r1", "B105", "src/a.py")


def test_plain_xml_is_read_as_other_xml(spark, monkeypatch):
    """Reports in plain XML are read by searching texts, to the same findings as by a parser; what is not
    plain is left to the parser."""
    value = ["a", "x y", "7", "07", "2.5", "-3", "é ☃", "b>c", "it's", "a&amp;b", " pad ", "", "tab\there", "line=9", "99999999999", "�"]
    rng, rows = random.Random(3), []
    for k in range(400):
        v = lambda: rng.choice(value if k % 3 == 0 else value[:7])
        gap, some = rng.choice(["", "\n", "  "]), lambda *xs: "".join(x for x in xs if rng.random() < 0.7)
        errors = [f"<error{some(f' line="{v()}"', f' column="{v()}"', f' severity="{rng.choice(["error", "warning", "Info", v()])}"', f' message="{v()}"', f' source="{v()}"')}{rng.choice(["/>", " />", "></error>"] if k % 5 == 0 else ["/>"])}{gap}" for _ in range(rng.randrange(3))]
        files = [f'<file{some(f' name="{v()}"')}>{gap}{"".join(errors)}</file>{gap}' for _ in range(rng.randrange(3))]
        rows.append(("p", f"c{k}", "checkstyle", f"<checkstyle>{gap}{''.join(files)}</checkstyle>{gap}", "", ""))
        bugs = [f'<BugInstance type="{v()}" rank="{v()}">{some(f"<LongMessage>{v()}</LongMessage>", gap, f"<SourceLine sourcepath=\"{v()}\" start=\"{v()}\"/>", f"<SourceLine start=\"{v()}\"/>")}</BugInstance>' for _ in range(rng.randrange(3))]
        rows.append(("p", f"s{k}", "spotbugs", f"<BugCollection>{gap}{''.join(bugs)}</BugCollection>", "", ""))
    odd = ['<checkstyle><file name="a"><error line="1" line="2"/></file></checkstyle>', '<checkstyle><file name="a"><error line="1"/></checkstyle>', '<checkstyle><file name="a"><error line="1"/></file></other>', '<checkstyle><file name="a"><!-- <error line="1"/> --></file></checkstyle>', '<checkstyle><file name="a"><error source="s" line="1"/></file></checkstyle>', '<checkstyle><file name="a"><error /><error/></file></checkstyle>', '<checkstyle><file name="a"><error line="1"/></file></checkstyle><x/>']
    rows += [("p", f"o{k}", "checkstyle", x, "", "") for k, x in enumerate(odd)]
    made = spark.createDataFrame(rows, R.REPORT)
    dialects = {n: R.DIALECTS[n] for n in ("checkstyle", "spotbugs")}
    plain = {n: R.plain_xml(d)[0] for n, d in dialects.items()}
    share = made.selectExpr(f"avg(if(CASE tool WHEN 'checkstyle' THEN {plain['checkstyle']} ELSE {plain['spotbugs']} END, 1, 0)) AS x").first().x
    got = sorted(map(repr, R.parse(made, dialects).collect()))
    assert not made.where("run_id LIKE 'o%'").where(plain["checkstyle"]).count() and 0.2 < share < 0.9
    monkeypatch.setattr(R, "PLAIN", 0)
    assert got == sorted(map(repr, R.parse(made, dialects).collect())) and len(got) > 300
