"""The report portal: four kinds of pages, made and written where their rows are.

blocks() of a page are rows (path, title, section, place, row): what its tables hold, as JSON. pages()
gives (path, content), a group a page. Pages are of bounded size: what is listed whole, projects on the
index and a run's security findings, goes over to further pages of PAGE_ROWS rows each.

write_site() writes pages by a data source: every task writes its files into a folder of a version of
its own, and the commit moves one small file into place that names the version. Until then readers find
the version before, whole; a write that fails leaves it as it was.
"""

from __future__ import annotations

import html
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from verdigris.operators import history, portal
from verdigris.operators.ordered import numbers, ranks
from verdigris.sources.scanners import opened
from verdigris.sources.work import written

RUN = ["project", "run_id"]
PAGE_ROWS = 500
#: The sections of pages, in the order in which they are shown.
SECTIONS = ["summary", "links", "runs", "projects", "metrics", "top", "quick_win", "security", "architecture", "severities", "clusters", "security_groups", "files", "families", "parsers", "trend", "findings"]
CURRENT = "_current.json"
STYLE = "body{font-family:sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #999;padding:.3em .6em;text-align:left}"


def document(title: str, body: str) -> str:
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title><style>{STYLE}</style></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def shown(value) -> str:
    """A cell; a link is an object {href, text}."""
    if type(value) is str:
        return html.escape(value)
    if isinstance(value, dict) and set(value) == {"href", "text"}:
        return f"<a href='{html.escape(value['href'], quote=True)}'>{html.escape(str(value['text']))}</a>"
    if isinstance(value, list):
        return "<br>".join(map(shown, value))
    return "" if value is None else html.escape(f"{value:g}" if isinstance(value, float) else str(value))


def grid(rows: list[dict]) -> str:
    names = list(dict.fromkeys(k for row in rows for k in row))
    line = lambda tag, cells: f"<tr><{tag}>" + f"</{tag}><{tag}>".join(cells) + f"</{tag}></tr>"
    return "<table>" + line("th", [html.escape(n.replace("_", " ")) for n in names]) + "".join([line("td", [shown(row.get(n)) for n in names]) for row in rows]) + "</table>"


def rendered(page: pd.DataFrame) -> pd.DataFrame:
    """One page from its blocks."""
    held: dict[str, list] = {}
    for section, place, row in zip(page["section"].tolist(), page["place"].tolist(), page["row"].tolist()):
        held.setdefault(section, []).append((place, row))
    body = "".join(f"<h2 id='{section}'>{section.replace('_', ' ')}</h2>" + grid([json.loads(x) for _, x in sorted(held[section])]) for section in SECTIONS if section in held)
    return pd.DataFrame({"path": [page["path"].iloc[0]], "content": [document(page["title"].iloc[0], body)]})


def block(rows: DataFrame, path: Column, title: Column, section: str, place: Column, *columns: Column | str) -> DataFrame:
    return rows.select(path.alias("path"), title.alias("title"), F.lit(section).alias("section"), place.cast("long").alias("place"), F.to_json(F.struct(*columns)).alias("row"))


def linked(href: Column, text: Column) -> Column:
    return F.struct(href.alias("href"), text.alias("text"))


def run_path(page: str) -> Column:
    return F.concat(F.lit("projects/"), "project", F.lit("/runs/"), "run_id", F.lit(f"/{page}.html"))


def numbered(rows: DataFrame, group: list[str], order: list) -> DataFrame:
    """Adds place from 0 and sheet, the number of the page that a row goes to, from 1. Rows that agree in
    the order have places of their own, so that every page but the last is full."""
    placed = numbers(rows, group, order, "place").withColumn("place", F.col("place") - 1)
    return placed.withColumn("sheet", F.floor(F.col("place") / PAGE_ROWS) + 1)


def sheet_name(name: str, sheet: Column) -> Column:
    return F.when(sheet == 1, f"{name}.html").otherwise(F.concat(F.lit(f"{name}-"), sheet.cast("string"), F.lit(".html")))


def blocks(cards: DataFrame, findings: DataFrame, plan: DataFrame, scalars: DataFrame | None = None) -> DataFrame:
    """The blocks of all pages. cards: runs with overall_score, grade, status, reasons, previous_score and
    trend_delta; findings: normalised and classified; plan: the lists of the action plan; scalars:
    (project, run_id, name, value)."""
    c = F.col
    counts = written(cards.select(*RUN).join(findings.groupBy(*RUN).agg(*(F.count_if(c("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info"))), RUN, "left").fillna(0), "counts")
    whole = cards.join(counts, RUN)
    title = F.concat(c("project"), F.lit(" "), c("run_id"))
    figures = ["overall_score", "grade", "status", "reasons", "critical", "high", "medium", "low", "trend_delta"]
    report, details, project = run_path("report"), run_path("details"), F.concat(F.lit("projects/"), c("project"), F.lit("/index.html"))
    zero = F.lit(0)
    security = findings.where("category = 'security'")
    cells = ["rule_id", "file", "line", "message", "score_weight"]
    listed = numbered(security.select(*RUN, portal.security_group(c("security_class")).alias("group"), "severity", "scanner_ord", "finding_ord", *cells), RUN, [*portal_order(), "scanner_ord", "finding_ord", *cells])
    sheets = listed.select(*RUN, "sheet").distinct()
    nav = F.array(linked(F.lit("details.html"), F.lit("details")), linked(F.lit("../../index.html"), F.lit("history")), linked(F.lit("summary.json"), F.lit("summary")), linked(F.lit("findings.json"), F.lit("findings")))
    own = lambda name: F.concat(F.lit("runs/"), c("run_id"), F.lit(f"/{name}.html"))
    # runs of a project in the order of their names, the last first
    runs = ranks(whole.withColumn("back", F.lit(0)), ["project"], ["run_id"], "nth")
    latest = numbered(history.latest(whole).withColumn("site", F.lit(0)), ["site"], [F.when(c("status") == "fail", 0).when(c("status") == "warn", 1).when(c("status") == "pass", 2).otherwise(3), "overall_score", "project"])
    index = sheet_name("index", c("sheet"))
    parts = [
        block(whole, report, title, "summary", zero, *figures), block(whole, report, title, "links", zero, nav.alias("pages")),
        *(block(plan.where(c("list") == name), report, title, name, c("place"), "title", "priority_score", "priority", "effort", "supporting_findings_count", "why", "recommended_fix", "where") for name in ("top", "quick_win", "security", "architecture")),
        block(whole, details, title, "summary", zero, *figures), block(whole, details, title, "trend", zero, "overall_score", "previous_score", "trend_delta"),
        block(counts.unpivot(RUN, ["critical", "high", "medium", "low", "info"], "severity", "n"), details, title, "severities", zero, "severity", c("n").alias("count")),
        block(portal.clusters(findings), details, title, "clusters", c("rank"), "severity", "category", "message_family", "count", "example_files"),
        block(portal.security_groups(findings), details, title, "security_groups", zero, "security_group", "count"),
        block(portal.affected_files(findings), details, title, "files", c("rank"), "file", "count"), block(portal.rule_families(findings), details, title, "families", c("rank"), "rule_family", "count"),
        block(portal.parser_summary(findings).where("scanner IS NOT NULL"), details, title, "parsers", zero, "scanner", "rule_id", "count"),
        block(sheets, details, title, "links", c("sheet"), linked(sheet_name("security", c("sheet")), F.concat(F.lit("security findings "), c("sheet").cast("string"))).alias("page")),
        block(listed, F.concat(F.lit("projects/"), "project", F.lit("/runs/"), "run_id", F.lit("/"), sheet_name("security", c("sheet"))), title, "findings", c("place"), "group", "severity", *cells),
        block(runs, project, c("project"), "runs", -c("nth"), linked(own("report"), c("run_id")).alias("run"), linked(own("details"), F.lit("details")).alias("more"), *figures),
        block(latest, index, F.lit("Projects"), "projects", c("place"), linked(F.concat(F.lit("projects/"), "project", F.lit("/index.html")), c("project")).alias("project"), *figures),
        block(latest.select("sheet").distinct(), F.lit("index.html"), F.lit("Projects"), "links", c("sheet"), linked(index, F.concat(F.lit("projects, page "), c("sheet").cast("string"))).alias("page")),
        block(history.portfolio(latest), F.lit("index.html"), F.lit("Projects"), "summary", zero, "project_count", "pass_count", "warn_count", "fail_count", "average_score"),
    ]
    if scalars is not None:
        parts.append(block(scalars, report, title, "metrics", zero, "name", "value"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def portal_order() -> list[Column]:
    """Groups in their order, then the severities."""
    place = F.when(F.col("group") == "runtime", 0).when(F.col("group") == "tooling", 1).when(F.col("group") == "test_only", 2).otherwise(3)
    severity = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "high", 1).when(F.col("severity") == "medium", 2).when(F.col("severity") == "low", 3).otherwise(4)
    return [place, severity]


def pages(found: DataFrame) -> DataFrame:
    """(path, content) of the pages whose blocks are given."""
    return found.groupBy("path").applyInPandas(rendered, "path string, content string")


class Wrote(WriterCommitMessage):
    def __init__(self, files: int, size: int):
        self.files, self.size = files, size


class SiteWriter(DataSourceWriter):
    """Writes files of one version; the commit publishes it."""

    def __init__(self, root: str):
        self.root, self.version = root.rstrip("/"), f"v-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Wrote:
        where, root = opened(self.root)
        files = size = 0
        for row in rows:
            parts = row.path.split("/")
            if row.path.startswith("/") or ".." in parts:
                raise ValueError(f"{row.path} leads outside the site")
            target = f"{root}/{self.version}/{row.path}"
            where.create_dir(target.rsplit("/", 1)[0], recursive=True)
            passing, data = f"{target}.{uuid.uuid4().hex}.part", row.content.encode()
            with where.open_output_stream(passing) as out:
                out.write(data)
            where.move(passing, target)  # a task that runs twice leaves the same
            files, size = files + 1, size + len(data)
        return Wrote(files, size)

    def commit(self, messages: list[Wrote | None]) -> None:
        where, root = opened(self.root)
        told = {"version": self.version, "files": sum(m.files for m in messages if m), "bytes": sum(m.size for m in messages if m)}
        start = f"<!DOCTYPE html><meta http-equiv='refresh' content='0; url={self.version}/index.html'>"
        for name, text in (("index.html", start), (CURRENT, json.dumps(told) + "\n")):
            with where.open_output_stream(f"{root}/.{name}-{self.version}") as out:
                out.write(text.encode())
            where.move(f"{root}/.{name}-{self.version}", f"{root}/{name}")

    def abort(self, messages: list[Wrote | None]) -> None:
        where, root = opened(self.root)
        where.delete_dir(f"{root}/{self.version}")


class Site(DataSource):
    """Files (path, content) under option `path`."""

    @classmethod
    def name(cls) -> str:
        return "site_files"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema, overwrite: bool) -> SiteWriter:
        return SiteWriter(self.options["path"])


def write_site(found: DataFrame, root: str) -> dict:
    """Writes files (path, content) as the site's new version and tells what was published."""
    found.sparkSession.dataSource.register(Site)
    found.select("path", "content").write.format("site_files").mode("append").save(root)
    return current(root)


def current(root: str) -> dict:
    """{version, files, bytes} of the published version of a site."""
    where, path = opened(root.rstrip("/"))
    with where.open_input_stream(f"{path}/{CURRENT}") as f:
        return json.loads(f.read())


def read_site(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of the published version."""
    base = f"{root.rstrip('/')}/{current(root)['version']}"
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.*").text(base, wholetext=True)
    return raw.select(F.substring_index(F.col("_metadata.file_path"), f"{base.rsplit('/', 1)[1]}/", -1).alias("path"), F.col("value").alias("content"))
