"""Findings derived from the order tables by fixed rules, for measuring at scale.

The same rules are written once in SQL that Spark and other engines both read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: {month}, {quarter} and {year} of the order date differ between engines; all else is shared.
RULES = """
SELECT concat('p', CAST(o_custkey % 5 AS {text})) AS project,
       concat(CAST(year(o_orderdate) AS {text}), '-q', CAST(quarter(o_orderdate) AS {text})) AS run_id,
       CASE l_suppkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 15 WHEN 3 THEN 16 WHEN 4 THEN 35 ELSE 37 END AS scanner_ord,
       l_orderkey * 8 + l_linenumber AS finding_ord,
       CASE l_suppkey % 6 WHEN 0 THEN 'ruff' WHEN 1 THEN 'pyright' WHEN 2 THEN 'bandit' WHEN 3 THEN 'opengrep' WHEN 4 THEN 'eslint' ELSE 'npm_audit' END AS tool,
       CASE WHEN l_suppkey % 6 = 2 THEN CASE l_partkey % 5 WHEN 0 THEN 'B105' WHEN 1 THEN 'B310' WHEN 2 THEN 'B404' WHEN 3 THEN 'B603' ELSE 'B104' END
            WHEN l_suppkey % 6 = 0 THEN CASE l_partkey % 5 WHEN 0 THEN 'F401' WHEN 1 THEN 'S101' WHEN 2 THEN 'E501' WHEN 3 THEN 'C901' ELSE 'W291' END
            ELSE concat('GEN.', CAST(l_partkey % 4 AS {text})) END AS rule_id,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END AS severity,
       CASE l_partkey % 8 WHEN 1 THEN 'typing' WHEN 2 THEN 'lint' WHEN 3 THEN 'maintainability' WHEN 4 THEN 'complexity' WHEN 5 THEN 'dead_code' WHEN 7 THEN 'system/parser' ELSE 'security' END AS category,
       CASE WHEN l_suppkey % 6 >= 4 THEN 'javascript' ELSE 'python' END AS language,
       concat(CASE l_orderkey % 8 WHEN 0 THEN 'src/' WHEN 1 THEN 'tests/' WHEN 2 THEN 'tools/' WHEN 3 THEN 'docs/' WHEN 4 THEN 'app/' WHEN 5 THEN 'lib/' WHEN 6 THEN 'src/vendor/' ELSE 'scripts/build/' END,
              'm', CAST(l_orderkey % 12 AS {text}), '.py') AS file,
       CAST(l_linenumber * 10 AS int) AS line,
       CASE WHEN l_orderkey % 5 < 2 THEN concat('fn_', CAST(l_partkey % 2 AS {text})) END AS symbol,
       CASE WHEN l_suppkey % 6 = 2 AND l_partkey % 5 = 0 THEN concat('Possible hardcoded password: ''', CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'NOT' ELSE 'hunter2' END, '''')
            WHEN l_suppkey % 6 = 2 AND l_partkey % 5 = 3 AND l_orderkey % 2 = 0 THEN concat('subprocess call with shell=True at line ', CAST(l_linenumber AS {text}))
            ELSE concat(substr(p_name, 1, 1), 'ad part  in "module" at  Line ', CAST(l_linenumber AS {text}), ' of 0x', CAST(l_partkey % 9 AS {text}), 'f!!') END AS message,
       CAST((CAST(l_quantity AS int) % 4 + 1) * 0.25 AS double) AS confidence,
       CASE WHEN l_orderkey % 2 = 0 THEN concat('{{"native_severity":"', o_orderpriority, '","snippet":" ', p_name, ' "}}')
            WHEN l_orderkey % 7 = 1 THEN concat('{{"secret_real":true,"detail":"', l_returnflag, '"}}') ELSE '{{}}' END AS raw_payload
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
"""

DUCK_SQL = RULES.format(text="varchar")
#: All columns that can tell two derived findings apart, in the order of the report.
ORDER = ["scanner_ord", "finding_ord", "rule_id", "file", "message", "symbol", "severity", "category", "confidence", "raw_payload"]


def run(spark: SparkSession, rules: str, **tables: DataFrame) -> DataFrame:
    """The rules over tables; all other braces are text."""
    sql = rules.format(text="string").replace("{", "{{").replace("}", "}}")
    for name in tables:
        sql = sql.replace(f"FROM {name}\n", f"FROM {{{name}}}\n").replace(f"FROM {name}) ", f"FROM {{{name}}}) ").replace(f"FROM {name} ", f"FROM {{{name}}} ").replace(f"JOIN {name} ", f"JOIN {{{name}}} ")
    return spark.sql(sql, **tables)


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each order line. Orders and parts are joined by key; Spark picks how. The lines are
    dealt by order, so that all cores work on what follows even if the table is one small file; a join
    that sorts both tables asks for the same, so nothing is moved twice, and no text of a finding is."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "part")}
    tables["lineitem"] = tables["lineitem"].repartition("l_orderkey")
    return run(spark, RULES, **tables)


#: Files of projects, with texts on which rules do and do not hold; nl is a line feed.
FILE_RULES = """
SELECT project, CASE WHEN root THEN name ELSE concat('d', CAST(k AS {text}), CASE WHEN k % 7 = 0 THEN '/tests/' WHEN k % 11 = 0 THEN '/node_modules/' ELSE '/' END, name) END AS path,
  CASE WHEN k % 16 < 2 THEN concat('FROM x', nl, CASE WHEN b1 THEN '  user root' ELSE 'USER rooted' END, nl, CASE WHEN b2 THEN 'HEALTHCHECK CMD y' ELSE '' END, nl, CASE WHEN b3 THEN 'ADD a b' ELSE 'COPY a b' END)
       WHEN k % 16 < 4 THEN concat('services:', nl, CASE WHEN b1 THEN '    privileged: true' ELSE '    # privileged: true' END, nl, CASE WHEN b2 THEN '    ports:' ELSE '    ports: [1]' END, nl, CASE WHEN b3 THEN '    network_mode: host' ELSE '    network_mode: hosted' END)
       WHEN k % 16 < 6 THEN concat(CASE WHEN b1 THEN 'PublishPort = 80:80' ELSE 'Publish=1' END, nl, CASE WHEN b2 THEN 'User = root' ELSE 'User=rooted' END, nl)
       WHEN k % 16 < 10 THEN concat(CASE WHEN b1 THEN 'ssl_protocols TLSv1 TLSv1.2;' ELSE 'ssl_protocols TLSv1_2;' END, nl, CASE WHEN b2 THEN 'server_tokens on;' ELSE 'server_tokens off;' END, nl, CASE WHEN b3 THEN 'insecureSkipVerify: TRUE' ELSE '' END)
       WHEN k % 16 = 10 THEN concat(CASE WHEN b1 THEN 'cidr = "0.0.0.0/0"' ELSE 'cidr = "10.0.0.0/8"' END, nl, CASE WHEN b2 THEN 'is_public = true' ELSE 'public = trueish' END, nl, CASE WHEN b3 THEN 'encrypted=false' ELSE '' END)
       WHEN k % 16 = 11 THEN concat('import os', nl, nl, CASE WHEN b1 THEN 'DEBUG = True' ELSE 'DEBUG = Trueish' END, nl, CASE WHEN b2 THEN 'ALLOWED_HOSTS = [ ]' ELSE 'ALLOWED_HOSTS = ["x"]' END, nl, CASE WHEN b3 THEN 'SECURE_PROXY_SSL_HEADER = 1' ELSE '' END)
       WHEN k % 16 = 12 AND root THEN CASE WHEN b1 THEN 'Django==4' ELSE 'flask' END
       WHEN k % 16 = 12 THEN concat(CASE WHEN k % 23 < 12 THEN 'from django.db import models' ELSE 'from fastapi import FastAPI' END, nl, CASE WHEN k % 23 = 20 THEN 'app = FastAPI()' ELSE '' END, nl, CASE WHEN k % 23 = 22 THEN 'import rest_framework' ELSE '' END, nl, CASE WHEN b1 THEN 'q = A.objects.raw("x")' ELSE 'q = 1' END, nl, CASE WHEN b2 THEN 'r = A.objects.all()' ELSE '' END, nl, CASE WHEN b3 THEN 's = A.select_related("b")' ELSE '' END)
       WHEN k % 16 < 15 THEN concat('<p>', nl, CASE WHEN b1 THEN '{{% autoescape OFF %}}' ELSE '' END, nl, '<form method="', CASE WHEN b2 THEN 'post' ELSE 'get' END, '">', nl, CASE WHEN b3 THEN '{{% csrf_token %}}' ELSE '<input name="x">' END, '</form>', nl,
            '<FORM id=two method=''POST''>', CASE WHEN k % 3 = 0 THEN '{{{{ form.csrf() }}}}' WHEN k % 3 = 1 THEN '<input type="hidden" name="csrf_token">' ELSE 'csrf' END, '</FORM >')
       WHEN NOT root THEN ''
       WHEN b1 THEN concat('{{"dependencies":{{"react":"1","left-', CAST(k % 3 AS {text}), '":"1"}},"devDependencies":{{"', CASE WHEN b2 THEN 'next' ELSE 'express' END, '":"2"}}}}')
       ELSE '{{"name":"x"}}' END AS text
FROM (SELECT concat('p', CAST(p_partkey % 23 AS {text})) AS project, p_partkey AS k, p_partkey % 32 >= 16 AS b1, p_partkey % 64 >= 32 AS b2, p_partkey % 128 >= 64 AS b3, chr(10) AS nl, p_partkey < 368 AND p_partkey % 16 IN (12, 15) AS root,
  CASE p_partkey % 16 WHEN 0 THEN 'Dockerfile' WHEN 1 THEN 'Containerfile' WHEN 2 THEN 'docker-compose.yml' WHEN 3 THEN 'compose.yaml' WHEN 4 THEN 'web.container' WHEN 5 THEN 'x.kube' WHEN 6 THEN 'my-traefik-1.yml'
    WHEN 7 THEN 'nginx.conf' WHEN 8 THEN 'site.nginx.conf' WHEN 9 THEN 'httpd.conf' WHEN 10 THEN 'main.tf' WHEN 11 THEN 'settings.py' WHEN 12 THEN CASE WHEN p_partkey < 368 THEN 'requirements.txt' ELSE 'models.py' END WHEN 13 THEN 'templates/a.html' WHEN 14 THEN 'templates/sub/b.html' ELSE CASE WHEN p_partkey < 368 THEN 'package.json' WHEN p_partkey % 3 = 0 AND p_partkey % 23 < 9 THEN 'app.tsx' ELSE 'app.js' END END AS name
  FROM part) x
"""

#: Java projects: a module or a source for each part; the texts tell frameworks and annotations.
JAVA_RULES = """
SELECT concat('j', CAST(k % 13 AS {text})) AS project,
  CASE WHEN k < 13 AND k % 2 = 0 THEN CASE WHEN k % 4 = 0 THEN 'pom.xml' ELSE 'build.gradle' END WHEN k < 26 THEN CASE WHEN k % 3 = 0 THEN 'mvnw' ELSE 'gradlew' END
    WHEN k % 13 = 12 THEN concat('src/', CAST(k AS {text}), '.java')
    WHEN k % 4 = 0 THEN concat('m', CAST(k AS {text}), CASE WHEN k % 8 = 0 THEN '/pom.xml' ELSE '/build.gradle.kts' END) ELSE concat('m', CAST(k AS {text}), '/src/A.java') END AS path,
  concat(CASE WHEN k % 5 = 0 THEN '<groupId>org.springframework.boot</groupId>' WHEN k % 5 = 1 THEN 'io.micronaut' WHEN k % 5 = 2 THEN 'IO.Quarkus' WHEN k % 5 = 3 THEN 'jakarta.ee' ELSE '' END,
    CASE WHEN k % 3 = 0 THEN ' @RestController class A' ELSE '' END, CASE WHEN k % 7 = 0 THEN ' @PreAuthorize("x")' ELSE '' END, CASE WHEN k % 11 = 0 THEN ' @Entity @Valid' ELSE '' END, CASE WHEN k % 17 = 0 THEN ' /actuator' ELSE '' END) AS text
FROM (SELECT p_partkey AS k FROM part) x
"""

#: Projects with and without Django: a file for each part.
DJANGO_RULES = """
SELECT concat('d', CAST(k % 11 AS {text})) AS project,
  CASE WHEN k < 11 THEN CASE k % 3 WHEN 0 THEN 'manage.py' WHEN 1 THEN 'requirements.txt' ELSE 'pyproject.toml' END WHEN k % 4 = 0 THEN concat('app', CAST(k AS {text}), '/settings.py') WHEN k % 4 = 1 THEN concat('app', CAST(k AS {text}), '/templates/x.html')
    WHEN k % 4 = 2 THEN concat('app', CAST(k AS {text}), '/consumers.py') ELSE concat('node_modules/', CAST(k AS {text}), '/settings.py') END AS path,
  CASE WHEN k < 11 THEN CASE WHEN k % 2 = 0 THEN 'uses Django here' ELSE 'uses flask here' END WHEN k % 4 = 0 THEN CASE WHEN k % 9 = 0 THEN 'DEBUG = True' ELSE 'x = 1' END
    WHEN k % 4 = 2 THEN CASE WHEN k % 17 = 0 THEN 'from channels import x' WHEN k % 19 = 1 THEN 'import daphne' WHEN k % 13 = 2 THEN 'import rest_framework' WHEN k % 23 = 3 AND k % 11 > 7 THEN 'from django.db import models' WHEN k % 29 = 4 THEN 'models.Model' ELSE '' END ELSE 'DEBUG = True' END AS text
FROM (SELECT p_partkey AS k FROM part) x
"""

#: Results of scanners: one for each order. Few have errors, so runs pass, warn and fail.
RESULT_RULES = """
SELECT concat('p', CAST(o_custkey % 7 AS {text})) AS project, concat('r', CAST(o_custkey % 271 AS {text})) AS run_id, CAST(o_custkey % 271 AS int) AS run_no, CAST(o_orderkey AS bigint) AS scanner_ord,
  concat('s', CAST(o_orderkey % 43 AS {text})) AS scanner, o_orderkey % 509 NOT IN (1, 2, 3, 4) AS success,
  CASE o_orderkey % 509 WHEN 1 THEN 'scanner_parser_missing' WHEN 2 THEN 'scanner_parse_error' WHEN 3 THEN 'scanner_timeout' WHEN 4 THEN 'finding_path_invalid' END AS error_code,
  CAST(o_orderkey % 5 AS bigint) AS finding_count, CASE WHEN o_orderkey % 509 = 2 THEN 2 WHEN o_orderkey % 1019 = 4 THEN 3 END AS invalid_finding_count, CAST(o_orderkey % 90 AS bigint) AS input_files,
  CASE WHEN o_orderkey % 29 = 0 THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'critical' ELSE 'medium' END WHEN '2' THEN 'high' WHEN '3' THEN 'medium' WHEN '4' THEN 'low' ELSE 'info' END END AS severity,
  CASE o_orderkey % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'lint' WHEN 2 THEN 'typing' ELSE 'complexity' END AS category,
  CASE WHEN o_orderkey % 13 = 0 THEN 'coverage_percent' WHEN o_orderkey % 13 = 1 THEN 'avg_complexity' END AS scalar, CAST(o_orderkey % 101 AS double) AS scalar_value
FROM orders
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, text), a file for each part."""
    return run(spark, FILE_RULES, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result of a scanner for each order, with the severity and category of a finding, if any."""
    return run(spark, RESULT_RULES, orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))


def java_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, text) of Java projects, a file for each part."""
    return run(spark, JAVA_RULES, part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def django_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(project, path, text) of projects with and without Django, a file for each part."""
    return run(spark, DJANGO_RULES, part=spark.read.parquet(f"{sf_dir}/part.parquet"))
