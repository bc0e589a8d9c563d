"""Issue-tracker tables derived from ``documents`` by SQL that Spark and DuckDB both run.

The texts are whole; markup, stack traces and code are appended to the descriptions by a fixed rule.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from tracklens.schema import TABLES
from tracklens.sources.issues import conformed

VIEWS = {
    "issues": """SELECT doc_id AS issue_id,
  (CASE WHEN doc_id % 4 = 3 THEN 'ALPHA2' ELSE 'ALPHA' END) || '-' || CAST(doc_id AS STRING) AS issue_key,
  CASE WHEN doc_id % 4 = 3 THEN 'ALPHA2' ELSE 'ALPHA' END AS project,
  '20' || lpad(CAST(8 + doc_id % 15 AS STRING), 2, '0') || '-' || lpad(CAST(1 + doc_id % 12 AS STRING), 2, '0')
       || '-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T' || lpad(CAST(doc_id % 24 AS STRING), 2, '0')
       || ':01:46.000+0000' AS create_time,
  CAST(NULL AS STRING) AS update_time, CAST(NULL AS STRING) AS resolve_time, 'Bug' AS issue_type, text AS summary,
  CASE WHEN doc_id % 16 = 7 THEN NULL ELSE text || CASE doc_id % 8
    WHEN 0 THEN ' see https://host.example.com/a/b?x=1). end' || chr(10)
    WHEN 1 THEN chr(10) || '{code:java}' || chr(10) || 'int x = 1; // note this' || chr(10) || 'foo(a);' || chr(10) || '{code} after http://x.example.org/{noformat}y{noformat}'
    WHEN 2 THEN ' {noformat}raw log at 10{noformat} after'
    WHEN 3 THEN ' {color:#ff0000}hot text{color} after {color:red}q{color:blue} end'
    WHEN 4 THEN chr(10) || 'java.io.EOFException: null' || chr(10) || '    at org.acme.A.run(A.java:96)' || chr(10)
             || 'Caused by: java.lang.RuntimeException: x' || chr(10) || '    at org.acme.B.go(B.java:7)' || chr(10)
    WHEN 5 THEN chr(10) || 'if (a) { b(c); { d(); } }' || chr(10) || '/* multi' || chr(10) || ' line */ tail'
    WHEN 6 THEN chr(160) || 'wide' || chr(13) || chr(10) || 'x = y;' || chr(13) || chr(10)
    ELSE '' END END AS description,
  'Major' AS priority, 'Open' AS status, CAST(NULL AS STRING) AS resolution,
  CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'dev' || CAST((doc_id * doc_id + doc_id) % 61 AS STRING) END AS assignee,
  'c' || CAST(doc_id % 13 AS STRING) AS creator, 'r' || CAST(doc_id % 17 AS STRING) AS reporter,
  CAST(NULL AS STRING) AS environment, CAST(doc_id % 9 AS INT) AS watch_count,
  CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'documentation'
    WHEN 3 THEN ' ; client,documentation' ELSE 'client ;  maven,,' END AS labels
FROM documents""",
    "issue_component": """SELECT issue_key, CASE issue_id % 12 WHEN 0 THEN 'server' WHEN 1 THEN 'client' WHEN 2 THEN 'tests'
    WHEN 3 THEN 'documentation' WHEN 4 THEN 'build' WHEN 5 THEN 'quorum' WHEN 6 THEN 'c client' WHEN 7 THEN 'security'
    WHEN 8 THEN 'jmx' WHEN 9 THEN 'jute' WHEN 10 THEN 'scripts' ELSE 'server' END AS component FROM issues
  UNION ALL SELECT issue_key, CASE WHEN issue_id % 2 = 0 THEN 'server' ELSE 'quorum' END FROM issues WHERE issue_id % 9 = 4""",
    # Releases come from the issues: a version's is in the month of its first issue, so some share a day; the last has none.
    "release_dim": """SELECT 'v' || CAST(issue_id % 8 AS STRING) AS version, CAST(min(issue_id * 5 % 8) AS INT) AS ordinal, min(substr(create_time, 1, 7)) || '-01' AS release_date
    FROM issues WHERE issue_id % 8 <> 7 GROUP BY issue_id % 8""",
    "issue_version": """SELECT issue_key, 'v' || CAST(issue_id % 8 AS STRING) AS version FROM issues""",
    # The component classes.
    "component_class": """SELECT * FROM (VALUES ('server', 0), ('client', 1), ('tests', 2), ('documentation', 3), ('build', 4),
    ('quorum', 5), ('scripts', 6), ('leaderElection', 7), ('security', 8), ('metric system', 9), ('jmx', 10),
    ('jute', 11), ('default other', 12)) AS t(component, class_id)""",
}


def views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables as DataFrames by name."""
    mark = f"{zlib.crc32(sf_dir.encode()):08x}"
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView(f"documents_{mark}")
    out = {}
    for name, sql in VIEWS.items():
        out[name] = spark.sql(sql.replace("FROM documents", f"FROM documents_{mark}").replace("FROM issues", f"FROM issues_{mark}"))
        if name in TABLES:
            out[name] = conformed(out[name], TABLES[name])
        out[name].createOrReplaceTempView(f"{name}_{mark}")
    return out


def with_views(sql: str, *more: tuple[str, str], once: bool = False) -> str:
    """``sql`` for DuckDB with the derived tables, and ``more`` ones, in front."""
    named = [*VIEWS.items(), *more]
    # Rounds that are written out refer to the one before many times: each is computed once.
    kept = lambda n: "MATERIALIZED " if once and n not in VIEWS else ""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {kept(n)}({q})" for n, q in named) + "\n" + sql
