"""Schemas of the issue-tracker tables."""

from pyspark.sql import types as T

ISSUE = T.StructType(
    [T.StructField("issue_id", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("issue_key", "project", "create_time", "update_time", "resolve_time", "issue_type", "summary", "description", "priority", "status", "resolution", "assignee", "creator", "reporter", "environment")]
    + [T.StructField("watch_count", T.IntegerType()), T.StructField("labels", T.StringType())]
)
ISSUE_COMPONENT = T.StructType([T.StructField("issue_key", T.StringType()), T.StructField("component", T.StringType())])
ISSUE_VERSION = T.StructType([T.StructField("issue_key", T.StringType()), T.StructField("version", T.StringType())])
EDGE = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType()), T.StructField("sim", T.DoubleType())])
TABLES = {"issues": ISSUE, "issue_component": ISSUE_COMPONENT, "issue_version": ISSUE_VERSION}
