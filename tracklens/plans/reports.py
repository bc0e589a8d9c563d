"""Reports over issues, their components and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.functions.dates import created, release_date
from tracklens.functions.text import label_names
from tracklens.operators.ranking import frequency, ranked
from tracklens.sources.issues import issues_of_project, rows_of_prefix


def label_counts(issues: DataFrame, project: str) -> DataFrame:
    """A1: how often each label occurs; a label twice on one issue counts twice."""
    rows = issues_of_project(issues, project).where("NOT labels = ''")
    return rows.select(F.explode(label_names(F.col("labels"))).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def component_counts(components: DataFrame, prefix: str) -> DataFrame:
    """A2."""
    return frequency(rows_of_prefix(components, prefix), "component")


def release_ranks(releases: DataFrame) -> DataFrame:
    """Releases by date, those of one day in their given order. A project has few releases: one task numbers them all."""
    rank = F.row_number().over(Window.orderBy("release_date", "ordinal"))
    return releases.select("version", "release_date", rank.alias("version_rank"))


def time_by_version(issues: DataFrame, versions: DataFrame, releases: DataFrame, project: str) -> DataFrame:
    """A point for each issue and released version: when it was created, the rank of the version."""
    rows = issues_of_project(issues, project).select("issue_key", created().alias("created")).join(versions, "issue_key")
    return rows.join(release_ranks(releases), "version").select("issue_key", "created", "version", "version_rank")


def highlighted(releases: DataFrame, version: str) -> DataFrame:
    """Where the guide lines of one release cross."""
    return release_ranks(releases).where(F.col("version") == version).select("version", release_date().alias("release_day"), "version_rank")


def assigned(issues: DataFrame, components: DataFrame, project: str) -> DataFrame:
    """Issue x component rows that have a time, a component and an assignee."""
    rows = issues_of_project(issues, project).select("issue_key", "create_time", "assignee").join(components, "issue_key")
    return rows.dropna(subset=["create_time", "component", "assignee"])


def main_assignees(rows: DataFrame, first: int = 16, last: int = 20) -> DataFrame:
    """The assignees of these ranks by number of rows; fewer if there aren't so many."""
    return ranked(frequency(rows, "assignee"), last, F.desc("n"), F.asc("assignee"), first=first, name="assignee_rank")


def main_components(rows: DataFrame, k: int = 10) -> DataFrame:
    """A4, W3."""
    return ranked(frequency(rows, "component"), k, F.desc("n"), F.asc("component"), name="component_rank")


def first_appearances(rows: DataFrame) -> DataFrame:
    """The earliest row of each assignee, by time, key and component."""
    first = rows.groupBy("assignee").agg(F.min(F.struct("create_time", "issue_key", "component")).alias("f"))
    return first.select("assignee", "f.create_time", "f.issue_key", "f.component")


def assignee_by_component(issues: DataFrame, components: DataFrame, project: str) -> DataFrame:
    """R2: a point for each row of a main assignee and a main component, and whether it is the assignee's first."""
    rows = assigned(issues, components, project)
    people = main_assignees(rows).select("assignee")
    tops = main_components(rows).select("component", F.col("component_rank").cast("int").alias("component_rank"))
    points = rows.join(F.broadcast(people), "assignee").join(F.broadcast(tops), "component")  # 5 and 10 rows
    # Of five assignees; of equal rows one is the first.
    first = F.row_number().over(Window.partitionBy("assignee").orderBy("create_time", "issue_key", "component")) == 1
    return points.select("issue_key", created().alias("created"), "component", "component_rank", "assignee", first.alias("first_appearance"))
