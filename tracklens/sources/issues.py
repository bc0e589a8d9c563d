"""Reading issues, and the plain sources and sinks of the toolkit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Fixed value: what stands between two clusters of a listing.
SEPARATOR = "-" * 50


def jdbc_options(url: str, name: str, user: str, password: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 16, **options: str) -> dict[str, str]:
    """The options of ``jdbc_table``."""
    out = {"url": url, "dbtable": name, "user": user, "password": password, **options}
    if key:
        out |= {"partitionColumn": key, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(parts)}
    return out


def jdbc_table(spark: SparkSession, *where: str, schema: StructType | None = None, **how) -> DataFrame:
    """A table of a database (S1), read in ``parts`` ranges of ``key`` where one is given. The driver's jar must be on the class path."""
    rows = spark.read.format("jdbc").options(**jdbc_options(*where, **how)).load()
    return rows if schema is None else conformed(rows, schema)


def conformed(rows: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a schema by name (F14), whatever their case, in its order and types; raises if one is missing."""
    there = {c.lower(): c for c in rows.columns}
    missing = [f.name for f in schema if f.name.lower() not in there]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    return rows.select(*[F.col(f"`{there[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in schema])


def saved(rows: DataFrame, schema: StructType, name: str, mode: str = "append") -> None:
    """Rows into a table of the catalogue, which is made where it doesn't exist."""
    conformed(rows, schema).write.mode(mode).saveAsTable(name)


def same(column: str, value: str) -> Column:
    """Equality as the issue database's collation has it, without regard to case."""
    return F.lower(column) == F.lower(F.lit(value))


def issues_of_project(issues: DataFrame, project: str) -> DataFrame:
    """An unknown project gives no rows."""
    return issues.where(same("project", project))


def issue_by_key(issues: DataFrame, key: str) -> DataFrame:
    """S3: the issue, if exactly one has the key."""
    found = issues.where(same("issue_key", key))
    one = found.groupBy(F.lower("issue_key").alias("k")).agg(F.count("*").alias("n"), F.first(F.struct(*issues.columns)).alias("r")).where("n = 1")
    return one.select("r.*")


def rows_of_prefix(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows whose issue key begins with the prefix, without regard to case; so ALPHA also takes ALPHA2-1."""
    return rows.where(F.startswith(F.lower("issue_key"), F.lower(F.lit(prefix))))


def without_keys(issues: DataFrame, keys: DataFrame) -> DataFrame:
    """issues whose key is not in ``keys``."""
    return issues.join(keys.select("issue_key"), "issue_key", "left_anti")


def write_edges(edges: DataFrame, path: str) -> None:
    """A similarity matrix as the table of its cells."""
    edges.write.mode("overwrite").parquet(path)


def read_dense_matrix(spark: SparkSession, path: str, min_sim: float = 0.0) -> DataFrame:
    """Src, dst, sim of the cells above ``min_sim`` of a comma-separated square matrix in one file; upper half.

    The file is read in splits. A line's number is its place in its split and the lines of the splits before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = lines.groupBy("block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.expr("sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"), F.lit(0))  # a row for each split
    placed = lines.join(blocks.select("block", "first", before.alias("before")), "block")
    cells = placed.select((F.col("before") + F.col("at") - F.col("first")).alias("src"), F.posexplode(F.split(F.rtrim("value"), ",")).alias("dst", "sim"))
    return cells.select("src", F.col("dst").cast("long").alias("dst"), F.col("sim").cast("double").alias("sim")).where((F.col("src") < F.col("dst")) & (F.col("sim") > min_sim))


def append_lines(lines: DataFrame, path: str) -> None:
    """One string column appended as text."""
    lines.write.mode("append").text(path)


def read_stop_words(spark: SparkSession, path: str) -> list[str]:
    """A list of words, one a line. A list beyond 100,000 words is refused: it is sent with every task."""
    words = [r.value for r in spark.read.text(path).limit(100_001).collect()]
    if len(words) > 100_000:
        raise ValueError("a stop-word list may have at most 100,000 words")
    return words


def cluster_listing(clusters: DataFrame, issues: DataFrame) -> DataFrame:
    """A line for each issue of a cluster: its key, five spaces, its summary; largest cluster first."""
    sized = clusters.join(clusters.groupBy("component").agg(F.count("*").alias("size")), "component")
    rows = sized.join(issues, sized.id == issues.issue_id)
    return rows.select("size", "component", "issue_id", F.concat_ws("     ", "issue_key", "summary").alias("line"))


def write_listing(clusters: DataFrame, issues: DataFrame, path: str) -> None:
    """The listing as text, largest cluster first, then by component and issue, a line of ``SEPARATOR`` after each cluster.

    Part files in the order of their names are the listing: lines are dealt by ranges of the whole order, so no task has
    all of them, and a separator is a row of its own behind its cluster, so that no task has to know the next one's rows.
    """
    lines = cluster_listing(clusters, issues).select("size", "component", F.lit(0).alias("kind"), "issue_id", "line")
    ends = lines.groupBy("size", "component").agg(F.lit(1).alias("kind"), F.lit(None).cast("long").alias("issue_id"), F.lit(SEPARATOR).alias("line"))
    parts = int(clusters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("size"), F.asc("component"), F.asc("kind"), F.asc("issue_id")]
    lines.unionByName(ends).repartitionByRange(parts, *order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
