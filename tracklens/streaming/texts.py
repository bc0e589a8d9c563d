"""The row-wise text functions on a stream of issues; clustering stays a batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklens.functions.dates import created
from tracklens.functions.text import meaningful, tokens, without_colour


def token_stream(issues: DataFrame, stop_words: list[str]) -> DataFrame:
    """issue_key, created and the meaningful tokens of the summary of each issue that arrives."""
    words = meaningful(tokens(without_colour(F.col("summary"))), stop_words)
    return issues.select("issue_key", created().alias("created"), words.alias("tokens"))


def term_counts(issues: DataFrame, stop_words: list[str], late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Terms for each window of creation time, with a watermark for late issues."""
    words = token_stream(issues, stop_words).withColumn("at", F.col("created").cast("timestamp")).withWatermark("at", late)
    return words.select(F.window("at", width).alias("window"), F.explode("tokens").alias("term")).groupBy("window", "term").agg(F.count("*").alias("n"))
