"""Routing of metrics to topics and of warnings to alerts."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import SUMMARY_TOPICS

# fixed values: alert level per severity and the level of anything else
ALERT_LEVELS = {"alta": "ERROR", "media": "WARNING", "regular": "INFO"}
DEFAULT_LEVEL = "INFO"


def volume_rows(aggregates: DataFrame) -> DataFrame:
    """Two rows per aggregate: ("in", bytes_inbound) and ("out", bytes_outbound)."""
    pairs = F.array(
        F.struct(F.lit("in").alias("metric_key"), F.col("bytes_inbound").alias("value")),
        F.struct(F.lit("out").alias("metric_key"), F.col("bytes_outbound").alias("value")),
    )
    return aggregates.select("window_start", F.inline(pairs))


def flow_rows(aggregates: DataFrame) -> DataFrame:
    """One row per aggregate: ("flow", unique_flow_count)."""
    return aggregates.select(
        "window_start", F.lit("flow").alias("metric_key"), F.col("unique_flow_count").alias("value")
    )


def branch_by_prefix(df: DataFrame, prefixes: Mapping[str, str], key: str = "metric_key") -> DataFrame:
    """Add ``branch`` from the first matching key prefix; rows matching none are discarded."""
    branch: Column = F.lit(None).cast("string")
    for prefix, name in reversed(list(prefixes.items())):
        branch = F.when(F.col(key).startswith(prefix), name).otherwise(branch)
    return df.withColumn("branch", branch).where(F.col("branch").isNotNull())


def split_metrics(aggregates: DataFrame) -> DataFrame:
    """Each aggregate's three metrics with the summary topic they belong to, in one pass."""
    rows = [
        F.struct(
            F.lit(metric_key).alias("metric_key"),
            F.col(column).alias("value"),
            F.lit(SUMMARY_TOPICS[metric_key]).alias("topic"),
        )
        for metric_key, column in (
            ("in", "bytes_inbound"),
            ("out", "bytes_outbound"),
            ("flow", "unique_flow_count"),
        )
    ]
    return aggregates.select("window_start", F.inline(F.array(*rows)))


def summary_records(aggregates: DataFrame) -> DataFrame:
    """Records for the three summary topics."""
    return split_metrics(aggregates).select(
        F.col("metric_key").alias("key"),
        F.col("value").cast("string").alias("value"),
        "topic",
        F.col("window_start").alias("timestamp"),
    )


def alert_messages(warnings: DataFrame) -> DataFrame:
    """Add level, title and text of the alert each warning becomes."""
    name = F.lower("severidade")
    level: Column = F.lit(DEFAULT_LEVEL)
    for severity, alert_level in ALERT_LEVELS.items():
        level = F.when(name == severity, alert_level).otherwise(level)
    return warnings.select(
        "*",
        level.alias("level"),
        # fixed value: wording of the title; a missing severity is written as null
        F.concat(
            F.lit("Alerta de rede ["), F.coalesce("severidade", F.lit("null")), F.lit("]")
        ).alias("title"),
        F.col("descricao").alias("text"),
    )
