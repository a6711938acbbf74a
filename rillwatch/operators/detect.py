"""Anomaly detection on traffic aggregates."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import round_half_up, to_bigint, wide
from ..schemas import (
    HISTORY,
    LIMITS,
    METRICS,
    MIN_SAMPLES,
    MISSING_KEY,
    RATIOS,
    SAMPLE_SIZE,
    SEVERITIES,
    WARNINGS,
)
from .ordered import BLOCK_ROWS, rolling, running

_ORDER = ("window_start",)


def _keyed(aggregates: DataFrame) -> DataFrame:
    """Key and metrics without NULLs: a missing key has a name, a missing count is zero."""
    return aggregates.select(
        F.coalesce("key", F.lit(MISSING_KEY)).alias("key"),
        "window_start",
        "window_end",
        *[
            F.coalesce(F.col(name).cast("bigint"), F.lit(0)).alias(name)
            for name, *_ in METRICS
        ],
    )


def window_chunk(windows: int = BLOCK_ROWS) -> Column:
    """Chunk number holding at most ``windows`` consecutive windows of a key."""
    start = F.unix_seconds("window_start")
    length = F.coalesce(F.unix_seconds("window_end") - start, F.lit(10))
    return F.floor(start / (F.greatest(length, F.lit(1)) * windows))


def unpivot_metrics(aggregates: DataFrame) -> DataFrame:
    """Three rows per aggregate: (key, window_start, metric, current)."""
    rows = [
        F.struct(F.lit(name).alias("metric"), F.col(name).alias("current")) for name, *_ in METRICS
    ]
    return _keyed(aggregates).select("key", "window_start", F.inline(F.array(*rows)))


def severity(ratio: Column, ratios: Sequence[float] = RATIOS) -> Column:
    """Name of the highest threshold reached, NULL below the lowest."""
    regular, media, alta = ratios
    return (
        F.when(ratio >= alta, SEVERITIES[2])
        .when(ratio >= media, SEVERITIES[1])
        .when(ratio >= regular, SEVERITIES[0])
    )


def warning_text(current: Column, label: Column, percent: Column, average: Column, samples: Column) -> Column:
    # fixed value: wording of the published description
    return F.format_string(
        "O último agregado registrou %d %s, %d%% acima da média de %d nas %d amostras anteriores",
        current,
        label,
        percent,
        round_half_up(average),
        samples,
    )


def rolling_means(aggregates: DataFrame, history: int = HISTORY, chunk_windows: int = BLOCK_ROWS) -> DataFrame:
    """Per metric row: number and mean of the up to ``history`` previous windows of its key."""
    measures = {"samples": F.count("*")}
    measures.update({f"{name}_sum": F.sum(wide(F.col(name))) for name, *_ in METRICS})
    framed = rolling(
        _keyed(aggregates),
        ["key"],
        _ORDER,
        window_chunk(chunk_windows),
        -history,
        -1,
        measures,
        block_rows=max(chunk_windows, history),
    )
    rows = [
        F.struct(
            F.lit(name).alias("metric"),
            F.lit(label).alias("label"),
            F.col(name).alias("current"),
            F.col(f"{name}_sum").alias("total"),
        )
        for name, label, *_ in METRICS
    ]
    long = framed.select(
        "key", "window_start", F.col("samples").cast("int").alias("samples"), F.inline(F.array(*rows))
    )
    average = F.when(F.col("samples") > 0, F.col("total").cast("double") / F.col("samples"))
    return long.withColumn("average", F.coalesce(average, F.lit(0.0))).drop("total")


def rolling_anomalies(
    aggregates: DataFrame,
    history: int = HISTORY,
    min_samples: int = MIN_SAMPLES,
    ratios: Sequence[float] = RATIOS,
    chunk_windows: int = BLOCK_ROWS,
) -> DataFrame:
    """Warnings for windows above the mean of their key's previous windows, per metric.

    A value joins the history after its own check, whether it was flagged or not. Windows without
    traffic have no row, so the history counts non-empty windows.
    """
    ready = rolling_means(aggregates, history, chunk_windows).where(
        (F.col("samples") >= min_samples) & (F.col("average") > 0)
    )
    rated = ready.withColumn("ratio", F.col("current") / F.col("average")).withColumn(
        "severidade", severity(F.col("ratio"), ratios)
    )
    flagged = rated.where(F.col("severidade").isNotNull()).withColumn(
        "percent_above", round_half_up((F.col("ratio") - 1) * 100)
    )
    text = warning_text(
        F.col("current"),
        F.col("label"),
        F.col("percent_above"),
        F.col("average"),
        F.col("samples"),
    )
    return flagged.withColumn("descricao", text).select(*WARNINGS.names)


def limit_alerts(
    aggregates: DataFrame,
    bytes_in: int = LIMITS[0],
    bytes_out: int = LIMITS[1],
    unique_flows: int = LIMITS[2],
) -> DataFrame:
    """Alerts for aggregates strictly above fixed limits, without warm-up."""
    rows = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(name).alias("current"),
            F.lit(limit).cast("bigint").alias("limit"),
            F.lit(title).alias("title"),
            F.lit(unit).alias("unit"),
        )
        for (name, _, title, unit), limit in zip(METRICS, (bytes_in, bytes_out, unique_flows))
    ]
    over = (
        _keyed(aggregates)
        .select("key", "window_start", F.inline(F.array(*rows)))
        .where(F.col("current") > F.col("limit"))
    )
    return over.select(
        "key",
        "window_start",
        "metric",
        "current",
        "limit",
        F.lit("WARNING").alias("level"),
        "title",
        # fixed value: wording of the alert
        F.format_string("O último agregado registrou %d %s", "current", "unit").alias("text"),
    )


def rolling_sample(
    aggregates: DataFrame, size: int = SAMPLE_SIZE, chunk_windows: int = BLOCK_ROWS
) -> DataFrame:
    """Sum and record of each metric over the last ``size`` aggregates, the current one included."""
    measures = {"samples": F.count("*")}
    for name, *_ in METRICS:
        measures[f"{name}_sum"] = F.sum(wide(F.col(name)))
        measures[f"{name}_record"] = F.max(name)
    return rolling(
        _keyed(aggregates),
        ["key"],
        _ORDER,
        window_chunk(chunk_windows),
        1 - size,
        0,
        measures,
        block_rows=max(chunk_windows, size),
    ).withColumns({f"{name}_sum": to_bigint(F.col(f"{name}_sum")) for name, *_ in METRICS}).drop("window_end")


def expanding_stats(
    aggregates: DataFrame,
    metrics: Sequence[str] = tuple(name for name, *_ in METRICS),
    chunk_windows: int = BLOCK_ROWS,
) -> DataFrame:
    """Statistics of each metric over all windows so far and the latest value's ratio to the mean.

    A zero mean gives NaN for a zero value and infinity otherwise.
    """
    values = [F.struct(F.lit(name).alias("metric"), F.col(name).alias("latest")) for name in metrics]
    rows = _keyed(aggregates).select(
        "key", "window_start", "window_end", F.inline(F.array(*values))
    )
    stats = running(
        rows,
        ["key", "metric"],
        _ORDER,
        window_chunk(chunk_windows),
        {
            "sample_size": ("count", "latest"),
            "total": ("sum", "latest"),
            "minimum": ("min", "latest"),
            "maximum": ("max", "latest"),
        },
    )
    average = F.col("total").cast("double") / F.col("sample_size")
    ratio = (
        F.when(F.col("average") != 0, F.col("latest") / F.col("average"))
        .when(F.col("latest") == 0, F.lit(float("nan")))
        .otherwise(F.lit(float("inf")))
    )
    return (
        stats.withColumn("average", average)
        .withColumn("ratio", ratio)
        .drop("window_end")
    )
