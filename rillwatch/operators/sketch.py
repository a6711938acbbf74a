"""Distinct flows by mergeable sketches, where exact counts would have to remember every flow."""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import group_key, joined_identity
from ..schemas import FIVE_TUPLE, WINDOW

LG_K = 12


def standard_error(lg_k: int = LG_K) -> float:
    """Relative standard error of an estimate, unions of sketches included: 1.04 / sqrt(2 ** lg_k)."""
    return 1.04 / math.sqrt(2**lg_k)


def flow_sketches(
    flows: DataFrame,
    window: str = WINDOW,
    group_cols: Sequence[str] = (),
    key_mode: str = "tuple",
    lg_k: int = LG_K,
    watermark: str | None = None,
    time: str = "timestamp",
) -> DataFrame:
    """key, window_start, window_end and a HyperLogLog sketch of the flows of each window.

    A sketch has a bounded size (2 ** ``lg_k`` buckets), so a window of any number of flows is one small
    row, in a shuffle and as the state of a stream. ``watermark`` gives the streaming form, as in
    :func:`rillwatch.operators.traffic_aggregate`.
    """
    rows = flows if watermark is None else flows.withWatermark(time, watermark)
    if key_mode not in ("tuple", "concat"):
        raise ValueError(f"key_mode must be 'tuple' or 'concat', not {key_mode!r}")
    # the parts as JSON: no two flows have the same text, and a missing part has its own
    identity = F.to_json(F.struct(*FIVE_TUPLE)) if key_mode == "tuple" else joined_identity()
    return (
        rows.groupBy(F.window(time, window).alias("window"), group_key(group_cols).alias("key"))
        .agg(F.hll_sketch_agg(identity, F.lit(lg_k)).alias("sketch"))
        .select("key", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "sketch")
    )


def union_sketches(sketches: DataFrame, window: str) -> DataFrame:
    """Sketches of longer windows out of those of the shorter ones in them, without the flows."""
    longer = sketches.groupBy(F.window("window_start", window).alias("window"), "key")
    return longer.agg(F.hll_union_agg("sketch").alias("sketch")).select(
        "key", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "sketch"
    )


def estimated_flows(sketch: str = "sketch") -> Column:
    """Distinct flows in a sketch, about."""
    return F.hll_sketch_estimate(sketch)


def within_error(estimate: Column, exact: Column, lg_k: int = LG_K, errors: float = 5.0) -> Column:
    """Whether an estimate lies within so many standard errors of the exact number (or one flow)."""
    return F.abs(estimate - exact) <= F.greatest(F.lit(1.0), exact * errors * standard_error(lg_k))
