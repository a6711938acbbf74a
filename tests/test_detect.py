import random

import pytest
from builders import aggregate_rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillwatch.operators import (
    alert_messages,
    branch_by_prefix,
    expanding_stats,
    limit_alerts,
    rolling_anomalies,
    rolling_means,
    rolling_sample,
    split_metrics,
    unpivot_metrics,
)


def inbound(spark, values, **options):
    rows = aggregate_rows(spark, [(n, v, 0, 0) for n, v in enumerate(values)])
    warnings = rolling_anomalies(rows, **options).orderBy("window_start").collect()
    return [(w.current, w.samples, w.severidade) for w in warnings if w.metric == "bytes_inbound"]


def test_thresholds_are_inclusive(spark):
    assert inbound(spark, [100, 100, 100, 119]) == []
    assert inbound(spark, [100, 100, 100, 120]) == [(120, 3, "regular")]
    assert inbound(spark, [100, 100, 100, 149]) == [(149, 3, "regular")]
    assert inbound(spark, [100, 100, 100, 150]) == [(150, 3, "media")]
    assert inbound(spark, [100, 100, 100, 200]) == [(200, 3, "alta")]


def test_warm_up_needs_three_samples_and_a_positive_mean(spark):
    assert inbound(spark, [100, 100, 900]) == []
    assert inbound(spark, [0, 0, 0, 0, 500]) == []
    assert inbound(spark, [0, 0, 3, 2]) == [(2, 3, "alta")]


def test_flagged_values_join_the_history(spark):
    assert inbound(spark, [100, 100, 100, 400, 180]) == [(400, 3, "alta")]


def test_the_oldest_of_31_samples_is_forgotten(spark):
    values = [10_000] + [100] * 30 + [120]
    assert inbound(spark, values)[-1] == (120, 30, "regular")
    assert inbound(spark, values, history=31) == []


def test_wording(spark):
    rows = aggregate_rows(spark, [(n, 0, 0, v) for n, v in enumerate([1, 2, 2, 4])])
    warning = rolling_anomalies(rows).first()
    assert (warning.metric, warning.severidade, warning.percent_above) == ("unique_flow_count", "alta", 140)
    assert warning.descricao == (
        "O último agregado registrou 4 conexões únicas, 140% acima da média de 2 nas 3 amostras anteriores"
    )


def test_missing_key_and_missing_metric(spark):
    rows = aggregate_rows(spark, [(0, 100, 5, 1), (1, 100, None, 1), (2, 100, 5, 1), (3, 300, 10, 1)], key=None)
    got = {w.metric: w for w in rolling_anomalies(rows).collect()}
    assert set(got) == {"bytes_inbound", "bytes_outbound"}
    assert got["bytes_inbound"].key == "global"
    assert got["bytes_outbound"].average == pytest.approx(10 / 3)


def sparse(spark, seed=7):
    """Keys with gaps of very different length between their windows."""
    rng = random.Random(seed)
    rows = []
    for key, gap in (("busy", 1), ("sparse", 40), ("single", 1000)):
        number = 0
        for _ in range(200 if key != "single" else 5):
            number += rng.randint(1, gap)
            rows.append((number, rng.randint(0, 500), rng.randint(0, 3), rng.randint(0, 9), key))
    rng.shuffle(rows)
    return aggregate_rows(spark, rows)


@pytest.mark.parametrize("chunk", [3, 31, 64, 4096])
def test_pieces_give_the_same_history_as_one_window(spark, chunk):
    rows = sparse(spark)
    w = Window.partitionBy("key").orderBy("window_start").rowsBetween(-30, -1)
    expected = rows.select(
        "key",
        "window_start",
        F.count("*").over(w).alias("n"),
        (F.sum("bytes_inbound").over(w) / F.count("*").over(w)).alias("mean"),
    ).where("n > 0")
    got = rolling_means(rows, chunk_windows=chunk).where("metric = 'bytes_inbound' AND samples > 0")
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got.select("key", "window_start", "samples", "average").collect()), key=key) == sorted(
        map(tuple, expected.collect()), key=key
    )


@pytest.mark.parametrize("chunk", [3, 4096])
def test_rolling_sample(spark, chunk):
    rows = sparse(spark)
    w = Window.partitionBy("key").orderBy("window_start").rowsBetween(-59, 0)
    expected = rows.select(
        "key",
        "window_start",
        F.count("*").over(w),
        F.sum("bytes_inbound").over(w),
        F.max("bytes_inbound").over(w),
    )
    got = rolling_sample(rows, chunk_windows=chunk).select(
        "key", "window_start", "samples", "bytes_inbound_sum", "bytes_inbound_record"
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_mean_lies_within_its_history(spark):
    rows = sparse(spark)
    bounds = rows.agg(F.min("bytes_inbound"), F.max("bytes_inbound")).first()
    means = rolling_means(rows).where("metric = 'bytes_inbound' AND samples > 0")
    low, high = means.agg(F.min("average"), F.max("average")).first()
    assert bounds[0] <= low and high <= bounds[1]


def test_expanding_stats(spark):
    rows = aggregate_rows(spark, [(0, 0, 0, 0), (1, 4, 0, 0), (2, 8, 0, 0)])
    got = expanding_stats(rows, ["bytes_inbound"], chunk_windows=2).orderBy("window_start").collect()
    assert [(r.sample_size, r.total, r.minimum, r.maximum, r.average) for r in got] == [
        (1, 0, 0, 0, 0.0),
        (2, 4, 0, 4, 2.0),
        (3, 12, 0, 8, 4.0),
    ]
    assert got[0].ratio != got[0].ratio and [r.ratio for r in got[1:]] == [2.0, 2.0]


def test_limits_are_strict(spark):
    rows = aggregate_rows(spark, [(0, 10_000_000, 1_000_000, 200), (1, 10_000_001, 1_000_001, 201)])
    assert [a.current for a in limit_alerts(rows).orderBy("metric").collect()] == [10_000_001, 1_000_001, 201]


def test_unpivot_and_split(spark):
    rows = aggregate_rows(spark, [(0, 1, 2, 3)])
    assert sorted((r.metric, r.current) for r in unpivot_metrics(rows).collect()) == [
        ("bytes_inbound", 1),
        ("bytes_outbound", 2),
        ("unique_flow_count", 3),
    ]
    assert sorted((r.metric_key, r.value, r.topic) for r in split_metrics(rows).collect()) == [
        ("flow", 3, "network-summary-unique-flow-count"),
        ("in", 1, "network-summary-bytes-inbound"),
        ("out", 2, "network-summary-bytes-outbound"),
    ]


def test_first_matching_branch_wins(spark):
    rows = spark.createDataFrame([("in",), ("inner",), ("out",), ("x",), (None,)], "metric_key STRING")
    got = branch_by_prefix(rows, {"inn": "a", "in": "b", "out": "c"}).collect()
    assert [tuple(r) for r in got] == [("in", "b"), ("inner", "a"), ("out", "c")]


def test_alert_levels(spark):
    names = ["alta", "ALTA", "media", "regular", "outra", None]
    rows = spark.createDataFrame([(n, "d") for n in names], "severidade STRING, descricao STRING")
    got = alert_messages(rows).collect()
    assert [r.level for r in got] == ["ERROR", "ERROR", "WARNING", "INFO", "INFO", "INFO"]
    assert got[1].title == "Alerta de rede [ALTA]" and got[5].title == "Alerta de rede [null]"
