"""Rolling anomaly detection as a keyed streaming operator.

Row frames are not available on streams, so each key keeps its last values as state: three short
lists, however long the stream runs. A key that is idle for long enough can lose them, and a stream can
begin with the values that a batch run ended with.
"""

import logging
import sys
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.durations import micros
from ..operators.detect import warning_text
from ..schemas import HISTORY, METRICS, MIN_SAMPLES, MISSING_KEY, RATIOS, SEVERITIES, WARNINGS

# ship this module to the executors by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_NAMES = [name for name, *_ in METRICS]
_STATE = T.StructType([T.StructField(name, T.ArrayType(T.LongType())) for name in _NAMES])
_RATED = T.StructType([field for field in WARNINGS if field.name != "descricao"])
_COLUMNS = list(_RATED.names)
_TEXTS = [field.name for field in _RATED if isinstance(field.dataType, T.StringType)]
_SEVERITIES = tuple(SEVERITIES)
_LARGEST = 2**63 - 1


def _ordered(rows: Iterator[pd.DataFrame]) -> tuple[pd.Series, dict[str, np.ndarray]]:
    """Window starts and the values of each metric, in time order."""
    starts, parts = [], []
    for some in rows:
        starts.append(some["window_start"])
        parts.append(some[_NAMES].to_numpy("int64"))
    start, values = pd.concat(starts, ignore_index=True), np.concatenate(parts)
    order = np.argsort(start.to_numpy(), kind="stable")
    return start.iloc[order], {name: values[order, i] for i, name in enumerate(_NAMES)}


class RollingDetector(StatefulProcessor):
    """Checks each window against the mean of the previous ones, then remembers it."""

    def __init__(self, history: int, min_samples: int, ratios: Sequence[float], idle_ms: int | None = None):
        self.history = history
        self.idle_ms = idle_ms
        self.min_samples = min_samples
        self.ratios = tuple(ratios)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getValueState("recent", _STATE, self.idle_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        last = initialState.sort_values("window_start", kind="stable").tail(self.history)
        self.values.update(tuple([*map(int, last[metric])] for metric in _NAMES))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # one row per closed window of this key; a micro-batch does not deliver them in order. Only four
        # numbers of each are held until all are there
        starts, columns = _ordered(rows)
        known = self.values.get() if self.values.exists() else None
        found, kept = [], []
        for position, metric in enumerate(_NAMES):
            past = list(known[position]) if known else []
            series = list(chain(past, columns[metric].tolist()))
            try:
                found.append(self._check(key[0], starts, metric, series, len(past)))
                kept.append(series[-self.history :])
            except Exception:  # a metric that fails leaves the others, and its own history, as they are
                logging.getLogger(__name__).exception("metric %s of key %s was not checked", metric, key[0])
                kept.append(past)
        self.values.update(tuple(kept))
        found = [some for some in found if len(some)]
        if found:
            # texts as objects: those of several parts joined are no single array otherwise
            yield pd.concat(found, ignore_index=True).astype({name: object for name in _TEXTS})

    def _check(self, key, starts, metric, series, known) -> pd.DataFrame:
        at = np.arange(known, len(series))
        oldest = np.maximum(at - self.history, 0)
        # whole numbers of any size: sums of large counts neither stop nor wrap
        sums = np.array([0, *np.cumsum(np.array(series, dtype=object))], dtype=object)
        samples = at - oldest
        totals = (sums[at] - sums[oldest]).astype("float64")
        ready = (samples >= self.min_samples) & (totals > 0)
        at, samples, totals = at[ready], samples[ready], totals[ready]
        current = np.array([series[i] for i in at], dtype="int64")
        average = totals / samples
        ratio = current / average
        grade = np.searchsorted(np.asarray(self.ratios), ratio, side="right")
        percent = np.floor((ratio - 1) * 100 + 0.5)
        rated = pd.DataFrame(
            {
                "key": key,
                "window_start": starts.to_numpy()[at - known],
                "metric": metric,
                "current": current,
                "samples": samples.astype("int32"),
                "average": average,
                "ratio": ratio,
                "percent_above": [min(int(p), _LARGEST) for p in percent],
                "severidade": [_SEVERITIES[g - 1] if g else None for g in grade],
            }
        )
        return rated[grade > 0][_COLUMNS]

    def close(self) -> None:
        pass


def _detector_input(aggregates: DataFrame) -> DataFrame:
    return aggregates.select(
        F.coalesce("key", F.lit(MISSING_KEY)).alias("key"),
        "window_start",
        *[F.coalesce(F.col(name).cast("bigint"), F.lit(0)).alias(name) for name in _NAMES],
    )


def last_windows(aggregates: DataFrame, history: int = HISTORY) -> DataFrame:
    """The latest ``history`` windows of each key, cut down in every task before they meet."""
    latest = Window.partitionBy("key").orderBy(F.desc("window_start"))
    rows = _detector_input(aggregates).withColumn("_place", F.row_number().over(latest))
    return rows.where(F.col("_place") <= history).drop("_place")


def stream_rolling_anomalies(
    aggregates: DataFrame,
    history: int = HISTORY,
    min_samples: int = MIN_SAMPLES,
    ratios: Sequence[float] = RATIOS,
    earlier: DataFrame | None = None,
    idle: str | None = None,
) -> DataFrame:
    """Streaming form of :func:`rillwatch.operators.rolling_anomalies` on closed windows.

    ``earlier`` is a batch of aggregates from before the stream: its latest windows are the state that the
    first micro-batch of a new checkpoint begins with, so batch and stream together find what one run would.
    ``idle`` (for example ``"30 days"``) ends the state of a key that has had no window for so long by the
    clock; the key then begins anew. Spark looks for expired state as long as the query runs, so such a query
    does not end by itself, also not with an ``availableNow`` trigger.
    """
    start = None if earlier is None else last_windows(earlier, history).groupBy("key")
    detector = RollingDetector(history, min_samples, ratios, None if idle is None else micros(idle) // 1000)
    rated = _detector_input(aggregates).groupBy("key").transformWithStateInPandas(
        detector, _RATED, "append", "None" if idle is None else "ProcessingTime", start
    )
    label = F.coalesce(*[F.when(F.col("metric") == name, F.lit(text)) for name, text, *_ in METRICS])
    text = warning_text(F.col("current"), label, F.col("percent_above"), F.col("average"), F.col("samples"))
    return rated.withColumn("descricao", text).select(*WARNINGS.names)


def detector_state(spark: SparkSession, checkpoint: str, batch: int | None = None) -> DataFrame:
    """key, metric and values: the last values that a detecting stream holds, read from its checkpoint.

    ``batch`` is the micro-batch after which the state is wanted, by default the last one.
    """
    options = {"path": checkpoint, "stateVarName": "recent"}
    if batch is not None:
        options["batchId"] = str(batch)
    rows = spark.read.format("statestore").options(**options).load()
    # state with a time to live wraps its value
    value = F.col("value.value") if "ttlExpirationMs" in rows.schema["value"].dataType.names else F.col("value")
    metrics = F.array(*[F.struct(F.lit(n).alias("metric"), value.getField(n).alias("values")) for n in _NAMES])
    return rows.select(F.col("key.key").alias("key"), F.inline(metrics))
