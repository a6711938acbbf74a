"""Alerts to a receiver: each one once, and a place for those it will not take.

The outcome of every alert is a row of a result table: the alert, its delivery id and the error, NULL if it
was delivered. A micro-batch's outcomes are committed in one step when all its alerts have been tried; that
commit is the ledger which keeps a finished batch from being sent again. Alerts whose sending failed are
the dead letters, and do not hold up the others.
"""

import sys
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import alert_messages, parse_warnings
from ..schemas import WARNINGS_TOPIC
from ..session import configure
from ..sources import read_topic
from .batches import has_batch, publish_batch, read_results, stored_batches
from .supervise import supervise

# ship this module to the executors by value, so that they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUTCOME = "delivery_id STRING, error STRING"


class ReceiverDown(Exception):
    """Raised by a sender when nothing can be delivered now: the batch fails and comes again."""


def _sent(send: Callable[[dict], None], tries: int, down: type, columns: list[str], batches: Iterator[pd.DataFrame]):
    """Outcomes of the rows of a task."""
    for rows in batches:
        errors = []
        for row in rows.to_dict("records"):
            error = None
            for _ in range(tries):
                try:
                    send(row)
                    error = None
                    break
                except down:
                    raise
                except Exception as failure:
                    error = f"{type(failure).__name__}: {failure}"
            errors.append(error)
        out = rows.copy()
        out["error"] = pd.Series(errors, index=rows.index, dtype=object)
        yield out[columns]


def outcome_schema(alerts: T.StructType) -> T.StructType:
    return T.StructType([*alerts.fields, *T.StructType.fromDDL(_OUTCOME).fields])


def deliver_once(
    alerts: DataFrame,
    send: Callable[[dict], None],
    outcomes: str,
    checkpoint: str,
    tries: int = 3,
    connect: Callable[[], None] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Send every row of a stream and keep its outcome in the result table ``outcomes``.

    ``send`` gets a row as a dict, in the tasks. If it raises, the row is tried up to ``tries`` times
    and is then a dead letter, with the last error. :class:`ReceiverDown`, or an error of ``connect``, which
    the driver calls before a batch, fails the whole batch instead; start the query again (see
    :func:`supervise`) and the batch is sent anew.

    A batch whose outcomes are committed is never sent again. Within a batch that failed half-way, and
    in a task that Spark repeats, rows may be sent twice: ``delivery_id`` is then the same, so a receiver
    that remembers it takes each alert once.
    """
    spark = alerts.sparkSession
    schema = outcome_schema(alerts.schema)
    run = partial(_sent, send, tries, ReceiverDown, schema.names)

    def write(batch: DataFrame, number: int) -> None:
        if has_batch(spark, outcomes, number):
            return
        if connect is not None:
            connect()
        # the stored batch gives its rows the same numbers whenever it is read
        name = F.concat_ws("-", F.lit(number), F.monotonically_increasing_id())
        sent = batch.withColumn("delivery_id", name).mapInPandas(run, schema)
        publish_batch(sent, outcomes, number)

    return stored_batches(alerts, write, checkpoint, available_now)


def delivered(spark: SparkSession, outcomes: str, alerts: T.StructType) -> DataFrame:
    """The alerts that were taken."""
    return read_results(spark, outcomes, outcome_schema(alerts)).where(F.col("error").isNull()).drop("error")


def dead_letters(spark: SparkSession, outcomes: str, alerts: T.StructType) -> DataFrame:
    """The alerts that were not taken, with the last error."""
    return read_results(spark, outcomes, outcome_schema(alerts)).where(F.col("error").isNotNull())


def alert_job(
    spark: SparkSession,
    source: dict,
    send: Callable[[dict], None],
    outcomes: str,
    checkpoint: str,
    tries: int = 3,
    connect: Callable[[], None] | None = None,
    available_now: bool = False,
    restarts: int = 5,
    pause: float = 1.0,
) -> T.StructType:
    """Warnings topic to a receiver, restarted after failures until it ends; the columns of its alerts."""
    configure(spark)

    def alerts() -> DataFrame:
        return alert_messages(parse_warnings(read_topic(spark, WARNINGS_TOPIC, stream=True, **source)))

    supervise(
        lambda: deliver_once(alerts(), send, outcomes, checkpoint, tries, connect, available_now), restarts, pause
    )
    return alerts().schema
