"""Accepted and rejected records of one stream, each record parsed once."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.parse import (
    accepted_aggregates,
    accepted_flows,
    judge_aggregates,
    judge_flows,
    rejected_records,
)
from ..schemas import AGGREGATED_TOPIC, RAW_TOPIC
from ..session import configure
from ..sources import read_topic
from .batches import publish_batch, stored_batches

# topic to its judge and to the reader of what the judge accepted
_KINDS = {
    RAW_TOPIC: (judge_flows, accepted_flows),
    AGGREGATED_TOPIC: (judge_aggregates, accepted_aggregates),
}


def quarantine_job(
    spark: SparkSession,
    source: dict,
    accepted: str,
    rejected: str,
    checkpoint: str,
    topic: str = RAW_TOPIC,
    available_now: bool = False,
) -> StreamingQuery:
    """Records of the raw (or aggregates) topic to two result tables: what they say, and the bad ones.

    A micro-batch is parsed once and stored; both tables are filled from that. Each gets a batch once,
    also if the job fails between them.
    """
    configure(spark)
    judge, read = _KINDS[topic]
    judged = judge(read_topic(spark, topic, stream=True, **source))

    def write(batch: DataFrame, number: int) -> None:
        publish_batch(read(batch), accepted, number)
        publish_batch(rejected_records(batch), rejected, number)

    return stored_batches(judged, write, checkpoint, available_now)
