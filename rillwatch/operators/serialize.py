"""Rows to the JSON texts of the topics, and the strict flow record round trip."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import with_once
from ..schemas import FLOWS, TIMESTAMP_PATTERN

# fixed value: keys of a flow record in writing order
FLOW_RECORD_KEYS = tuple(name for name in FLOWS.names if name != "ingest_time")
_TEXT_KEYS = ("flow_key", "src_ip", "dst_ip", "protocol", "dir")


def aggregate_json() -> Column:
    """Public text of an aggregate, times with milliseconds, NULLs written as null."""
    return F.to_json(
        F.struct(
            "timestamp_start",
            "timestamp_end",
            "bytes_inbound",
            "bytes_outbound",
            "packets_inbound",
            "packets_outbound",
            "unique_flow_count",
            "tcp_syn_total",
            "tcp_ack_total",
            "tcp_fin_total",
            "tcp_rst_total",
            F.col("average_packet_size").alias("averagePacketSize"),
            "window_start",
            "window_end",
        ),
        {"timestampFormat": TIMESTAMP_PATTERN, "ignoreNullFields": "false"},
    )


def aggregate_records(aggregates: DataFrame) -> DataFrame:
    """Records for the aggregates topic; a row without text is dropped."""
    return aggregates.select(
        "key", aggregate_json().alias("value"), F.col("window_end").alias("timestamp")
    ).where(F.col("value").isNotNull())


def warning_json() -> Column:
    """Public text of a warning: its two original keys only."""
    return F.to_json(F.struct("severidade", "descricao"), {"ignoreNullFields": "false"})


def warning_records(warnings: DataFrame) -> DataFrame:
    """Records for the warnings topic, keyed like the aggregate they come from."""
    return warnings.select(
        "key", warning_json().alias("value"), F.col("window_start").alias("timestamp")
    )


def _time_parts(time: Column) -> Column:
    """A timestamp as [year, month, day, hour, minute(, second(, nanosecond))]."""
    second = F.second(time)
    nano = (F.unix_micros(time) % 1_000_000 * 1000).cast("int")
    minutes = [part(time) for part in (F.year, F.month, F.dayofmonth, F.hour, F.minute)]
    return (
        F.when(nano != 0, F.array(*minutes, second, nano))
        .when(second != 0, F.array(*minutes, second))
        .otherwise(F.array(*minutes))
    )


def _written(names: Callable[[str], Column], time: Column) -> Column:
    """The text of a flow record with the given fields and its time as an array of numbers."""
    fields = [(time if name == "timestamp" else names(name)).alias(name) for name in FLOW_RECORD_KEYS]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def flow_json() -> Column:
    """A flow record with its timestamp as an array of numbers."""
    time = F.col("timestamp")
    return _written(F.col, F.when(time.isNotNull(), _time_parts(time)))


def _kind(name: str) -> str:
    if name in _TEXT_KEYS:
        return "string"
    return "double" if name == "mean_iat_us" else "bigint"


def _time(part: Callable[[int], Column]) -> Column:
    """The timestamp whose parts :func:`_time_parts` has written."""

    def later(position: int) -> Column:
        return F.coalesce(part(position), F.lit(0))

    seconds = later(5).cast("decimal(8,6)") + (later(6) / 1_000_000_000).cast("decimal(8,6)")
    return F.make_timestamp(part(0), part(1), part(2), part(3), part(4), seconds.cast("decimal(16,6)"))


def _judged_flow(text: Column) -> Column:
    """The fields of any text of a flow record. Malformed text, an unknown key or a bad value raises."""
    unknown = F.array_except(
        F.json_object_keys(text), F.array(*[F.lit(name) for name in FLOW_RECORD_KEYS])
    )
    checked = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown flow keys: "), F.to_json(unknown))))

    def fields(doc: Column) -> Column:
        def field(name: str) -> Column:
            if name == "timestamp":
                return _time(lambda position: F.variant_get(doc, f"$.timestamp[{position}]", "int"))
            return F.variant_get(doc, f"$.{name}", _kind(name))

        return F.struct(*[field(name).alias(name) for name in FLOW_RECORD_KEYS])

    # the lambda holds the document, so that it is parsed once
    document = F.parse_json(F.coalesce(checked.cast("string"), text))
    return F.get(F.transform(F.array(document), fields), F.lit(0))


def read_flow_json(records: DataFrame, value: str = "value") -> DataFrame:
    """Flows from :func:`flow_json` text. Malformed text, an unknown key or a bad value raises.

    A record is read once with its types. If writing what was read gives the same text again, nothing in it
    was malformed, unknown or bad; any other record is judged in detail.
    """
    text = F.col(value)
    kinds = [(name, "array<int>" if name == "timestamp" else _kind(name)) for name in FLOW_RECORD_KEYS]
    typed = F.from_json(text, ", ".join(f"{name} {kind}" for name, kind in kinds))
    read = with_once(records, typed.alias("_typed"))
    same = _written(lambda name: F.col(f"_typed.{name}"), F.col("_typed.timestamp")) == text
    read = with_once(read, F.coalesce(same, F.lit(False)).alias("_same"))
    read = with_once(read, F.when(~F.col("_same"), _judged_flow(text)).alias("_judged"))

    def field(name: str) -> Column:
        mine, judged = F.col(f"_typed.{name}"), F.col(f"_judged.{name}")
        if name == "timestamp":
            parts = F.col("_typed.timestamp")
            mine = _time(lambda position: F.get(parts, F.lit(position)))
        found = F.when(F.col("_same"), mine).otherwise(judged)
        if name == "timestamp" or name in _TEXT_KEYS:
            return found.alias(name)
        return F.coalesce(found, F.lit(0).cast(_kind(name))).alias(name)

    return read.select(*[field(name) for name in FLOW_RECORD_KEYS])
