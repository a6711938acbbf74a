"""JSON topic values to rows, with the acceptance rules of each record type.

The rules depend on whether a key is missing or ``null`` and on the type of a scalar. Flows, the
bulk of the data, are read once against their usual types; only a record that leaves a field open
there is read again, as text, and judged in detail. Aggregates and warnings are few and are read
as VARIANT, which keeps all of these cases apart.
"""

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import flow_key
from ..functions.once import with_once
from ..schemas import DIRECTIONS, FLOWS, PROTOCOLS, TIMESTAMP_PATTERN
from .aggregate import average_packet_size

# fixed values: keys of the records, with the column a microflow key becomes
MICROFLOW_TEXTS = ("src_ip", "dst_ip", "protocol", "dir")
MICROFLOW_COUNTS = {
    "src_port": "src_port",
    "dst_port": "dst_port",
    "packets": "packet_count",
    "bytes": "byte_count",
    "min_size": "min_packet_size",
    "max_size": "max_packet_size",
}
TCP_FLAGS = ("syn", "fin", "rst", "ack")
FLOW_COUNTS = {**MICROFLOW_COUNTS, **{f"tcp.{flag}": f"tcp_{flag}_count" for flag in TCP_FLAGS}}
AGGREGATE_TIMES = ("timestamp_start", "timestamp_end")
AGGREGATE_COUNTS = (
    "bytes_inbound",
    "bytes_outbound",
    "packets_inbound",
    "packets_outbound",
    "unique_flow_count",
    "tcp_syn_total",
    "tcp_ack_total",
    "tcp_fin_total",
    "tcp_rst_total",
)
WINDOW_BOUNDS = ("window_start", "window_end")
WARNING_KEYS = ("severidade", "descricao")

# doubles from here on have no BIGINT value
_BIGINT_EDGE = 9.2e18
_STRICT_JSON = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def _microflow_type(number: str, mean: str) -> str:
    """Schema text of a microflow record with the given types for counts and for the mean."""
    texts = [f"{name} STRING" for name in MICROFLOW_TEXTS]
    counts = [f"{name} {number}" for name in MICROFLOW_COUNTS]
    flags = ", ".join(f"{flag}: {number}" for flag in TCP_FLAGS)
    return ", ".join([*texts, *counts, f"mean_iat_us {mean}", f"tcp STRUCT<{flags}>"])


def _all(conditions: Sequence[Column]) -> Column:
    return F.coalesce(reduce(and_, conditions), F.lit(False))


def _document(text: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` applied to the parsed text. Malformed text gives a NULL document.

    The many small lookups run inside a lambda, which keeps them out of the generated code of the
    stage: there they would make one method too large to be compiled.
    """
    return F.get(F.transform(F.array(F.try_parse_json(text)), build), F.lit(0))


def _field(doc: Column, path: str) -> Column:
    return F.variant_get(doc, f"$.{path}", "variant")


def _type(doc: Column, path: str) -> Column:
    """Type name of a field's value, VOID when it is null or missing."""
    return F.coalesce(F.schema_of_variant(_field(doc, path)), F.lit("VOID"))


def _is_object(doc: Column) -> Column:
    return F.schema_of_variant(doc).startswith("OBJECT")


def _text(doc: Column, path: str) -> Column:
    """Scalars as text, '' for an object or array, NULL for a null."""
    nested = _type(doc, path).rlike("^(OBJECT|ARRAY)")
    return F.when(~nested, F.try_variant_get(doc, f"$.{path}", "string")).otherwise("")


def _double(doc: Column, path: str) -> Column:
    """Number, numeric text or boolean as DOUBLE; 0 for anything else."""
    return F.coalesce(F.try_variant_get(doc, f"$.{path}", "double"), F.lit(0.0))


def _integer(doc: Column, path: str) -> Column:
    """As :func:`_double`, cut to its integer part."""
    exact = F.try_variant_get(doc, f"$.{path}", "bigint")
    inside = F.least(F.greatest(_double(doc, path), F.lit(-_BIGINT_EDGE)), F.lit(_BIGINT_EDGE))
    return F.coalesce(exact, inside.cast("bigint"))


def _present(value: Column) -> Column:
    """All keys present at both levels."""
    outer = [*MICROFLOW_TEXTS, *MICROFLOW_COUNTS, "mean_iat_us"]
    inner = F.get_json_object(value, "$.tcp")
    missing = [
        F.size(F.array_except(F.array(*[F.lit(name) for name in names]), F.json_object_keys(text)))
        for names, text in ((outer, value), (TCP_FLAGS, inner))
    ]
    return F.coalesce((missing[0] == 0) & (missing[1] == 0), F.lit(False))


def _number(text: Column) -> Column:
    """Numeric text as DOUBLE, NULL for other text."""
    return text.try_cast("double")


def _whole(text: Column) -> Column:
    """Integer part of numeric text, NULL for other text."""
    number = _number(text)
    inside = F.least(F.greatest(number, F.lit(-_BIGINT_EDGE)), F.lit(_BIGINT_EDGE))
    cut = F.when(number.isNotNull() & ~F.isnan(number), inside.cast("bigint"))
    return F.coalesce(text.try_cast("bigint"), cut)


def _unusual_flow(json: Column) -> Column:
    """The flow of a record that does not fit the usual types, NULL if a key is missing.

    Its values are read as text. A lambda holds the text, so that it is parsed once, and the
    rare questions the text cannot answer (true or "true", an object or text like one) go back
    to the record.
    """
    booleans = F.from_json(json, _microflow_type("BOOLEAN", "BOOLEAN"), _STRICT_JSON)

    def fields(read: Column) -> Column:
        def at(row: Column, path: str) -> Column:
            return reduce(Column.getField, path.split("."), row)

        def number(path: str, convert: Callable[[Column], Column], kind: str) -> Column:
            text = at(read, path)
            said = F.when(text.isin("true", "false"), at(booleans, path).cast("int").cast(kind))
            return F.coalesce(said, convert(text), F.lit(0).cast(kind))

        def address(name: str) -> Column:
            text = at(read, name)
            opens = text.startswith("{") | text.startswith("[")
            kind = F.schema_of_variant(_field(F.try_parse_json(json), name))
            return F.when(opens & kind.rlike("^(OBJECT|ARRAY)"), F.lit("")).otherwise(text)

        # a field that is not NULL proves its key; only a record with a NULL has its keys listed
        paths = [*MICROFLOW_TEXTS, "mean_iat_us", *FLOW_COUNTS]
        filled = reduce(and_, [at(read, path).isNotNull() for path in paths])
        flow = F.struct(
            address("src_ip").alias("src_ip"),
            address("dst_ip").alias("dst_ip"),
            at(read, "protocol").alias("protocol"),
            at(read, "dir").alias("dir"),
            number("mean_iat_us", _number, "double").alias("mean_iat_us"),
            *[number(path, _whole, "bigint").alias(column) for path, column in FLOW_COUNTS.items()],
        )
        return F.when(filled | _present(json), flow)

    text = F.from_json(json, _microflow_type("STRING", "STRING"), _STRICT_JSON)
    return F.get(F.transform(F.array(text), fields), F.lit(0))


def _read_flows(raw: DataFrame, value: str) -> tuple[DataFrame, Column]:
    """``raw`` with the fields of its flows in ``_typed`` or ``_other``, and who is valid.

    Contract: all keys present at both levels, protocol and direction known (case-sensitive).
    A null or non-numeric number is 0, true is 1, other numbers are cut to integers, extra keys
    are ignored.
    """
    json = F.col(value)
    usual_types = F.from_json(json, _microflow_type("BIGINT", "DOUBLE"), _STRICT_JSON)
    read = with_once(raw, usual_types.alias("_typed"))
    texts = [F.col(f"_typed.{name}") for name in MICROFLOW_TEXTS]
    usual = _all(
        [F.col(f"_typed.{path}").isNotNull() for path in ("mean_iat_us", *FLOW_COUNTS)]
        # text that opens like an object or array may stand for one
        + [text.isNotNull() & ~text.startswith("{") & ~text.startswith("[") for text in texts]
    )
    other = F.when(~F.col("_usual"), _unusual_flow(json))
    read = with_once(read.withColumn("_usual", usual), other.alias("_other"))
    known = _found("protocol").isin(*PROTOCOLS) & _found("dir").isin(*DIRECTIONS)
    return read, F.coalesce(known, F.lit(False))


def _found(path: str, column: str | None = None) -> Column:
    return F.when(F.col("_usual"), F.col(f"_typed.{path}")).otherwise(F.col(f"_other.{column or path}"))


def parse_flows(raw: DataFrame, value: str = "value", event_time: str = "timestamp") -> DataFrame:
    """Flows of the valid microflow records in ``raw``; other records are dropped."""
    read, valid = _read_flows(raw, value)
    return _flows(read.where(valid).select(*_flow_fields(), F.col(event_time).alias("timestamp")))


def _flow_fields() -> list[Column]:
    return [
        *[_found(name).alias(name) for name in (*MICROFLOW_TEXTS, "mean_iat_us")],
        *[_found(path, column).alias(column) for path, column in FLOW_COUNTS.items()],
    ]


def _flows(fields: DataFrame) -> DataFrame:
    complete = {"ingest_time": F.current_timestamp(), "flow_key": flow_key()}
    return fields.withColumns(complete).select(*FLOWS.names)


def judge_flows(raw: DataFrame, value: str = "value") -> DataFrame:
    """``raw`` with ``accepted``, the fields of each valid microflow record; NULL for the other records.

    Both halves come from one parse of each record. Store the result, or take it from one micro-batch, and
    split it with :func:`accepted_flows` and :func:`rejected_records`.
    """
    read, valid = _read_flows(raw, value)
    accepted = F.when(valid, F.struct(*_flow_fields()))
    return with_once(read, accepted.alias("accepted")).drop("_typed", "_usual", "_other")


def accepted_flows(judged: DataFrame, event_time: str = "timestamp") -> DataFrame:
    """The flows in the result of :func:`judge_flows`, as :func:`parse_flows` returns them."""
    rows = judged.where(F.col("accepted").isNotNull())
    return _flows(rows.select("accepted.*", F.col(event_time).alias("timestamp")))


def rejected_records(judged: DataFrame) -> DataFrame:
    """The records that were not accepted, unchanged."""
    return judged.where(F.col("accepted").isNull()).drop("accepted")


def parse_rejects(raw: DataFrame, value: str = "value") -> DataFrame:
    """The records :func:`parse_flows` drops, unchanged, for a quarantine table."""
    read, valid = _read_flows(raw, value)
    return read.where(~valid).drop("_typed", "_usual", "_other")


def _count_ok(doc: Column, path: str) -> Column:
    kind = _type(doc, path)
    whole_text = F.try_variant_get(doc, f"$.{path}", "string").rlike(r"^\s*([+-]?[0-9]+)?\s*$")
    return kind.rlike("^(VOID|BIGINT|DECIMAL|DOUBLE|FLOAT)") | ((kind == "STRING") & whole_text)


def _time(doc: Column, path: str) -> Column:
    text = F.try_variant_get(doc, f"$.{path}", "string")
    return F.try_to_timestamp(text, F.lit(TIMESTAMP_PATTERN))


def _time_ok(doc: Column, path: str) -> Column:
    kind = _type(doc, path)
    blank = F.try_variant_get(doc, f"$.{path}", "string") == ""
    return (kind == "VOID") | ((kind == "STRING") & (blank | _time(doc, path).isNotNull()))


def _aggregate(doc: Column) -> Column:
    checks = [_is_object(doc)]
    checks += [_count_ok(doc, name) for name in AGGREGATE_COUNTS]
    checks += [_time_ok(doc, name) for name in (*AGGREGATE_TIMES, *WINDOW_BOUNDS)]
    return F.when(
        _all(checks),
        F.struct(
            F.coalesce(_time(doc, "window_start"), _time(doc, "timestamp_start")).alias("window_start"),
            _time(doc, "window_end").alias("window_end"),
            *[_time(doc, name).alias(name) for name in AGGREGATE_TIMES],
            *[_integer(doc, name).alias(name) for name in AGGREGATE_COUNTS],
        ),
    )


def parse_aggregates(raw: DataFrame, value: str = "value", key: str | None = "key") -> DataFrame:
    """Aggregates from their published JSON.

    Unknown keys are ignored, a missing or null count is 0. A value of the wrong type or an
    unreadable timestamp rejects the record. Records written without window bounds take
    ``timestamp_start`` as their window start.
    """
    return accepted_aggregates(judge_aggregates(raw, value), key)


def judge_aggregates(raw: DataFrame, value: str = "value") -> DataFrame:
    """``raw`` with ``accepted``, the fields of each readable aggregate; NULL for the other records."""
    return with_once(raw, _document(F.col(value), _aggregate).alias("accepted"))


def accepted_aggregates(judged: DataFrame, key: str | None = "key") -> DataFrame:
    """The aggregates in the result of :func:`judge_aggregates`."""
    given = F.col(key) if key else F.lit(None).cast("string")
    read = judged.where(F.col("accepted").isNotNull()).select(given.alias("key"), "accepted.*")
    return read.withColumn("average_packet_size", average_packet_size())


def _warning(doc: Column) -> Column:
    nested = [_type(doc, name).rlike("^(OBJECT|ARRAY)") for name in WARNING_KEYS]
    return F.when(
        _all([_is_object(doc), *[~one for one in nested]]),
        F.struct(*[_text(doc, name).alias(name) for name in WARNING_KEYS]),
    )


def parse_warnings(raw: DataFrame, value: str = "value") -> DataFrame:
    """Warnings (severidade, descricao); records with other keys or nested values are skipped."""
    known = F.array(*[F.lit(name) for name in WARNING_KEYS])
    unknown = F.array_except(F.json_object_keys(F.col(value)), known)
    read = with_once(
        raw,
        _document(F.col(value), _warning).alias("_warning"),
        F.size(unknown).alias("_unknown"),
    )
    return read.where(F.col("_warning").isNotNull() & (F.col("_unknown") == 0)).select("_warning.*")
