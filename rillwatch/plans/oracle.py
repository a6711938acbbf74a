"""DuckDB SQL for the registered queries, written independently of the operators."""

_SUMS = (
    "bytes_inbound",
    "bytes_outbound",
    "packets_inbound",
    "packets_outbound",
    "tcp_syn_total",
    "tcp_ack_total",
    "tcp_fin_total",
    "tcp_rst_total",
)
# sums end here
_MOST = 9223372036854775807
_AGGREGATE_COLUMNS = (
    "key, window_start, window_end, timestamp_start, timestamp_end, bytes_inbound, bytes_outbound,"
    " packets_inbound, packets_outbound, unique_flow_count, tcp_syn_total, tcp_ack_total,"
    " tcp_fin_total, tcp_rst_total, average_packet_size"
)


def _ip(column: str) -> str:
    parts = [f"CAST(({column} >> {shift}) & 255 AS VARCHAR)" for shift in (24, 16, 8)]
    return " || '.' || ".join([*parts, f"CAST({column} & 255 AS VARCHAR)"])


def _direction(src: str, dst: str) -> str:
    local = "(({} & 4294967040) = 170524928)"
    s, d = local.format(src), local.format(dst)
    return (
        f"CASE WHEN {s} AND {d} THEN 'LATERAL' WHEN {s} THEN 'OUTBOUND'"
        f" WHEN {d} THEN 'INBOUND' ELSE 'UNKNOWN' END"
    )


ENDPOINTS = """
endpoints AS (SELECT *,
  CASE WHEN event_type IN ('click','purchase','signup') THEN CAST(170524928 AS BIGINT)+user_id%8
       ELSE CAST(3639549952 AS BIGINT)+user_id%8 END AS src_ip,
  CASE WHEN event_type IN ('view','purchase') THEN CAST(170524928 AS BIGINT)+(user_id+3)%8
       ELSE CAST(3639549952 AS BIGINT)+(user_id+3)%8 END AS dst_ip,
  CAST(40000+user_id%16 AS INTEGER) AS src_port, CAST(443 AS INTEGER) AS dst_port,
  CAST(floor(value*10) AS BIGINT)%1461 AS payload_size
FROM events)"""

PACKETS = (
    ENDPOINTS
    + """,
packets AS (SELECT event_id AS pkt_seq, ts, src_ip, dst_ip, src_port, dst_port,
  CASE WHEN event_id%5=0 THEN 17 ELSE 6 END AS protocol, payload_size,
  CAST(CASE WHEN event_id%5=0 THEN 0 ELSE event_id%32 END AS INTEGER) AS tcp_flags
FROM endpoints)"""
)

MICROFLOWS = (
    PACKETS
    + f""",
gaps AS (SELECT *, time_bucket(INTERVAL '10 minutes', ts) AS tick_start,
  epoch_us(ts) - lag(epoch_us(ts)) OVER (
    PARTITION BY time_bucket(INTERVAL '10 minutes', ts), src_ip, src_port, dst_ip, dst_port, protocol
    ORDER BY pkt_seq) AS gap
FROM packets),
grouped AS (SELECT tick_start, src_ip AS src, src_port, dst_ip AS dst, dst_port, protocol AS number,
  count(*) AS packets, CAST(sum(payload_size) AS BIGINT) AS bytes,
  CAST(min(payload_size) AS INTEGER) AS min_size, CAST(max(payload_size) AS INTEGER) AS max_size,
  CASE WHEN count(*)>1 THEN CAST(sum(gap) AS DOUBLE)/(count(*)-1) ELSE 0.0 END AS mean_iat_us,
  CAST(sum(CASE WHEN protocol=6 AND tcp_flags&2<>0 THEN 1 ELSE 0 END) AS BIGINT) AS tcp_syn,
  CAST(sum(CASE WHEN protocol=6 AND tcp_flags&16<>0 THEN 1 ELSE 0 END) AS BIGINT) AS tcp_ack,
  CAST(sum(CASE WHEN protocol=6 AND tcp_flags&1<>0 THEN 1 ELSE 0 END) AS BIGINT) AS tcp_fin,
  CAST(sum(CASE WHEN protocol=6 AND tcp_flags&4<>0 THEN 1 ELSE 0 END) AS BIGINT) AS tcp_rst
FROM gaps GROUP BY ALL),
microflows AS (SELECT tick_start, {_ip('src')} AS src_ip, src_port, {_ip('dst')} AS dst_ip, dst_port,
  CASE number WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'OTHER' END AS protocol,
  {_direction('src', 'dst')} AS dir,
  packets, bytes, min_size, max_size, mean_iat_us, tcp_syn, tcp_ack, tcp_fin, tcp_rst
FROM grouped)"""
)


def _aggregate(source: str, key: str, flow: str = "(src_ip, src_port, dst_ip, dst_port, protocol)") -> str:
    """Aggregates of ``source`` in one step, with a plain distinct count."""
    volume = ", ".join(
        f"CAST(least(sum(CASE WHEN dir='{way}' THEN {column} ELSE 0 END), {_MOST}) AS BIGINT)"
        f" AS {name}_{way.lower()}"
        for name, column in (("bytes", "bytes"), ("packets", "packets"))
        for way in ("INBOUND", "OUTBOUND")
    )
    flags = ", ".join(
        f"CAST(sum(tcp_{flag}) AS BIGINT) AS tcp_{flag}_total" for flag in ("syn", "ack", "fin", "rst")
    )
    return f"""
totals AS (SELECT {key} AS key, time_bucket(INTERVAL '1 hour', tick_start) AS window_start,
  min(tick_start) AS timestamp_start, max(tick_start) AS timestamp_end,
  {volume}, count(DISTINCT {flow}) AS unique_flow_count, {flags}
FROM {source} GROUP BY ALL),
aggregates AS (SELECT *, window_start + INTERVAL '1 hour' AS window_end,
  CASE WHEN packets_inbound + packets_outbound = 0 THEN 0.0
       ELSE CAST(CAST(bytes_inbound AS HUGEINT) + bytes_outbound AS DOUBLE)/(packets_inbound + packets_outbound)
  END AS average_packet_size
FROM totals)"""


AGGREGATES = MICROFLOWS + "," + _aggregate("microflows", "'global-key'")

LONG = """
long AS (
  SELECT key, window_start, 'bytes_inbound' AS metric, 'bytes recebidos' AS label,
         bytes_inbound AS current FROM aggregates
  UNION ALL SELECT key, window_start, 'bytes_outbound', 'bytes enviados', bytes_outbound FROM aggregates
  UNION ALL SELECT key, window_start, 'unique_flow_count', 'conexões únicas', unique_flow_count
  FROM aggregates)"""

ROLLED = (
    LONG
    + """,
framed AS (SELECT *, CAST(count(*) OVER w AS INTEGER) AS samples, sum(current) OVER w AS total
FROM long WINDOW w AS (PARTITION BY key, metric ORDER BY window_start
                       ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)),
rolled AS (SELECT * EXCLUDE (total),
  CASE WHEN samples > 0 THEN CAST(total AS DOUBLE)/samples ELSE 0.0 END AS average FROM framed)"""
)

WARNINGS_FROM_AGGREGATES = (
    ROLLED
    + """,
rated AS (SELECT *, current/average AS ratio FROM rolled WHERE samples >= 3 AND average > 0),
flagged AS (SELECT *, CAST(floor((ratio-1)*100+0.5) AS BIGINT) AS percent_above,
  CASE WHEN ratio >= 2.0 THEN 'alta' WHEN ratio >= 1.5 THEN 'media'
       WHEN ratio >= 1.2 THEN 'regular' END AS severidade
FROM rated),
warnings AS (SELECT key, window_start, metric, current, samples, average, ratio, percent_above, severidade,
  'O último agregado registrou ' || current || ' ' || label || ', ' || percent_above
  || '% acima da média de ' || CAST(floor(average+0.5) AS BIGINT) || ' nas ' || samples
  || ' amostras anteriores' AS descricao
FROM flagged WHERE severidade IS NOT NULL)"""
)

WARNINGS = AGGREGATES + "," + WARNINGS_FROM_AGGREGATES

TITLE = "'Alerta de rede [' || coalesce(severidade, 'null') || ']'"
LEVEL = "CASE lower(severidade) WHEN 'alta' THEN 'ERROR' WHEN 'media' THEN 'WARNING' ELSE 'INFO' END"

# expected packets of the derived frames, from the event columns
DECODED = (
    ENDPOINTS
    + """,
shapes AS (SELECT *,
  CASE WHEN event_id%41=0 THEN 1 WHEN event_id%5=0 THEN 17 ELSE 6 END AS number,
  CASE WHEN event_id%7=0 THEN 18 ELSE 14 END AS ip_at,
  CASE WHEN event_id%11=0 THEN 24 ELSE 20 END AS ip_length,
  CASE WHEN event_id%43=0 THEN 40 WHEN event_id%47=0 THEN 30 ELSE 128 END AS caplen
FROM endpoints WHERE event_id%23<>0 AND event_id%29<>0 AND event_id%31<>0),
decoded AS (SELECT event_id AS pkt_seq, ts, src_ip, dst_ip, src_port, dst_port, number AS protocol,
  CASE WHEN event_id%37=0 THEN 0 ELSE payload_size END AS payload_size,
  CAST(CASE WHEN number=6 THEN event_id%256 ELSE 0 END AS INTEGER) AS tcp_flags
FROM shapes WHERE number IN (6,17) AND caplen >= ip_at+20
  AND caplen >= ip_at + ip_length + CASE number WHEN 6 THEN 20 ELSE 8 END)"""
)

# the derived raw topic, written as text and read with DuckDB's JSON functions
_JSON_KEYS = (
    "src_ip src_port dst_ip dst_port protocol dir packets bytes min_size max_size mean_iat_us"
    " tcp.syn tcp.ack tcp.fin tcp.rst"
).split()


def _json_number(path: str) -> str:
    return (
        f"CASE WHEN json_type(value, '$.{path}') = 'BOOLEAN'"
        f" THEN CASE WHEN json_extract_string(value, '$.{path}') = 'true' THEN 1.0 ELSE 0.0 END"
        f" ELSE coalesce(TRY_CAST(json_extract_string(value, '$.{path}') AS DOUBLE), 0.0) END"
    )


def _json_integer(path: str) -> str:
    return f"CAST(trunc({_json_number(path)}) AS BIGINT)"


RAW = (
    ENDPOINTS
    + f""",
parts AS (SELECT *, event_id%40 AS c, {_direction('src_ip', 'dst_ip')} AS way,
  CAST(event_id%50 AS VARCHAR) AS n,
  CASE WHEN event_id%5=0 THEN 0 ELSE event_id%32 END AS bits FROM endpoints),
texts AS (SELECT event_id, ts, c,
  CASE WHEN c=10 THEN '{{"extra":[1,2],' ELSE '{{' END || '"src_ip":'
  || CASE WHEN c=17 THEN 'null' ELSE '"' || {_ip('src_ip')} || '"' END
  || ',"src_port":' || src_port || ',"dst_ip":"' || {_ip('dst_ip')}
  || '","dst_port":443,"protocol":"'
  || CASE WHEN c=8 THEN 'OTHER' WHEN event_id%5=0 THEN 'UDP' ELSE 'TCP' END
  || '","dir":"' || CASE WHEN c=9 THEN lower(way) ELSE way END || '","packets":'
  || CASE c WHEN 11 THEN '"' || n || '"' WHEN 12 THEN 'null' WHEN 13 THEN n || '.9'
       WHEN 14 THEN 'true' WHEN 15 THEN '"many"' WHEN 16 THEN '{{"n":1}}' ELSE n END
  || ',"bytes":' || payload_size || ',"min_size":' || event_id%9 || ','
  || CASE WHEN c=5 THEN '' ELSE '"max_size":' || (event_id%9+100) || ',' END
  || '"mean_iat_us":' || event_id%1000 || '.' || event_id%10 || ',"tcp":'
  || CASE WHEN c=6 THEN '5' ELSE '{{' || CASE WHEN c=7 THEN '' ELSE '"syn":' || ((bits>>1)&1) || ',' END
       || '"ack":' || ((bits>>4)&1) || ',"fin":' || (bits&1) || ',"rst":' || ((bits>>2)&1) || '}}' END
  || '}}' AS text
FROM parts),
raw AS (SELECT event_id AS "offset", ts AS "timestamp",
  CASE c WHEN 1 THEN '{{bad' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '[1]' ELSE text END AS value
FROM texts),
readable AS (SELECT * FROM raw WHERE coalesce(json_valid(value), false)),
checked AS (SELECT *, {' AND '.join(f"json_exists(value, '$.{key}')" for key in _JSON_KEYS)}
  AND coalesce(json_extract_string(value, '$.protocol') IN ('TCP','UDP'), false)
  AND coalesce(json_extract_string(value, '$.dir') IN ('INBOUND','OUTBOUND','LATERAL','UNKNOWN'), false)
  AS ok FROM readable),
read AS (SELECT json_extract_string(value, '$.src_ip') AS src_ip, {_json_integer('src_port')} AS src_port,
  json_extract_string(value, '$.dst_ip') AS dst_ip, {_json_integer('dst_port')} AS dst_port,
  json_extract_string(value, '$.protocol') AS protocol, json_extract_string(value, '$.dir') AS dir,
  {_json_integer('packets')} AS packet_count, {_json_integer('bytes')} AS byte_count,
  {_json_integer('min_size')} AS min_packet_size, {_json_integer('max_size')} AS max_packet_size,
  "timestamp", {_json_number('mean_iat_us')} AS mean_iat_us,
  {_json_integer('tcp.syn')} AS tcp_syn_count, {_json_integer('tcp.fin')} AS tcp_fin_count,
  {_json_integer('tcp.rst')} AS tcp_rst_count, {_json_integer('tcp.ack')} AS tcp_ack_count
FROM checked WHERE ok),
flows AS (SELECT coalesce(src_ip,'null') || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-'
  || protocol AS flow_key, * FROM read)"""
)

RAW_TRAFFIC = (
    RAW
    + """,
timed AS (SELECT "timestamp" AS tick_start, coalesce(src_ip,'null') AS src_ip, src_port, dst_ip, dst_port,
  protocol, dir, packet_count AS packets, byte_count AS bytes, tcp_syn_count AS tcp_syn,
  tcp_ack_count AS tcp_ack, tcp_fin_count AS tcp_fin, tcp_rst_count AS tcp_rst FROM flows),"""
    + _aggregate("timed", "'global-key'")
)

ARRIVALS = """
arrivals AS (SELECT event_id AS pkt_seq, event_id + CASE WHEN event_id%10=0 THEN 60 ELSE 0 END AS arrival,
  CAST(user_id%3 AS INTEGER) AS source_partition, ts AS "timestamp" FROM events)"""

_CLOSED = "WHERE window_end <= (SELECT max(timestamp_end) FROM aggregates)"
# what a drained stream has emitted: windows ended by the latest packet, not by the latest tick
_EMITTED = "WHERE window_end <= (SELECT max(ts) FROM events)"

_FLAG_TEXT = " || ".join(
    f"CASE WHEN f&{bit}<>0 THEN ' {name}' ELSE '' END"
    for bit, name in ((2, "SYN"), (16, "ACK"), (1, "FIN"), (4, "RST"), (8, "PSH"), (32, "URG"))
)

_MICROFLOW_TEXT = (
    "'{\"src_ip\":\"' || src_ip || '\",\"src_port\":' || src_port || ',\"dst_ip\":\"' || dst_ip"
    " || '\",\"dst_port\":' || dst_port || ',\"protocol\":\"' || protocol || '\",\"dir\":\"' || dir"
    " || '\",\"packets\":' || packets || ',\"bytes\":' || bytes || ',\"min_size\":' || min_size"
    " || ',\"max_size\":' || max_size || ',\"mean_iat_us\":' || printf('%.1f', mean_iat_us)"
    " || ',\"tcp\":{\"syn\":' || tcp_syn || ',\"ack\":' || tcp_ack || ',\"fin\":' || tcp_fin"
    " || ',\"rst\":' || tcp_rst || '}}'"
)

_FLOW_TIME = (
    "'[' || year(t) || ',' || month(t) || ',' || day(t) || ',' || hour(t) || ',' || minute(t)"
    " || CASE WHEN second(t)<>0 OR epoch_us(t)%1000000<>0 THEN ',' || second(t) ELSE '' END"
    " || CASE WHEN epoch_us(t)%1000000<>0 THEN ',' || (epoch_us(t)%1000000*1000) ELSE '' END || ']'"
)

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g')"


def _summary(topic: str, key: str, column: str) -> str:
    return (
        f"SELECT window_start, '{key}' AS metric_key, {column} AS value, '{topic}' AS topic FROM aggregates"
    )


_SUMMARIES = " UNION ALL ".join(
    [
        _summary("network-summary-bytes-inbound", "in", "bytes_inbound"),
        _summary("network-summary-bytes-outbound", "out", "bytes_outbound"),
        _summary("network-summary-unique-flow-count", "flow", "unique_flow_count"),
    ]
)

_LIMITS = (
    ("bytes_inbound", 1500, "Alerta de bytes recebidos", "bytes recebidos"),
    ("bytes_outbound", 3000, "Alerta de bytes enviados", "bytes enviados"),
    ("unique_flow_count", 15, "Alerta de número de conexões", "conexões"),
)
_LIMIT_ALERTS = " UNION ALL ".join(
    f"SELECT key, window_start, '{metric}' AS metric, {metric} AS current, CAST({limit} AS BIGINT) AS \"limit\","
    f" 'WARNING' AS level, '{title}' AS title,"
    f" 'O último agregado registrou ' || {metric} || ' {unit}' AS text FROM aggregates WHERE {metric} > {limit}"
    for metric, limit, title, unit in _LIMITS
)

_SAMPLE = ", ".join(
    f"{m}, CAST(least(sum({m}) OVER w, {_MOST}) AS BIGINT) AS {m}_sum, max({m}) OVER w AS {m}_record"
    for m in ("bytes_inbound", "bytes_outbound", "unique_flow_count")
)


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()} {select}"


def _by_key(key: str) -> str:
    return MICROFLOWS + "," + _aggregate("microflows", key)


def _late(partition: str, columns: str) -> str:
    return _with(
        ARRIVALS,
        f"""SELECT {columns} FROM (SELECT *, max("timestamp") OVER ({partition} ORDER BY arrival, pkt_seq
        ROWS UNBOUNDED PRECEDING) AS seen FROM arrivals)
        WHERE time_bucket(INTERVAL '1 hour', "timestamp") + INTERVAL '1 hour' > seen""",
    )


_HOST_WARNINGS = _by_key("src_ip") + "," + WARNINGS_FROM_AGGREGATES
_FRAME_TRAFFIC = DECODED + f""",
ticked AS (SELECT *, time_bucket(INTERVAL '10 minutes', ts) AS tick_start, 1 AS packets,
  payload_size AS bytes, {_direction('src_ip', 'dst_ip')} AS dir,
  CASE WHEN protocol=6 THEN (tcp_flags>>1)&1 ELSE 0 END AS tcp_syn,
  CASE WHEN protocol=6 THEN (tcp_flags>>4)&1 ELSE 0 END AS tcp_ack,
  CASE WHEN protocol=6 THEN tcp_flags&1 ELSE 0 END AS tcp_fin,
  CASE WHEN protocol=6 THEN (tcp_flags>>2)&1 ELSE 0 END AS tcp_rst FROM decoded),""" + _aggregate(
    "ticked", "'global-key'"
) + "," + WARNINGS_FROM_AGGREGATES

# the six applications: the last tick never closes, nor does the window its predecessor lies in
_APPLIED = (
    _FRAME_TRAFFIC.replace(
        "FROM decoded),\n", "FROM decoded WHERE time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes'"
        " <= (SELECT max(ts) FROM decoded)),\n"
    )
    .replace("\naggregates AS (SELECT *,", "\nevery_window AS (SELECT *,")
    .replace(
        "\nlong AS (",
        "\naggregates AS (SELECT * FROM every_window WHERE window_end <= (SELECT max(tick_start) FROM ticked)),"
        "\nlong AS (",
    )
)

# Four files in time order, every fiftieth row one file late, a restart after the second. A window leaves
# at the end of the batch after the one that passes it, so a row one file late still finds its window, but
# for the rows that come after the restart: before it, the stream has closed all that it could.
_RESTARTED = (
    PACKETS.replace("packets AS (SELECT event_id", "every AS (SELECT event_id")
    + """,
dealt AS (SELECT *, least(3, CASE WHEN day(ts)<8 THEN 0 WHEN day(ts)<15 THEN 1 WHEN day(ts)<22 THEN 2 ELSE 3 END
  + CASE WHEN pkt_seq%50=0 THEN 1 ELSE 0 END) AS part FROM every),
packets AS (SELECT * EXCLUDE (part) FROM dealt WHERE part < 2 OR time_bucket(INTERVAL '1 hour', ts)
  + INTERVAL '1 hour' > (SELECT max(ts) FROM dealt WHERE part < 2))"""
    + WARNINGS[len(PACKETS):]
)

_EXTREME = RAW.replace(
    "|| payload_size || ',\"min_size\":'",
    "|| CASE WHEN event_id%4=0 THEN '1000000000000000000000000000000' ELSE CAST(payload_size AS VARCHAR) END"
    " || ',\"min_size\":'",
).replace(_json_integer("bytes"), f"CAST(least(trunc({_json_number('bytes')}), 9.2e18) AS BIGINT)")
_EXTREME_TRAFFIC = _EXTREME + RAW_TRAFFIC[len(RAW):]

# aggregates with byte counts whose sum is beyond BIGINT
_HUGE = AGGREGATES.replace("FROM totals)", "FROM huge)").replace(
    "\naggregates AS (SELECT *,",
    """
huge AS (SELECT * REPLACE (
  CASE WHEN day(window_start)%4=0 THEN 5000000000000000000 ELSE bytes_inbound END AS bytes_inbound,
  CASE WHEN day(window_start)%4=0 THEN 5000000000000000000 ELSE bytes_outbound END AS bytes_outbound)
FROM totals),
aggregates AS (SELECT *,""",
)

_ALL_AGGREGATES = f"SELECT {_AGGREGATE_COLUMNS} FROM aggregates"
_WARNING_COLUMNS = (
    "key, window_start, metric, current, samples, average, ratio, percent_above, severidade, descricao"
)

# the derived warnings topic by its twelve cases
_WARNING_NAME = (
    "CASE event_id%12 WHEN 0 THEN 'alta' WHEN 1 THEN 'MEDIA' WHEN 2 THEN 'regular' WHEN 3 THEN 'outra'"
    " WHEN 4 THEN NULL WHEN 5 THEN '7' ELSE 'Alta' END"
)

ORACLE: dict[str, str] = {
    "decode_frames": _with(DECODED, "SELECT * FROM decoded"),
    "decode_filters": _with(
        DECODED,
        """SELECT CASE protocol WHEN 6 THEN 'TCP' ELSE 'UDP' END AS protocol, count(*) AS kept,
        CAST(sum(CASE WHEN payload_size=0 THEN 1 ELSE 0 END) AS BIGINT) AS empty_payload,
        CAST(sum(payload_size) AS BIGINT) AS payload FROM decoded GROUP BY ALL""",
    ),
    "classify_direction": _with(
        PACKETS,
        f"SELECT pkt_seq, {_direction('src_ip', 'dst_ip')} AS known_net, 'UNKNOWN' AS no_net FROM packets",
    ),
    "protocol_name": """SELECT event_id, CAST(event_id%20 AS INTEGER) AS number,
        CASE event_id%20 WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'OTHER' END AS protocol FROM events""",
    "ip_text": _with(
        PACKETS,
        f"SELECT pkt_seq, {_ip('src_ip')} AS src, {_ip('dst_ip')} AS dst, src_ip, dst_ip FROM packets",
    ),
    "tcp_flag_counts": _with(
        PACKETS,
        "SELECT src_port, "
        + ", ".join(
            f"count(*) FILTER (WHERE protocol=6 AND tcp_flags&{bit}<>0) AS {name}"
            for name, bit in (("syn", 2), ("ack", 16), ("fin", 1), ("rst", 4))
        )
        + " FROM packets GROUP BY src_port",
    ),
    "flags_text": f"""SELECT event_id, trim({_FLAG_TEXT}) AS flags
        FROM (SELECT event_id, event_id%64 AS f FROM events)""",
    "microflow_aggregate": _with(MICROFLOWS, "SELECT * FROM microflows"),
    "mean_iat": _with(
        MICROFLOWS,
        """SELECT protocol, dir, count(*) AS flows, min(mean_iat_us) AS shortest,
        max(mean_iat_us) AS longest FROM microflows WHERE packets > 1 GROUP BY ALL""",
    ),
    "microflow_json": _with(
        MICROFLOWS, f"SELECT tick_start, {_MICROFLOW_TEXT} AS value FROM microflows"
    ),
    "flow_report": _with(
        MICROFLOWS,
        """SELECT tick_start, src_ip || ':' || src_port || ' -> ' || dst_ip || ':' || dst_port AS flow,
        CASE dir WHEN 'OUTBOUND' THEN 'OUT' WHEN 'INBOUND' THEN 'IN' WHEN 'LATERAL' THEN 'LAT'
          ELSE 'UNK' END AS dir, protocol, packets, bytes, min_size || '/' || max_size AS min_max,
        printf('%.1f us', mean_iat_us) AS mean_iat,
        CASE protocol WHEN 'TCP' THEN tcp_syn || '/' || tcp_ack || '/' || tcp_fin || '/' || tcp_rst
          ELSE '-' END AS tcp_flags FROM microflows""",
    ),
    "parse_flows": _with(RAW, "SELECT * FROM flows"),
    "parse_rejects": _with(
        RAW,
        """SELECT "offset", value, "timestamp" FROM raw
        WHERE "offset" NOT IN (SELECT "offset" FROM checked WHERE ok)""",
    ),
    "flow_key": _with(
        MICROFLOWS,
        """SELECT src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-' || protocol
        AS flow_key, count(*) AS ticks, CAST(sum(packets) AS BIGINT) AS packets
        FROM microflows GROUP BY ALL""",
    ),
    "flow_record_json": _with(
        MICROFLOWS,
        """SELECT '{"flow_key":"' || src_ip || ':' || src_port || '-' || dst_ip || ':' || dst_port || '-'
        || protocol || '","src_ip":"' || src_ip || '","dst_ip":"' || dst_ip || '","src_port":' || src_port
        || ',"dst_port":' || dst_port || ',"protocol":"' || protocol || '","dir":"' || dir
        || '","packet_count":' || packets || ',"byte_count":' || bytes || ',"min_packet_size":' || min_size
        || ',"max_packet_size":' || max_size || ',"timestamp":' || """
        + _FLOW_TIME
        + """ || ',"mean_iat_us":' || printf('%.1f', mean_iat_us) || ',"tcp_syn_count":' || tcp_syn
        || ',"tcp_fin_count":' || tcp_fin || ',"tcp_rst_count":' || tcp_rst || ',"tcp_ack_count":'
        || tcp_ack || '}' AS value FROM (SELECT *, tick_start AS t FROM microflows)""",
    ),
    "flow_record_roundtrip": _with(RAW, "SELECT * FROM flows"),
    "traffic_aggregate": _with(AGGREGATES, _ALL_AGGREGATES),
    "packet_traffic": _with(AGGREGATES, _ALL_AGGREGATES),
    "raw_traffic": _with(RAW_TRAFFIC, _ALL_AGGREGATES),
    "topic_roundtrip": _with(AGGREGATES, _ALL_AGGREGATES),
    "traffic_by_direction": _with(_by_key("dir"), _ALL_AGGREGATES),
    "traffic_by_host_and_protocol": _with(
        _by_key("""'{"src_ip":"' || src_ip || '","protocol":"' || protocol || '"}'"""), _ALL_AGGREGATES
    ),
    "unique_flows": _with(AGGREGATES, "SELECT window_start, unique_flow_count FROM aggregates"),
    "unique_flows_sketch": _with(
        AGGREGATES,
        """SELECT 'hour' AS length, window_start, true AS ok FROM aggregates
        UNION ALL SELECT 'day', window_start, true
        FROM (SELECT DISTINCT time_bucket(INTERVAL '1 day', window_start) AS window_start FROM aggregates)""",
    ),
    "unique_flows_concat": _with(
        MICROFLOWS
        + ","
        + _aggregate("microflows", "'global-key'", "src_ip || src_port || dst_ip || dst_port || protocol"),
        "SELECT window_start, unique_flow_count FROM aggregates",
    ),
    "avg_packet_size": _with(
        _by_key("dir"), "SELECT key, window_start, average_packet_size FROM aggregates"
    ),
    "aggregate_json": _with(
        AGGREGATES,
        f"""SELECT key, '{{"timestamp_start":"' || {_ISO.format('timestamp_start')}
        || '","timestamp_end":"' || {_ISO.format('timestamp_end')}
        || '","bytes_inbound":' || bytes_inbound || ',"bytes_outbound":' || bytes_outbound
        || ',"packets_inbound":' || packets_inbound || ',"packets_outbound":' || packets_outbound
        || ',"unique_flow_count":' || unique_flow_count || ',"tcp_syn_total":' || tcp_syn_total
        || ',"tcp_ack_total":' || tcp_ack_total || ',"tcp_fin_total":' || tcp_fin_total
        || ',"tcp_rst_total":' || tcp_rst_total || ',"averagePacketSize":null'
        || ',"window_start":"' || {_ISO.format('window_start')}
        || '","window_end":"' || {_ISO.format('window_end')} || '"}}' AS value, average_packet_size FROM aggregates""",
    ),
    "aggregate_json_roundtrip": _with(AGGREGATES, _ALL_AGGREGATES),
    "closed_windows": _with(AGGREGATES, f"{_ALL_AGGREGATES} {_CLOSED}"),
    "drop_late": _late("", 'pkt_seq, "timestamp"'),
    "drop_late_by_partition": _late(
        "PARTITION BY source_partition", 'source_partition, pkt_seq, "timestamp"'
    ),
    "unpivot_metrics": _with(AGGREGATES + "," + LONG, "SELECT * EXCLUDE (label) FROM long"),
    "rolling_mean_30": _with(AGGREGATES + "," + ROLLED, "SELECT * EXCLUDE (label) FROM rolled"),
    "rolling_anomalies": _with(WARNINGS, f"SELECT {_WARNING_COLUMNS} FROM warnings"),
    "rolling_anomalies_by_host": _with(_HOST_WARNINGS, f"SELECT {_WARNING_COLUMNS} FROM warnings"),
    "null_key_anomalies": _with(WARNINGS, "SELECT 'global' AS key, window_start, metric FROM warnings"),
    "anomaly_severity_counts": _with(
        WARNINGS,
        """SELECT metric, severidade, count(*) AS warnings, max(percent_above) AS most_above
        FROM warnings GROUP BY ALL""",
    ),
    "warning_text": _with(WARNINGS, "SELECT window_start, metric, descricao FROM warnings"),
    "warning_json": _with(
        WARNINGS,
        """SELECT window_start, '{"severidade":"' || severidade || '","descricao":"' || descricao || '"}'
        AS value FROM warnings""",
    ),
    "limit_alerts": _with(AGGREGATES, _LIMIT_ALERTS),
    "rolling_sample_60": _with(
        AGGREGATES,
        f"""SELECT key, window_start, count(*) OVER w AS samples, {_SAMPLE} FROM aggregates
        WINDOW w AS (PARTITION BY key ORDER BY window_start ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    ),
    "expanding_stats": _with(
        AGGREGATES + "," + LONG,
        """, stats AS (SELECT key, window_start, metric, current AS latest, count(*) OVER w AS sample_size,
        CAST(sum(current) OVER w AS BIGINT) AS total, min(current) OVER w AS minimum,
        max(current) OVER w AS maximum FROM long
        WINDOW w AS (PARTITION BY key, metric ORDER BY window_start ROWS UNBOUNDED PRECEDING)),
        averaged AS (SELECT *, CAST(total AS DOUBLE)/sample_size AS average FROM stats)
        SELECT *, CASE WHEN average <> 0 THEN latest/average WHEN latest = 0 THEN CAST('nan' AS DOUBLE)
        ELSE CAST('inf' AS DOUBLE) END AS ratio FROM averaged""",
    ),
    "split_metrics": _with(AGGREGATES, _SUMMARIES),
    "branch_by_prefix": _with(
        AGGREGATES,
        """SELECT window_start, 'in' AS metric_key, bytes_inbound AS value, 'branch-in' AS branch
        FROM aggregates UNION ALL
        SELECT window_start, 'out', bytes_outbound, 'branch-out' FROM aggregates""",
    ),
    "alert_messages": _with(
        WARNINGS,
        f"SELECT window_start, metric, {LEVEL} AS level, {TITLE} AS title, descricao AS text FROM warnings",
    ),
    "parse_warnings": f"""WITH records AS (SELECT {_WARNING_NAME} AS severidade,
        'evento ' || event_id AS descricao FROM events WHERE event_id%12 NOT IN (6, 7, 8, 9, 10))
        SELECT *, {LEVEL} AS level, {TITLE} AS title FROM records""",
    "frames_to_alerts": _with(
        _FRAME_TRAFFIC,
        f"""SELECT window_start, metric, current, {LEVEL} AS level, {TITLE} AS title, descricao AS text
        FROM warnings""",
    ),
    "stream_microflow_aggregate": _with(
        MICROFLOWS,
        """SELECT * FROM microflows
        WHERE tick_start + INTERVAL '10 minutes' <= (SELECT max(ts) FROM events)""",
    ),
    "stream_traffic_aggregate": _with(AGGREGATES, f"{_ALL_AGGREGATES} {_EMITTED}"),
    "stream_raw_traffic": _with(
        RAW_TRAFFIC,
        f'{_ALL_AGGREGATES} WHERE window_end <= (SELECT max("timestamp") FROM flows)',
    ),
    "stream_rolling_anomalies": _with(
        WARNINGS,
        f"""SELECT {_WARNING_COLUMNS} FROM warnings
        WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events)""",
    ),
    "routed_sinks": _with(
        AGGREGATES,
        f"""SELECT topic, metric_key AS key, value, window_start AS "timestamp" FROM ({_SUMMARIES})
        WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events)""",
    ),
    "alert_delivery": _with(
        WARNINGS, f"SELECT {LEVEL} AS level, {TITLE} AS title, descricao AS text FROM warnings"
    ),
    "stream_latest_warnings": _with(
        WARNINGS,
        f"""SELECT {LEVEL} AS level, {TITLE} AS title, descricao AS text FROM warnings
        WHERE day(window_start)%3 <> 0""",
    ),
    "raw_traffic_extreme_numbers": _with(_EXTREME_TRAFFIC, _ALL_AGGREGATES),
    "rolling_sample_extreme_numbers": _with(
        _EXTREME_TRAFFIC,
        f"""SELECT key, window_start, count(*) OVER w AS samples, {_SAMPLE} FROM aggregates
        WINDOW w AS (PARTITION BY key ORDER BY window_start ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)""",
    ),
    "aggregates_extreme_numbers": _with(_HUGE, _ALL_AGGREGATES),
    "watch_extreme_numbers": _with(
        _HUGE + "," + WARNINGS_FROM_AGGREGATES,
        f"""SELECT level, title, count(*) AS alerts FROM (SELECT {LEVEL} AS level, {TITLE} AS title FROM warnings)
        GROUP BY ALL""",
    ),
    "stream_quarantine": _with(
        RAW,
        """SELECT 'accepted' AS half, flow_key AS text, "timestamp" FROM flows
        UNION ALL SELECT 'rejected', value, "timestamp" FROM raw
        WHERE "offset" NOT IN (SELECT "offset" FROM checked WHERE ok)""",
    ),
    "stream_drop_late": _late("PARTITION BY source_partition", 'source_partition, pkt_seq, "timestamp"'),
    "stream_detection_from_history": _with(WARNINGS, f"SELECT {_WARNING_COLUMNS} FROM warnings"),
    "detector_state": _with(
        AGGREGATES + "," + LONG,
        """SELECT key, metric, CAST(least(30, n) - back AS INTEGER) AS place, current AS value FROM (
        SELECT *, row_number() OVER (PARTITION BY key, metric ORDER BY window_start DESC) AS back,
          count(*) OVER (PARTITION BY key, metric) AS n FROM long) WHERE back <= 30""",
    ),
    "alert_delivery_retry": _with(
        WARNINGS,
        f"""SELECT {LEVEL} AS level, {TITLE} AS title, descricao AS text,
        descricao = (SELECT min(descricao) FROM warnings) AS dead FROM warnings""",
    ),
    "stream_latest_summaries": _with(
        AGGREGATES,
        f"""SELECT topic, metric_key AS key, value, window_start AS "timestamp" FROM ({_SUMMARIES})
        WHERE day(window_start) >= 16""",
    ),
    "stream_stage_counts": _with(
        RAW_TRAFFIC,
        """SELECT 'parsed' AS point, 'rows' AS metric, count(*) AS value FROM flows
        UNION ALL SELECT 'emitted', 'rows', count(*) FROM aggregates
        WHERE window_end <= (SELECT max("timestamp") FROM flows)""",
    ),
    "drop_late_topic": _late("", 'pkt_seq, "timestamp"'),
    "aggregates_topic": _with(AGGREGATES, _ALL_AGGREGATES),
    "stored_frames": _with(DECODED, "SELECT * FROM decoded"),
    "ingest_time": _with(RAW, "SELECT count(*) AS flows, CAST(0 AS BIGINT) AS wrong FROM flows"),
    "stream_restart": _with(
        _RESTARTED,
        f"""SELECT {_WARNING_COLUMNS} FROM warnings
        WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events)""",
    ),
    "stream_rolling_anomalies_by_host": _with(
        _HOST_WARNINGS,
        f"""SELECT {_WARNING_COLUMNS} FROM warnings
        WHERE window_start + INTERVAL '1 hour' <= (SELECT max(ts) FROM events)""",
    ),
    "applications": _with(
        _APPLIED,
        f"""SELECT 'raw' AS stage, count(*) AS rows FROM
          (SELECT DISTINCT tick_start, src_ip, src_port, dst_ip, dst_port, protocol FROM ticked)
        UNION ALL SELECT 'aggregates', count(*) FROM aggregates
        UNION ALL SELECT 'warnings', count(*) FROM warnings
        UNION ALL SELECT 'summaries', 3 * count(*) FROM aggregates
        UNION ALL SELECT 'limits', count(*) FROM ({_LIMIT_ALERTS})
        UNION ALL SELECT 'alerts', count(*) FROM warnings""",
    ),
    "stage_counts": _with(
        RAW_TRAFFIC,
        """SELECT 'received_rows' AS metric, count(*) AS value FROM raw
        UNION ALL SELECT 'parsed_rows', count(*) FROM flows
        UNION ALL SELECT 'parsed_bytes', CAST(sum(byte_count) AS BIGINT) FROM flows
        UNION ALL SELECT 'emitted_rows', count(*) FROM aggregates""",
    ),
}
