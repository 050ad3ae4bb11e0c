"""Fixed schemas of the stored layouts and of the JSON inputs."""

# Column names and types of the stored layouts.
LONG_ROW = "device_id string, ts_ms bigint, param_id string, value float"
PACKET_WIDE = "device_id string, ts_ms bigint, param_ids array<string>, values array<float>"
RAW_ARCHIVE = "schema_version smallint, device_id string, timestamp_ms bigint, payload binary"
DEVICE_INVENTORY = "device_id string, ip string, port int"
SUBSCRIPTION = "client_id string, device_id string, param_ids array<string>"

# JSON inputs.
PACKET_LINE = "id string, t bigint, s bigint, p map<string,variant>"
INGEST_BATCH = "device_id string, recv_ts bigint, points array<struct<ts:bigint,param_id:string,value:double>>"
PUBLISHED_PACKET = "device_id string, ts_ms bigint, points array<struct<id:string,value:double>>"
SEGMENT_MANIFEST = (
    "segment_file string, min_ts bigint, max_ts bigint, rows bigint, points bigint, "
    "created_at_ms bigint, mode string, param_ids array<string>"
)
ARCHIVE_MANIFEST = (
    "schema_version smallint, device_id string, file_name string, day_key string, hour int, part int, "
    "min_ts_ms bigint, max_ts_ms bigint, rows bigint, payload_bytes bigint, file_size_bytes bigint, "
    "sealed boolean, created_at_ms bigint"
)

POINT_COLUMNS = ["device_id", "ts_ms", "param_id", "value"]
POINTS = "array<struct<param_id:string,value:double>>"

# Storage modes, with the spellings accepted for each.
MODE_LONG_ROW = "long_row"
MODE_PACKET_WIDE = "packet_wide"
MODE_SPELLINGS = {
    "long_row": MODE_LONG_ROW,
    "long-row": MODE_LONG_ROW,
    "packet_wide": MODE_PACKET_WIDE,
    "packet-wide": MODE_PACKET_WIDE,
}

MAX_POINT_COLUMNS = 10_000

# Fixed value: version of raw archive rows and of their manifest.
RAW_SCHEMA_VERSION = 1


def storage_mode(text: str) -> str:
    """Canonical name of a storage mode (both spellings are accepted)."""
    try:
        return MODE_SPELLINGS[text.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown storage mode: {text!r}") from None
