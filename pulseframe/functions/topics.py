"""Topic names, topic filters and message contents."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseframe.functions.codes import normalise_param
from pulseframe.functions.columns import evaluated_once

# Parts of topic names and message kinds.
TOPIC_PREFIX = "gw"
TELEMETRY_LEAF = "telemetry"
PAYLOAD_LEAF = "payload"
MISSING_TEXT = "-"
KIND_TELEMETRY = "telemetry"
KIND_JSON = "json"
KIND_TEXT = "text/binary"

# Alternative field names of a point, in order of preference.
POINT_NAME_FIELDS = ["point_id", "id", "code", "name"]
POINT_VALUE_FIELDS = ["value", "val", "v"]


def telemetry_topic(device_id: Column, prefix: str = TOPIC_PREFIX) -> Column:
    """Topic of all points of a device."""
    return F.concat_ws("/", F.lit(prefix), device_id, F.lit(TELEMETRY_LEAF))


def param_topic(device_id: Column, param_id: Column, prefix: str = TOPIC_PREFIX) -> Column:
    """Topic of one parameter of a device."""
    return F.concat_ws("/", F.lit(prefix), device_id, normalise_param(param_id))


def client_topic(client_id: Column, device_id: Column, prefix: str = TOPIC_PREFIX) -> Column:
    """Topic of the packets selected for one client."""
    return F.concat_ws("/", F.lit(prefix), client_id, device_id, F.lit(PAYLOAD_LEAF))


def topic_device(topic: Column, prefix: str = TOPIC_PREFIX) -> Column:
    """Device of a topic with at least three parts, else empty text."""
    parts = F.split(topic, "/")
    return F.when((F.size(parts) >= 3) & (F.get(parts, F.lit(0)) == prefix), F.get(parts, F.lit(1))).otherwise(F.lit(""))


def topic_param(topic: Column, prefix: str = TOPIC_PREFIX) -> Column:
    """Parameter of a three-part topic unless its last part is the telemetry leaf."""
    parts = F.split(topic, "/")
    leaf = normalise_param(F.get(parts, F.lit(2)))
    named = (F.size(parts) == 3) & (F.get(parts, F.lit(0)) == prefix) & (leaf != TELEMETRY_LEAF.upper())
    return F.when(named, leaf).otherwise(F.lit(""))


def topic_matches(topic: Column, topic_filter: str) -> Column:
    """MQTT-style filter: ``+`` is one level, a final ``#`` is the rest."""
    levels = topic_filter.split("/")
    rest = levels[-1] == "#"
    wanted = [r"[^/]*" if level == "+" else re.escape(level) for level in (levels[:-1] if rest else levels)]
    pattern = "^" + "/".join(wanted)
    if rest:
        pattern += r"(/.*)?" if wanted else ".*"
    return topic.rlike("(?s)" + pattern + r"\z")


def message_kind(payload: Column) -> Column:
    """``telemetry``, ``json``, the scalar type name, or ``text/binary``."""
    value = F.try_parse_json(payload)
    kind = F.schema_of_variant(value)
    points = F.schema_of_variant(F.try_variant_get(value, "$.points", "variant"))
    return (
        F.when(value.isNull(), F.lit(KIND_TEXT))
        .when(F.startswith(kind, F.lit("OBJECT")) & F.startswith(points, F.lit("ARRAY")), F.lit(KIND_TELEMETRY))
        .when(F.startswith(kind, F.lit("OBJECT")) | F.startswith(kind, F.lit("ARRAY")), F.lit(KIND_JSON))
        .when(kind == "VOID", F.lit("object"))
        .when(kind == "STRING", F.lit("string"))
        .when(kind == "BOOLEAN", F.lit("boolean"))
        .otherwise(F.lit("number"))
    )


def _variant_text(value: Column) -> Column:
    """Strings as they are, anything else as JSON."""
    return F.when(F.schema_of_variant(value) == "STRING", value.cast("string")).otherwise(F.to_json(value))


def _member(members: Column, name: str | Column) -> Column:
    """A member that is present and not a JSON null."""
    found = F.element_at(members, name)
    return F.when(F.schema_of_variant(found) != "VOID", found)


def _point_fields(point: Column) -> Column:
    """Normalised name and value text of a point in any of its spellings."""

    def read(members: Column) -> Column:
        name = F.coalesce(*[_member(members, field) for field in POINT_NAME_FIELDS])
        value = F.coalesce(*[_member(members, field) for field in POINT_VALUE_FIELDS])
        name_text = F.when(F.schema_of_variant(name) == "STRING", normalise_param(name.cast("string")))
        return F.struct(name_text.alias("name"), _variant_text(value).alias("text"))

    return evaluated_once(F.try_variant_get(point, "$", "map<string,variant>"), read)


def message_fields(payload: Column) -> Column:
    """A message taken apart once: top-level members, ``data`` members, points.

    ``usable`` is false for text that is not JSON and for a JSON null.  Keep the result in a column of its own when several parameters are picked.
    """

    def take(value: Column) -> Column:
        return F.struct(
            F.coalesce(F.schema_of_variant(value) != "VOID", F.lit(False)).alias("usable"),
            F.try_variant_get(value, "$", "map<string,variant>").alias("top"),
            F.try_variant_get(value, "$.data", "map<string,variant>").alias("data"),
            F.transform(F.try_variant_get(value, "$.points", "array<variant>"), _point_fields).alias("points"),
        )

    return evaluated_once(F.try_parse_json(payload), take)


def pick_from(fields: Column, param_id: Column) -> Column:
    """Text of one parameter in a message taken apart by :func:`message_fields`.

    Looks at the top level, then inside ``data``, then through the points.
    """
    wanted = normalise_param(param_id)
    direct = F.coalesce(
        _member(fields["top"], wanted), _member(fields["top"], param_id), _member(fields["data"], wanted)
    )
    named = F.filter(fields["points"], lambda p: p["name"] == wanted)
    return F.coalesce(_variant_text(direct), F.get(named, F.lit(0))["text"], F.lit(MISSING_TEXT))


def pick_param_value(payload: Column, param_id: Column) -> Column:
    """Text of one parameter in a message of any of the known shapes."""
    return evaluated_once(message_fields(payload), lambda fields: pick_from(fields, param_id))
