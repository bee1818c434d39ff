"""Kafka-shaped records: topic, string key, string value (SNK-4, SNK-6, SNK-7)."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_JSON_OPTS = {"ignoreNullFields": "false"}


def to_kafka_string(events: DataFrame, topic: Column, key: Column, value: Column) -> DataFrame:
    """SNK-4: ``StringConverter`` records: (topic, key, value) as JSON text.

    Rows flagged ``is_tombstone`` (``operators.tombstones``) get a NULL value.

    Writing is ``records.writeStream.format("kafka")`` when the Kafka jar is on
    the classpath, or any file sink offline; the frame is the same.
    """
    text = F.to_json(value, _JSON_OPTS)
    if "is_tombstone" in events.columns:
        text = F.when(~F.col("is_tombstone"), text)
    return events.select(
        topic.alias("topic"),
        F.to_json(key, _JSON_OPTS).alias("key"),
        text.alias("value"),
    )


_CONNECT_TYPES = {
    T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32", T.LongType: "int64",
    T.FloatType: "float", T.DoubleType: "float64", T.BooleanType: "boolean", T.StringType: "string",
    T.BinaryType: "bytes",
}


def connect_schema(dt: T.DataType, name: str | None = None, optional: bool = True) -> dict:
    """The JSON converter's schema object for a Spark type (``schemas.enable=true``)."""
    if isinstance(dt, T.StructType):
        out = {
            "type": "struct",
            "fields": [dict(connect_schema(f.dataType, optional=f.nullable), field=f.name) for f in dt.fields],
            "optional": optional,
        }
        if name:
            out["name"] = name
        return out
    if isinstance(dt, T.ArrayType):
        return {"type": "array", "items": connect_schema(dt.elementType, optional=dt.containsNull),
                "optional": optional}
    if isinstance(dt, T.MapType):
        return {"type": "map", "keys": connect_schema(dt.keyType, optional=False),
                "values": connect_schema(dt.valueType, optional=dt.valueContainsNull), "optional": optional}
    if isinstance(dt, T.DecimalType):
        return {"type": "bytes", "optional": optional, "name": "org.apache.kafka.connect.data.Decimal",
                "version": 1, "parameters": {"scale": str(dt.scale)}}
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return {"type": "int64", "optional": optional, "name": "org.apache.kafka.connect.data.Timestamp",
                "version": 1}
    if isinstance(dt, T.DateType):
        return {"type": "int32", "optional": optional, "name": "org.apache.kafka.connect.data.Date", "version": 1}
    for cls, name_ in _CONNECT_TYPES.items():
        if isinstance(dt, cls):
            return {"type": name_, "optional": optional}
    raise TypeError(f"no converter type for {dt}")


def _connect_value(c: Column, dt: T.DataType) -> Column:
    """A value as the JSON converter writes its schema's type: decimals as base64 of the
    unscaled big-endian integer, timestamps as epoch milliseconds, dates as epoch days."""
    if isinstance(dt, T.DecimalType):
        if dt.precision > 18:
            raise TypeError("decimals of more than 18 digits have no encoding here")
        unscaled = (c * F.lit(10**dt.scale).cast("decimal(19,0)")).cast("bigint")
        digits = F.lpad(F.hex(unscaled), 16, "0")
        # The shortest two's-complement form: leading 00 (FF) bytes go while the sign bit stays.
        short = F.when(unscaled < 0, F.regexp_replace(digits, "^(?:FF)+(?=[89A-F][0-9A-F])", "")).otherwise(F.regexp_replace(digits, "^(?:00)+(?=[0-7][0-9A-F])", ""))
        return F.base64(F.unhex(short))
    if isinstance(dt, T.TimestampNTZType):
        return F.unix_millis(c.cast("timestamp"))
    if isinstance(dt, T.TimestampType):
        return F.unix_millis(c)
    if isinstance(dt, T.DateType):
        return F.unix_date(c)
    if isinstance(dt, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_connect_value(c.getField(f.name), f.dataType).alias(f.name) for f in dt.fields]))
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _connect_value(x, dt.elementType))
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda k, x: _connect_value(x, dt.valueType))
    return c


def json_with_schema(df: DataFrame, payload: list[str], name: str) -> Column:
    """SNK-6: value text ``{"schema": ..., "payload": ...}``.

    The schema part is derived once on the driver from the frame's type and
    enters the plan as a literal; only the payload is serialized per row, each
    value in the form that its schema entry names.
    """
    sub = df.select(*payload).schema
    schema_json = json.dumps(connect_schema(sub, name=name, optional=False), separators=(",", ":"))
    body = F.to_json(F.struct(*[_connect_value(F.col(f.name), f.dataType).alias(f.name) for f in sub.fields]), _JSON_OPTS)
    return F.concat(F.lit('{"schema":' + schema_json + ',"payload":'), body, F.lit("}"))


_AVRO_BAD = re.compile(r"[^A-Za-z0-9_]")


def avro_name(name: str) -> str:
    """An Avro-valid name: invalid characters become ``_``; a leading digit gets ``_``."""
    out = _AVRO_BAD.sub("_", name)
    return "_" + out if not out or out[0].isdigit() else out


def _avro_type(dt: T.DataType) -> T.DataType:
    if isinstance(dt, T.StructType):
        return T.StructType([T.StructField(n, _avro_type(f.dataType), f.nullable) for n, f in zip(_avro_names(dt.fieldNames()), dt.fields)])
    if isinstance(dt, T.ArrayType):
        return T.ArrayType(_avro_type(dt.elementType), dt.containsNull)
    if isinstance(dt, T.MapType):
        return T.MapType(dt.keyType, _avro_type(dt.valueType), dt.valueContainsNull)
    return dt


def _avro_names(names: list[str]) -> list[str]:
    out = [avro_name(n) for n in names]
    if len({n.lower() for n in out}) < len(out):
        raise ValueError(f"names collide as Avro names: {names}")
    return out


def avro_safe_names(df: DataFrame) -> DataFrame:
    """SNK-7: rename columns and nested fields to Avro-valid names (a projection).

    Two names that become one are an error.
    """
    cols = [F.col(f"`{f.name}`").cast(_avro_type(f.dataType)).alias(n) for n, f in zip(_avro_names(df.columns), df.schema.fields)]
    return df.select(*cols)
