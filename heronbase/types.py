"""Column types: the dialect's names, Spark's types, and the names that results carry."""

from __future__ import annotations

import re

from pyspark.sql import types as T

#: The dialect's type names and what stores them.
_PLAIN = {
    **dict.fromkeys(("INT", "INTEGER"), T.IntegerType()),
    "BIGINT": T.LongType(), "SMALLINT": T.ShortType(), **dict.fromkeys(("TINYINT", "BYTEINT"), T.ByteType()),
    **dict.fromkeys(("FLOAT", "FLOAT8", "DOUBLE", "DOUBLE PRECISION"), T.DoubleType()),
    **dict.fromkeys(("FLOAT4", "REAL"), T.FloatType()),
    **dict.fromkeys(("VARCHAR", "CHAR", "CHARACTER", "STRING", "TEXT", "GEOGRAPHY", "GEOMETRY"), T.StringType()),
    "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIME": T.TimeType(6),
    **dict.fromkeys(("TIMESTAMP", "DATETIME", "TIMESTAMP_NTZ"), T.TimestampNTZType()),
    **dict.fromkeys(("TIMESTAMP_LTZ", "TIMESTAMP_TZ"), T.TimestampType()),
    **dict.fromkeys(("VARIANT", "OBJECT", "ARRAY"), T.VariantType()),
    **dict.fromkeys(("BINARY", "VARBINARY"), T.BinaryType()),
}
_DECIMAL = ("NUMBER", "NUMERIC", "DECIMAL")
NAMES = frozenset(_PLAIN) | frozenset(_DECIMAL)


def spark_type(name: str) -> T.DataType:
    """Spark's type for a type name with optional arguments; unknown names are strings."""
    m = re.fullmatch(r"\s*([A-Za-z_0-9 ]+?)\s*(?:\(([^)]*)\))?\s*", name)
    base, args = (m[1].upper(), m[2]) if m else (name.upper(), None)
    if base in _DECIMAL:
        numbers = [int(x) for x in (args or "38,0").split(",")]
        return T.DecimalType(numbers[0], numbers[1] if len(numbers) > 1 else 0)
    return _PLAIN.get(base, T.StringType())


def wire_name(kind: T.DataType) -> str:
    """The name that result metadata carries."""
    for types, name in (
        ((T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType), "NUMBER"),
        ((T.FloatType, T.DoubleType), "FLOAT"),
        ((T.TimestampNTZType,), "TIMESTAMP_NTZ"), ((T.TimestampType,), "TIMESTAMP_TZ"),
        ((T.DateType,), "DATE"), ((T.TimeType,), "TIME"), ((T.BooleanType,), "BOOLEAN"), ((T.BinaryType,), "BINARY"),
        ((T.VariantType,), "VARIANT"), ((T.ArrayType,), "ARRAY"), ((T.StructType, T.MapType), "OBJECT"),
    ):
        if isinstance(kind, types):
            return name
    return "TEXT"


def column_metadata(schema: T.StructType) -> list[dict]:
    out = []
    for f in schema:
        one = {"name": f.name, "type": wire_name(f.dataType), "nullable": f.nullable}
        if isinstance(f.dataType, T.DecimalType):
            one |= {"precision": f.dataType.precision, "scale": f.dataType.scale}
        elif one["type"] == "NUMBER":
            one |= {"precision": 38, "scale": 0}
        out.append(one)
    return out


def is_numeric(name: str) -> bool:
    return wire_name(spark_type(name)) in ("NUMBER", "FLOAT")


def is_string(name: str) -> bool:
    return name.split("(")[0].strip().upper() in ("VARCHAR", "CHAR", "CHARACTER", "STRING", "TEXT")


def is_temporal(name: str) -> bool:
    return isinstance(spark_type(name), (T.DateType, T.TimeType, T.TimestampType, T.TimestampNTZType))
