"""SQL type names of the supported dialect and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

_NAMES = {
    T.LongType: "INT INT64 INTEGER BIGINT",
    T.BooleanType: "BOOL BOOLEAN",
    T.DoubleType: "NUMERIC DECIMAL DOUBLE FLOAT FLOAT64",
    T.DateType: "DATE",
    T.StringType: "STRING VARCHAR CHAR TEXT",
    T.TimestampType: "TIMESTAMP DATETIME",
}
TYPES = {name: kind() for kind, names in _NAMES.items() for name in names.split()}
REJECTED = frozenset("BLOB ARRAY STRUCT MAP JSON TIME INTERVAL BYTES".split())


def sql_type(name: str) -> T.DataType:
    """Spark type of a column type name; lengths and precisions in brackets are ignored."""
    base = name.strip().upper().split("(")[0].strip()
    if base in TYPES:
        return TYPES[base]
    raise ValueError(f"unsupported column type: {name}")


def schema(columns: list[tuple[str, str]]) -> T.StructType:
    """Schema of (name, type name) pairs; every field may be null. Repeated names are an error."""
    seen = set()
    for name, _ in columns:
        if name.lower() in seen:
            raise ValueError(f"column given twice: {name}")
        seen.add(name.lower())
    return T.StructType([T.StructField(n, sql_type(t), True) for n, t in columns])
