"""Types: names, exact value contracts and call layouts."""

from __future__ import annotations

import hashlib
import json
import math
import struct

from pyspark.sql import types as T

SCALARS = {"bool": T.BooleanType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "bytes": T.BinaryType()}
_ALIASES = {"boolean": "bool", "utf8": "string", "str": "string", "large_string": "string", "int": "int32", "integer": "int32", "long": "int64", "bigint": "int64", "float": "float32", "double": "float64", "binary": "bytes"}
_INT_RANGE = {"int32": (-(2**31), 2**31 - 1), "int64": (-(2**63), 2**63 - 1)}


def canonical(name: str) -> str:
    name = name.strip().lower()
    if len(name.encode()) > 256:
        raise ValueError("type name is too long")
    return _ALIASES.get(name, name)


def to_spark(dtype: str | T.DataType) -> T.DataType:
    if isinstance(dtype, T.DataType):
        return dtype
    name = canonical(dtype)
    return SCALARS[name] if name in SCALARS else T._parse_datatype_string(dtype)


def name_of(dtype: T.DataType) -> str:
    for name, t in SCALARS.items():
        if type(t) is type(dtype):
            return name
    return dtype.simpleString()


def schema_document(schema: T.StructType, limit: int = 4096) -> str:
    """Canonical JSON of a schema, independent of the order of its fields; names appear as digests."""
    if len(schema) > limit:
        raise ValueError("too many fields")
    rows = sorted([hashlib.sha256(f.name.encode()).hexdigest(), name_of(f.dataType)] for f in schema)
    return json.dumps({"fields": [{"name": n, "type": t} for n, t in rows]}, sort_keys=True, separators=(",", ":"))


def schema_digest(schema: T.StructType) -> str:
    return hashlib.sha256(schema_document(schema).encode()).hexdigest()


def normalize_scalar(value, dtype: str, nullable: bool = True):
    """The value as the type holds it. Only exact Python types are taken: no bool for an int, no int for a float."""
    if value is None:
        if nullable:
            return None
        raise TypeError(f"{dtype} is not nullable")
    want = {"bool": bool, "int32": int, "int64": int, "float32": float, "float64": float, "string": str, "bytes": bytes}.get(dtype)
    if want is None:
        return value
    if type(value) is not want:
        raise TypeError(f"{dtype} takes {want.__name__}, not {type(value).__name__}")
    if dtype in _INT_RANGE:
        low, high = _INT_RANGE[dtype]
        if not low <= value <= high:
            raise OverflowError(f"{value} is out of range for {dtype}")
    if dtype == "float32" and math.isfinite(value):
        return struct.unpack("<f", struct.pack("<f", value))[0]  # raises OverflowError itself
    return value


def layout(arguments: list[T.DataType], result: T.DataType) -> str:
    """scalar_slot, exact_unicode or python_object."""
    slots = {"bool", "int32", "int64", "float32", "float64"}
    if len(arguments) == 1:
        a, r = name_of(arguments[0]), name_of(result)
        if a in slots and r in slots:
            return "scalar_slot"
        if a == "string" and r in {"bool", "int64", "float64", "string"}:
            return "exact_unicode"
    return "python_object"
