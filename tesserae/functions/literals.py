"""Parsing of one-dict-literal-per-line text into declared Spark columns.

The lines are Python literals, not JSON: ``None``, ``True``, ``u'x'`` and ``\\xa0`` are valid and
``null``, ``true`` and trailing text are not, so ``from_json`` would keep and drop other rows.
"""

from __future__ import annotations

import ast
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_BAD_LINE = (ValueError, SyntaxError, TypeError, RecursionError, MemoryError)
_BAD_CAST = (ValueError, TypeError, OverflowError)
_LONG = 2**63
_OWN = {T.StringType: str, T.DoubleType: float, T.LongType: int}
# Outside of strings JSON reads these words, which are no literals; the escapes mean other things there.
_OTHER_IN_JSON = re.compile(r"true|false|null|\\[u/]")
# Python's parser has a limit of depth, far above this number of brackets.
_BRACKETS = 50


def as_text(value) -> str | None:
    """A scalar or nested value as text; nested values are joined by spaces."""
    if value is None or isinstance(value, str):
        return value
    if isinstance(value, dict):
        value = list(value.values())
    if isinstance(value, (list, tuple, set)):
        return " ".join((as_text(v) or "").strip() for v in value)
    return str(value)


def convert(value, dtype: T.DataType):
    """The value in the declared type; null when it has none."""
    if value is None:
        return None
    try:
        if isinstance(dtype, T.StringType):
            return as_text(value)
        if isinstance(dtype, T.DoubleType):
            return float(value)
        if isinstance(dtype, T.LongType):
            number = int(value)
            return number if -_LONG <= number < _LONG else None
        if isinstance(dtype, T.ArrayType):
            listed = value if isinstance(value, (list, tuple)) else [value]
            return [convert(v, dtype.elementType) for v in listed]
    except _BAD_CAST:
        return None
    raise TypeError(f"undeclarable field type {dtype}")


def converted(values: list, dtype: T.DataType) -> list:
    """The values in the declared type; a list that has this type already is returned unchanged."""
    own = _OWN.get(type(dtype))
    if own and set(map(type, values)) <= {own, type(None)}:
        if own is not int or all(-_LONG <= v < _LONG for v in values if v is not None):
            return values
    return [convert(v, dtype) for v in values]


def _no_constant(name: str):
    raise ValueError(f"{name} is no literal")


def json_reader():
    """Reads a JSON value at the start of a text; made once per task, as it cannot travel with the job."""
    return json.JSONDecoder(parse_constant=_no_constant).raw_decode


def _from_json(text: str, read):
    """The value of a text that means the same in JSON, once quotes are double; None if it may not.

    JSON is read many times faster. What its reader takes is also a Python literal of the same value, but
    for the words and escapes above, ``NaN`` and the like, and nesting beyond Python's limit.
    """
    if '"' not in text:
        if "\\'" in text:
            return None
        text = text.replace("'", '"')
    if text.count("{") + text.count("[") > _BRACKETS or _OTHER_IN_JSON.search(text):
        return None
    try:
        value, end = read(text)
    except (ValueError, RecursionError):
        return None
    return value if end == len(text) else None


def parse_literal(line: bytes | None, read=None) -> dict | None:
    """The dict on the line, or None; undecodable bytes are ignored."""
    text = (line or b"").decode("utf-8", "ignore").strip()
    if not text:
        return None
    record = _from_json(text, read or json_reader())
    if record is not None:
        return record if isinstance(record, dict) else None
    try:
        record = ast.literal_eval(text)
    except _BAD_LINE:
        return None
    return record if isinstance(record, dict) else None


def parse_lines(lines: DataFrame, fields: T.StructType, line: str = "line") -> DataFrame:
    """Replaces the binary column ``line`` by the declared fields; other lines are dropped."""
    kept = [c for c in lines.columns if c != line]
    schema = T.StructType([lines.schema[c] for c in kept] + fields.fields)

    def parse(batches):
        read = json_reader()
        for batch in batches:
            records = [parse_literal(x, read) for x in batch.column(line).to_pylist()]
            good = [i for i, r in enumerate(records) if r is not None]
            columns = [batch.column(c) for c in kept]
            if len(good) < len(records):
                columns = [c.take(pa.array(good, pa.int64())) for c in columns]
                records = [records[i] for i in good]
            for field in fields.fields:
                values = converted([r.get(field.name) for r in records], field.dataType)
                columns.append(pa.array(values, to_arrow_type(field.dataType)))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return lines.mapInArrow(parse, schema)
