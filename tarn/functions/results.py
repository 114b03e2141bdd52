"""Results as JSON lines and back, with their types checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Microseconds and the offset, so that no timestamp loses anything.
_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def to_lines(rows: DataFrame) -> DataFrame:
    """(line): each row as a JSON object; fields that are null are there as null."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", **_TIME}).alias("line"))


def parsed(line: Column, schema: str | StructType, required: Sequence[str], what: str) -> Column:
    """The struct that a JSON object stands for. The job fails where the text is null, no object, or has no
    value of the right type for one of the ``required`` fields; fields that the schema does not name are
    left out, others that are missing are null."""
    value = F.from_json(line, schema, {"mode": "PERMISSIVE", **_TIME})
    whole = F.coalesce(F.ltrim(line).startswith("{"), F.lit(False))
    for field in required:
        whole = whole & value[field].isNotNull()
    return F.when(whole, value).otherwise(F.raise_error(F.concat(F.lit(f"stored {what} is invalid: "), F.coalesce(F.substring(line, 1, 200), F.lit("null")))))


def from_lines(lines: DataFrame, schema: str | StructType, required: Sequence[str] | None = None, what: str = "result") -> DataFrame:
    """The rows of ``to_lines`` (column ``line``), with these types. Without ``required`` every field that a
    StructType says is never null is required, of DDL text those marked NOT NULL."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    required = [f.name for f in fields if not f.nullable] if required is None else required
    return lines.select(parsed(F.col("line"), fields, required, what).alias("value")).select(*(F.col("value")[f.name].alias(f.name) for f in fields))
