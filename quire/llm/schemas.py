"""Output schemas of the Arrow operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of ``df`` with the fields of ``ddl`` after its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])
