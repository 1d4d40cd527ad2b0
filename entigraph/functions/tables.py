"""Functions that return tables, for SQL: their columns follow from their arguments."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import SkipRestOfInputTableException


@udtf
class FirstRows:
    """``first_rows(TABLE(t) PARTITION BY .. ORDER BY .., n => 3)``: the first rows of each partition, with their place.

    Any table goes; the result has its columns and ``place``.  A partition is read no further than its last row that counts."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, n: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("first_rows takes a table, then n")
        if not n.isConstantExpression or n.value is None or n.value < 1:
            raise ValueError("n has to be a constant of 1 or more")
        if "place" in (f.name.lower() for f in rows.dataType.fields):
            raise ValueError("the table has a column named place")
        return AnalyzeResult(schema=StructType([*rows.dataType.fields]).add("place", IntegerType()))

    def __init__(self) -> None:
        self.place = 0

    def eval(self, rows: Any, n: int) -> Any:
        if self.place >= n:
            raise SkipRestOfInputTableException("the rest does not count")
        self.place += 1
        yield (*rows, self.place)


@udtf
class Permissions:
    """``permissions_of(TABLE(grants) PARTITION BY user_id)``: the distinct resources and actions of names like ``resource:action``
    in the last column of each row, once a partition, in order, with the columns before it."""

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or len(rows.dataType.fields) < 2:
            raise ValueError("permissions_of takes a table whose last column names a permission")
        return AnalyzeResult(schema=StructType(rows.dataType.fields[:-1]).add("resource", "string").add("action", "string"))

    def __init__(self) -> None:
        self.found: set[tuple] = set()

    def eval(self, rows: Any) -> None:
        *own, name = rows
        if name is not None:
            resource, _, action = name.partition(":")
            self.found.add((*own, resource, action))

    def terminate(self) -> Any:
        yield from sorted(self.found, key=str)


def register(spark: SparkSession) -> None:
    spark.udtf.register("first_rows", FirstRows)
    spark.udtf.register("permissions_of", Permissions)
