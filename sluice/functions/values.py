"""Typed column values: a Spark column with its static type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import PlanFault

LONG, DOUBLE, STRING, BOOL, NULL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.NullType()
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.TimestampType, T.TimestampNTZType, T.DateType)


@dataclass
class Val:
    col: Column
    type: T.DataType
    const: object = None  # the Python value of a literal
    is_const: bool = False

    @property
    def kind(self) -> str:
        """null, bool, number, string, array, object or time."""
        t = self.type
        if isinstance(t, T.NullType):
            return "null"
        if isinstance(t, T.BooleanType):
            return "bool"
        if isinstance(t, T.NumericType):
            return "number"
        if isinstance(t, T.StringType):
            return "string"
        if isinstance(t, T.ArrayType):
            return "array"
        if isinstance(t, (T.StructType, T.MapType, T.VariantType)):
            return "object"
        if isinstance(t, _TIMES):
            return "time"
        return "string"

    @property
    def is_int(self) -> bool:
        return isinstance(self.type, _INTS)

    def double(self) -> Column:
        return self.col.cast("double")

    def number(self) -> Column:
        """Integers as long, all else as double."""
        return self.col.cast("long") if self.is_int else self.col.cast("double")

    def plain(self) -> Val:
        """The value with one of the language's own types."""
        if self.kind == "number" and self.type not in (LONG, DOUBLE):
            return Val(self.number(), LONG if self.is_int else DOUBLE, self.const, self.is_const)
        return self


def lit(value) -> Val:
    if value is None:
        return Val(F.lit(None), NULL, None, True)
    if isinstance(value, bool):
        return Val(F.lit(value), BOOL, value, True)
    if isinstance(value, int):
        return Val(F.lit(value).cast("long"), LONG, value, True)
    if isinstance(value, float):
        return Val(F.lit(value), DOUBLE, value, True)
    if isinstance(value, str):
        return Val(F.lit(value), STRING, value, True)
    raise PlanFault(f"no literal for {value!r}")


def common(vals: list[Val]) -> T.DataType:
    """The one type that several branches have; numbers widen to float."""
    types = [v.type for v in vals if v.kind != "null"]
    if not types:
        return NULL
    if all(isinstance(t, T.NumericType) for t in types):
        return LONG if all(isinstance(t, _INTS) for t in types) else DOUBLE
    first = types[0]
    if all(t.simpleString() == first.simpleString() for t in types):
        return first
    kinds = {Val(F.lit(1), t).kind for t in types}
    if len(kinds) == 1:
        return first
    raise PlanFault(f"branches of different kinds: {', '.join(sorted(kinds))}")


def as_type(v: Val, t: T.DataType) -> Column:
    return v.col if v.type.simpleString() == t.simpleString() else v.col.cast(t)


def millis(v: Val) -> Column:
    """Epoch milliseconds (UTC) of a timestamp column, of a number or of ISO text."""
    if v.kind == "time":
        return F.unix_millis(v.col.cast("timestamp"))
    if v.kind == "number":
        return v.col.cast("long")
    return F.unix_millis(F.to_timestamp(v.col))


def stamp(v: Val) -> Column:
    """A timestamp of whatever a date function accepts."""
    if v.kind == "time":
        return v.col.cast("timestamp")
    if v.kind == "number":
        return F.timestamp_millis(v.col.cast("long"))
    return F.to_timestamp(v.col)
