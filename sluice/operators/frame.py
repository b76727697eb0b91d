"""A frame: a lazy DataFrame with what the language knows of it besides."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.plans.compiler import Scope, quoted

#: Hidden columns begin with this.
HIDDEN = "__s_"


@dataclass(frozen=True)
class Frame:
    """``order``: hidden columns and directions of the order that rows are in; ``keys``: columns whose order groups come in;
    ``per``: hidden columns that tell the outer rows of a lookup apart, so that blocking stages run for each of them."""

    df: DataFrame
    alias: str | None = None
    order: tuple[tuple[str, bool], ...] = ()
    keys: tuple[str, ...] = ()
    per: tuple[str, ...] = ()
    outer: dict = field(default_factory=dict)
    outer_aliases: frozenset = frozenset()
    sorted: bool = False
    scattered: bool = False  # rows have an order but no longer stand in it

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def scope(self) -> Scope:
        return Scope(self.df.schema, self.alias, self.outer, self.outer_aliases)

    def visible(self) -> list[str]:
        return [c for c in self.df.columns if not c.startswith(HIDDEN)]

    def hidden(self) -> list[str]:
        return [c for c in self.df.columns if c.startswith(HIDDEN)]

    def of(self, df: DataFrame, **changes) -> Frame:
        return replace(self, df=df, **changes)

    def rank(self) -> Column | None:
        """A value that rises along the frame's order, for ``min_by`` and ``max_by``; None without an order, or one that no value tells."""
        parts = []
        for name, desc in self.order:
            c, t = F.col(quoted(name)), self.df.schema[name].dataType
            if not desc:
                parts.append(c)
                continue
            if isinstance(t, T.IntegralType):
                down = F.bitwise_not(c)
            elif isinstance(t, T.NumericType):
                down = -c
            elif isinstance(t, T.BooleanType):
                down = ~c
            elif isinstance(t, T.TimestampNTZType):
                down = -F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)
            elif isinstance(t, T.TimestampType):
                down = -F.unix_micros(c)
            elif isinstance(t, T.DateType):
                down = -F.unix_date(c)
            else:
                return None
            parts += [c.isNull(), down]
        return F.struct(*[p.alias(f"c{i}") for i, p in enumerate(parts)]) if parts else None

    def ordering(self) -> list[Column]:
        """Sort expressions for the frame's order, or for the byte order of group keys."""
        if self.order:
            return [F.col(quoted(c)).desc_nulls_last() if desc else F.col(quoted(c)).asc_nulls_first() for c, desc in self.order]
        out = []
        for k in self.keys:
            if k in self.df.columns:
                c, t = F.col(quoted(k)), self.df.schema[k].dataType
                if isinstance(t, T.StringType):
                    out += [F.octet_length(c), c]
                elif isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
                    out += [c < 0, c]
                else:
                    out.append(c)
        return out
