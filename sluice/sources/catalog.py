"""Where collections come from: folders of Parquet tables, the versioned store, views, literal rows and system collections."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import PlanFault
from sluice.operators.frame import Frame
from sluice.plans.compiler import constant
from sluice.plans.parser import Source


def literal_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Literal objects as a frame; types are those of the values, whole and fractional numbers together are fractional."""
    names = list(dict.fromkeys(k for r in rows for k in r))
    schema = T.StructType([T.StructField(n, _type([r.get(n) for r in rows])) for n in names])
    return spark.createDataFrame([tuple(_fit(r.get(n), schema[n].dataType) for n in names) for r in rows], schema)


def _type(values: list) -> T.DataType:
    values = [v for v in values if v is not None]
    if not values:
        return T.StringType()
    if all(isinstance(v, bool) for v in values):
        return T.BooleanType()
    if all(isinstance(v, int) and not isinstance(v, bool) for v in values):
        return T.LongType() if all(-(1 << 63) <= v < 1 << 63 for v in values) else T.DecimalType(20, 0)
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in values):
        return T.DoubleType()
    if all(isinstance(v, list) for v in values):
        return T.ArrayType(_type([x for v in values for x in v]))
    if all(isinstance(v, dict) for v in values):
        names = list(dict.fromkeys(k for v in values for k in v))
        return T.StructType([T.StructField(n, _type([v.get(n) for v in values])) for n in names])
    return T.StringType()


def _fit(v, t: T.DataType):
    if v is None:
        return None
    if isinstance(t, T.DoubleType):
        return float(v)
    if isinstance(t, T.DecimalType):
        return Decimal(v)
    if isinstance(t, T.ArrayType):
        return [_fit(x, t.elementType) for x in v]
    if isinstance(t, T.StructType):
        return {f.name: _fit(v.get(f.name), f.dataType) for f in t.fields}
    return v if not isinstance(t, T.StringType) or isinstance(v, str) else str(v)


class Catalog:
    """Names to frames. ``tables`` maps names to DataFrames; ``root`` is a folder of <name>.parquet."""

    def __init__(self, spark: SparkSession, root: str | None = None, store=None, tables: dict[str, DataFrame] | None = None):
        self.spark, self.root, self.store = spark, root, store
        self.tables: dict[str, DataFrame] = dict(tables or {})
        self.views = None
        self.system: dict = {}
        self.scope: dict[str, object] = {}
        self._read: dict[str, tuple[tuple, DataFrame]] = {}
        self.touched: dict[str, tuple] = {}  # tables read, and the state of their files

    def source(self, spec: Source, planner) -> Frame:
        if spec.kind == "values":
            return Frame(literal_rows(self.spark, [constant(r, "values") for r in spec.rows]), spec.alias)
        if spec.kind == "view":
            return self._view(spec, planner)
        stored = self.store is not None and self.store.has(spec.name)
        if (spec.history or spec.as_of is not None) and not stored:
            raise PlanFault(f"{spec.name} keeps no history")
        moment = planner.moment if spec.as_of is None else spec.as_of
        if spec.history:
            df = self.store.history(spec.name)
        elif stored and moment is not None:
            df = self.store.as_of(spec.name, moment)
        else:
            df = self.table(spec.name)
        return Frame(self._scoped(df), spec.alias)

    def _scoped(self, df: DataFrame) -> DataFrame:
        """Row-level scope: a filter on every leaf, below all that the query does."""
        for name, value in self.scope.items():
            df = df.filter(F.col(name).eqNullSafe(F.lit(value))) if name in df.columns else df.filter(F.lit(False))
        return df

    def table(self, name: str) -> DataFrame:
        """A collection; one that nobody has written reads as empty."""
        if name in self.system:
            return self.system[name]()
        if name in self.tables:
            return self.tables[name]
        if self.store is not None and self.store.has(name):
            return self.store.current(name)
        if self.root is not None:
            path = f"{self.root}/{name}.parquet"
            state = self._state(path)
            if state is None:
                return self.spark.createDataFrame([], T.StructType([]))
            if name not in self._read or self._read[name][0] != state:
                self._read[name] = (state, self.spark.read.parquet(path))
            self.touched[path] = state
            return self._read[name][1]
        return self.spark.createDataFrame([], T.StructType([]))

    def _state(self, path: str) -> tuple | None:
        """What changes when a table's files change; None where there is none."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(p):
            return None
        content = fs.getContentSummary(p)
        return content.getLength(), content.getFileCount(), fs.getFileStatus(p).getModificationTime()

    def _view(self, spec: Source, planner) -> Frame:
        if self.views is None:
            raise PlanFault(f"unknown view {spec.name!r}")
        frame = self.views.frame(spec, planner)
        return Frame(frame.df.select(*[F.col(f"`{c}`") for c in frame.visible()]), spec.alias)
