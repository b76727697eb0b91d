"""window and fill."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.errors import PlanFault
from sluice.functions import scalar
from sluice.functions.values import lit, stamp
from sluice.operators.frame import HIDDEN, Frame
from sluice.operators.rowlocal import put, stripped
from sluice.plans.compiler import compiled, constant, quoted
from sluice.plans.expression import Path

#: Most values that one grid holds: a fixed value of the language.
GRID = 100_000


def window(f: Frame, args: dict) -> Frame:
    """Functions over partitions, each a column; a later one may read an earlier one. Rows come out by partition and order."""
    partition = [compiled(Path(p.parts, True), f.scope).col for p in args["partition"]]
    keys = []
    for k in args["order"]:
        e = k["expr"]
        c = compiled(Path(e.parts, True) if isinstance(e, Path) else e, f.scope).col
        keys.append(c.desc_nulls_last() if k["desc"] else c.asc_nulls_first())
    per = [F.col(quoted(p)) for p in f.per]
    w = Window.partitionBy(*per, *partition).orderBy(*keys, *f.ordering())
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = f.df
    for fn in args["functions"]:
        v = None if fn["path"] is None else compiled(fn["path"], f.of(df).scope)
        name = fn["fn"]
        if name == "row_number":
            c = F.row_number().over(w).cast("long")
        elif name in ("lag", "lead"):
            if fn["n"] < 1:
                raise PlanFault(f"{name}: at least one row")
            c = (F.lag if name == "lag" else F.lead)(v.col, fn["n"]).over(w)
        elif name == "cumsum":
            c = F.sum(v.col if v.kind == "number" else F.lit(None).cast("double")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        else:
            c = (F.first if name == "first" else F.last)(v.col).over(whole)
        df = df.withColumn(fn["alias"], c)
    if not f.per:
        df = df.orderBy(*[p.asc_nulls_first() for p in partition], *keys, *f.ordering())
    return f.of(df, keys=(), sorted=True)


def fill(f: Frame, args: dict) -> Frame:
    """The grid values that a partition lacks, as new rows: a grid per partition, without those that are there."""
    start, stop, step = (constant(args[k], "fill") for k in ("start", "stop", "step"))
    name = stripped(args["path"], f.alias, f.df.columns)
    v = compiled(args["path"], f.scope)
    by = [(stripped(p, f.alias, f.df.columns), compiled(p, f.scope)) for p in args["by"]]
    grid = _grid(start, stop, step, v)
    hold = {f"__s_b{i}": b.col for i, (_, b) in enumerate(by)}
    df = f.df.withColumns(hold) if hold else f.df
    parts = df.select(*hold).distinct() if hold else df.limit(1).select(F.lit(1).alias("__s_one"))
    wanted = parts.withColumn("__s_v", F.explode(grid))
    have = df.select(*[F.col(h).alias(f"{h}h") for h in hold], v.col.cast(wanted.schema["__s_v"].dataType).alias("__s_vh"))
    same = F.col("__s_v").eqNullSafe(F.col("__s_vh"))
    for h in hold:
        same = same & F.col(h).eqNullSafe(F.col(f"{h}h"))
    new = wanted.join(have, same, "left_anti")
    new = put(new, name, type(v)(F.col("__s_v").cast(v.type), v.type))
    for (target, b), h in zip(by, hold, strict=True):
        new = put(new, target, type(b)(F.col(h), b.type))
    for target, e in args["with"]:
        parts_ = stripped(target, f.alias, f.df.columns)
        value = compiled(e, f.scope)
        held = f.scope.find(Path(parts_))
        new = put(new, parts_, type(value)(value.col.cast(held.type), held.type) if held is not None else value)
    new = new.select(*[c for c in new.columns if not c.startswith(HIDDEN)])
    out = f.df.select(*map(quoted, f.visible())).unionByName(new, allowMissingColumns=True)
    scope = f.of(out).scope
    order = [compiled(Path(t), scope).col.asc_nulls_first() for t, _ in by] + [compiled(Path(name), scope).col.asc_nulls_first()]
    return f.of(out.orderBy(*order), order=(), keys=(), sorted=True)


def _grid(start, stop, step, v):
    """The array of grid values, written as ``start`` is."""
    if isinstance(step, (int, float)) and not isinstance(step, bool):
        if step <= 0:
            raise PlanFault("fill: the step must be positive")
        n = int((stop - start) / step + 1e-9) + 1 if stop >= start else 0
        if n > GRID:
            raise PlanFault("fill: the grid has more than 100000 values")
        if n <= 0:
            return F.array().cast("array<double>")
        kind = "long" if all(isinstance(x, int) for x in (start, step)) else "double"
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.lit(start) + i * F.lit(step)).cast(kind))
    u = scalar.unit(lit(step))
    a, b = stamp(lit(start)), stamp(lit(stop))
    length = (scalar.ordinal(b, u) - scalar.ordinal(a, u)).cast("int")
    times = F.filter(F.transform(F.sequence(F.lit(0), F.greatest(length, F.lit(0))), lambda i: scalar.added(a, i, u)), lambda t: t <= b)
    if v.kind == "time":
        return times
    if isinstance(start, int):
        return F.transform(times, F.unix_millis)
    pattern = {4: "yyyy", 7: "yyyy-MM", 10: "yyyy-MM-dd"}.get(len(start), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.transform(times, lambda t: F.date_format(t, pattern))


