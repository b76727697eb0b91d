"""Order, bounds, samples and duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sluice.errors import PlanFault
from sluice.operators import rowlocal
from sluice.operators.frame import HIDDEN, Frame
from sluice.plans.compiler import compiled, constant, quoted
from sluice.plans.expression import Lit, Path


def sort(f: Frame, args: dict, keep: bool) -> Frame:
    """``keep``: a later stage needs to know the order, so the keys stay as hidden columns."""
    df, order, columns = f.df, [], []
    level = len([c for c in f.hidden() if c.startswith(f"{HIDDEN}s")])
    for i, k in enumerate(args["keys"]):
        e = k["expr"]
        v = compiled(Path(e.parts, True) if isinstance(e, Path) else e, f.scope)
        c = v.col
        if keep or f.per:
            name = f"{HIDDEN}s{level + i}"
            df = df.withColumn(name, c)
            order.append((name, k["desc"]))
            c = F.col(name)
        columns.append(c.desc_nulls_last() if k["desc"] else c.asc_nulls_first())
    if f.per:
        return f.of(df, order=(*order, *f.order), keys=(), sorted=True)
    ties = f.ordering() if keep else []
    return f.of(df.orderBy(*columns, *ties), order=(*order, *f.order) if keep else (), keys=(), sorted=True, scattered=False)


def _count(args: dict, what: str) -> int:
    n = constant(args["n"], what)
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise PlanFault(f"{what}: a whole number is expected")
    return n


def arranged(f: Frame) -> Frame:
    """Groups come in the byte order of their keys, first rows in that of all rows: only a bound makes that matter."""
    if f.scattered or f.keys and not f.sorted:
        order = f.ordering()
        if order:
            return f.of(f.df.orderBy(*order), keys=(), sorted=True, scattered=False)
    return f


def ranked(f: Frame, name: str) -> Frame:
    """Numbers rows from 1 for each outer row of a lookup."""
    order = f.ordering() or [F.lit(0)]
    w = Window.partitionBy(*map(quoted, f.per)).orderBy(*order)
    return f.of(f.df.withColumn(name, F.row_number().over(w)))


def limit(f: Frame, args: dict) -> Frame:
    n = _count(args, "limit")
    if f.per:
        r = ranked(f, f"{HIDDEN}rank")
        return r.of(r.df.filter(F.col(f"{HIDDEN}rank") <= n).drop(f"{HIDDEN}rank"))
    f = arranged(f)
    return f.of(f.df.limit(n))


def skip(f: Frame, args: dict) -> Frame:
    n = _count(args, "skip")
    if f.per:
        r = ranked(f, f"{HIDDEN}rank")
        return r.of(r.df.filter(F.col(f"{HIDDEN}rank") > n).drop(f"{HIDDEN}rank"))
    f = arranged(f)
    return f.of(f.df.offset(n))


def _projected(f: Frame, path) -> Frame:
    return f if path is None else rowlocal.select(f, {"items": [{"expr": path, "alias": None}]})


def first(f: Frame, args: dict) -> Frame:
    return _projected(limit(f, {"n": Lit(1)}), args["path"])


def single(f: Frame, args: dict) -> Frame:
    """The only row; none or several are an error when the query runs."""
    if f.per:
        raise PlanFault("single is not allowed inside a lookup")
    names = f.visible()
    held = f.df.limit(2).select(F.struct(*map(quoted, names)).alias("r"))
    one = held.agg(F.count(F.lit(1)).alias("n"), F.first("r").alias("r"))
    checked = F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(F.lit("single: exactly one row is expected")).cast(one.schema["r"].dataType))
    return _projected(f.of(one.select(checked.alias("r")).select("r.*"), order=(), keys=()), args["path"])


def sample(f: Frame, args: dict, seed: int | None) -> Frame:
    n = _count(args, "sample")
    rand = F.rand() if seed is None else F.rand(seed)
    if f.per:
        df = f.df.withColumn(f"{HIDDEN}rand", rand)
        return limit(f.of(df, order=((f"{HIDDEN}rand", False),), keys=()), args)
    return f.of(f.df.orderBy(rand).limit(n), order=(), keys=(), sorted=False)


def distinct(f: Frame, args: dict) -> Frame:
    """Whole rows, or the first full row of each key in the input's order.

    Spark passes on one row a key and task (WindowGroupLimit), so a hot key is small when it is shuffled.
    """
    if not args["paths"]:
        names = [*f.visible(), *f.per]
        return f.of(f.df.select(*map(quoted, names)).distinct(), order=(), keys=(), sorted=False)
    keys = [compiled(Path(p.parts, True), f.scope).col for p in args["paths"]]
    w = Window.partitionBy(*map(quoted, f.per), *keys).orderBy(*(f.ordering() or [F.lit(0)]))
    rank = f"{HIDDEN}rank"
    return f.of(f.df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) == 1).drop(rank), scattered=bool(f.order), sorted=False)


def count(f: Frame, args: dict) -> Frame:
    if f.per:
        raise PlanFault("count ends a query; it is not allowed inside a lookup")
    return f.of(f.df.agg(F.count(F.lit(1)).alias(args["alias"])), order=(), keys=())
