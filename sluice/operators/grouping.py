"""group, bucket and pivot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.errors import PlanFault
from sluice.functions.values import Val
from sluice.operators import rowlocal
from sluice.operators.frame import HIDDEN, Frame
from sluice.plans.compiler import compiled, quoted, summable
from sluice.plans.expression import Call, Path
from sluice.plans.parser import last

#: Measures whose result depends on the order of rows.
ORDERED = ("first", "last", "list")

#: Measures that need the order of a group's values.
QUANTILES = ("median", "percentile")

#: Columns that a pivot may make: their labels come to the driver.
LABELS = 10_000

#: Rank error of a quantile's first estimate is one in this many rows at most.
ACCURACY = 10_000

#: Values beyond which a group is large: only the bounds of large groups are broadcast, at most one for so many rows.
LARGE = 100_000


def _key(item, f: Frame) -> tuple[str, Val]:
    e = item["expr"]
    v = compiled(e, f.scope)
    return (item["alias"] or last(e)), v


def group(f: Frame, args: dict, certain: bool) -> Frame:
    """``certain``: the stages before leave field kinds known, so numbers are told from keys by the schema."""
    if args["form"] == "compound":
        measures = args["measures"] or [_counting()]
        return aggregate(f, [_key(i, f) for i in args["by"]], measures)
    items = args["items"]
    if len(items) == 1:
        return aggregate(f, [_key(items[0], f)], [_counting()])
    later = items[1:]
    known = [summable(i["expr"], f.scope) if certain and not (isinstance(i["expr"], Path) and len(i["expr"].parts) > 1 and i["expr"].parts[0] != f.alias) else None for i in later]
    if None in known:
        known = [False] * (len(later) - 1) + [True]
    keys = [items[0], *(i for i, s in zip(later, known, strict=True) if not s)]
    sums = [i for i, s in zip(later, known, strict=True) if s]
    measures = [{**_counting(), "fn": "sum", "expr": i["expr"], "alias": i["alias"] or last(i["expr"])} for i in sums] or [_counting()]
    return aggregate(f, [_key(i, f) for i in keys], measures)


def _counting() -> dict:
    return {"fn": "count", "expr": None, "by": None, "where": None, "fraction": None, "alias": "count"}


def _ranked(f: Frame, rank: str, keys: list):
    """The frame's rows with a value that tells their order within a group; only an order that no value tells needs a window."""
    found, order = f.rank(), f.ordering()
    if found is None:
        found = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) if order else F.monotonically_increasing_id()
    return f.df.withColumn(rank, found)


def aggregate(f: Frame, keys: list[tuple[str, Val]], measures: list[dict]) -> Frame:
    """Keys and measures. First, last and list follow the input's order, which a rank within each group carries."""
    per = list(f.per)
    named = [(n, v.col) for n, v in keys]
    made = [*(n.split(".")[0] for n, _ in named if "." not in n), *(m["alias"] for m in measures)]
    if len(set(made)) < len(made):
        raise PlanFault(f"group: {next(n for n in made if made.count(n) > 1)} is made twice")
    df = f.df
    hold = {f"{HIDDEN}k{i}": c for i, (_, c) in enumerate(named)}
    df = df.withColumns(hold) if hold else df
    scope = f.of(df).scope
    rank = None
    if any(m["fn"] in ORDERED for m in measures):
        rank = f"{HIDDEN}ord"
        df = _ranked(f.of(df), rank, [*map(quoted, per), *hold])
    by = [*per, *hold]
    quantiles = [(m["alias"], _number(m, scope), 0.5 if m["fn"] == "median" else float(m["fraction"])) for m in measures if m["fn"] in QUANTILES]
    columns = [measure(m, scope, rank).alias(m["alias"]) for m in measures if m["fn"] not in QUANTILES]
    grouped = _with_quantiles(df, by, columns, quantiles) if quantiles else df.groupBy(*map(quoted, by)).agg(*columns)
    out = [F.col(quoted(p)) for p in per]
    nested: dict[str, list] = {}
    for i, (n, _) in enumerate(named):
        parts = n.split(".")
        if len(parts) > 1:
            nested.setdefault(parts[0], []).append((tuple(parts[1:]), f"{HIDDEN}k{i}"))
        else:
            out.append(F.col(f"{HIDDEN}k{i}").alias(n))
    out += [rowlocal._object(v).alias(n) for n, v in nested.items()]
    out += [F.col(quoted(m["alias"])) for m in measures]
    return f.of(grouped.select(*out), order=(), keys=tuple(n for n, _ in named if "." not in n), sorted=False, scattered=False)


def _number(m: dict, scope):
    """A measure's value as a double; null where its condition does not hold."""
    v = compiled(m["expr"], scope)
    col = v.col if v.kind in ("number", "null") else F.lit(None)
    return (col if m["where"] is None else F.when(compiled(m["where"], scope).col, col)).cast("double")


def _with_quantiles(df: DataFrame, by: list[str], columns: list, quantiles: list) -> DataFrame:
    """Other measures and exact quantiles (name, value, fraction), with no group's values in one task.

    The first pass has a sketch of each group, which bounds the values that a quantile can lie at. The second counts: values
    below the bounds and beyond them are one row each a group and task before they move, only those between are told apart, so
    that a running count over them finds the two ranks. The row next to the bounds is kept on either side; the bounds are eight
    times as far apart as the sketch's error, and a rank outside them is an error, never another value. Bounds go to the rows,
    since a join by the group's key would sort all of its rows in one task. Small groups have none: their values are few.
    """
    one = f"{HIDDEN}one"
    margin = 8 / ACCURACY
    df = df.withColumns({one: F.lit(1), **{f"{HIDDEN}v{i}": v for i, (_, v, _) in enumerate(quantiles)}})
    sketches = []
    for i, (_, _, p) in enumerate(quantiles):
        v = F.col(f"{HIDDEN}v{i}")
        ends = F.percentile_approx(v, [max(0.0, p - margin), min(1.0, p + margin)], ACCURACY)
        sketches += [ends.alias(f"{HIDDEN}e{i}"), F.count(v).alias(f"{HIDDEN}n{i}")]
    first = df.groupBy(*map(quoted, by)).agg(*columns, *sketches).withColumn(one, F.lit(1))
    keys = [one, *by]
    other = [f"{HIDDEN}b{j}" for j in range(len(keys))]
    same = reduce(lambda x, y: x & y, [F.col(quoted(k)).eqNullSafe(F.col(o)) for k, o in zip(keys, other, strict=True)])
    renamed = [F.col(quoted(k)).alias(o) for k, o in zip(keys, other, strict=True)]
    found = range(len(quantiles))
    large = reduce(lambda x, y: x | y, [F.col(f"{HIDDEN}n{i}") > LARGE for i in found])
    bounds = F.broadcast(first.filter(large).select(*renamed, *[f"{HIDDEN}e{i}" for i in found]))
    asked = F.array(*[
        F.struct(F.lit(i).alias("m"), F.col(f"{HIDDEN}v{i}").alias("v"), F.col(f"{HIDDEN}e{i}")[0].alias("lo"), F.col(f"{HIDDEN}e{i}")[1].alias("hi"))
        for i in found
    ])
    values = df.select(*map(quoted, keys), *[f"{HIDDEN}v{i}" for i in found]).join(bounds, same, "left").select(*renamed, F.explode(asked).alias("q"))
    side = F.when(F.col("q.v") < F.col("q.lo"), -1).when(F.col("q.v") > F.col("q.hi"), 1).otherwise(0)
    values = values.filter("q.v is not null").select(*other, "q.m", side.alias("side"), "q.v")
    counted = values.groupBy(*other, "m", "side", F.when(F.col("side") == 0, F.col("v")).alias("x"))
    counted = counted.agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
    ordered = Window.partitionBy(*other, "m").orderBy("side", "x")
    running, whole = (ordered.rowsBetween(Window.unboundedPreceding, end) for end in (0, Window.unboundedFollowing))
    at = F.array(*[F.lit(p) for _, _, p in quantiles])[F.col("m")] * (F.sum("c").over(whole) - 1)
    counted = counted.withColumns({"upto": F.sum("c").over(running), "at": at})

    def ranked(rank):
        """The value at a rank, counted from 0, in the row that holds it."""
        far = ((F.col("side") < 0) & (rank < F.col("upto") - 1)) | ((F.col("side") > 0) & (rank > F.col("upto") - F.col("c")))
        value = F.when(far, F.raise_error(F.lit("quantile: outside its bounds"))).when(F.col("side") < 0, F.col("most")).otherwise(F.col("least"))
        return F.when((rank >= F.col("upto") - F.col("c")) & (rank < F.col("upto")), value)

    low, high = F.floor("at"), F.ceil("at")
    counted = counted.select(*other, "m", "at", ranked(low).alias("low"), ranked(high).alias("high"))
    picked = counted.groupBy(*other, "m", "at").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    value = F.when(low == high, F.col("low")).otherwise((high - F.col("at")) * F.col("low") + (F.col("at") - low) * F.col("high"))
    picked = picked.groupBy(*other).agg(*[F.max(F.when(F.col("m") == i, value)).alias(f"{HIDDEN}q{i}") for i in found])
    named = [F.col(f"{HIDDEN}q{i}").alias(name) for i, (name, _, _) in enumerate(quantiles)]
    return first.join(picked, same, "left").select(*[F.col(quoted(c)) for c in first.columns], *named)


def measure(m: dict, scope, rank: str | None):
    """One aggregate column."""
    fn = m["fn"]
    p = None if m["where"] is None else compiled(m["where"], scope).col
    v = None if m["expr"] is None else compiled(m["expr"], scope)
    if v is None:
        return F.count(F.lit(1)) if p is None else F.count(F.when(p, 1))
    col = v.col if p is None else F.when(p, v.col)
    if fn in ("sum", "avg", "median", "percentile", "stddev") and v.kind not in ("number", "null"):
        col = F.lit(None).cast("double")
    if fn == "sum":
        return F.sum(col)
    if fn == "avg":
        return F.avg(col.cast("double"))
    if fn == "count":
        return F.count(col)
    if fn in ("min", "max"):
        return F.min(col) if fn == "min" else F.max(col)
    if fn == "median":
        return F.median(col.cast("double"))
    if fn == "percentile":
        return F.percentile(col.cast("double"), F.lit(float(m["fraction"])))
    if fn == "stddev":
        return F.stddev_samp(col.cast("double"))
    at = F.col(rank)
    if fn == "list":
        return F.transform(F.array_sort(F.collect_list(F.when(col.isNotNull(), F.struct(at.alias("o"), col.alias("v"))))), lambda x: x["v"])
    boxed = F.struct(v.col.alias("v"))
    if m["by"] is None:
        picked = F.min_by(boxed, at) if fn == "first" else F.max_by(boxed, at)
    else:
        o = compiled(m["by"], scope).col
        usable = o.isNotNull() if p is None else o.isNotNull() & p
        by = F.when(usable, F.struct(o.alias("o"), at.alias("i")))
        picked = F.min_by(F.when(usable, boxed), by) if fn == "first" else F.max_by(F.when(usable, boxed), by)
    return picked.getField("v")


def bucket(f: Frame, args: dict) -> Frame:
    v = compiled(Call("bucket", (args["expr"], args["bounds"], args["default"])), f.scope)
    return aggregate(f, [(args["alias"], v)], [_counting()])


def pivot(f: Frame, args: dict) -> Frame:
    """Dynamic columns: their labels are one distinct over the column fields, the only data that comes to the driver."""
    scope = f.scope
    rows = [_key(i, f) for i in args["rows"]]
    labels = []
    for i in args["columns"]:
        v = compiled(Path(i["expr"].parts, True) if isinstance(i["expr"], Path) else i["expr"], scope)
        labels.append(F.coalesce(v.col.cast("string"), F.lit("null")))
    label = f"{HIDDEN}label"
    measures = []
    for i in args["values"]:
        m = {**_counting(), "fn": args["aggregate"], "expr": i["expr"], "alias": i["alias"] or last(i["expr"])}
        measures.append(m)
    if len({m["alias"] for m in measures}) < len(measures):
        raise PlanFault("pivot: value names must differ")
    df = f.df.withColumn(label, F.concat_ws(".", *labels))
    hold = {f"{HIDDEN}k{i}": v.col for i, (_, v) in enumerate(rows)}
    df = df.withColumns(hold)
    rank = None
    if args["aggregate"] in ORDERED:
        rank = f"{HIDDEN}ord"
        df = _ranked(f.of(df), rank, [*hold, label])
    names = sorted(r[0] for r in df.select(label).distinct().limit(LABELS + 1).collect())
    if len(names) > LABELS:
        raise PlanFault(f"pivot: more than {LABELS} columns")
    scope = f.of(df).scope
    columns = []
    for m in measures:
        c = measure(m, scope, rank)
        if m["fn"] == "sum":
            c = F.when(F.count(F.lit(1)) > 0, F.coalesce(c, F.lit(0)))
        columns.append(c.alias(m["alias"]))
    wide = df.groupBy(*hold).pivot(label, names).agg(*columns)
    out = [F.col(f"{HIDDEN}k{i}").alias(n.split(".")[-1]) for i, (n, _) in enumerate(rows)]
    for n in names:
        for m in measures:
            made = n if len(measures) == 1 else f"{n}_{m['alias']}"
            out.append(F.col(quoted(made)).alias(n if len(measures) == 1 else f"{n}.{m['alias']}"))
    return f.of(wide.select(*out), order=(), keys=tuple(n.split(".")[-1] for n, _ in rows), sorted=False)


