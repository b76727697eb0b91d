"""Stages that look at one row at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import PlanFault
from sluice.functions.values import Val
from sluice.operators.frame import HIDDEN, Frame
from sluice.plans.compiler import compiled, constant, quoted
from sluice.plans.expression import Path, paths


def where(f: Frame, args: dict) -> Frame:
    p = compiled(args["predicate"], f.scope)
    if p.kind not in ("bool", "null"):
        raise PlanFault(f"where: a boolean is expected, not {p.kind}")
    return f.of(f.df.filter(p.col))


def put(df: DataFrame, target: tuple[str, ...], v: Val) -> DataFrame:
    """The frame with a value at a path; objects on the way are made."""
    col = v.col.cast("string") if v.kind == "null" else v.col
    if len(target) == 1:
        return df.withColumn(target[0], col)
    head, rest = target[0], target[1:]
    if head in df.columns and isinstance(df.schema[head].dataType, T.StructType):
        return df.withColumn(head, _with(F.col(quoted(head)), df.schema[head].dataType, rest, col))
    for name in reversed(rest):
        col = F.struct(col.alias(name))
    return df.withColumn(head, col)


def _with(obj, t: T.StructType, rest, col):
    if len(rest) == 1:
        return obj.withField(quoted(rest[0]), col)
    inner = rest[0]
    if inner in t.fieldNames() and isinstance(t[inner].dataType, T.StructType):
        return obj.withField(quoted(inner), _with(obj.getField(inner), t[inner].dataType, rest[1:], col))
    for name in reversed(rest[1:]):
        col = F.struct(col.alias(name))
    return obj.withField(quoted(inner), col)


def stripped(path: Path, alias: str | None, names) -> tuple[str, ...]:
    parts = path.parts
    return parts[1:] if len(parts) > 1 and parts[0] == alias and parts[0] not in names else parts


def derive(f: Frame, args: dict) -> Frame:
    """Assignments from left to right; those that do not read each other share one projection."""
    df, pending, targets = f.df, {}, set()

    def flush(df):
        return df.withColumns(pending) if pending else df

    for target, e in args["assign"]:
        parts = stripped(target, f.alias, df.columns)
        if isinstance(e, Path) and e.parts == target.parts:
            continue
        reads = {p.parts[0] for p in paths(e)} | {stripped(p, f.alias, ())[0] for p in paths(e)}
        if reads & targets or len(parts) > 1 or parts[0] in targets:
            df, pending, targets = flush(df), {}, set()
        v = compiled(e, f.of(df).scope)
        if len(parts) > 1:
            df = put(df, parts, v)
        else:
            pending[parts[0]] = v.col.cast("string") if v.kind == "null" else v.col
            targets.add(parts[0])
    return f.of(flush(df))


def select(f: Frame, args: dict) -> Frame:
    """Only the listed items, later ones may read earlier aliases. A missing plain field is left out."""
    df, names, kept_keys = f.df, [], []
    nested: dict[str, list] = {}
    temp = {}
    for item in args["items"]:
        e = item["expr"]
        scope = f.of(df).scope
        if isinstance(e, Path) and item.get("alias") is None:
            v = scope.find(e)
            if v is None:
                continue
            parts = e.parts[1:] if e.parts in f.outer else stripped(e, f.alias, df.columns)
            target = parts
        else:
            v = compiled(e, scope)
            target = tuple(item["alias"].split("."))
        col = v.col.cast("string") if v.kind == "null" else v.col
        if len(target) > 1:
            hold = f"{HIDDEN}n{len(temp)}"
            temp[hold] = target
            df = df.withColumn(hold, col)
            nested.setdefault(target[0], []).append((target[1:], hold))
            if target[0] not in names:
                names.append(target[0])
        else:
            if not (isinstance(e, Path) and e.parts == target and e.parts not in f.outer):
                df = df.withColumn(target[0], col)
            if target[0] not in names:
                names.append(target[0])
            kept_keys.append(target[0])
    if "_id" in f.visible() and "_id" not in names:
        names.append("_id")
    out = []
    for n in names:
        out.append(_object(nested[n]).alias(n) if n in nested else F.col(quoted(n)))
    keep = [c for c in f.hidden()]
    return f.of(df.select(*out, *map(quoted, keep)), keys=tuple(k for k in f.keys if k in names))


def _object(items):
    tree: dict = {}
    for parts, hold in items:
        at = tree
        for p in parts[:-1]:
            at = at.setdefault(p, {})
        at[parts[-1]] = hold

    def build(t):
        return F.struct(*[(build(v) if isinstance(v, dict) else F.col(v)).alias(k) for k, v in t.items()])

    return build(tree)


def rename(f: Frame, args: dict) -> Frame:
    v = f.scope.find(args["source"])
    if v is None:
        return f
    a, b = stripped(args["source"], f.alias, f.df.columns), stripped(args["target"], f.alias, f.df.columns)
    if len(a) == 1 and len(b) == 1:
        return f.of(f.df.withColumnRenamed(a[0], b[0]), keys=tuple(b[0] if k == a[0] else k for k in f.keys))
    return f.of(_dropped(put(f.df, b, v), a))


def _dropped(df: DataFrame, parts) -> DataFrame:
    if len(parts) == 1:
        return df.drop(parts[0])
    if parts[0] not in df.columns or not isinstance(df.schema[parts[0]].dataType, T.StructType):
        return df
    t = df.schema[parts[0]].dataType
    for p in parts[1:]:
        if not isinstance(t, T.StructType) or p not in t.fieldNames():
            return df
        t = t[p].dataType
    return df.withColumn(parts[0], F.col(quoted(parts[0])).dropFields(".".join(map(quoted, parts[1:]))))


def drop(f: Frame, args: dict) -> Frame:
    df = f.df
    for p in args["paths"]:
        df = _dropped(df, stripped(p, f.alias, df.columns))
    return f.of(df)


def root(f: Frame, args: dict) -> Frame:
    v = compiled(args["path"], f.scope)
    if not isinstance(v.type, T.StructType):
        raise PlanFault(f'root: "{args["path"]}" is not an object')
    hold = f.df.withColumn(f"{HIDDEN}root", F.when(v.col.isNull(), F.raise_error(F.lit("root: not an object")).cast(v.type)).otherwise(v.col))
    return f.of(hold.select(f"{HIDDEN}root.*", *map(quoted, f.hidden())), keys=())


def near(f: Frame, args: dict) -> Frame:
    """Cosine distance of an array field to a constant vector, as _distance."""
    v = f.scope.find(args["path"])
    q = [float(x) for x in constant(args["vector"], "near")]
    norm = sum(x * x for x in q) ** 0.5
    if not norm:
        raise PlanFault("near: the vector is zero")
    if v is None:
        return f.of(f.df.filter(F.lit(False)).withColumn("_distance", F.lit(0.0)))
    if v.kind != "array":
        raise PlanFault("near: an array of numbers is expected")
    d = v.col.cast("array<double>")
    query = F.array(*[F.lit(x) for x in q])
    dot = F.aggregate(F.zip_with(d, query, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    own = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    cosine = F.greatest(F.least(dot / (own * norm), F.lit(1.0)), F.lit(-1.0))
    fail = lambda text: F.raise_error(F.lit(text)).cast("double")
    value = F.when(F.size(d) != len(q), fail("near: the dimensions differ")).when(own == 0, fail("near: a zero vector")).otherwise(1 - cosine)
    return f.of(f.df.filter(v.col.isNotNull()).withColumn("_distance", value))


def unwind(f: Frame, args: dict) -> Frame:
    """One row per item; an empty array's row goes unless kept; what is no array passes through."""
    v = f.scope.find(args["path"])
    parts = stripped(args["path"], f.alias, f.df.columns)
    if v is None or v.kind != "array":
        return f.of(f.df.withColumn(args["index"], F.lit(None).cast("long")) if args["index"] else f.df)
    df = f.df if args["keep"] else f.df.filter(v.col.isNull() | (F.size(v.col) > 0))
    pos, item = f"{HIDDEN}pos", f"{HIDDEN}item"
    df = df.select("*", F.posexplode_outer(v.col).alias(pos, item))
    df = put(df, parts, Val(F.col(item), v.type.elementType))
    if args["index"]:
        df = df.withColumn(args["index"], F.col(pos).cast("long"))
    return f.of(df.drop(pos, item))

