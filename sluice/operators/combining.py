"""lookup and union: joins that the language writes as nested pipelines.

A sub-pipeline is never run per outer row. What it reads of the outer row is found first; where that is only equalities with joined
fields, the sub-pipeline runs once over the joined collection, apart for each key, and its results are joined by key. Otherwise the
distinct outer values that it reads are joined to the collection, the sub-pipeline runs apart for each of them, and the results are
joined back to the outer rows by these values.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import PlanFault
from sluice.operators.frame import HIDDEN, Frame
from sluice.plans.compiler import compiled, quoted
from sluice.plans.expression import Bin, Call, Lit, Path, paths, rebuilt
from sluice.plans.parser import Stage, conjoined, conjuncts, expressions

#: Rows of a lookup without any condition on the outer row, at most: each outer row gets all of them.
KEYLESS = 100_000

#: Stages of a sub-pipeline that need no rows but their own.
ROW_LOCAL = ("where", "select", "derive", "rename", "drop", "near", "unwind", "root")


def union(f: Frame, branch: Frame) -> Frame:
    a, b = f.df.select(*map(quoted, f.visible())), branch.df.select(*map(quoted, branch.visible()))
    for c in set(a.columns) & set(b.columns):
        x, y = a.schema[c].dataType, b.schema[c].dataType
        if x != y and not (isinstance(x, T.NumericType) and isinstance(y, T.NumericType)):
            a, b = a.withColumn(c, F.col(quoted(c)).cast("string")), b.withColumn(c, F.col(quoted(c)).cast("string"))
    return f.of(a.unionByName(b, allowMissingColumns=True), order=(), keys=(), sorted=False)


def outer_reads(stages: list[Stage], aliases: frozenset[str]) -> list[tuple[str, ...]]:
    """Paths that begin with an enclosing alias, in order of appearance."""
    found: dict[tuple[str, ...], None] = {}
    for e in expressions(stages):
        for p in paths(e):
            if len(p.parts) > 1 and p.parts[0] in aliases:
                found[p.parts] = None
    return list(found)


def _side(e, inner_alias: str | None, aliases: frozenset[str]) -> str:
    """inner, outer, both or none: whose fields an expression reads."""
    sides = {"outer" if len(p.parts) > 1 and p.parts[0] in aliases and p.parts[0] != inner_alias else "inner" for p in paths(e)}
    return "both" if len(sides) == 2 else next(iter(sides), "none")


def lookup(f: Frame, args: dict, inner: Frame, run, later: list[Stage]) -> tuple[Frame, int]:
    """The frame with the joined rows as an array, and how many of the stages that follow are done with it.

    ``run(frame, stages)`` compiles the sub-pipeline.
    """
    into = args["into"]
    aliases = (frozenset({f.alias}) if f.alias else frozenset()) | f.outer_aliases
    aliases -= {inner.alias}
    stages = list(args["stages"])
    if args["on"] is not None:
        joined, outer = args["on"]
        outer = outer if outer.parts[0] in aliases else Path((f.alias or f"{HIDDEN}outer", *outer.parts), outer.optional)
        joined = Path(joined.parts[1:], joined.optional) if len(joined.parts) > 1 and joined.parts[0] == inner.alias else joined
        aliases |= {outer.parts[0]}
        stages = [Stage("where", {"predicate": Bin("==", joined, outer)})]
    own = f if f.alias or args["on"] is None else replace(f, alias=f"{HIDDEN}outer")

    equal, rest = [], []
    body = stages
    if stages and stages[0].name == "where":
        for c in conjuncts(stages[0].args["predicate"]):
            if isinstance(c, Call) and c.name == "exists" and isinstance(c.args[0], Path):
                continue
            if isinstance(c, Bin) and c.op == "==":
                sides = _side(c.left, inner.alias, aliases), _side(c.right, inner.alias, aliases)
                if sides == ("inner", "outer"):
                    equal.append((c.left, c.right))
                    continue
                if sides == ("outer", "inner"):
                    equal.append((c.right, c.left))
                    continue
            rest.append(c)
        body = ([Stage("where", {"predicate": conjoined(rest)})] if rest else []) + stages[1:]
    reads = outer_reads(body, aliases)
    if not reads and (equal or not stages or stages[0].name != "where" or rest or body):
        return _keyed(own, f, inner, equal, body, into, run, later)
    found = _nearest(own, f, inner, stages, aliases, into, run)
    return (found if found is not None else _correlated(own, f, inner, stages, aliases, into, run)), 0


def _outer_value(own: Frame, e):
    return compiled(_optional(e), own.scope)


def _optional(e):
    return Path(e.parts, True) if isinstance(e, Path) else e


def _rows(sub: Frame):
    return F.struct(*[F.col(quoted(c)) for c in sub.visible()])


def _empty(t):
    return F.array().cast(T.ArrayType(t))


def _keyed(own: Frame, f: Frame, inner: Frame, equal, body, into, run, later):
    """Equalities only: the sub-pipeline runs over the collection once, apart for each key."""
    level = len(f.hidden())
    keys = [f"{HIDDEN}j{level}_{i}" for i in range(len(equal))]
    mine = [f"{HIDDEN}m{level}_{i}" for i in range(len(equal))]
    optional = [_is_optional(a) or _is_optional(b) for a, b in equal]
    inner = inner.of(inner.df.withColumns({k: compiled(_optional(a), inner.scope).col for k, (a, _) in zip(keys, equal, strict=True)})) if keys else inner
    local = all(s.name in ROW_LOCAL for s in body)
    sub = run(replace(inner, per=() if local and keys else tuple(keys)), body)
    outer_df = f.df.withColumns({m: _outer_value(own, b).col for m, (_, b) in zip(mine, equal, strict=True)}) if mine else f.df

    def match(right=keys):
        out = F.lit(True)
        for m, k, o in zip(mine, right, optional, strict=True):
            out = out & (F.col(m).eqNullSafe(F.col(k)) if o else F.col(m) == F.col(k))
        return out

    names = [c for c in outer_df.columns if c not in mine and c != into]
    if keys and local:
        done = _as_join(f, sub, outer_df, keys, mine, match, into, later, names)
        if done is not None:
            return done
    t = T.StructType([sub.schema[c] for c in sub.visible()])
    order = sub.ordering()
    if keys and _length_only(into, later):
        n = f"{HIDDEN}n"
        counted = sub.df.groupBy(*map(quoted, keys)).agg(F.count(F.lit(1)).cast("int").alias(n))
        joined = outer_df.join(counted, match(), "left")
        return f.of(joined.select(*map(quoted, names), F.array_repeat(F.lit(True), F.coalesce(n, F.lit(0))).alias(into))), 0
    if not keys:
        bounded = replace(sub, df=sub.df.limit(KEYLESS + 1))
        packed = _packed(bounded, (), into, order)
        few = F.when(F.size(into) <= KEYLESS, F.col(quoted(into))).otherwise(F.raise_error(F.lit(f"lookup: without a key at most {KEYLESS} rows are joined")).cast(T.ArrayType(t)))
        joined = outer_df.join(packed.select(few.alias(into)), F.lit(True), "left")
    else:
        packed = _packed(sub, keys, into, order)
        joined = outer_df.join(packed.withColumnRenamed(into, f"{HIDDEN}into"), match(), "left")
    held = f"{HIDDEN}into" if keys else into
    joined = joined.select(*map(quoted, names), F.coalesce(F.col(quoted(held)), _empty(t)).alias(into))
    return f.of(joined), 0


def _is_optional(e) -> bool:
    return any(p.optional for p in paths(e)) or (isinstance(e, Call) and e.name == "optional")


def _packed(sub: Frame, keys, into: str, order):
    """One row a key with its rows as an array, in their order."""
    rank = sub.rank()
    if rank is not None:
        packed = F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("o"), _rows(sub).alias("r")))), lambda x: x["r"])
        return sub.df.groupBy(*map(quoted, keys)).agg(packed.alias(into))
    if order:
        rank = F.row_number().over(Window.partitionBy(*map(quoted, keys)).orderBy(*order))
        ranked = sub.df.withColumn(f"{HIDDEN}ord", rank)
        packed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(f"{HIDDEN}ord").alias("o"), _rows(sub).alias("r")))), lambda x: x["r"])
        return ranked.groupBy(*map(quoted, keys)).agg(packed.alias(into))
    return sub.df.groupBy(*map(quoted, keys)).agg(F.collect_list(_rows(sub)).alias(into))


def _as_join(f: Frame, sub: Frame, outer_df, keys, mine, match, into, later, names):
    """Without the array: unwound at once it is an inner or left join; asked for its length only, a semi or anti join."""
    if not later:
        return None
    nxt = later[0]
    if nxt.name == "unwind" and nxt.args["path"].parts == (into,) and nxt.args["index"] is None:
        right = sub.df.select(*map(quoted, keys), _rows(sub).alias(f"{HIDDEN}into"))
        joined = outer_df.join(right, match(), "left" if nxt.args["keep"] else "inner")
        return f.of(joined.select(*map(quoted, names), F.col(f"{HIDDEN}into").alias(into))), 1
    if nxt.name == "where" and _unused(into, later[1:]):
        how = _length_test(nxt.args["predicate"], into)
        if how:
            right = sub.df.select(*map(quoted, keys))
            return f.of(outer_df.join(right, match(), how).select(*map(quoted, names))), 1
    return None


def _length_test(e, into: str) -> str | None:
    if isinstance(e, Bin) and isinstance(e.left, Call) and e.left.name == "len" and isinstance(e.left.args[0], Path) and e.left.args[0].parts == (into,):
        value = getattr(e.right, "value", None)
        if (e.op, value) in ((">", 0), (">=", 1), ("!=", 0)):
            return "left_semi"
        if (e.op, value) in (("==", 0), ("<", 1)):
            return "left_anti"
    return None


def _length_only(into: str, stages: list[Stage]) -> bool:
    """Whether only the array's length is read before it is left behind: then its rows are counted, not gathered."""
    for s in stages:
        if s.name == "drop" and any(p.parts == (into,) for p in s.args["paths"]):
            return True
        length = lambda e: Lit(0) if isinstance(e, Call) and e.name == "len" and len(e.args) == 1 and isinstance(e.args[0], Path) and e.args[0].parts[-1] == into else e
        if any(into in p.parts[:2] for e in expressions([s]) for p in paths(rebuilt(e, length))):
            return False
        if s.name in ("select", "group", "count", "bucket", "pivot"):
            return True
    return False


def _unused(into: str, stages: list[Stage]) -> bool:
    """Whether the array is dropped, or left behind by a projection, before anything reads it."""
    for s in stages:
        if s.name == "drop" and any(p.parts == (into,) for p in s.args["paths"]):
            return True
        if any(p.parts[0] == into or (len(p.parts) > 1 and p.parts[1] == into) for e in expressions([s]) for p in paths(e)):
            return False
        if s.name in ("select", "group", "count", "bucket", "pivot"):
            return True
    return False


def _nearest(own: Frame, f: Frame, inner: Frame, stages, aliases, into, run) -> Frame | None:
    """``where <equalities> and t <= o.t | sort t desc, ... | first``: the row just before (or after) each outer row.

    Both sides lie in one order within a key, and each outer row takes the last inner row that comes before it: linear in the rows of
    a key, where a join would pair all earlier ones. None for any other sub-pipeline.
    """
    if len(stages) < 3 or [s.name for s in stages[:2]] != ["where", "sort"]:
        return None
    last = stages[2]
    if not (last.name == "first" and last.args["path"] is None or last.name == "limit" and last.args["n"] == Lit(1)):
        return None
    keys, bound = [], []
    for c in conjuncts(stages[0].args["predicate"]):
        if not isinstance(c, Bin) or c.op not in ("==", "<", "<=", ">", ">="):
            return None
        a, b, op = c.left, c.right, c.op
        if (_side(a, inner.alias, aliases), _side(b, inner.alias, aliases)) == ("outer", "inner"):
            a, b, op = b, a, {"==": "==", "<": ">", "<=": ">=", ">": "<", ">=": "<="}[op]
        if (_side(a, inner.alias, aliases), _side(b, inner.alias, aliases)) != ("inner", "outer"):
            return None
        (keys if op == "==" else bound).append((a, b, op))
    order = stages[1].args["keys"]
    own_path = lambda e: e.parts[1:] if len(e.parts) > 1 and e.parts[0] == inner.alias else e.parts
    if len(bound) != 1 or not isinstance(bound[0][0], Path) or not isinstance(order[0]["expr"], Path) or own_path(order[0]["expr"]) != own_path(bound[0][0]):
        return None
    op = bound[0][2]
    if order[0]["desc"] != (op in ("<", "<=")) or outer_reads([*stages[1:]], aliases):
        return None
    pairs = [(compiled(_optional(a), inner.scope), compiled(_optional(b), own.scope)) for a, b, _ in [*keys, *bound]]
    if any(x.type != y.type or x.kind == "null" for x, y in pairs):
        return None
    level = len(f.hidden())
    names = [f"{HIDDEN}q{level}_{i}" for i in range(len(pairs))]
    held, t = f"{HIDDEN}near", names[-1]
    there = inner.of(inner.df.withColumns({n: x.col for n, (x, _) in zip(names, pairs, strict=True)}).filter(F.col(t).isNotNull()), per=tuple(names))
    tied = [Stage("sort", {"keys": order[1:]})] if len(order) > 1 else []
    there = run(there, [*tied, Stage("limit", {"n": Lit(1)})])
    outer_df = f.df.withColumns({n: y.col for n, (_, y) in zip(names, pairs, strict=True)})
    asked = outer_df.select(*names).filter(F.col(t).isNotNull()).distinct()
    row = F.struct(*map(quoted, inner.df.columns))
    strict = op in ("<", ">")
    events = there.df.select(*names, row.alias(held), F.lit(int(strict)).alias("side")).unionByName(asked.withColumn("side", F.lit(int(not strict))), allowMissingColumns=True)
    along = Window.partitionBy(*names[:-1]).orderBy(F.col(t).asc() if op in ("<", "<=") else F.col(t).desc(), "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = events.withColumn(held, F.last(held, ignorenulls=True).over(along)).filter((F.col("side") == int(not strict)) & F.col(held).isNotNull())
    sub = run(replace(inner, df=found.select(*names, f"{held}.*"), per=tuple(names), order=()), stages[3:])
    packed = _packed(sub, tuple(names), into, [])
    right = packed.select(*[F.col(n).alias(f"{n}r") for n in names], F.col(quoted(into)).alias(f"{HIDDEN}into"))
    match = F.lit(True)
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"{n}r"))
    kept = [c for c in f.df.columns if c != into]
    empty = _empty(T.StructType([sub.schema[c] for c in sub.visible()]))
    return f.of(outer_df.join(right, match, "left").select(*map(quoted, kept), F.coalesce(F.col(f"{HIDDEN}into"), empty).alias(into)))


def _correlated(own: Frame, f: Frame, inner: Frame, stages, aliases, into, run) -> Frame:
    """The distinct outer values that the sub-pipeline reads, joined to the collection; then by these values back to the rows."""
    reads = outer_reads(stages, aliases)
    if not reads:
        raise PlanFault("lookup: a sub-pipeline without a condition or a stage")
    level = len(f.hidden())
    held = {p: f"{HIDDEN}o{level}_{i}" for i, p in enumerate(reads)}
    values = {n: compiled(Path(p, True), own.scope).col for p, n in held.items()}
    values = {n: c.cast("string") if t_null(own, p) else c for (p, n), c in zip(held.items(), values.values(), strict=True)}
    outer_df = f.df.withColumns(values)
    keys = outer_df.select(*held.values()).distinct()
    clash = [c for c in inner.df.columns if c in keys.columns]
    if clash:
        raise PlanFault(f"lookup: hidden names clash: {clash}")
    body, condition = stages, F.lit(True)
    both = T.StructType([*inner.schema.fields, *keys.schema.fields])
    scope = replace(inner.scope, schema=both, outer={**inner.outer, **held}, outer_aliases=aliases)
    drop_prefix = None
    if stages[0].name == "where":
        body = stages[1:]
        for c in conjuncts(stages[0].args["predicate"]):
            if isinstance(c, Call) and c.name == "starts_with" and drop_prefix is None:
                sides = _side(c.args[0], inner.alias, aliases), _side(c.args[1], inner.alias, aliases)
                if sides == ("outer", "inner"):
                    # Each prefix of the outer text, of a length that there is, is an equality: no pair is compared that does not match.
                    text = compiled(_optional(c.args[0]), scope).col.cast("string")
                    prefix = compiled(c.args[1], inner.scope).col
                    lengths = inner.df.agg(F.sort_array(F.collect_set(F.char_length(prefix)))).scalar()
                    drop_prefix = f"{HIDDEN}p{level}"
                    fitting = F.filter(drop_prefix, lambda n: n <= F.char_length(text))
                    keys = keys.withColumn(drop_prefix, lengths).withColumn(drop_prefix, F.explode(F.transform(fitting, lambda n: F.substring(text, F.lit(1), n))))
                    condition = condition & (F.col(drop_prefix) == compiled(c.args[1], scope).col)
                    continue
            p = compiled(c, scope)
            if p.kind not in ("bool", "null"):
                raise PlanFault("where: a boolean is expected")
            condition = condition & p.col
    joined = keys.join(inner.df, condition, "inner")
    joined = joined.drop(drop_prefix) if drop_prefix else joined
    sub = run(replace(inner, df=joined, per=tuple(held.values()), outer={**inner.outer, **held}, outer_aliases=aliases), body)
    packed = _packed(sub, tuple(held.values()), into, sub.ordering())
    t = T.StructType([sub.schema[c] for c in sub.visible()])
    right = packed.select(*[F.col(h).alias(f"{h}r") for h in held.values()], F.col(quoted(into)).alias(f"{HIDDEN}into"))
    match = F.lit(True)
    for h in held.values():
        match = match & F.col(h).eqNullSafe(F.col(f"{h}r"))
    names = [c for c in f.df.columns if c != into]
    back = outer_df.join(right, match, "left").select(*map(quoted, names), F.coalesce(F.col(f"{HIDDEN}into"), _empty(t)).alias(into))
    return f.of(back)


def t_null(own: Frame, parts) -> bool:
    return compiled(Path(parts, True), own.scope).kind == "null"
