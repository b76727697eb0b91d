"""Expressions to typed columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import PlanFault
from sluice.functions import scalar
from sluice.functions.values import BOOL, DOUBLE, LONG, Val, as_type, common, lit
from sluice.plans.expression import Arr, Bin, Call, Lit, Obj, Param, Path, Un


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass
class Scope:
    """What names mean: the columns of a row, its alias, and the rows that enclose it.

    ``outer`` maps an enclosing alias and path to the hidden column that carries its value.
    """

    schema: T.StructType
    alias: str | None = None
    outer: dict[tuple[str, ...], str] = field(default_factory=dict)
    outer_aliases: frozenset[str] = frozenset()

    def find(self, path: Path) -> Val | None:
        parts = path.parts
        if len(parts) > 1 and parts[0] in self.outer_aliases and parts in self.outer:
            name = self.outer[parts]
            return Val(F.col(quoted(name)), self.schema[name].dataType)
        if len(parts) > 1 and parts[0] == self.alias and parts[0] not in self.schema.fieldNames():
            parts = parts[1:]
        names = self.schema.fieldNames()
        joined = ".".join(parts)
        if len(parts) > 1 and joined in names:
            return Val(F.col(quoted(joined)), self.schema[joined].dataType)
        if parts[0] not in names:
            return None
        v = Val(F.col(quoted(parts[0])), self.schema[parts[0]].dataType)
        for p in parts[1:]:
            if isinstance(v.type, T.StructType):
                if p not in v.type.fieldNames():
                    return None
                v = Val(v.col.getField(p), v.type[p].dataType)
            elif isinstance(v.type, T.MapType):
                v = Val(F.try_element_at(v.col, F.lit(p)), v.type.valueType)
            else:
                return None
        return v


def constant(e, what: str):
    """The Python value of a constant expression."""
    if isinstance(e, Lit):
        return e.value
    if isinstance(e, Arr):
        return [constant(x, what) for x in e.items]
    if isinstance(e, Obj):
        return {k: constant(v, what) for k, v in e.items}
    if isinstance(e, Un) and e.op == "-":
        return -constant(e.arg, what)
    raise PlanFault(f"{what} takes a constant")


def compiled(e, scope: Scope) -> Val:
    if isinstance(e, Lit):
        return lit(e.value)
    if isinstance(e, Path):
        v = scope.find(e)
        if v is None:
            if e.optional:
                return lit(None)
            raise PlanFault(f'field path "{e}" is missing')
        return v.plain()
    if isinstance(e, Param):
        raise PlanFault(f"unknown parameter ${e.name}")
    if isinstance(e, Arr):
        vals = [compiled(x, scope) for x in e.items]
        if not vals:
            return Val(F.array(), T.ArrayType(T.NullType()))
        t = common(vals)
        return Val(F.array(*[as_type(v, t) for v in vals]), T.ArrayType(t))
    if isinstance(e, Obj):
        vals = [(k, compiled(v, scope)) for k, v in e.items]
        return Val(F.struct(*[v.col.alias(k) for k, v in vals]), T.StructType([T.StructField(k, v.type) for k, v in vals]))
    if isinstance(e, Un):
        v = compiled(e.arg, scope)
        if e.op == "not":
            if v.kind != "bool":
                raise PlanFault(f"not: a boolean is expected, not {v.kind}")
            return Val(~v.col, BOOL)
        if v.kind not in ("number", "null"):
            raise PlanFault(f"unary {e.op}: a number is expected, not {v.kind}")
        return Val(-v.col if e.op == "-" else v.col, v.type)
    if isinstance(e, Call):
        return _call(e, scope)
    if isinstance(e, Bin):
        return _binary(e, scope)
    raise PlanFault(f"not an expression: {e!r}")


def _call(e: Call, scope: Scope) -> Val:
    if e.name in scalar.LAZY:
        low, high = scalar.LAZY[e.name]
    elif e.name in scalar.FUNCTIONS:
        low, high, build = scalar.FUNCTIONS[e.name]
    else:
        raise PlanFault(f"unknown function {e.name!r}")
    if not low <= len(e.args) <= high:
        raise PlanFault(f"{e.name} takes {low}" + ("" if low == high else f" to {high}") + f" arguments, not {len(e.args)}")
    if e.name == "exists":
        if not isinstance(e.args[0], Path):
            raise PlanFault("exists takes a field path")
        return Val(F.lit(scope.find(e.args[0]) is not None), BOOL)
    if e.name == "optional":
        a = e.args[0]
        return compiled(Path(a.parts, True) if isinstance(a, Path) else a, scope)
    if e.name == "bucket":
        default = compiled(e.args[2], scope) if len(e.args) > 2 else lit(None)
        return scalar.bucket_of(compiled(e.args[0], scope), constant(e.args[1], "bucket"), default)
    if e.name == "len" and isinstance(e.args[0], Call) and e.args[0].name == "split" and len(e.args[0].args) == 2:
        text, by = (compiled(a, scope) for a in e.args[0].args)
        if by.is_const and isinstance(by.const, str) and by.const and text.kind == "string":  # counted without making the parts
            without = F.char_length(F.replace(text.col, by.col, F.lit("")))
            return Val((F.lit(1) + (F.char_length(text.col) - without) / len(by.const)).cast("long"), LONG)
    args = [compiled(a, scope) for a in e.args]
    if e.name == "coalesce":
        args = [a for a in args if a.kind != "null"] or [lit(None)]
    if e.name == "case" and any(c.kind != "bool" for c in args[: len(args) - len(args) % 2 : 2]):
        raise PlanFault("case: conditions are booleans")
    return build(*args)


_COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def _binary(e: Bin, scope: Scope) -> Val:
    a, b = compiled(e.left, scope), compiled(e.right, scope)
    op = e.op
    if op in ("and", "or"):
        for v in (a, b):
            if v.kind not in ("bool", "null"):
                raise PlanFault(f"{op}: a boolean is expected, not {v.kind}")
        return Val(a.col & b.col if op == "and" else a.col | b.col, BOOL)
    if op in ("==", "!="):
        if {a.kind, b.kind} == {"number", "string"}:
            raise PlanFault(f"{op}: a number and a string do not compare")
        a, b = _times(a, b)
        if a.kind != b.kind and "null" not in (a.kind, b.kind):
            return Val(F.lit(op == "!="), BOOL)
        same = a.col.eqNullSafe(b.col)
        return Val(same if op == "==" else ~same, BOOL)
    if op in _COMPARE:
        a, b = _times(a, b)
        if a.kind != b.kind and "null" not in (a.kind, b.kind):
            raise PlanFault(f"{op}: {a.kind} and {b.kind} do not compare")
        return Val(_COMPARE[op](a.col, b.col), BOOL)
    if op == "in":
        if b.kind != "array":
            raise PlanFault("in: an array is expected on the right")
        if isinstance(e.right, Arr) and all(isinstance(x, Lit) and x.value is not None for x in e.right.items) and e.right.items:
            values = [x.value for x in e.right.items]
            fits = [v for v in values if lit(v).kind == a.kind]
            return Val(F.coalesce(a.col.isin(fits), F.lit(False)) if fits else F.lit(False), BOOL)
        return Val(F.exists(b.col, lambda x: x.eqNullSafe(a.col)), BOOL)
    for v in (a, b):
        if v.kind not in ("number", "null"):
            raise PlanFault(f"{op}: a number is expected, not {v.kind}")
    if op == "/":
        return Val(a.double() / b.double(), DOUBLE)
    out = LONG if a.is_int and b.is_int else DOUBLE
    x, y = as_type(a, out), as_type(b, out)
    return Val({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "%": lambda: x % y}[op](), out)


def _times(a: Val, b: Val) -> tuple[Val, Val]:
    """A timestamp column compares with ISO text and with milliseconds."""
    if a.kind == "time" and b.kind in ("string", "number"):
        return a, _as_time(b, a)
    if b.kind == "time" and a.kind in ("string", "number"):
        return _as_time(a, b), b
    return a, b


def _as_time(v: Val, like: Val) -> Val:
    c = v.col if v.kind == "string" else F.timestamp_millis(v.col.cast("long"))
    return Val(c.cast(like.type), like.type)


def summable(e, scope: Scope) -> bool | None:
    """Whether a grouped item is a number: it is summed then, else a key. None where the text alone cannot tell."""
    if isinstance(e, Path):
        v = scope.find(e)
        return None if v is None else v.kind == "number"
    if isinstance(e, Lit):
        return isinstance(e.value, (int, float)) and not isinstance(e.value, bool)
    if isinstance(e, Un):
        return e.op != "not"
    if isinstance(e, Bin):
        return e.op in ("+", "-", "*", "/", "%")
    if isinstance(e, Call):
        if e.name in scalar.NUMERIC:
            return True
        if e.name in ("if", "case", "coalesce", "min", "max"):
            parts = e.args[1:] if e.name == "if" else [a for i, a in enumerate(e.args) if i % 2 or i == len(e.args) - 1] if e.name == "case" else e.args
            found = [summable(p, scope) for p in parts if not (isinstance(p, Lit) and p.value is None)]
            return None if None in found else all(found)
        if e.name in ("at", "get"):
            return None
    return False
