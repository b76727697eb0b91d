"""The scalar functions: name to (least arguments, most arguments, builder)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import PlanFault
from sluice.functions.values import BOOL, DOUBLE, LONG, STRING, Val, as_type, common, lit, millis, stamp

FUNCTIONS: dict = {}

#: Functions whose result is a number whatever the data: they make a grouped item a sum. Fixed values.
NUMERIC = set("abs sqrt floor ceil round trunc pow sum avg median percentile stddev div ln log10 log exp sign len index_of date_diff date_part fiscal_year fiscal_month days_in to_int to_float".split())


def function(name: str, low: int, high: int | None = None):
    def add(f):
        FUNCTIONS[name] = (low, low if high is None else high, f)
        return f

    return add


MANY = 255


def _number(v: Val, name: str) -> Val:
    if v.kind not in ("number", "null"):
        raise PlanFault(f"{name}: a number is expected, not {v.kind}")
    return v.plain()


def _text(v: Val, name: str):
    if v.kind not in ("string", "null"):
        raise PlanFault(f"{name}: a string is expected, not {v.kind}")
    return v.col.cast("string")


def _refuse(bad, message: str, value):
    """The value, or an error where ``bad`` holds."""
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


# numbers


@function("abs", 1)
def _(x):
    x = _number(x, "abs")
    return Val(F.abs(x.col), x.type)


@function("sqrt", 1)
def _(x):
    c = _number(x, "sqrt").double()
    return Val(_refuse(c < 0, "sqrt: negative number", F.sqrt(c)), DOUBLE)


@function("floor", 1)
def _(x):
    return Val(F.floor(_number(x, "floor").col).cast("long"), LONG)


@function("ceil", 1)
def _(x):
    return Val(F.ceil(_number(x, "ceil").col).cast("long"), LONG)


@function("round", 1, 3)
def _(x, digits=None, mode=None):
    x = _number(x, "round")
    if digits is not None and digits.kind == "string":
        digits, mode = None, digits
    f = F.bround if mode is not None and mode.const == "half_even" else F.round
    n = 0 if digits is None else int(digits.const)
    if x.is_int:
        return x
    c = f(x.col, n)
    return Val(c.cast("long"), LONG) if digits is None else Val(c, DOUBLE)


@function("trunc", 1, 2)
def _(x, digits=None):
    x = _number(x, "trunc")
    if x.is_int:
        return x
    scale = 10.0 ** (0 if digits is None else int(digits.const))
    c = F.signum(x.col) * F.floor(F.abs(x.col) * scale) / scale
    return Val(c.cast("long"), LONG) if digits is None else Val(c, DOUBLE)


@function("pow", 2)
def _(x, y):
    x, y = _number(x, "pow"), _number(y, "pow")
    c = F.pow(x.double(), y.double())
    if x.is_int and y.is_int and y.is_const and y.const >= 0:
        return Val(c.cast("long"), LONG)
    return Val(c, DOUBLE)


def _spread(args):
    """The values of arguments, or of the one array argument."""
    if len(args) == 1 and args[0].kind == "array":
        return args[0].col, args[0].type.elementType
    t = common(list(args))
    return F.array(*[as_type(a, t) for a in args]), t


def _doubles(args):
    col, t = _spread(args)
    return F.transform(F.filter(col, lambda x: x.isNotNull()), lambda x: x.cast("double")), t


@function("min", 1, MANY)
def _(*args):
    col, t = _spread(args)
    return Val(F.array_min(col), t)


@function("max", 1, MANY)
def _(*args):
    col, t = _spread(args)
    return Val(F.array_max(col), t)


def _is_int(t):
    return isinstance(t, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))


@function("sum", 1, MANY)
def _(*args):
    col, t = _spread(args)
    to = LONG if _is_int(t) else DOUBLE
    zero = F.lit(0).cast(to)
    return Val(F.aggregate(F.filter(col, lambda x: x.isNotNull()), zero, lambda a, x: a + x.cast(to)), to)


@function("avg", 1, MANY)
def _(*args):
    col, _t = _doubles(args)
    return Val(F.when(F.size(col) > 0, F.aggregate(col, F.lit(0.0), lambda a, x: a + x) / F.size(col)), DOUBLE)


def _percentile(col, p):
    s = F.array_sort(col)
    at = (F.size(s) - 1) * p
    low = F.floor(at).cast("int")
    a, b = F.try_element_at(s, low + 1), F.try_element_at(s, F.least(low + 2, F.size(s)))
    return F.when(F.size(s) > 0, a + (b - a) * (at - low))


@function("median", 1, MANY)
def _(*args):
    return Val(_percentile(_doubles(args)[0], F.lit(0.5)), DOUBLE)


@function("percentile", 2)
def _(values, p):
    return Val(_percentile(_doubles([values])[0], p.double()), DOUBLE)


@function("stddev", 1, MANY)
def _(*args):
    col, _t = _doubles(args)
    n = F.size(col)
    mean = F.aggregate(col, F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate(F.transform(col, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return Val(F.when(n > 1, F.sqrt(squares / (n - 1))), DOUBLE)


@function("div", 2, 3)
def _(a, b, fallback=None):
    a, b = _number(a, "div"), _number(b, "div")
    other = F.lit(None).cast("double") if fallback is None else fallback.double()
    return Val(F.when(b.double() == 0, other).otherwise(F.try_divide(a.double(), b.double())), DOUBLE)


@function("ln", 1)
def _(x):
    c = _number(x, "ln").double()
    return Val(_refuse(c <= 0, "ln: not a positive number", F.log(c)), DOUBLE)


@function("log10", 1)
def _(x):
    c = _number(x, "log10").double()
    return Val(_refuse(c <= 0, "log10: not a positive number", F.log10(c)), DOUBLE)


@function("log", 2)
def _(x, base):
    c = _number(x, "log").double()
    exact = {2: F.log2, 10: F.log10}.get(base.const)
    value = exact(c) if exact else F.log(c) / F.log(base.double())
    return Val(_refuse(c <= 0, "log: not a positive number", value), DOUBLE)


@function("exp", 1)
def _(x):
    c = F.exp(_number(x, "exp").double())
    return Val(_refuse(c == float("inf"), "exp: too large", c), DOUBLE)


@function("sign", 1)
def _(x):
    return Val(F.signum(_number(x, "sign").double()).cast("long"), LONG)


# logic


@function("coalesce", 1, MANY)
def _(*args):
    t = common(list(args))
    return Val(F.coalesce(*[as_type(a, t) for a in args]), t)


@function("if", 3)
def _(c, a, b):
    t = common([a, b])
    return Val(F.when(c.col, as_type(a, t)).otherwise(as_type(b, t)), t)


@function("case", 2, MANY)
def _(*args):
    pairs = [(args[i], args[i + 1]) for i in range(0, len(args) - 1, 2)]
    other = args[-1] if len(args) % 2 else lit(None)
    t = common([v for _, v in pairs] + [other])
    out = as_type(other, t)
    for c, v in reversed(pairs):
        out = F.when(c.col, as_type(v, t)).otherwise(out)
    return Val(out, t)


@function("nullif", 2)
def _(a, b):
    if a.kind != b.kind:
        return a
    return Val(F.when(a.col.eqNullSafe(b.col), F.lit(None)).otherwise(a.col), a.type)


@function("between", 3)
def _(x, low, high):
    return Val((x.col >= low.col) & (x.col <= high.col), BOOL)


def bucket_of(x: Val, bounds: list, default: Val) -> Val:
    if len(bounds) < 2 or any(b >= a for a, b in zip(bounds[1:], bounds, strict=False)):
        raise PlanFault("bucket: at least two ascending bounds are needed")
    label = lit(bounds[0])
    t = STRING if default.kind not in ("null", label.kind) else common([*map(lit, bounds), default])
    out = as_type(default, t)
    for low, high in reversed(list(zip(bounds, bounds[1:], strict=False))):
        out = F.when((x.col >= F.lit(low)) & (x.col < F.lit(high)), as_type(lit(low), t)).otherwise(out)
    return Val(out, t)


# conversions


@function("to_int", 1)
def _(x):
    if x.kind == "number":
        return x if x.is_int else Val(x.col.cast("double").cast("long"), LONG)
    if x.kind == "bool":
        return Val(x.col.cast("int").cast("long"), LONG)
    return Val(F.trim(_text(x, "to_int")).cast("double").cast("long"), LONG)


@function("to_float", 1)
def _(x):
    if x.kind == "string":
        return Val(F.trim(x.col).cast("double"), DOUBLE)
    if x.kind == "bool":
        return Val(x.col.cast("int").cast("double"), DOUBLE)
    return Val(x.double(), DOUBLE)


def text_of(x: Val):
    if x.kind in ("array", "object"):
        return F.to_json(x.col)
    return x.col.cast("string")


@function("to_string", 1)
def _(x):
    return Val(text_of(x), STRING)


@function("to_bool", 1)
def _(x):
    if x.kind == "bool":
        return x
    if x.kind == "number":
        return Val(x.col != 0, BOOL)
    c = F.lower(F.trim(_text(x, "to_bool")))
    return Val(F.when(c.isin("true", "1", "yes"), True).when(c.isin("false", "0", "no"), False).when(c.isNull(), None).otherwise(F.raise_error(F.lit("to_bool: not a boolean")).cast("boolean")), BOOL)


@function("type", 1)
def _(x):
    name = "string" if x.kind == "time" else x.kind
    return Val(F.when(x.col.isNull(), "null").otherwise(name), STRING)


# text

_BLANK = r"[\p{Z}\s\x{85}]+"


@function("len", 1)
def _(x):
    if x.kind == "array":
        return Val(F.size(x.col).cast("long"), LONG)
    if x.kind == "object":
        return Val(F.lit(len(x.type.fields)).cast("long") if isinstance(x.type, T.StructType) else F.size(x.col).cast("long"), LONG)
    return Val(F.char_length(_text(x, "len")).cast("long"), LONG)


@function("lower", 1)
def _(x):
    return Val(F.lower(_text(x, "lower")), STRING)


@function("upper", 1)
def _(x):
    return Val(F.upper(_text(x, "upper")), STRING)


@function("trim", 1)
def _(x):
    return Val(F.regexp_replace(_text(x, "trim"), f"^{_BLANK}|{_BLANK}$", ""), STRING)


@function("ltrim", 1)
def _(x):
    return Val(F.regexp_replace(_text(x, "ltrim"), f"^{_BLANK}", ""), STRING)


@function("rtrim", 1)
def _(x):
    return Val(F.regexp_replace(_text(x, "rtrim"), f"{_BLANK}$", ""), STRING)


@function("concat", 1, MANY)
def _(*args):
    if all(a.kind == "array" for a in args):
        return Val(F.concat(*[a.col for a in args]), args[0].type)
    return Val(F.concat_ws("", *[text_of(a) for a in args]), STRING)


@function("contains", 2)
def _(x, y):
    if x.kind == "array":
        return Val(F.exists(x.col, lambda e: e.eqNullSafe(y.col)), BOOL)
    return Val(F.contains(_text(x, "contains"), _text(y, "contains")), BOOL)


@function("starts_with", 2)
def _(x, y):
    return Val(F.startswith(_text(x, "starts_with"), _text(y, "starts_with")), BOOL)


@function("ends_with", 2)
def _(x, y):
    return Val(F.endswith(_text(x, "ends_with"), _text(y, "ends_with")), BOOL)


def _from(start, size):
    """A position from the front, 0-based, of one that may count from the end."""
    return F.greatest(F.when(start < 0, size + start).otherwise(start), F.lit(0)).cast("int")


@function("substr", 2, 3)
def _(x, start, n=None):
    c = _text(x, "substr")
    at = _from(start.col, F.char_length(c))
    size = F.char_length(c) if n is None else n.col.cast("int")
    return Val(F.substring(c, at + 1, F.greatest(size, F.lit(0))), STRING)


@function("split", 2)
def _(x, sep):
    c = _text(x, "split")
    if sep.const == "":
        return Val(F.filter(F.split(c, ""), lambda p: p != ""), T.ArrayType(STRING))
    quoted = F.lit("\\Q" + sep.const + "\\E") if sep.is_const else F.concat(F.lit("\\Q"), sep.col, F.lit("\\E"))
    return Val(F.split(c, quoted), T.ArrayType(STRING))


@function("replace", 3)
def _(x, find, put):
    if find.const == "":
        raise PlanFault("replace: the search text is empty")
    return Val(F.replace(_text(x, "replace"), find.col, put.col), STRING)


@function("index_of", 2)
def _(x, y):
    if x.kind == "array":
        return Val((F.array_position(x.col, y.col) - 1).cast("long"), LONG)
    return Val((F.instr(_text(x, "index_of"), y.col) - 1).cast("long"), LONG)


def _padded(name, f):
    @function(name, 2, 3)
    def _(x, width, fill=None):
        c, w = _text(x, name), width.col.cast("int")
        return Val(F.when(F.char_length(c) >= w, c).otherwise(f(c, w, F.lit(" ") if fill is None else fill.col)), STRING)


_padded("pad_left", F.lpad)
_padded("pad_right", F.rpad)


# arrays


@function("at", 2)
def _(x, i):
    at = F.when(i.col < 0, i.col).otherwise(i.col + 1).cast("int")
    return Val(F.try_element_at(x.col, at), x.type.elementType)


@function("slice", 2, 3)
def _(x, start, n=None):
    at = _from(start.col, F.size(x.col))
    size = F.size(x.col) if n is None else F.greatest(n.col.cast("int"), F.lit(0))
    return Val(F.slice(x.col, at + 1, size), x.type)


@function("reverse", 1)
def _(x):
    return Val(F.reverse(x.col), x.type)


@function("sort_array", 1, 2)
def _(x, direction=None):
    return Val(F.sort_array(x.col, asc=not (direction is not None and direction.const in ("desc", False))), x.type)


@function("unique", 1)
def _(x):
    return Val(F.array_distinct(x.col), x.type)


@function("flatten", 1)
def _(x):
    if not isinstance(x.type.elementType, T.ArrayType):
        return x
    return Val(F.flatten(x.col), x.type.elementType)


@function("range", 2, 3)
def _(start, stop, step=None):
    by = step if step is not None else lit(1)
    if by.const == 0:
        raise PlanFault("range: the step is zero")
    s, e, d = start.col.cast("long"), stop.col.cast("long"), by.col.cast("long")
    last = e - F.signum(d).cast("long")
    return Val(F.when((e - s) * d > 0, F.sequence(s, last, d)).otherwise(F.array().cast("array<bigint>")), T.ArrayType(LONG))


# objects


def _fields(x: Val):
    if not isinstance(x.type, T.StructType):
        return None
    return sorted(x.type.fieldNames())


@function("keys", 1)
def _(x):
    names = _fields(x)
    return Val(F.array(*map(F.lit, names)) if names is not None else F.array_sort(F.map_keys(x.col)), T.ArrayType(STRING))


@function("values", 1)
def _(x):
    names = _fields(x)
    if names is None:
        return Val(F.transform(F.array_sort(F.map_keys(x.col)), lambda k: F.element_at(x.col, k)), T.ArrayType(x.type.valueType))
    vals = [Val(x.col.getField(n), x.type[n].dataType) for n in names]
    t = common(vals)
    return Val(F.array(*[as_type(v, t) for v in vals]), T.ArrayType(t))


@function("merge", 1, MANY)
def _(*args):
    fields: dict = {}
    for a in args:
        if a.kind == "null":
            continue
        for f in a.type.fields:
            held = fields.get(f.name)
            c = a.col.getField(f.name)
            fields[f.name] = (F.when(a.col.isNull(), held[0]).otherwise(c) if held is not None and held[1] == f.dataType else c, f.dataType)
    return Val(F.struct(*[c.alias(n) for n, (c, _) in sorted(fields.items())]), T.StructType([T.StructField(n, t) for n, (_, t) in sorted(fields.items())]))


@function("get", 2, 3)
def _(x, key, default=None):
    if isinstance(x.type, T.MapType):
        v = Val(F.try_element_at(x.col, key.col), x.type.valueType)
    elif key.const in x.type.fieldNames():
        v = Val(x.col.getField(key.const), x.type[key.const].dataType)
    else:
        v = lit(None)
    return v if default is None else FUNCTIONS["coalesce"][2](v, default)


@function("has", 2)
def _(x, key):
    if isinstance(x.type, T.MapType):
        return Val(F.map_contains_key(x.col, key.col), BOOL)
    return Val(F.lit(key.const in x.type.fieldNames()), BOOL)


# dates, all in UTC

UNITS = {"millisecond": "MILLISECOND", "second": "SECOND", "minute": "MINUTE", "hour": "HOUR", "day": "DAY", "week": "WEEK", "month": "MONTH", "quarter": "QUARTER", "year": "YEAR"}


def unit(v: Val) -> str:
    name = str(v.const).lower()
    name = name[:-1] if name.endswith("s") and name[:-1] in UNITS else name
    if name not in UNITS:
        raise PlanFault(f"unknown date unit {v.const!r}")
    return name


@function("now", 0)
def _():
    return Val(F.unix_millis(F.current_timestamp()), LONG)


@function("parse_date", 1)
def _(x):
    return Val(millis(x), LONG)


@function("date_trunc", 2)
def _(x, u):
    return Val(F.unix_millis(F.date_trunc(UNITS[unit(u)], stamp(x))), LONG)


def added(ts, n, u: str):
    if u == "quarter":
        return F.timestamp_add("MONTH", n * 3, ts)
    return F.timestamp_add(UNITS[u], n, ts)


@function("date_add", 3)
def _(x, n, u):
    return Val(F.unix_millis(added(stamp(x), n.col.cast("int"), unit(u))), LONG)


def ordinal(ts, u: str):
    """The number of a timestamp's unit since the epoch: differences count the boundaries crossed."""
    if u in ("year", "quarter", "month"):
        months = F.year(ts) * 12 + F.month(ts) - 1
        return F.floor(months / {"year": 12, "quarter": 3, "month": 1}[u])
    size = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}[u]
    shift = 3 * 86_400_000 if u == "week" else 0  # the epoch was a Thursday
    return F.floor((F.unix_millis(ts) + shift) / size)


@function("date_diff", 3)
def _(a, b, u):
    name = unit(u)
    return Val((ordinal(stamp(b), name) - ordinal(stamp(a), name)).cast("long"), LONG)


_PARTS = {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "week": F.weekofyear, "day_of_year": F.dayofyear}


@function("date_part", 2)
def _(x, part):
    ts, name = stamp(x), str(part.const).lower()
    if name in _PARTS:
        c = _PARTS[name](ts)
    elif name == "second":
        c = F.second(ts)
    elif name == "millisecond":
        c = F.pmod(F.unix_millis(ts), F.lit(1000))
    elif name in ("weekday", "day_of_week"):
        c = F.weekday(ts) + 1
    else:
        raise PlanFault(f"date_part: unknown part {part.const!r}")
    return Val(c.cast("long"), LONG)


def _two(c):
    return F.lpad(c.cast("string"), 2, "0")


_FORMATS = {
    "Y": lambda t: F.lpad(F.year(t).cast("string"), 4, "0"),
    "m": lambda t: _two(F.month(t)),
    "d": lambda t: _two(F.dayofmonth(t)),
    "H": lambda t: _two(F.hour(t)),
    "M": lambda t: _two(F.minute(t)),
    "S": lambda t: _two(F.second(t)),
    "L": lambda t: F.lpad(F.pmod(F.unix_millis(t), F.lit(1000)).cast("string"), 3, "0"),
    "j": lambda t: F.lpad(F.dayofyear(t).cast("string"), 3, "0"),
    "u": lambda t: (F.weekday(t) + 1).cast("string"),
    "V": lambda t: _two(F.weekofyear(t)),
    "F": lambda t: F.date_format(t, "yyyy-MM-dd"),
    "T": lambda t: F.date_format(t, "HH:mm:ss"),
    "%": lambda t: F.lit("%"),
}


@function("date_format", 1, 2)
def _(x, pattern=None):
    ts = stamp(x)
    if pattern is None:
        return Val(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), STRING)
    parts, text, i = [], pattern.const, 0
    while i < len(text):
        if text[i] == "%" and i + 1 < len(text):
            if text[i + 1] not in _FORMATS:
                raise PlanFault(f"date_format: unknown %{text[i + 1]}")
            parts.append(_FORMATS[text[i + 1]](ts))
            i += 2
        else:
            j = text.find("%", i + 1)
            j = len(text) if j < 0 else j
            parts.append(F.lit(text[i:j]))
            i = j
    return Val(F.concat(*parts), STRING)


def _fiscal(x: Val, closing: Val):
    """(year, month) of the fiscal year that ends with the closing month; it is named after the calendar year of its end."""
    ts, c = stamp(x), closing.col.cast("int")
    month = F.month(ts)
    year = F.year(ts) + (month > c).cast("int")
    return year, F.pmod(month - c - 1, F.lit(12)) + 1, c


@function("fiscal_year", 2)
def _(x, closing):
    return Val(_fiscal(x, closing)[0].cast("long"), LONG)


@function("fiscal_month", 2)
def _(x, closing):
    return Val(_fiscal(x, closing)[1].cast("long"), LONG)


def _first_day(year, month):
    return F.make_date(year, month, F.lit(1)).cast("timestamp")


@function("fiscal_start", 2)
def _(x, closing):
    year, _m, c = _fiscal(x, closing)
    return Val(F.unix_millis(F.timestamp_add("MONTH", F.lit(-11), _first_day(year, c))), LONG)


@function("fiscal_end", 2)
def _(x, closing):
    year, _m, c = _fiscal(x, closing)
    return Val(F.unix_millis(F.last_day(_first_day(year, c)).cast("timestamp")), LONG)


@function("month_end", 1)
def _(x):
    return Val(F.unix_millis(F.last_day(stamp(x)).cast("timestamp")), LONG)


@function("days_in", 2)
def _(x, u):
    name = unit(u)
    begin = F.date_trunc(UNITS[name], stamp(x))
    return Val(F.datediff(added(begin, F.lit(1), name), begin).cast("long"), LONG)


#: Read by the compiler itself: they look at paths, not at values.
LAZY = {"exists": (1, 1), "optional": (1, 1), "bucket": (2, 3)}

assert len(FUNCTIONS) + len(LAZY) == 74, len(FUNCTIONS) + len(LAZY)
