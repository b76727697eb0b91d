"""Delimited text, fixed-width text and spreadsheets to typed frames, and a profile of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Delimiters that are tried, in order: fixed values.
DELIMITERS = (",", ";", "\t", "|")

#: Bytes that the encoding is guessed from, and those that Windows-1252 leaves undefined: fixed values.
PREFIX, UNDEFINED = 300_000, frozenset((0x81, 0x8D, 0x8F, 0x90, 0x9D))

#: Words that read as a boolean.
YES, NO = ("true", "yes", "y", "1", "oui", "ja", "si"), ("false", "no", "n", "0", "non", "nein")

#: Largest whole number that a 64-bit float holds exactly.
EXACT = 1 << 53


def guess_encoding(spark: SparkSession, path: str) -> str:
    """UTF-16 by its mark, UTF-8 where the beginning reads as such, else Windows-1252, or Latin-1 if that has no such byte."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s.getPath() for g in fs.globStatus(p) or () for s in (fs.listStatus(g.getPath()) if g.isDirectory() else [g])]
    for file in (f for f in files if not f.getName().startswith(("_", "."))):
        stream = fs.open(file)
        try:
            raw = bytes(stream.readNBytes(PREFIX))
        finally:
            stream.close()
        if raw.startswith((b"\xff\xfe", b"\xfe\xff")):
            return "UTF-16LE" if raw[0] == 0xFF else "UTF-16BE"
        try:
            raw.decode()
        except UnicodeDecodeError as e:
            if e.reason != "unexpected end of data":
                return "ISO-8859-1" if UNDEFINED & set(raw) else "windows-1252"
        break
    return "UTF-8"


def _csv(spark: SparkSession, path: str, encoding: str, **options) -> DataFrame:
    """The file's fields as text. Spark's reader does not know Windows-1252: it reads Latin-1, and the signs that differ are exchanged."""
    if encoding == "UTF-8":
        return spark.read.csv(path, **options)
    df = spark.read.csv(path, encoding="ISO-8859-1" if encoding == "windows-1252" else encoding, lineSep="\n", **options)
    if encoding == "windows-1252":
        bytes_ = [b for b in range(0x80, 0xA0) if b not in UNDEFINED]
        latin, signs = "".join(map(chr, bytes_)), bytes(bytes_).decode("cp1252")
        exchanged = str.maketrans(latin, signs)
        df = df.select(*[F.translate(F.col(f"`{c}`"), latin, signs).alias(c.translate(exchanged)) for c in df.columns])
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def guess_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The delimiter that splits the first lines into the same number of fields, most of them."""
    lines = [r[0] for r in _csv(spark, path, encoding, sep="\0", quote="").limit(20).collect() if r[0]]
    best, most = ",", 0
    for d in DELIMITERS:
        counts = [x.count(d) for x in lines]
        if counts and min(counts) == max(counts) > most:
            best, most = d, counts[0]
    return best


def read_csv(spark: SparkSession, path: str, delimiter: str | None = None, header: bool = True, encoding: str | None = None) -> DataFrame:
    """Columns become numbers only if every value is one: no leading zeros, whole numbers within +-2^53, decimal commas where
    fields are parted by semicolons. One pass over the file decides for all columns."""
    encoding = encoding or guess_encoding(spark, path)
    sep = delimiter or guess_delimiter(spark, path, encoding)
    return typed(_csv(spark, path, encoding, sep=sep, header=header, escape='"'), decimal_comma=sep == ";")


def mapped(raw: DataFrame, fields: dict[str, tuple]) -> DataFrame:
    """Columns by a mapping: name to (source column, kind, order). Kinds: string, number, date, month, boolean; what does not read is null.

    Dates that begin with their year are year-month-day; others go by ``order``: dmy (the default) or mdy. Years of two digits lie
    within 1970 to 2069; a bare number is a spreadsheet's day.
    """
    out = []
    for name, (source, kind, *order) in fields.items():
        text = F.trim(F.col(f"`{source}`").cast("string"))
        if kind == "number":
            plain = F.regexp_replace(text, r"[\s\u00A0\u202F']", "")
            value = F.when(plain.rlike(r"^[-+]?\d+([.,]\d+)?$"), F.replace(plain, F.lit(","), F.lit("."))).cast("double")
        elif kind in ("date", "month"):
            by_year, other = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})"
            at = {1: 3, 2: 1, 3: 2} if order[:1] == ["mdy"] else {1: 3, 2: 2, 3: 1}
            part = lambda i: F.when(text.rlike(by_year), F.regexp_extract(text, by_year, i)).otherwise(F.regexp_extract(text, other, at[i]))
            year = part(1)
            year = F.when(F.length(year) == 2, F.concat(F.when(year < "70", "20").otherwise("19"), year)).otherwise(year)
            spelled = F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0")))
            serial = F.when(text.rlike(r"^\d{1,6}$"), F.date_add(F.lit("1899-12-30").cast("date"), text.cast("int")))
            value = F.date_format(F.coalesce(serial, spelled), "yyyy-MM-dd" if kind == "date" else "yyyy-MM")
        elif kind == "boolean":
            value = F.when(F.lower(text).isin(*YES), F.lit(True)).when(F.lower(text).isin(*NO), F.lit(False))
        else:
            value = text
        out.append(value.alias(name))
    return raw.select(*out)


def typed(raw: DataFrame, decimal_comma: bool = False) -> DataFrame:
    number = r"^-?(0|[1-9]\d*)([.,]\d+)?$" if decimal_comma else r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"
    whole = r"^-?(0|[1-9]\d*)$"
    checks = []
    for c in raw.columns:
        v = F.col(f"`{c}`")
        filled = v.isNotNull() & (F.trim(v) != "")
        exact = F.abs(F.expr(f"try_cast(`{c}` AS DOUBLE)")) <= EXACT
        checks += [F.sum(filled.cast("int")).alias(f"{c}#n"), F.sum((filled & v.rlike(number)).cast("int")).alias(f"{c}#d"), F.sum((filled & v.rlike(whole) & exact).cast("int")).alias(f"{c}#i")]
    if not checks:
        return raw
    seen = raw.agg(*checks).first().asDict()
    out = []
    for c in raw.columns:
        n, v = seen[f"{c}#n"] or 0, F.col(f"`{c}`")
        blank = F.when(F.trim(v) != "", v)
        if n and seen[f"{c}#i"] == n:
            out.append(blank.cast("long").alias(c))
        elif n and seen[f"{c}#d"] == n:
            out.append((F.replace(blank, F.lit(","), F.lit(".")) if decimal_comma else blank).cast("double").alias(c))
        else:
            out.append(v.alias(c))
    return raw.select(*out)


def read_fixed(spark: SparkSession, path: str, widths: list[tuple[str, int]]) -> DataFrame:
    """Fields of given widths, trimmed, then typed."""
    columns, at = [], 1
    for name, width in widths:
        columns.append(F.trim(F.substring("value", at, width)).alias(name))
        at += width
    return typed(spark.read.text(path).select(*columns))


def read_excel(spark: SparkSession, path: str, sheet=0) -> DataFrame:
    """One sheet, read on the driver: a workbook holds a million rows at most. Needs a reader for the format to be installed."""
    import pandas as pd

    table = pd.read_excel(path, sheet_name=sheet, dtype=str)
    return typed(spark.createDataFrame(table.where(table.notna(), None).astype(object)))


def profile(df: DataFrame) -> DataFrame:
    """Per column: filled values, distinct values (about), least, greatest and a role: key, measure, date or label. One pass."""
    parts = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        date = v.cast("string").rlike(r"^\d{4}-\d{2}(-\d{2})?")
        parts.append(F.struct(F.lit(c).alias("name"), F.count(v).alias("filled"), F.approx_count_distinct(v).alias("distinct"), F.min(v).cast("string").alias("least"), F.max(v).cast("string").alias("greatest"), F.sum(date.cast("int")).alias("dates"), F.lit(dict(df.dtypes)[c]).alias("type")))
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*parts).alias("p")) if parts else df.agg(F.count(F.lit(1)).alias("rows"), F.array().alias("p"))
    rows = one.select("rows", F.explode("p").alias("c")).select("c.*", "rows")
    role = F.when((F.col("dates") == F.col("filled")) & (F.col("filled") > 0), "date").when(F.col("type").isin("double", "bigint", "int"), F.when(F.col("distinct") >= 0.95 * F.col("rows"), "key").otherwise("measure")).when(F.col("distinct") >= 0.95 * F.col("rows"), "key").otherwise("label")
    return rows.withColumn("role", role).drop("dates")
