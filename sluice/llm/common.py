"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters that are folded where only A-Z count as upper case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word: anything but the space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"

#: Largest table, in bytes, that an operator sends to every executor; beyond it the same join is shuffled.
BROADCAST_BYTES = 16 << 20


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to this application's executors, once: their Python workers import it wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        name = os.path.join(tempfile.mkdtemp(prefix="package-"), "sluice_package.zip")
        with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(os.path.join(top, "sluice")):
                for f in files:
                    if f.endswith(".py"):
                        z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), top))
        spark.sparkContext.addPyFile(name)


def ship_file(spark: SparkSession, path: str) -> str:
    """Gives a file of the driver's machine to all executors; ``SparkFiles.get`` of the name returned finds it there."""
    key = f"{spark.sparkContext.applicationId} {path}"
    if key not in _SHIPPED:
        _SHIPPED.add(key)
        spark.sparkContext.addFile(path)
    return os.path.basename(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset and all run on this machine, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='checkpoint-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame written as a table in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more: what was made of them is a written table itself."""
    for df in tables:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(side: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a written join side for broadcast only if its counted rows fit the limit; else it stays as it is and the join shuffles."""
    return F.broadcast(side) if side.count() * row_bytes <= limit else side


def exact_id(id_col: str) -> list:
    """doc_id (0 without one) and no_id: pandas makes floats of a column with a null, which hold no id above 2^53."""
    ident = F.col(id_col).cast("long")
    return [F.coalesce(ident, F.lit(0)).alias("doc_id"), ident.isNull().alias("no_id")]


def with_nulls(df: DataFrame) -> DataFrame:
    """Makes the ids of ``exact_id`` null again."""
    return df.select(F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), *(c for c in df.columns if c not in ("doc_id", "no_id")))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """These names, changed where the frame has them already; names are compared without case, as Parquet and SQL do."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def lower_ascii(text):
    """Lower-cases A-Z only. Texts without other letters take the fast built-in, which does the same to them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
