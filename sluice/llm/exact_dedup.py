"""Exact deduplication by a tree merge of digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sluice.llm.common import fresh, lower_ascii, written

#: Runs at the leaves of the tree, and how many runs each round merges into one: 64 leaves take three rounds.
RUNS, FAN_IN = 64, 4


def digests(docs: DataFrame, normalise=lower_ascii, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, run, digest (32 bytes), n_bytes, check: the digest and two independent figures of each normalised text.

    A row's run depends on its id alone, so that a recomputed task deals it out alike.
    """
    text = normalise(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("t"))
    return rows.select(
        "doc_id",
        F.pmod(F.xxhash64(F.lit(7), F.coalesce("doc_id", F.lit(-1))), F.lit(RUNS)).cast("int").alias("run"),
        F.unhex(F.sha2("t", 256)).alias("digest"),
        F.octet_length("t").alias("n_bytes"),
        F.xxhash64("t").alias("check"),
    )


def merge_runs(leaves: DataFrame, better=F.max) -> DataFrame:
    """One row a distinct text: the id that stays and the number of rows.

    Each round halves the run number twice and merges the runs that meet; every level keeps one row a text and run. Length and
    second hash are part of what is merged on, so texts under one digest that differ in either never share a row. The id that stays
    is a struct, which Spark can only aggregate over sorted rows: a task sorts its run by digest, spilling sorted pieces that it
    merges, and drops equal neighbours before the run moves; the receiver brings its runs into one order and does the same.
    """
    key = ["digest", "n_bytes", "check"]
    level, runs = leaves, RUNS
    while runs > 1:
        runs = max(1, runs // FAN_IN)
        level = (
            level.withColumn("run", F.shiftright("run", FAN_IN.bit_length() - 1))
            .groupBy("run", *key)
            .agg(better("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        )
    return level.drop("run")


def exact_dedup(docs: DataFrame, keep: str = "largest", normalise=lower_ascii, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after ``normalise``; a null text counts as empty, and empty texts equal each other. Of equal texts
    the row with the largest (or smallest) id stays. Null ids lose to any other id; of rows that repeat both id and text one stays.
    Other columns are ignored. An empty table gives an empty result.

    One exchange deals out rows by text and run; the leaves are built from it, and the answer comes back down the tree: it is
    joined to leaves, which hold a text at most once a run, then to rows, where a text that a third of all rows share is spread over
    its runs.
    """
    better, order = (F.max, F.col("doc_id").desc_nulls_last()) if keep == "largest" else (F.min, F.col("doc_id").asc_nulls_last())
    key = ["digest", "n_bytes", "check"]
    rows = written(digests(docs, normalise, id_col, text_col), "digests")
    known = F.col("doc_id").isNotNull() if keep == "largest" else F.col("doc_id").isNull()
    leaves = rows.groupBy("run", *key).agg(better(F.struct(known.alias("known"), "doc_id")).alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    root = merge_runs(leaves, better).withColumn("keep_id", F.col("keep_id.doc_id"))
    answers = leaves.select("run", *key).join(root, key)
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("run", *key).orderBy(order)))
    return ranked.join(answers, ["run", *key]).select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        ((F.col("nth") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lower_ascii) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; texts move at most once, and only the ids of kept rows with them."""
    sha, kept_id, kept_sha, nth = fresh(docs, "sha", "kept_id", "kept_sha", "nth")
    tagged = docs.withColumn(sha, F.sha2(normalise(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256))
    kept = exact_dedup(docs, id_col=id_col, text_col=text_col, normalise=normalise).filter("kept")
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    joined = tagged.join(kept, F.col(id_col).cast("long").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi")
    repeated = Window.partitionBy(id_col, sha).orderBy(F.lit(0))
    return joined.withColumn(nth, F.row_number().over(repeated)).filter(F.col(nth) == 1).select(*docs.columns)
