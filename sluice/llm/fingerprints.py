"""Document fingerprints: a canonical exact digest, in DataFrame and SQL functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import small_or_shuffled, written

#: Rows of a block of neighbours, on average, and how many blocks the next level puts together.
BLOCK_ROWS, BLOCKS = 512, 512


def canonical(text: Column) -> Column:
    """Unicode compatibility composition, full case folding, runs of white space as one space, none at the ends.

    ASCII is its own normal form and folds to lower case, so only other texts go through the normaliser; again after they are folded.
    """
    composed = lambda t: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(True))
    folded = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed(text), F.lit(True))
    normal = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(composed(folded))
    return F.trim(F.regexp_replace(normal, r"[\s\u0085  -     　]+", " "))


def bucket(canon: Column) -> Column:
    """128 bits as 32 hexadecimal digits: two xxhash64 with different seeds."""
    return F.concat(F.lpad(F.lower(F.hex(F.xxhash64(canon))), 16, "0"), F.lpad(F.lower(F.hex(F.xxhash64(F.lit("wide"), canon))), 16, "0"))


def unconfirmed_buckets(docs: DataFrame, buckets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The buckets (of a frame with one row a document) in which canonical texts differ: two texts under one 128-bit hash.

    Only rows of buckets with several documents are looked at. The smallest and the largest canonical text of each are compared byte
    for byte; they are found with partial aggregates, so of a text that a third of all rows share each task passes on one.
    """
    shared = written(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), "shared-buckets")
    rows = docs.select(canonical(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("canon")).withColumn("bucket", bucket(F.col("canon")))
    members = rows.join(small_or_shuffled(shared, 64), "bucket", "left_semi")
    ends = members.groupBy("bucket").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return written(ends.filter("low <> high").select("bucket"), "unconfirmed-buckets")


def _completed(name: str, sha: str, bad: str) -> Column:
    return F.when(F.col(bad).isNull(), F.col(name)).otherwise(F.concat(name, F.lit("-"), sha))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint: equal fingerprints if and only if canonical texts are equal byte for byte.

    A bucket whose texts differ completes its members' fingerprints by their own SHA-256. Null texts count as empty, and empty texts
    equal one another; null and repeated ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    canon = canonical(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), bucket(canon).alias("bucket"), F.sha2(canon, 256).alias("sha"))
    rows = written(rows, "fingerprints")
    bad = small_or_shuffled(unconfirmed_buckets(docs, rows, id_col, text_col), 64).select("bucket", F.lit(1).alias("bad"))
    return rows.join(bad, "bucket", "left").select("doc_id", _completed("bucket", "sha", "bad").alias("fingerprint"))


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text: the text of the document with the next smaller id; after the smallest comes the largest.

    Documents are dealt into blocks, equal ranges of ids that hold BLOCK_ROWS on average however wide the ids lie apart, and each block
    is ordered by itself. Only a block's last row needs the first row of the next block that has any; these first rows, one a block,
    are linked by the same rule one level up, and the last level has one row for some hundred thousand documents. Rows that repeat an
    id follow one another. Rows without an id come last, in the order of their texts' hashes, in blocks of these.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("doc_id").alias("n")).first()
    step = (ids["most"] - ids["least"]) // (ids["n"] // BLOCK_ROWS + 1) + 1 if ids["n"] else 1
    below = math.floor((ids["least"] or 0) / step) - 1
    unnamed = F.lit(below) - F.shiftright(F.xxhash64("text"), 52) - 2048
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("doc_id") / F.lit(float(step))), unnamed))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    within = Window.partitionBy("block").orderBy(*order)
    linked = rows.withColumn("next_in", F.lead("text").over(within)).withColumn("last", F.lead(F.lit(1)).over(within).isNull())
    heads = rows.groupBy("block").agg(F.max("doc_id").alias("head_id"))
    upper = Window.partitionBy("hyper").orderBy(F.col("block").desc())
    heads = heads.withColumn("hyper", F.floor(F.col("block") / BLOCKS)).withColumn("to", F.lead("block").over(upper))
    tops = heads.groupBy("hyper").agg(F.max("block").alias("top"))
    tops = tops.withColumn("below", F.coalesce(F.lead("top").over(Window.orderBy(F.col("hyper").desc())), F.max("top").over(Window.partitionBy())))
    to = heads.join(tops.select("hyper", "below"), "hyper").select("block", F.coalesce("to", "below").alias("to"))
    first = rows.withColumn("rank", F.row_number().over(within)).filter("rank = 1").select(F.col("block").alias("to"), F.col("text").alias("head_text"))
    after = to.join(first, "to").select("block", "head_text")
    return linked.join(after, "block").select("doc_id", "text", F.when(F.col("last"), F.col("head_text")).otherwise(F.col("next_in")).alias("next_text"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every whole text.

    The edited text replaces the last half of a text by the start of its neighbour's. An exact digest knows equality only, so a
    likeness is 1.0 for canonical texts that agree byte for byte and 0.0 for all others.
    """
    half = F.floor(F.col("n_chars") / 2).cast("int")
    pairs = neighbours(docs, id_col, text_col).withColumn("n_chars", F.char_length("text").cast("long"))
    pairs = pairs.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half)))
    canon, edited, following = canonical(F.col("text")), canonical(F.col("edited")), canonical(F.col("next_text"))
    scored = pairs.select("doc_id", "n_chars", "edited", canon.alias("canon"), edited.alias("edited_canon"), following.alias("next_canon")).select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        bucket(F.col("canon")).alias("bucket"),
        bucket(F.col("edited_canon")).alias("edited_bucket"),
        F.sha2("canon", 256).alias("sha"),
        F.sha2("edited_canon", 256).alias("edited_sha"),
        (F.col("canon") == F.col("edited_canon")).cast("double").alias("near_edited"),
        (F.col("canon") == F.col("next_canon")).cast("double").alias("near_next"),
    )
    scored = written(scored, "scored")
    # edited texts are nowhere kept, so in their buckets, which are hardly ever shared, it is SHA-256 that must agree
    both = scored.select("bucket", "sha").union(scored.select("edited_bucket", "edited_sha")).groupBy("bucket").agg(F.min("sha").alias("low"), F.max("sha").alias("high"))
    unconfirmed = unconfirmed_buckets(docs, scored, id_col, text_col).union(both.filter("low <> high").select("bucket")).distinct()
    bad = small_or_shuffled(written(unconfirmed, "unconfirmed"), 64).select("bucket", F.lit(1).alias("bad"))
    joined = scored.join(bad, "bucket", "left").join(bad.select(F.col("bucket").alias("edited_bucket"), F.lit(1).alias("bad_edited")), "edited_bucket", "left")
    return joined.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _completed("bucket", "sha", "bad").alias("fingerprint"),
        _completed("edited_bucket", "edited_sha", "bad_edited").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
