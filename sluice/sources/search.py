"""Text search: an inverted word index as a table, with prefixes, one typo and rarity scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a passage, about.
PASSAGE = 1000


def index(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, id, hits): every word of every text, folded; a table to be written once and searched often."""
    words = F.split(F.lower(F.col(text_col)), r"[^\p{L}\p{N}]+")
    return df.select(F.col(id_col).alias("id"), F.explode(words).alias("word")).filter("word <> ''").groupBy("word", "id").agg(F.count(F.lit(1)).alias("hits"))


def search(words: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(id, score): rows that match every word of the query, as a prefix or with one typo, rare words counting more."""
    wanted = [w for w in query.lower().split() if w]
    spark = words.sparkSession
    terms = spark.createDataFrame([(i, w) for i, w in enumerate(wanted)], "term int, query string")
    total = words.select("id").distinct().count()
    vocabulary = words.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))
    near = F.startswith("word", F.col("query")) | ((F.char_length("query") > 3) & (F.levenshtein("word", "query", 1) >= 0))
    matched = vocabulary.join(F.broadcast(terms), near).withColumn("weight", F.log(F.lit(1.0 + total) / F.col("rows")) * F.when(F.col("word") == F.col("query"), 1.0).when(F.startswith("word", F.col("query")), 0.7).otherwise(0.4))
    scored = words.join(matched, "word").groupBy("id", "term").agg(F.max("weight").alias("w")).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("score"))
    return scored.filter(F.col("n") == len(wanted)).select("id", "score").orderBy(F.desc("score"), "id").limit(limit)


def passages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, nth, passage): texts cut into pieces of about PASSAGE characters, at white space."""
    cut = F.regexp_extract_all(text_col, F.lit(rf"(?s)(.{{1,{PASSAGE}}})(?:\s|$)|(.{{1,{PASSAGE}}})"), F.lit(0))
    return df.select(F.col(id_col).alias("id"), F.posexplode(cut).alias("nth", "passage"))
