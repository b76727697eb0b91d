"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import BROADCAST_BYTES, fresh

#: A mean above this is drawn as a sum of independent draws, since exp(-mean) must not underflow.
LARGEST_MEAN = 64.0


def _uniform(seed: int, *parts) -> F.Column:
    """A number in (0, 1) from 52 bits of an MD5: the same on every engine and in every run."""
    text = F.concat_ws(":", F.lit(str(seed)), *parts)
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _inverse_poisson(u, mean) -> F.Column:
    """The smallest k whose cumulative Poisson probability reaches u, by the recurrence p(k+1) = p(k) * mean / (k+1)."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))

    def step(acc, i):
        p = acc["p"] * mean / i
        return F.when(acc["cdf"] >= u, acc).otherwise(F.struct(i.alias("k"), p.alias("p"), (acc["cdf"] + p).alias("cdf")))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["k"])


def source_means(docs: DataFrame, weights: dict[str, float] | None, target_rows: float | None, source_col: str) -> DataFrame:
    """Per source (of): n_rows and the mean number of copies that makes its expected share its weight."""
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("of")).agg(F.count(F.lit(1)).alias("n_rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "of string, weight double")
        counts = counts.join(F.broadcast(given), "of", "left").fillna({"weight": 0.0})
    total = counts.agg(F.sum("weight").alias("weight"), F.sum("n_rows").alias("rows")).first()
    rows = float(total["rows"] or 0) if target_rows is None else float(target_rows)
    mean = F.lit(rows) * F.col("weight") / F.lit(float(total["weight"])) / F.col("n_rows") if total["weight"] else F.lit(0.0)
    return counts.select("of", "n_rows", mean.alias("mean"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target_rows: float | None = None, seed: int = 17, source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Every document as often as its Poisson draw says, in a globally shuffled order: the input's columns, then copy and shuffle_key.

    ``weights`` maps sources to shares (None: all sources alike; a source that is not named gets none); ``target_rows`` is the
    expected size (None: that of the input). A document's draw is seeded by its id, so reruns and other partitionings agree; rows
    that repeat an id repeat its draw. A null source counts as the empty one, a null id as the empty text. Weights of zero give
    no rows. Columns of the input that are called copy or shuffle_key, in
    any case, are replaced. An empty table gives an empty result.

    Only source counts are aggregated, with partial sums, so a source with a third of the rows is no hot key. The table of means
    is sent to all executors if its rows are few enough, else it is joined by a shuffle. Texts move once, already replicated, dealt
    out by a hash of id and copy; sorting by that hash within partitions completes the shuffle.
    """
    means = source_means(docs, weights, target_rows, source_col)
    limit = BROADCAST_BYTES // 128
    of, mean, n = fresh(docs, "of", "mean", "n")
    side = means.select(F.col("of").alias(of), F.col("mean").alias(mean))
    side = F.broadcast(side) if means.limit(limit + 1).count() <= limit else side
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    parts = F.greatest(F.ceil(F.col(mean) / LARGEST_MEAN), F.lit(1)).cast("int")
    drawn = F.aggregate(
        F.sequence(F.lit(1), parts),
        F.lit(0),
        lambda acc, i: acc + _inverse_poisson(_uniform(seed, ident, i.cast("string")), F.col(mean) / parts),
    )
    columns = [c for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    joined = docs.select(*columns, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias(of)).join(side, of)
    copies = joined.withColumn(n, drawn).filter(F.col(n) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n))))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), ident, F.col("copy").cast("string"))))
    return keyed.select(*columns, "copy", "shuffle_key").repartition("shuffle_key").sortWithinPartitions("shuffle_key")


#: The same rows in SQL, for equal weights: one row for each document and copy.
ORACLE_SQL = """
WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
m AS (SELECT s, (SELECT sum(n) FROM n)::DOUBLE * 1.0 / (SELECT count(*) FROM n)::DOUBLE / n AS mean FROM n),
p AS (SELECT s, mean, greatest(ceil(mean / 64.0), 1)::INT AS parts FROM m),
k AS (SELECT s, mean, parts, k, exp(-mean / parts + k * ln(mean / parts) - lgamma(k + 1)) AS prob
      FROM p, generate_series(0, 400) AS g(k) WHERE k <= ceil(mean / parts + 12 * sqrt(mean / parts) + 30)),
c AS (SELECT s, k, sum(prob) OVER (PARTITION BY s ORDER BY k) AS cdf FROM k),
d AS (SELECT doc_id, text, lang, source, n_chars, s, unnest(generate_series(1, parts)) AS part
      FROM documents JOIN p ON p.s = coalesce(source, '')),
u AS (SELECT *, (('0x' || substr(md5('17:' || doc_id || ':' || part), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM d),
t AS (SELECT doc_id, any_value(text) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars,
      sum((SELECT count(*) FROM c WHERE c.s = u.s AND c.cdf < u.u))::INT AS n FROM u GROUP BY doc_id),
e AS (SELECT *, unnest(generate_series(1, n)) AS copy FROM t)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('order17:' || doc_id || ':' || copy) AS shuffle_key FROM e
"""
