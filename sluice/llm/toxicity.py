"""Toxicity by class-conditional Kneser-Ney models over byte n-grams."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import fresh, small_or_shuffled, written

#: Longest expression in bytes; words are scored with a space on both sides, A-Z folded.
ORDER = 7

#: Absolute discount.
DISCOUNT = 0.75

#: N-grams that a task adds up before it hands them on.
HELD_GRAMS = 1 << 18

#: Words whose ratios a task remembers, and bytes of text that it scores at once.
HELD_WORDS, AT_ONCE = 1 << 17, 1 << 20

#: N-grams of a model that is sent to all workers (12 bytes each); a larger model stays a table that words are joined with.
MOST_SENT = 6_000_000

#: Log ratios are whole numbers of this share, so that sums are the same in any order.
UNIT = 2.0**-24

#: Labelled rows from which the calibration weights are fitted, at most; those with the smallest hashes of their ids.
CALIBRATION_ROWS = 20_000

#: Words of the windows whose length-normalised ratios are looked at besides the whole text's.
WINDOWS = (1, 2, 4, 8)

#: Features of a text.
FEATURES = 2 + len(WINDOWS)

#: What stands before a word, so that its first byte has a context too.
_START = b"\0" * (ORDER - 2) + b" "


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, word): each byte of "word " with the ORDER - 1 bytes before it, from the word's start on, packed into one number."""
    padded = [_START + w + b" " for w in words]
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    raw = np.frombuffer(b"".join(padded), np.uint8).astype(np.uint64)
    code = np.zeros(max(0, len(raw) - ORDER + 1), np.uint64)
    for j in range(ORDER):
        code |= raw[j : len(raw) - ORDER + 1 + j] << np.uint64(8 * (ORDER - 1 - j))
    ends = np.cumsum(sizes)
    word = np.repeat(np.arange(len(words)), sizes)[: len(code)]
    inside = np.arange(len(code)) + ORDER <= ends[word]
    return code[inside], word[inside]


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def pieces_of(texts: list) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about AT_ONCE characters, or one text."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > AT_ONCE and i > begin:
            yield begin, i
            begin, size = i, len(t or "")
    if begin < len(texts):
        yield begin, len(texts)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, toxic, ordinary) over all rows of (t, toxic): each task adds up a bounded table, then one grouping adds the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def summed(parts):
            grams = np.concatenate([g for g, _ in parts])
            counts = np.concatenate([c for _, c in parts])
            keys, at = np.unique(grams, return_inverse=True)
            out = np.zeros((len(keys), 2), np.int64)
            np.add.at(out, at, counts)
            return keys, out

        held = []
        for batch in batches:
            for label in (0, 1):
                texts = batch["t"][batch["toxic"] == label].tolist()
                for begin, end in pieces_of(texts):
                    words = [w for t in texts[begin:end] for w in tokens(t)]
                    if words:
                        grams, n = np.unique(word_grams(words)[0], return_counts=True)
                        counts = np.zeros((len(grams), 2), np.int64)
                        counts[:, 1 - label] = n
                        held = [summed([*held, (grams, counts)])]
                        if len(held[0][0]) > HELD_GRAMS:
                            yield pd.DataFrame({"gram": held[0][0].view(np.int64), "toxic": held[0][1][:, 0], "ordinary": held[0][1][:, 1]})
                            held = []
        if held:
            grams, counts = summed(held)
            yield pd.DataFrame({"gram": grams.view(np.int64), "toxic": counts[:, 0], "ordinary": counts[:, 1]})

    found = texts.mapInPandas(run, "gram long, toxic long, ordinary long")
    return written(found.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary")), "grams")


def log_ratios(grams: DataFrame) -> DataFrame:
    """(gram, n, r) of all seen n-grams: their count, and the log ratio of what the two classes' models give them.

    P_c(w | h) = max(c_c(hw) - D, 0) / c_c(h) + D t(h) / c(h) * P(w | h'). The backoff is shared: t counts the distinct continuations
    of h in both classes, and P counts distinct contexts, in how many different n-grams of both classes the shorter one occurs. So
    what neither class has seen has a ratio of 1 and says nothing, however unequal the classes are.
    """
    d = DISCOUNT
    byte = F.lit(255)
    rows = grams.withColumn("h", F.shiftright("gram", 8)).withColumn("w", F.col("gram").bitwiseAND(byte))
    rows = rows.withColumn("tail", F.col("gram").bitwiseAND(F.lit((1 << (8 * (ORDER - 1))) - 1)))
    level = rows.groupBy("tail").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("tail", "g")  # contexts before each shorter n-gram
    lower = None
    chain = []
    for order in range(ORDER - 1, 0, -1):
        level = written(level, "level")  # each level is used several times
        chain.append(level)
        level = level.select(F.col("g").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n")) if order > 1 else level
    for level in reversed(chain):  # from single bytes up
        level = level.withColumn("gh", F.shiftright("g", 8))
        context = level.groupBy("gh").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"))
        joined = level.join(context, "gh")
        if lower is None:
            p = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("types") / 256.0) / F.col("total")
        else:
            shift = (1 << (8 * lower[1])) - 1
            joined = joined.withColumn("below", F.col("g").bitwiseAND(F.lit(shift))).join(lower[0], "below")
            p = (F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("types") * F.col("p_below")) / F.col("total")
        size = 1 if lower is None else lower[1] + 1
        lower = (written(joined.select(F.col("g").alias("below"), p.alias("p_below")), "backoff"), size)
    contexts = rows.groupBy("h").agg(F.sum("toxic").alias("ct"), F.sum("ordinary").alias("co"), F.count(F.lit(1)).alias("kinds"))
    seen = rows.join(contexts, "h").join(lower[0].withColumnRenamed("below", "tail"), "tail")
    share = lambda n, c: F.when(F.col(c) > 0, F.greatest(F.col(n) - d, F.lit(0.0)) / F.col(c)).otherwise(F.lit(0.0))
    shared = d * F.col("kinds") / (F.col("ct") + F.col("co")) * F.col("p_below")
    ratio = F.log((share("toxic", "ct") + shared) / (share("ordinary", "co") + shared))
    return written(seen.select("gram", (F.col("toxic") + F.col("ordinary")).alias("n"), F.round(ratio / UNIT).cast("long").alias("r")), "ratios")


def _bucket(gram: np.ndarray, bits: int) -> np.ndarray:
    x = gram.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)


class Table:
    """All n-grams of a model with their log ratios, as a hash table in three arrays."""

    def __init__(self, gram: np.ndarray, r: np.ndarray):
        self.bits = max(4, len(gram).bit_length())
        bucket = _bucket(gram, self.bits)
        order = np.argsort(bucket, kind="stable")
        self.gram, self.r = gram[order], r[order].astype(np.int32)
        self.start = np.searchsorted(bucket[order], np.arange((1 << self.bits) + 1)).astype(np.int32)

    def find(self, gram: np.ndarray) -> np.ndarray:
        """Log ratios; 0 for what was never seen."""
        bucket = _bucket(gram, self.bits)
        at, end = self.start[bucket], self.start[bucket + 1]
        r = np.zeros(len(gram), np.int64)
        live = np.flatnonzero(at < end)
        while len(live):
            hit = self.gram[at[live]] == gram[live]
            r[live[hit]] = self.r[at[live[hit]]]
            at[live] += 1
            live = live[~hit & (at[live] < end[live])]
        return r

    def words(self, words: list[bytes]) -> np.ndarray:
        """The log ratio of each word: the sum over its n-grams."""
        gram, word = word_grams(words)
        total = np.zeros(len(words), np.int64)
        np.add.at(total, word, self.find(gram.view(np.int64)))
        return total


def word_ratios(texts: DataFrame, ratios: DataFrame) -> DataFrame:
    """(word, r) of each distinct word of the one column of texts, by joins: what ``Table.words`` gives, for a model of any size."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: set = set()
        for batch in batches:
            for t in batch.column(0):
                held.update(tokens(t.as_py()))
                if len(held) > HELD_WORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["word"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["word"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram, word = word_grams(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(word)), pa.array(gram.view(np.int64))], names=["word", "gram"])

    words = texts.mapInArrow(distinct, "word binary").distinct()
    ratios = ratios.select("gram", "r")
    found = words.mapInArrow(spelled, "word binary, gram long").join(ratios, "gram", "left")
    return written(found.groupBy("word").agg(F.sum(F.coalesce("r", F.lit(0))).alias("r")), "word-ratios")


def features(r: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length-normalised log ratios (toxic over ordinary, a byte) of a text and of its most toxic window of each width; log of its words.

    ``r`` and ``sizes``: the log ratio and the bytes of each word, the space behind it included.
    """
    out = np.zeros(FEATURES)
    if len(r):
        value, size = np.r_[0, np.cumsum(r)], np.r_[0, np.cumsum(sizes)]
        out[0], out[-1] = value[-1] * UNIT / size[-1], math.log(len(r))
        for i, w in enumerate(WINDOWS, 1):
            w = min(w, len(r))
            out[i] = ((value[w:] - value[:-w]) / (size[w:] - size[:-w])).max() * UNIT
    return out


def described(docs: DataFrame, columns: list[str], ratios: DataFrame, text: str, feature: str) -> DataFrame:
    """The columns and an array of features for each row of ``docs`` (text in the column ``text``); texts stay where they are read
    if the model is small enough to be sent, else each row meets the ratios of its own words."""
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(feature, T.ArrayType(T.DoubleType()))])
    small = ratios.limit(MOST_SENT + 1).count() <= MOST_SENT
    if small:
        got = ratios.select("gram", F.col("r").cast("int").alias("r")).toArrow()
        sent = docs.sparkSession.sparkContext.broadcast(Table(got["gram"].to_numpy(), got["r"].to_numpy()))

    def values(texts, look):
        """``look(words)``: the ratios of words in a list."""
        out, known = [], {}
        for begin, end in pieces_of(texts):
            ws = [tokens(t) for t in texts[begin:end]]
            new = [w for w in set().union(*ws) if w not in known]
            known.update(zip(new, look(new).tolist(), strict=True))
            for w in ws:
                r = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
                out.append(features(r, np.fromiter(map(len, w), np.int64, len(w)) + 1))
            if len(known) > HELD_WORDS:
                known.clear()
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            if small:
                found = values(texts, sent.value.words)
            else:
                found = []
                for t, own in zip(texts, batch.column(words).to_pylist(), strict=True):
                    own = {x["word"]: x["r"] for x in own or ()}
                    found += values([t], lambda new, own=own: np.array([own[w] for w in new], np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.list_(pa.float64()))], names=[*columns, feature])

    if small:
        return docs.select(*dict.fromkeys([*columns, text])).mapInArrow(run, schema)
    row, words = fresh(docs, "row", "words")
    docs = written(docs.select(*dict.fromkeys([*columns, text])).withColumn(row, F.monotonically_increasing_id()), "rows")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = [list(set(tokens(t))) for t in batch.column(1).to_pylist()]
            rows = np.repeat(batch.column(0).to_numpy(), list(map(len, ws)))
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array([w for x in ws for w in x], pa.binary())], names=["row", "word"])

    pairs = docs.select(row, text).mapInArrow(own, "row long, word binary").join(word_ratios(docs.select(text), ratios), "word")
    pairs = pairs.groupBy(F.col("row").alias(row)).agg(F.collect_list(F.struct("word", "r")).alias(words))
    return docs.join(pairs, row, "left").drop(row).mapInArrow(run, schema)


@dataclass
class Model:
    """The log ratios of all n-grams, a written table, and the calibration: weights of the features, then a constant."""

    ratios: DataFrame
    weights: np.ndarray

    def score(self, feature: str):
        """The score as a column over the features."""
        z = F.lit(float(self.weights[-1]))
        for i in range(FEATURES):
            z = z + F.col(feature)[i] * float(self.weights[i])
        return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge; a constant of one class gives that class's rate."""
    if not len(y):
        return np.r_[np.zeros(x.shape[1]), -4.0]
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + penalty * w
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + penalty * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] /= scale
    w[-1] -= w[:-1] @ mean
    return w


def train(docs: DataFrame, labels: DataFrame, usable) -> Model:
    """A model from the labelled rows for which ``usable`` (a condition on doc_id) holds.

    A bounded number of them, by hashes of the ids, and one in five at most, calibrates the score over the counts of all others; then
    their own counts are added, so that the model's come from all usable rows. Rows without a label, with a null label or with labels
    that contradict each other teach nothing. Without any toxic rows all scores are low.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1) and doc_id is not null")
    marked = marked.filter(usable).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).filter("toxic = most").drop("most")
    marked = written(marked.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(5))), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("t")).filter(usable)
    sample = marked.filter("fold = 0").orderBy(F.xxhash64("doc_id", F.lit(3))).limit(CALIBRATION_ROWS).select("doc_id", "toxic")
    sample = F.broadcast(written(sample, "sample"))
    learn = texts.join(small_or_shuffled(written(marked.join(sample, "doc_id", "left_anti").select("doc_id", "toxic"), "learnt"), 48), "doc_id")
    held = written(texts.join(sample, "doc_id").select("doc_id", "t", "toxic"), "calibration")
    counts, rest = gram_counts(learn.select("t", "toxic")), gram_counts(held.select("t", "toxic"))
    got = described(held, ["doc_id", "toxic"], log_ratios(counts), "t", "x").toArrow().sort_by("doc_id")
    x = np.array(got["x"].to_pylist()).reshape(-1, FEATURES)
    whole = counts.union(rest).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    ratios = log_ratios(written(whole, "all-grams"))
    return Model(ratios, fit_weights(x, got["toxic"].to_numpy().astype(float)))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The columns of ``docs``, or those named, but score and predicted, then these: score in 0 to 1 and predicted = 1 from the threshold on.

    Whole texts are scored. Null, empty and blank texts score as a text without any evidence.
    """
    columns = [c for c in columns or docs.columns if c.lower() not in ("score", "predicted")]
    text, feature = fresh(docs, "text_to_score", "features")
    rows = described(docs.withColumn(text, F.col(text_col).cast("string")), columns, model.ratios, text, feature)
    rows = rows.select(*columns, model.score(feature).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


#: Rows of the third fold are never learnt from.
HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labelled rows that are not held out.

    Null ids are scored and never learnt from; rows that repeat an id repeat nothing but their own score; other columns are ignored;
    empty tables give an empty result.
    """
    model = train(docs, labels, F.expr(f"not ({HELD_OUT})"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(F.expr(HELD_OUT), F.lit(False)))
    scored = score(rows, model, threshold, columns=["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "score", "predicted")
