"""What the two repeated-passage operators share: anchors that find every passage that may occur twice, and the covers of documents.

A unit is a byte or a word. Any window of ``window`` units holds the least of its ``gram``-unit hashes, its anchor, and equal windows
hold equal anchors at equal places. So a window can only occur twice if its anchor does; all else is out of the question, exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import BROADCAST_BYTES, discard, exact_id, written

_C = np.uint64(0xD6E8FEB86659FD93)
_LOW = np.uint64((1 << 28) - 1)

#: Windows of a document that are looked at at once; their positions fit the low bits.
AT_ONCE = 1 << 24

#: Anchors whose contexts one task is given, on average.
ANCHORS_A_SHARD = 16_000


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """Hash of each run of ``gram`` units (a power of two), by doubling."""
    h, m = (units + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    h ^= h >> np.uint64(31)
    while m < gram:
        g = h[:-m] * _C
        g += h[m:]
        g ^= g >> np.uint64(29)
        h, m = g * np.uint64(0xBF58476D1CE4E5B9), 2 * m
    h ^= h >> np.uint64(32)
    return h


def anchors(units: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(positions, hashes, begins, ends) of one document's anchors: the leftmost least gram of every window.

    ``begins`` and ``ends`` are where the windows of an anchor, which follow one another, begin first and end last.
    """
    if len(units) < window:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(units) > AT_ONCE + window:
        parts = [anchors(units[b : b + AT_ONCE + window - 1], window, gram) for b in range(0, len(units) - window + 1, AT_ONCE)]
        shift = lambda i: np.concatenate([p[i] + b * AT_ONCE for b, p in enumerate(parts)])
        return shift(0), np.concatenate([p[1] for p in parts]), shift(2), shift(3)
    h = gram_hashes(units, gram)
    w = window - gram + 1
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    pad = -len(key) % w
    rows = np.concatenate([key, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(key) - w + 1
    least = np.minimum(after[:n], before[w - 1 : w - 1 + n])
    begins = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    at = (least[begins] & _LOW).astype(np.int64)
    return at, h[at], begins, np.r_[begins[1:], n] - 1 + window


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, no_id, t, d: d is the hash of the text, by which copies are one text and rows need no id."""
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*exact_id(id_col), t.alias("t")).withColumn("d", F.xxhash64("t", F.octet_length("t")))


def repeated_anchors(rows: DataFrame, units_of: Callable[[str], np.ndarray], window: int, gram: int) -> DataFrame:
    """(d, at): for each distinct text its anchors that occur at another place too, copies of the text aside: place p, begin b, end e."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            a, d, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty((3, 0), np.int64)]
            for key, t in zip(batch["d"], batch["t"], strict=True):
                if key not in seen:
                    seen.add(key)
                    at, h, begins, ends = anchors(units_of(t), window, gram)
                    a.append(h)
                    places.append(np.stack([at, begins, ends]))
                    d.append(np.full(len(at), key))
            p, b, e = np.concatenate(places, axis=1).astype(np.int32)
            yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "d": np.concatenate(d), "p": p, "b": p - b, "e": e - p})

    found = written(rows.select("d", "t").mapInPandas(run, "a long, d long, p int, b int, e int"), "anchors")
    place = F.xxhash64("d", "p")
    again = found.groupBy("a").agg(F.min(place).alias("least"), F.max(place).alias("most")).filter("least <> most").select("a")
    again = written(again, "again")  # a join of two exchanges is one that Spark can split where a key is hot
    repeated = written(found.join(again, "a").groupBy("d").agg(F.sort_array(F.collect_set(F.struct("p", "b", "e"))).alias("at")), "repeated")
    discard(found, again)
    return repeated


#: Largest table of covers, in bytes, that is sent to every executor; beyond it the texts are shuffled to it.
COVER_BYTES = 6 * BROADCAST_BYTES


def bounded(side: DataFrame, array: str) -> DataFrame:
    """A written table with one array of runs (32 bytes each) a row, marked for broadcast only if it fits the limit; else it is joined by a shuffle."""
    size = side.agg((F.sum(F.size(array)) * 32 + F.count(F.lit(1)) * 96).alias("n")).first()["n"] or 0
    return F.broadcast(side) if size <= COVER_BYTES else side


def contexts(rows: DataFrame, repeated: DataFrame, cut: Callable[[str, np.ndarray], Iterator[tuple]], units_of, window: int, gram: int) -> DataFrame:
    """(a, d, start, ch, body): around each repeated anchor all windows that it is the anchor of; dealt out by anchor.

    ``start`` is the unit at which the context begins, ``body`` its bytes. A task that meets an anchor's equal context again leaves its body
    out (null) and sends the hash ``ch`` only, so that a passage in a third of all documents travels once a task. Contexts of one
    anchor and text that touch are one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        seen_text, seen_body = set(), set()
        for batch in batches:
            out = []
            for d, t, at in zip(batch["d"], batch["t"], batch["at"], strict=True):
                if d in seen_text:
                    continue
                seen_text.add(d)
                at, lo, hi = (np.array([x[c] for x in at], np.int64) for c in "pbe")
                lo, hi = at - lo, at + hi
                h = gram_hashes(units_of(t), gram)[at]
                order = np.lexsort((at, h))
                h, lo, hi = h[order], lo[order], hi[order]
                first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (lo[1:] > hi[:-1])])
                last = np.r_[first[1:], len(h)] - 1
                for a, s, body in zip(h[first].view(np.int64), lo[first], cut(t, np.stack([lo[first], hi[last]], 1)), strict=True):
                    ch = xxhash.xxh3_64_intdigest(body) >> 1
                    known = (a, ch) in seen_body
                    out.append((a, d, s, ch, None if known else body))
                    if not known and len(seen_body) < 1 << 20:
                        seen_body.add((a, ch))
            yield pd.DataFrame(out, columns=["a", "d", "start", "ch", "body"])

    joined = rows.select("d", "t").join(repeated.hint("merge"), "d")
    return joined.mapInPandas(run, "a long, d long, start int, ch long, body binary")


def shards(repeated: DataFrame) -> int:
    n = repeated.agg(F.sum(F.size("at")).alias("n")).first()["n"] or 0
    return max(1, -(-n // ANCHORS_A_SHARD))


def covers(spans: DataFrame, rows: DataFrame) -> DataFrame:
    """(d, runs): for each text the pieces to remove, as start and end; (0, -1) for a text of which there are copies."""
    own = spans.select("d", F.struct(F.col("b").cast("int").alias("b"), F.col("e").cast("int").alias("e")).alias("run"))
    copies = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d", F.struct(F.lit(0).alias("b"), F.lit(-1).alias("e")).alias("run"))
    return written(own.union(copies).groupBy("d").agg(F.sort_array(F.collect_set("run")).alias("runs")), "covers")


def merged(runs, n: int) -> np.ndarray:
    """Sorted maximal runs of units as rows (start, end), from overlapping ones; an end of -1 is the text's."""
    if not len(runs):
        return np.empty((0, 2), np.int64)
    b = np.array([r["b"] for r in runs], np.int64)
    e = np.array([r["e"] if r["e"] >= 0 else n for r in runs], np.int64)
    order = np.argsort(b, kind="stable")
    b, e = b[order], np.maximum.accumulate(e[order])
    new = np.r_[True, b[1:] > e[:-1]]
    return np.stack([b[new], e[np.r_[new[1:], True]]], 1)
