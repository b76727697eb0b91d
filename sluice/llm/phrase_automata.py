"""Substring dedup by automata of repeated phrases."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import repeats
from sluice.llm.common import with_nulls

#: Words of a window, and of the anchor that finds it.
WINDOW, GRAM = 35, 8

#: Windows that one automaton may hold: with one node a word at most, its size is bounded.
WINDOWS_AN_AUTOMATON = 6_000


def words_of(text: str) -> list[bytes]:
    """Runs without ASCII spaces, as UTF-8, unchanged."""
    return text.encode("utf-8", "surrogatepass").split()


def _units(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _cut(text: str, ends: np.ndarray) -> list[bytes]:
    words = words_of(text)
    return [b" ".join(words[b:e]) for b, e in ends]


class Passages:
    """The contexts of some anchors: where each begins, and each distinct one's words as numbers."""

    def __init__(self):
        self.body: dict[int, tuple[int, ...]] = {}
        self.places: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.number: dict[bytes, int] = {}

    def add(self, a: int, ch: int, d: int, start: int, body: bytes | None) -> None:
        self.places.setdefault(a, {}).setdefault(ch, []).append((d, start))
        if body is not None and ch not in self.body:
            number = self.number
            self.body[ch] = tuple([number.setdefault(w, len(number)) for w in body.split(b" ")])

    def confirmed(self, a: int, window: int) -> set[tuple[int, ...]]:
        """The windows of the anchor's contexts that begin at two places at least, compared word by word."""
        first: dict[tuple[int, ...], tuple[int, int]] = {}
        again = set()
        for ch, places in self.places[a].items():
            body, several = self.body[ch], len(set(places)) > 1
            d, start = places[0]
            for i in range(len(body) - window + 1):
                key = body[i : i + window]
                if key in again:
                    continue
                if several or first.setdefault(key, (d, start + i)) != (d, start + i):
                    again.add(key)
        return again

    def located(self, window: int) -> Iterator[tuple[int, int, int]]:
        """(d, begin, end) of every occurrence of a confirmed window, merged within a context."""
        held: list[int] = []
        phrases: set[tuple[int, ...]] = set()
        for a in self.places:
            phrases |= self.confirmed(a, window)
            held.append(a)
            if len(phrases) >= WINDOWS_AN_AUTOMATON:
                yield from self._stream(held, phrases, window)
                held, phrases = [], set()
        yield from self._stream(held, phrases, window)

    def _stream(self, held, phrases, window):
        if not phrases:
            return
        automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for p in phrases:
            automaton.add_word(p)
        automaton.make_automaton()
        done: dict[int, list[tuple[int, int]]] = {}
        for a in held:
            for ch, places in self.places[a].items():
                if ch not in done:
                    spans: list[tuple[int, int]] = []
                    for end, _ in automaton.iter(self.body[ch]):
                        b, e = end + 1 - window, end + 1
                        if spans and spans[-1][1] >= b:
                            spans[-1] = (spans[-1][0], e)
                        else:
                            spans.append((b, e))
                    done[ch] = spans
                for d, start in places:
                    for b, e in done[ch]:
                        yield d, start + b, start + e


def repeated_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, cover): the keyed documents, and for each text the word spans that a repeated window covers."""
    rows = repeats.keyed(docs, id_col, text_col)
    found = repeats.repeated_anchors(rows, _units, window, GRAM)
    pieces = repeats.contexts(rows, found, _cut, _units, window, GRAM)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Passages()
        for batch in batches:
            for row in zip(batch["a"], batch["ch"], batch["d"], batch["start"], batch["body"], strict=True):
                shard.add(*row)
        spans = list(shard.located(window))
        for i in range(0, len(spans), 100_000):
            yield pd.DataFrame(spans[i : i + 100_000], columns=["d", "b", "e"])

    spans = pieces.repartition(repeats.shards(found), "a").mapInPandas(run, "d long, b int, e int")
    return rows, repeats.covers(spans, rows)


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text: every document without the words that repeated windows cover.

    A word goes if a window of ``window`` consecutive words around it also begins anywhere else, in the same document too; windows
    are judged on the input. Kept words are joined by one space. A null, empty or blank text has no words; texts shorter than a window
    stay; of repeated rows nothing of a window's length stays, since each is elsewhere too; an empty table gives an empty result.

    Anchors that occur twice are found by one grouping of hashes. Their surroundings are dealt out by anchor; in each shard windows
    are confirmed word by word, compiled into automata of bounded size, and all surroundings streamed through them, which locates
    every occurrence.
    """
    rows, cover = repeated_words(docs, window, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, null, t, runs in zip(batch["doc_id"], batch["no_id"], batch["t"], batch["runs"], strict=True):
                words = words_of(t)
                n = len(words)
                kept = words
                if runs is not None and n >= window:
                    keep = np.ones(n, bool)
                    for b, e in repeats.merged(runs, n):
                        keep[b:e] = False
                    kept = [w for w, k in zip(words, keep, strict=True) if k]
                body = b" ".join(kept)
                out.append((i, null, n, n - len(kept), hashlib.sha256(body).hexdigest(), body.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(out, columns=["doc_id", "no_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    joined = rows.join(repeats.bounded(cover, "runs"), "d", "left").select("doc_id", "no_id", "t", "runs")
    return with_nulls(joined.mapInPandas(run, "doc_id long, no_id boolean, n_words long, n_removed long, kept_sha256 string, kept_text string"))
