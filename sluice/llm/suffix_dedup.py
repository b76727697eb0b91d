"""Suffix-array dedup: external induced sorting with common-prefix values."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm import repeats
from sluice.llm.common import with_nulls

#: Bytes of a repeated string, and of the anchor that finds it.
WINDOW, GRAM = 200, 32

#: Tuples that the queues of one sort hold in memory; more go to disk.
TUPLES_IN_MEMORY = 4 << 20

#: Symbols of a shard beyond which its text is mapped from disk.
MAPPED = 64 << 20

#: Symbols: end of all, end of a context, then the bytes.
END, STOP, SHIFT = 0, 1, 2


class SuffixQueues:
    """A disk-backed monotone priority queue of suffix tuples (position, common prefix with the tuple before).

    Sources come in suffix order, so tuples of one first symbol arrive in order: the queue is a row of tapes, one a symbol. A tape
    keeps its newest blocks in memory until the sort's share is used up; then its blocks go to the tape's file in the task's scratch
    folder, which ends with the sort, as a sort's spill files do.
    """

    def __init__(self, symbols: int, folder: str, memory: int):
        self.blocks: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.held, self.memory, self.folder = 0, memory, folder

    def push(self, symbol: int, positions: np.ndarray, lcp: np.ndarray) -> None:
        block = np.empty(len(positions), dtype=[("p", np.int64), ("l", np.int16)])
        block["p"], block["l"] = positions, lcp
        self.blocks[symbol].append(block)
        self.held += len(block)
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """Each tape's blocks in memory become one more file of the tape."""
        for symbol, blocks in enumerate(self.blocks):
            kept = [b for b in blocks if isinstance(b, np.ndarray)]
            if kept:
                name = f"{self.folder}/{symbol}-{len(blocks)}-{os.urandom(4).hex()}.npy"
                np.save(name, np.concatenate(kept))
                self.blocks[symbol] = [b for b in blocks if not isinstance(b, np.ndarray)] + [name]
        self.held = 0

    def pop(self, symbol: int) -> np.ndarray | None:
        """The oldest tuples of a symbol: whole blocks, together about a quarter of the memory at most."""
        taken, size = [], 0
        blocks = self.blocks[symbol]
        while blocks and size <= self.memory // 4:
            block = blocks.pop(0)
            if isinstance(block, str):
                name, block = block, np.load(block)
                os.unlink(name)
            else:
                self.held -= len(block)
            taken.append(block)
            size += len(block)
        return np.concatenate(taken) if taken else None


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Symbols that the suffixes at a and b have in common, at most ``most``; four at a time where the text goes on for so long."""
    out = np.full(len(a), most, np.int16)
    fours = np.ndarray(max(0, len(text) - 3), np.uint64, text.data, strides=(2,)) if len(text) > 3 else np.empty(0, np.uint64)
    live, done, n = np.flatnonzero(a != b), 0, len(text)
    while len(live) and done < most:
        x, y = a[live] + done, b[live] + done
        whole = np.maximum(x, y) < len(fours)
        differ = np.ones(len(live), np.int64)
        differ[whole] = (fours[x[whole]] ^ fours[y[whole]]).view(np.int64)
        for i in np.flatnonzero(~whole):  # at the end of the text
            k = 0
            while max(x[i], y[i]) + k < n and text[x[i] + k] == text[y[i] + k]:
                k += 1
            out[live[i]] = min(done + k, most)
        ends = np.flatnonzero(whole & (differ != 0))
        low = differ[ends] & -differ[ends]  # the lowest bit that differs is in the first symbol that does
        first = (low < 0).astype(np.int64) * 3 + np.where(low > 0, np.searchsorted(np.array([1 << 16, 1 << 32, 1 << 48]), low, "right"), 0)
        out[live[ends]] = np.minimum(done + first, most)
        live = live[whole & (differ == 0)]
        done += 4
    return out


def _order_of_leftmost(text: np.ndarray, falls: np.ndarray, stars: np.ndarray, most: int) -> np.ndarray:
    """Leftmost S-suffixes in suffix order: names of the substrings between them, then the order of the string of names."""
    n = len(text)
    bounds = np.r_[stars[1:], n - 1]
    size = bounds - stars + 1
    symbol = (text.astype(np.uint64) << np.uint64(1)) | (~falls).astype(np.uint64)
    rank, live = np.zeros(len(stars), np.int64), np.arange(len(stars))
    done = 0
    while len(live):
        key = np.zeros(len(live), np.uint64)
        for j in range(6):
            at = stars[live] + done + j
            inside = done + j < size[live]
            key = (key << np.uint64(10)) | np.where(inside, symbol[np.minimum(at, n - 1)] + np.uint64(1), np.uint64(0))
        order = np.lexsort((key, rank[live])) if done else np.argsort(key, kind="stable")
        r, k = rank[live][order], key[order]
        fresh = np.r_[True, (r[1:] != r[:-1]) | (k[1:] != k[:-1])]
        begin = np.r_[True, r[1:] != r[:-1]]
        start = np.maximum.accumulate(np.where(begin, np.arange(len(r)), 0))
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(r)), 0))
        rank[live[order]] = r + (first - start)
        done += 6
        live = live[size[live] > done]
    return _order_of_names(rank, most)


def _order_of_names(rank: np.ndarray, most: int) -> np.ndarray:
    """Suffix order of a string of names by doubling; the recursion's reduced strings end here. A name is the number of smaller ones.

    Only names that still tie are sorted again. A name stands for two symbols at least, so suffixes that tie after ``most`` symbols
    may come in any order: their common prefix is the longest that is asked for.
    """
    m, step = len(rank), 1
    live = np.arange(m)
    count = np.bincount(rank, minlength=m)
    live = live[count[rank] > 1]
    while len(live) and 2 * step <= most:  # so far names of 2 * step symbols at least are told apart
        behind = np.where(live + step < m, rank[np.minimum(live + step, m - 1)], -1)
        key = rank[live] * (m + 1) + behind + 1
        order = np.argsort(key, kind="stable")
        k = key[order]
        r = rank[live[order]]
        group = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        fresh = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        begin = np.repeat(group, np.diff(np.r_[group, len(r)]))
        size = np.diff(np.r_[fresh, len(k)])
        first = np.repeat(fresh, size)
        rank[live[order]] = r + first - begin
        live = np.sort(live[order][np.repeat(size, size) > 1])
        step *= 2
    return np.argsort(rank, kind="stable")


class InducedSort:
    """Suffix order of a text with common prefixes of neighbours (at most ``most``), by induction from leftmost S-suffixes.

    Two sweeps over the symbols: upwards each suffix hands its predecessor, if that is larger, to the queue of the predecessor's
    symbol; downwards likewise for smaller ones. With a tuple goes its common prefix with the tuple before it in the same queue: one
    more than the least common prefix among the sources between the two.
    """

    def __init__(self, text: np.ndarray, most: int, memory: int = TUPLES_IN_MEMORY, folder: str | None = None):
        self.text, self.most, self.memory = text, most, memory
        self.folder = tempfile.mkdtemp(prefix="induced-", dir=folder)
        self.symbols = int(text.max()) + 1 if len(text) else 1

    def _types(self) -> np.ndarray:
        """True for L: larger than the suffix that follows. Runs of one symbol take the type of their last."""
        t = self.text
        n = len(t)
        differs = np.flatnonzero(t[1:] != t[:-1])
        falls = np.zeros(n, bool)
        falls[: n - 1] = np.repeat(t[differs] > t[differs + 1], np.diff(np.r_[-1, differs]))
        return falls

    def _induce(self, block: np.ndarray, queues: SuffixQueues, least: np.ndarray, want: np.ndarray) -> None:
        """Hands on the predecessors of a block of sources. ``least``: the least common prefix since each symbol's last tuple."""
        p, lcp = block["p"].astype(np.int64), block["l"]
        if not len(p):
            return
        before = p - 1
        ok = (before >= 0) & want[np.maximum(before, 0)]
        symbol = np.where(ok, self.text[np.maximum(before, 0)], -1)
        order = np.argsort(symbol, kind="stable")
        cut = np.searchsorted(symbol[order], np.arange(self.symbols + 1))
        for s in np.flatnonzero(cut[1:] > cut[:-1]):
            at = order[cut[s] : cut[s + 1]]
            # the first tuple of the block also looks back to the symbol's last tuple in an earlier block
            low = np.minimum.reduceat(lcp[: at[-1] + 1], np.r_[0, at[:-1] + 1])
            low[0] = min(low[0], least[s])
            queues.push(int(s), before[at], np.minimum(low + 1, self.most))
            tail = lcp[at[-1] + 1 :]
            least[s] = tail.min() if len(tail) else self.most
        unseen = np.ones(self.symbols, bool)
        unseen[np.unique(symbol[ok])] = False
        least[unseen] = np.minimum(least[unseen], lcp.min())

    def _seam(self, last: int | None, block: np.ndarray) -> np.ndarray:
        """The block with the true common prefix of its first suffix and the suffix before it."""
        if len(block):
            block = block.copy()
            block["l"][0] = 0 if last is None else common_prefix(self.text, np.array([last]), block["p"][:1].astype(np.int64), self.most)[0]
        return block

    def blocks(self) -> Iterator[np.ndarray]:
        """Blocks of (p, l) in descending suffix order; l is the common prefix with the suffix emitted just before."""
        t = self.text
        n = len(t)
        falls = self._types()
        try:
            star = np.zeros(n, bool)
            star[1:] = ~falls[1:] & falls[:-1]
            stars = np.flatnonzero(star)
            ordered = stars[_order_of_leftmost(t, falls, stars, self.most)] if len(stars) else stars
            seed = np.zeros(len(ordered), dtype=[("p", np.int64), ("l", np.int16)])
            seed["p"] = ordered
            if len(ordered) > 1:
                for i in range(1, len(ordered), 1 << 16):
                    j = min(len(ordered), i + (1 << 16))
                    seed["l"][i:j] = common_prefix(t, ordered[i - 1 : j - 1], ordered[i:j], self.most)
            cut = np.searchsorted(t[ordered], np.arange(self.symbols + 1))
            up, larger = SuffixQueues(self.symbols, self.folder, self.memory), SuffixQueues(self.symbols, self.folder, self.memory)
            least, last = np.zeros(self.symbols, np.int16), None
            for s in range(self.symbols):
                while (block := up.pop(s)) is not None:
                    block = self._first(last, block, s)
                    larger.push(s, block["p"], block["l"])
                    last = int(block["p"][-1])
                    self._induce(block, up, least, falls)
                own = self._seam(last, seed[cut[s] : cut[s + 1]])
                if len(own):
                    last = int(own["p"][-1])
                    self._induce(own, up, least, falls)
            down, least, last = SuffixQueues(self.symbols, self.folder, self.memory), np.zeros(self.symbols, np.int16), None
            for s in range(self.symbols - 1, -1, -1):
                while (block := down.pop(s)) is not None:
                    block = self._first(last, block, s)
                    yield block
                    last = int(block["p"][-1])
                    self._induce(block, down, least, ~falls)
                held = []
                while (block := larger.pop(s)) is not None:
                    held.append(block)
                if s == END:
                    held.append(np.array([(n - 1, 0)], dtype=seed.dtype))
                if held:
                    block = self._reversed(last, np.concatenate(held))
                    yield block
                    last = int(block["p"][-1])
                    self._induce(block, down, least, ~falls)
        finally:
            shutil.rmtree(self.folder, ignore_errors=True)

    def _first(self, last: int | None, block: np.ndarray, symbol: int) -> np.ndarray:
        """A block's first tuple follows another kind of suffix, or another symbol, where its symbol's bucket begins."""
        if last is None or self.text[last] != symbol:
            return self._seam(last, block)
        return block

    def _reversed(self, last: int | None, block: np.ndarray) -> np.ndarray:
        out = block[::-1].copy()
        out["l"][1:] = block["l"][::-1][:-1]
        return self._seam(last, out)


def _array(n: int, kind, folder: str) -> np.ndarray:
    """Zeros in memory, or mapped from a scratch file beyond MAPPED items."""
    return np.zeros(n, kind) if n <= MAPPED else np.memmap(f"{folder}/{np.dtype(kind).name}", kind, "w+", shape=(n,))


class Contexts:
    """The distinct contexts of a shard, and the places of each."""

    def __init__(self):
        self.body: dict[int, bytes] = {}
        self.places: dict[int, list[tuple[int, int]]] = {}
        self.anchors: dict[int, set[int]] = {}

    def add(self, a: int, ch: int, d: int, start: int, body: bytes | None) -> None:
        self.places.setdefault(ch, []).append((d, start))
        self.anchors.setdefault(a, set()).add(ch)
        if body is not None:
            self.body.setdefault(ch, body)

    def spans(self, window: int, memory: int = TUPLES_IN_MEMORY) -> Iterator[tuple[int, int, int]]:
        """(d, begin, end) of what repeated strings cover. Contexts at several places are covered whole; in the others a string
        counts if it begins at two different places. Strings of an anchor are in its contexts only, so an anchor whose contexts are
        all the same, at several places, needs no sorting."""
        alike = {next(iter(chs)) for chs in self.anchors.values() if len(chs) == 1}
        alike -= {ch for chs in self.anchors.values() if len(chs) > 1 for ch in chs}
        alike = {ch for ch in alike if len(set(self.places[ch])) > 1}
        for ch in alike:
            for d, s in self.places[ch]:
                yield d, s, s + len(self.body[ch])
        keys = [k for k in self.body if k not in alike]
        if not keys:
            return
        sizes = np.array([len(self.body[k]) for k in keys], np.int64)
        several = np.array([len(set(self.places[k])) > 1 for k in keys], bool)
        begin = np.cumsum(np.r_[0, sizes + 1])[:-1]
        total = int((sizes + 1).sum()) + 1
        folder = tempfile.mkdtemp(prefix="shard-")
        try:
            text, owner, covered = (_array(total, kind, folder) for kind in (np.uint16, np.int32, np.bool_))
            for i, (b, k, m) in enumerate(zip(begin, keys, sizes, strict=True)):
                text[b : b + m] = np.frombuffer(self.body[k], np.uint8)
                text[b : b + m] += SHIFT
                text[b + m] = STOP
                owner[b : b + m + 1] = i
            text[-1], owner[-1] = END, len(keys)
            first = np.array([*(self.places[k][0] for k in keys), (0, 0)], np.int64)
            ends, starts = np.r_[begin + sizes, total - 1], np.r_[begin, total - 1]
            repeated = np.r_[several, False]

            def close(p: np.ndarray, at: np.ndarray) -> None:
                """Suffixes in order, and where each group of those that share a string of the window's length begins among them."""
                own = owner[p]
                place = first[own, 0] * np.int64(1_000_003) + first[own, 1] + (p - starts[own])
                again = (np.minimum.reduceat(place, at) != np.maximum.reduceat(place, at)) | np.logical_or.reduceat(repeated[own], at)
                again &= ends[own[at]] - p[at] >= window  # all of a group are long enough, or none
                covered[p[np.repeat(again, np.diff(np.r_[at, len(p)]))]] = True

            tail = np.empty(0, np.int64)
            for block in InducedSort(text, window, memory, folder).blocks():
                p = np.r_[tail, block["p"]]
                new = len(tail) + np.flatnonzero(block["l"] < window)
                if not len(new):
                    tail = p
                    continue
                at = np.r_[0, new[new > 0]]
                if len(at) > 1:
                    close(p[: at[-1]], at[:-1])
                tail = p[at[-1] :]
            if len(tail):
                close(tail, np.zeros(1, np.int64))
            at = np.flatnonzero(covered)
            at = at[~repeated[owner[at]]]
            own = owner[at]
        finally:
            shutil.rmtree(folder, ignore_errors=True)
        for i in np.flatnonzero(several):
            for d, s in self.places[keys[i]]:
                yield d, s, s + int(sizes[i])
        if len(at):
            new = np.r_[True, (own[1:] != own[:-1]) | (at[1:] > at[:-1] + window)]
            for o, x, y in zip(own[new], at[new], at[np.r_[new[1:], True]] + window, strict=True):
                yield int(first[o, 0]), int(first[o, 1] + x - begin[o]), int(first[o, 1] + y - begin[o])


def bytes_of(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _units(text: str) -> np.ndarray:
    return np.frombuffer(bytes_of(text), np.uint8).astype(np.uint64)


def _cut(text: str, ends: np.ndarray) -> list[bytes]:
    raw = bytes_of(text)
    return [raw[b:e] for b, e in ends]


def repeated_bytes(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, cover): the keyed documents, and for each text the byte spans that a repeated string covers."""
    rows = repeats.keyed(docs, id_col, text_col)
    found = repeats.repeated_anchors(rows, _units, window, GRAM)
    pieces = repeats.contexts(rows, found, _cut, _units, window, GRAM)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Contexts()
        for batch in batches:
            for row in zip(batch["a"], batch["ch"], batch["d"], batch["start"], batch["body"], strict=True):
                shard.add(*row)
        spans = list(shard.spans(window))
        for i in range(0, len(spans), 100_000):
            yield pd.DataFrame(spans[i : i + 100_000], columns=["d", "b", "e"])

    spans = pieces.repartition(repeats.shards(found), "a").mapInPandas(run, "d long, b int, e int")
    return rows, repeats.covers(spans, rows)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary): every document without its repeated bytes.

    A byte goes if a string of ``window`` bytes over it also begins anywhere else, in the same document too; strings are judged on
    the input and never cross documents. Spans are the maximal removed runs. A null text counts as empty; texts shorter than a
    window stay; of repeated rows nothing of a window's length stays, since each is elsewhere too; an empty table gives an empty result.

    Anchors that occur twice are found by one grouping of hashes. Their surroundings are dealt out by anchor, and each shard's
    distinct surroundings are sorted as suffixes with their common prefixes: neighbours that share a window are repeats.
    """
    rows, cover = repeated_bytes(docs, window, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, null, t, runs in zip(batch["doc_id"], batch["no_id"], batch["t"], batch["runs"], strict=True):
                raw = bytes_of(t)
                n, gone, kept = len(raw), np.empty((0, 2), np.int64), raw
                if runs is not None and n >= window:
                    gone = repeats.merged(runs, n)
                    edges = np.r_[0, gone.ravel(), n].reshape(-1, 2)
                    kept = b"".join([raw[b:e] for b, e in edges])
                out.append((i, null, n, n - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["doc_id", "no_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = rows.join(repeats.bounded(cover, "runs"), "d", "left").select("doc_id", "no_id", "t", "runs")
    return with_nulls(joined.mapInPandas(run, "doc_id long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))
