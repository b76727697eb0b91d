"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.common import fresh, ship_file

#: A piece of rank r weighs (r + RANK_SHIFT) ** -EXPONENT: merge vocabularies rank their pieces by frequency but give no probabilities.
RANK_SHIFT, EXPONENT = 32.0, 1.0

#: Log weight of one byte of a character that has no piece.
BYTE_WEIGHT = -14.0

#: Bytes of a lattice that is held at once; longer runs without a space go block by block.
LATTICE = 1 << 15

#: Bytes of text that are sampled at once.
AT_ONCE = 1 << 18

_ODD = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """A vocabulary as bytes (spaces for the space sign), and its trie as one open hash table of (node, byte) to node."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.raw: list[bytes] = []
        self.byte_id = np.zeros(256, np.int32)
        plain = []
        for i in range(sp.vocab_size()):
            if sp.is_byte(i):
                b = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_id[b] = i
                self.raw.append(bytes([b]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"")
            else:
                self.raw.append(sp.id_to_piece(i).replace("▁", " ").encode())
                plain.append(i)
        self.weight = np.full(len(self.raw), BYTE_WEIGHT, np.float64)
        self.weight[plain] = -EXPONENT * np.log(np.arange(len(plain)) + RANK_SHIFT)
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i in plain:
            at = 0
            for b in self.raw[i]:
                at = nodes.setdefault((at, b), len(nodes) + 1)
            ends.setdefault(at, i)
        self.longest = max(len(self.raw[i]) for i in plain)
        self.end = np.full(len(nodes) + 1, -1, np.int32)
        for node, i in ends.items():
            self.end[node] = i
        self.bits = (4 * len(nodes)).bit_length()
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        keys = np.array([n << 8 | b for n, b in nodes], np.int64)
        for k, slot, to in zip(keys.tolist(), self._slot(keys).tolist(), nodes.values(), strict=True):
            while self.key[slot] >= 0:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.key[slot], self.to[slot] = k, to

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * _ODD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The child of each node, 0 where there is none."""
        keys = node.astype(np.int64) << 8 | byte
        slot, out = self._slot(keys), np.zeros(len(keys), np.int32)
        live = np.arange(len(keys))
        while len(live):
            found = self.key[slot[live]]
            hit = found == keys[live]
            out[live[hit]] = self.to[slot[live[hit]]]
            live = live[~hit & (found >= 0)]
            slot[live] = (slot[live] + 1) & ((1 << self.bits) - 1)
        return out

    def decode(self, ids) -> str:
        """The text of a sequence of pieces; the space put before the text goes."""
        return b"".join([self.raw[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


class Lattice:
    """All lattices of some distinct segments: forward weights, and for each end the edges with their cumulative shares."""

    def __init__(self, pieces: Pieces, segments: list[bytes], given: np.ndarray = np.zeros(1)):
        """``given``: forward weights of a lone segment's first nodes, of which only the first is needed."""
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        raw = np.frombuffer(b"".join(segments), np.uint8)
        self.base = np.cumsum(sizes) - sizes  # of bytes; nodes have one more a segment
        segment = np.repeat(np.arange(len(segments)), sizes)
        stop = (self.base + sizes)[segment]
        self.node0 = self.base + np.arange(len(segments))
        head = (raw & 0xC0) != 0x80
        start, node = np.flatnonzero(head), np.zeros(int(head.sum()), np.int32)
        begin, length, piece = [], [], []
        width = np.where(raw >= 0xF0, 4, np.where(raw >= 0xE0, 3, np.where(raw >= 0xC0, 2, 1)))
        alone = np.zeros(len(raw), bool)
        for n in range(1, pieces.longest + 1):
            inside = start + n <= stop[start]
            start, node = start[inside], node[inside]
            node = pieces.step(node, raw[start + n - 1])
            start, node = start[node > 0], node[node > 0]
            if not len(start):
                break
            i = pieces.end[node]
            hit = i >= 0
            begin.append(start[hit])
            length.append(np.full(int(hit.sum()), n))
            piece.append(i[hit])
            alone[start[hit][width[start[hit]] == n]] = True
        lead = np.flatnonzero(head & ~alone)
        spell = np.concatenate([lead + k for k in range(4)])
        keep = np.concatenate([width[lead] > k for k in range(4)])
        spell = spell[keep]
        begin.append(spell)
        length.append(np.ones(len(spell), np.int64))
        piece.append(pieces.byte_id[raw[spell]])
        begin, length, piece = map(np.concatenate, (begin, length, piece))
        offset = segment[begin] if len(begin) else begin
        end = begin + length - self.base[offset]
        order = np.lexsort((offset, end))
        begin, length, piece, offset, end = (x[order] for x in (begin, length, piece, offset, end))
        source, target = begin + offset, begin + offset + length
        forward = np.full(len(raw) + len(segments), -np.inf)
        forward[self.node0] = 0
        forward[: len(given)] = given if len(segments) else 0
        share = np.empty(len(begin))
        cut = np.searchsorted(end, np.arange(1, int(sizes.max()) + 2)) if len(sizes) else [0]
        for b, e in list(zip(cut[:-1], cut[1:], strict=True))[len(given) - 1 :]:
            if b == e:
                continue
            to = target[b:e]
            first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
            count = np.diff(np.r_[first, e - b])
            v = forward[source[b:e]] + pieces.weight[piece[b:e]]
            top = np.maximum.reduceat(v, first)
            top = np.where(np.isfinite(top), top, 0)
            w = np.exp(v - np.repeat(top, count))
            total = np.add.reduceat(w, first)
            with np.errstate(divide="ignore", invalid="ignore"):
                forward[to[first]] = top + np.log(total)
                c = np.cumsum(w)
                c -= np.repeat(c[first] - w[first], count)
                share[b:e] = c / np.repeat(total, count)
            share[b:e][first + count - 1] = 2.0
        self.forward = forward
        self.piece, self.length, self.share = piece.astype(np.int32), length.astype(np.int32), share
        self.edge = np.zeros(len(forward), np.int64)
        first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.empty(0, np.int64)
        self.edge[target[first]] = first

    def sample(self, segment: np.ndarray, size: np.ndarray, at: np.ndarray, key: np.ndarray, doc: np.ndarray, stop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(doc, end, piece) of sampled pieces, for occurrences of segments: ``at`` is where each begins, ``key`` seeds its draws.

        Each step draws the last piece of every prefix that is left, by its share of the forward weight, down to ``stop`` bytes.
        """
        docs, ends, found = [], [], []
        left = size.copy()
        while len(left):
            e = self.edge[self.node0[segment] + left]
            u = _uniform(key + (at + left).astype(np.uint64) * _ODD)
            live = np.flatnonzero(self.share[e] <= u)
            while len(live):
                e[live] += 1
                live = live[self.share[e[live]] <= u[live]]
            docs.append(doc)
            ends.append(at + left)
            found.append(self.piece[e])
            left = left - self.length[e]
            go = left > stop
            segment, left, at, key, doc = segment[go], left[go], at[go], key[go], doc[go]
        return np.concatenate(docs), np.concatenate(ends), np.concatenate(found)


def sample_long(pieces: Pieces, raw: bytes, at: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """(end, piece) of a segment of any length: what one lattice over it would give, with the memory of a block.

    Forwards each block starts from the weights of the last nodes before it, as many as a piece is long; backwards each is made
    again from these, and drawn from until a piece reaches into the block before.
    """
    held, given, begin = [], np.zeros(1), 0
    while begin < len(raw):
        end = min(len(raw), begin + LATTICE)
        while end < len(raw) and (raw[end] & 0xC0) == 0x80:
            end -= 1
        low = begin - len(given) + 1
        held.append((low, begin, end, given))
        given = Lattice(pieces, [raw[low:end]], given).forward[max(0, end - pieces.longest) - low : end - low + 1]
        begin = end
    ends, found, left = [], [], len(raw)
    for low, begin, end, given in reversed(held):
        one = lambda x, kind=np.int64: np.array([x], kind)
        _, e, p = Lattice(pieces, [raw[low:end]], given).sample(one(0), one(left - low), one(at + low), one(key, np.uint64), one(0), begin - low)
        ends.append(e)
        found.append(p)
        left = int(e[-1]) - at - len(pieces.raw[p[-1]])
    return np.concatenate(ends), np.concatenate(found)


def _uniform(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def segments_of(raw: bytes) -> list[bytes]:
    """Cuts before each space that follows another character."""
    out = []
    parts = raw.split(b" ")
    held = b""
    for p in parts[1:]:
        held += b" "
        if p:
            out.append(held + p)
            held = b""
    if held:
        out.append(held)
    return out


def encode_batch(pieces: Pieces, texts: list[str], keys: list[int]) -> list[np.ndarray]:
    """The sampled pieces of each text."""
    number: dict[bytes, int] = {}
    of, counts = [], []
    for t in texts:
        parts = segments_of(b" " + t.encode("utf-8", "surrogatepass")) if t else []
        of.extend([number.setdefault(s, len(number)) for s in parts])
        counts.append(len(parts))
    if not of:
        return [np.empty(0, np.int32) for _ in texts]
    distinct = list(number)
    lattice = Lattice(pieces, [s if len(s) <= LATTICE else b"" for s in distinct])
    sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
    segment = np.array(of, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    size = sizes[segment]
    place = np.cumsum(size) - size
    first = np.cumsum(counts) - counts
    begin = place - np.repeat(place[np.minimum(first, len(place) - 1)], counts)
    seeds = np.array(keys, np.uint64)[doc]
    short = size <= LATTICE
    drawn = [lattice.sample(segment[short], size[short], begin[short], seeds[short], doc[short])] if short.any() else []
    for i in np.flatnonzero(~short):
        ends, found = sample_long(pieces, distinct[segment[i]], int(begin[i]), int(seeds[i]))
        drawn.append((np.full(len(ends), doc[i]), ends, found))
    docs, ends, found = map(np.concatenate, zip(*drawn, strict=True))
    order = np.lexsort((ends, docs))
    return np.split(found[order], np.cumsum(np.bincount(docs, minlength=len(texts)))[:-1])


_LOADED: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def sample_pieces(docs: DataFrame, model: str, seed: int = 11, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` without their text, then pieces (array of ids), n_pieces, decoded_sha256 and lossless.

    Each whole text, with a space before it, is cut into lattices at its spaces, where no piece crosses; over each, however long, the forward weights of all its prefixes are
    summed, and pieces are drawn from its end by their shares. A draw is seeded by the row's id (without one by the text), so any
    rerun gives the same pieces. Characters that no piece covers go byte by byte, also the sign that stands for a space in the
    vocabulary, so decoding gives back every text. A null or empty text has no pieces and decodes to the empty text. Columns that
    are called like the new ones are replaced; an empty table gives an empty result. One pass; a task holds a bounded piece of text.
    """
    new = ("pieces", "n_pieces", "decoded_sha256", "lossless")
    columns = [c for c in docs.columns if c.lower() not in (*new, text_col.lower())]
    id_, t_ = fresh(docs, "id_to_seed", "text_to_cut")
    name = ship_file(docs.sparkSession, model)
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("lossless", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(SparkFiles.get(name))
        for batch in batches:
            texts, ids = [t or "" for t in batch.column(t_).to_pylist()], batch.column(id_).to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size + len(texts[end]) <= AT_ONCE):
                    size += len(texts[end])
                    end += 1
                part = texts[begin:end]
                keys = [xxhash.xxh3_64_intdigest(f"{seed}:{i}" if i is not None else f"{seed}:{t}".encode("utf-8", "surrogatepass")) for i, t in zip(ids[begin:end], part, strict=True)]
                found = encode_batch(pieces, part, keys)
                decoded = [pieces.decode(x.tolist()) for x in found]
                values = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in found])], pa.int32()), pa.array(np.concatenate(found)))
                sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in decoded]
                out = [*(batch.column(c).slice(begin, end - begin) for c in columns), values, pa.array([len(x) for x in found], pa.int64()), pa.array(sha), pa.array([a == b for a, b in zip(decoded, part, strict=True)])]
                yield pa.RecordBatch.from_arrays(out, names=[*columns, *new])
                begin = end

    rows = docs.select(*columns, F.col(id_col).cast("long").alias(id_), F.col(text_col).cast("string").alias(t_))
    return rows.mapInArrow(run, schema)
