"""Token counts by a linear longest-match automaton over a word-piece vocabulary."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import exact_id, ship_file, with_nulls

#: Words whose counts one task remembers; the memory is emptied when it is full.
REMEMBERED = 1 << 20

#: Code points that the byte alphabet of public byte-level vocabularies moves above 255; all other bytes stand for themselves.
_KEPT = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def byte_alphabet() -> dict[str, int]:
    """Character to byte: printable Latin-1 stands for itself, the other bytes follow from 256 on, in order."""
    moved = [b for b in range(256) if b not in set(_KEPT)]
    return {chr(b): b for b in _KEPT} | {chr(256 + i): b for i, b in enumerate(moved)}


def word_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-piece vocabulary from a byte-level BPE file: pieces that start a word, and pieces that go on.

    Tokens with a leading space start words, without it; all tokens without a space go on; every single byte does both, so no
    word is unknown.
    """
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet, start, more = byte_alphabet(), set(), set()
    for token in vocab:
        if all(c in alphabet for c in token):
            raw = bytes(alphabet[c] for c in token)
            if raw.startswith(b" ") and len(raw) > 1 and b" " not in raw[1:]:
                start.add(raw[1:])
            elif b" " not in raw:
                more.add(raw)
    single = {bytes([b]) for b in range(256)}
    return sorted(start | single), sorted(more | single)


class LongestMatch:
    """Trie over both kinds of pieces; each node has a failure link and the number of pieces that following it completes.

    Where no child fits, what has been read is a path v. The greedy longest-match pieces that v surely begins with are popped: their
    number is ``popped[v]``, and the rest of v is the path of ``fail[v]``, below the root of continuing pieces. Counts are added on
    the way; no piece is built. Each byte moves down once, so the work is linear in the word.
    """

    def __init__(self, start: Iterable[bytes], more: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}, {}]  # 0: a word's start, 1: inside a word
        final = [False, False]
        for root, pieces in ((0, start), (1, more)):
            for piece in pieces:
                at = root
                for b in piece:
                    nxt = self.children[at].get(b)
                    if nxt is None:
                        nxt = self.children[at][b] = len(self.children)
                        self.children.append({})
                        final.append(False)
                    at = nxt
                final[at] = True
        self.fail, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque([0, 1])
        while queue:
            at = queue.popleft()
            for b, child in self.children[at].items():
                if final[child]:
                    self.fail[child], self.popped[child] = 1, 1
                else:
                    z, n = self.fail[at], self.popped[at]
                    while z >= 0 and b not in self.children[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[child], self.popped[child] = self.children[z][b], n
                queue.append(child)

    def count(self, word: bytes) -> int:
        """Number of greedy pieces; a word that the vocabulary cannot cover counts as one unknown piece."""
        children, fail, popped = self.children, self.fail, self.popped
        at = n = 0
        for b in word:
            nxt = children[at].get(b)
            while nxt is None:
                n += popped[at]
                at = fail[at]
                if at < 0:
                    return 1
                nxt = children[at].get(b)
            at = nxt
        while at > 1:
            n += popped[at]
            at = fail[at]
            if at < 0:
                return 1
        return n


_BUILT: dict[str, LongestMatch] = {}


def automaton(path: str) -> LongestMatch:
    """The automaton of a vocabulary file, built once in each worker."""
    if path not in _BUILT:
        _BUILT[path] = LongestMatch(*word_pieces(path))
    return _BUILT[path]


#: The five ASCII control spaces become spaces, so that one split by spaces finds the words.
_SPACES = bytes.maketrans(b"\x09\x0a\x0b\x0c\x0d", b"     ")


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens of every whole text.

    Words are runs without ASCII spaces, taken as UTF-8; ``n_tokens`` sums their greedy word pieces. A null or empty text has no
    words. Rows that repeat are counted alike; other columns are ignored; an empty table gives an empty result. One pass without a
    shuffle; a task holds the automaton, one batch and a bounded memory of word counts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, known = automaton(SparkFiles.get(name)).count, {}
        for batch in batches:
            n_words, n_tokens = [], []
            for text in batch["t"]:
                words = text.encode().translate(_SPACES).split(b" ") if text else []
                total = empty = 0
                for w in words:
                    if not w:
                        empty += 1
                        continue
                    n = known.get(w)
                    if n is None:
                        n = count(w)
                        if len(w) <= 64:
                            if len(known) >= REMEMBERED:
                                known.clear()
                            known[w] = n
                    total += n
                n_words.append(len(words) - empty)
                n_tokens.append(total)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "no_id": batch["no_id"], "n_words": n_words, "n_tokens": n_tokens})

    name = ship_file(docs.sparkSession, vocabulary)
    rows = docs.select(*exact_id(id_col), F.col(text_col).cast("string").alias("t"))
    return with_nulls(rows.mapInPandas(run, "doc_id long, no_id boolean, n_words long, n_tokens long"))
