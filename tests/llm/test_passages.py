"""Suffix-array dedup, phrase automata and the induced sort against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sluice.llm import phrase_automata, repeats, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, d string, body string"


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, "x", "y") for i, t in zip(ids, texts)], SCHEMA)


def lcp(t, a, b, most):
    k = 0
    while k < most and a + k < len(t) and b + k < len(t) and t[a + k] == t[b + k]:
        k += 1
    return k


@pytest.mark.parametrize("memory", [1, 9, 10_000])
def test_induced_sort_in_any_memory(memory, tmp_path):
    rng = random.Random(memory)
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            parts += [rng.randint(2, 2 + rng.choice([1, 3, 255])) for _ in range(rng.randint(0, 40))] + [1]
        t = np.array([*parts, 0], np.uint16)
        out = [(int(p), int(x)) for b in suffix_dedup.InducedSort(t, 20, memory, str(tmp_path)).blocks() for p, x in b]
        order = sorted(range(len(t)), key=lambda i: list(t[i:]), reverse=True)
        assert [tuple(t[p : p + 20]) for p, _ in out] == [tuple(t[p : p + 20]) for p in order]
        assert sorted(p for p, _ in out) == list(range(len(t)))
        for (a, _), (b, x) in zip(out, out[1:]):
            assert x == lcp(t, a, b, 20)
    assert not list(tmp_path.iterdir())


def test_equal_windows_share_an_anchor():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 4, 60).astype(np.uint64)
    for _ in range(50):
        one = np.r_[rng.integers(0, 4, rng.integers(0, 80)).astype(np.uint64), shared, rng.integers(0, 4, rng.integers(0, 80)).astype(np.uint64)]
        other = np.r_[rng.integers(0, 4, rng.integers(0, 80)).astype(np.uint64), shared]
        a, b = (repeats.anchors(x, 35, 8) for x in (one, other))
        assert set(a[1]) & set(b[1])


def corpus(rng, glue=" ", n=40):
    base = [glue.join("w%d" % rng.randint(0, 5000) for _ in range(120)) for _ in range(6)]
    out = [None, "", " \t\n", "short text", "a" * 900, "ab " * 300]
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(1, 3)):
            b = rng.choice(base)
            i, j = sorted((rng.randint(0, len(b)), rng.randint(0, len(b))))
            parts.append(b[i:j] + glue.join("u%d" % rng.randint(0, 10**6) for _ in range(rng.randint(0, 30))))
        out.append("".join(parts) + rng.choice(["", "é", " ü\n"]))
    return out + out[6:9] + ["z" * 100_000 + out[10]]


def brute_bytes(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[k : k + window] for r in raw for k in range(len(r) - window + 1))
    for r in raw:
        keep, end, spans = bytearray(b"\1" * len(r)), -1, 0
        for k in range(len(r) - window + 1):
            if seen[r[k : k + window]] > 1:
                spans += k > end
                keep[k : k + window] = bytes(window)
                end = k + window
        kept = bytes(c for c, x in zip(r, keep) if x)
        yield len(r), len(r) - len(kept), spans, hashlib.sha256(kept).hexdigest()


def test_suffix_dedup(spark):
    texts = corpus(random.Random(2))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(frame(spark, texts)).collect()}
    for i, expected in enumerate(brute_bytes(texts, 200)):
        assert got[i] == expected, texts[i]
    assert sum(x[1] for x in got.values()) > 5000


def brute_words(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    for w in words:
        keep = [True] * len(w)
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                keep[k : k + window] = [False] * window
        kept = b" ".join(x for x, y in zip(w, keep) if y)
        yield len(w), len(w) - sum(keep), hashlib.sha256(kept).hexdigest()


def test_phrase_automata(spark):
    texts = corpus(random.Random(3))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in phrase_automata.substring_dedup(frame(spark, texts)).collect()}
    for i, expected in enumerate(brute_words(texts, 35)):
        assert got[i] == expected, texts[i]
    assert sum(x[1] for x in got.values()) > 500


def test_repeated_and_null_ids(spark):
    """A null id in the batch of ids that no float can hold; rows that repeat; columns with clashing names."""
    text, big = " ".join(f"w{i}" for i in range(90)), (1 << 53) + 1
    docs = frame(spark, [text, text, "solo", "solo"], [None, big, big + 2, big + 2]).coalesce(1)
    for rows in (suffix_dedup.suffix_dedup(docs).collect(), phrase_automata.substring_dedup(docs).collect()):
        assert Counter((r.doc_id, r.n_removed > 0) for r in rows) == Counter([(None, True), (big, True), (big + 2, False), (big + 2, False)])


@pytest.mark.parametrize("at_once", [1, 3, 64])
def test_anchors_in_pieces(monkeypatch, at_once):
    """Each window has the same anchor, whether a long document is looked at whole or in pieces."""
    units = np.random.default_rng(3).integers(0, 3, 900).astype(np.uint64)

    def anchor_of_window():
        found = {}
        for p, h, b, e in zip(*(x.tolist() for x in repeats.anchors(units, 35, 8))):
            found |= {s: (p, h) for s in range(b, e - 35 + 1)}
        return found

    whole = anchor_of_window()
    monkeypatch.setattr(repeats, "AT_ONCE", at_once)
    assert anchor_of_window() == whole and set(whole) == set(range(len(units) - 34))


def test_empty(spark):
    none = frame(spark, ["x"]).filter("false")
    assert suffix_dedup.suffix_dedup(none).count() == 0
    assert phrase_automata.substring_dedup(none).count() == 0
