"""Exact dedup, fingerprints, mixing, token counts and secret scans against brute force."""

import hashlib
import random
import re
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.llm import exact_dedup, fingerprints, mixing, secret_scan, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string"


def frame(spark, texts, ids=None, source="a"):
    ids = ids or range(1, len(texts) + 1)
    return spark.createDataFrame([(i, t, None, source, None, "x") for i, t in zip(ids, texts)], SCHEMA)


LONG = "Lorem ipsum dolor " * 20000
ODD = [None, "", "Hello World", "hello world", "HELLO WORLD", "É", "é", " ", LONG, LONG + "x", "Ｆullwidth  ﬁ\t\n", "fullwidth fi", "straße\u2028x", "STRASSE X", "ΟΔΟΣ", "οδος", "οδοσ", "ǅ ŉ"]
BIG = (1 << 53) + 1


def fold(t):
    return "".join(c.lower() if c.isascii() else c for c in t or "")


def test_exact_dedup(spark):
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, ODD)).collect()}
    groups = {}
    for i, t in enumerate(ODD, 1):
        groups.setdefault(fold(t), []).append(i)
    for ids in groups.values():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(fold(ODD[i - 1]).encode()).hexdigest()
    assert len(got) == len(ODD)


def test_exact_dedup_repeated_and_null_ids(spark):
    rows = exact_dedup.exact_dedup(frame(spark, ["a", "a", "a", "b"], [5, 5, None, None])).collect()
    assert sorted(r.kept for r in rows) == [False, False, True, True]
    kept = exact_dedup.survivors(frame(spark, ["a", "A", "a", "b", "b"], [5, 5, 3, 9, 9])).collect()
    assert sorted(r.doc_id for r in kept) == [5, 9] and kept[0].copy == "x"


def test_empty_tables(spark):
    none = frame(spark, ["x"]).filter("false")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert fingerprints.edited_likeness(none).count() == 0
    assert fingerprints.fingerprints(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert token_counts.token_counts(none, VOCAB).count() == 0
    assert secret_scan.scan(none).count() == 0


def canon(t):
    return re.sub(r"[\s\u0085  -     　]+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold())).strip(" ")


def test_fingerprints(spark):
    ids = [3, 700, 701, 1500, -2, 9000, 90001, 4, 5, BIG, 7, BIG + 2, -(1 << 60), 8, 1 << 62, 9, 10, 11]
    got = {r.doc_id: r for r in fingerprints.edited_likeness(frame(spark, ODD, ids)).collect()}
    order = sorted(ids, reverse=True)
    text = dict(zip(ids, (t or "" for t in ODD)))
    for at, i in enumerate(order):
        t, nxt = text[i], text[order[(at + 1) % len(order)]]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == float(canon(t) == canon(edited))
        assert got[i].near_next == float(canon(t) == canon(nxt))
        for j in ids:
            assert (got[i].fingerprint == got[j].fingerprint) == (canon(t) == canon(text[j])), (t, text[j])


@pytest.mark.parametrize("rows, blocks", [(2, 2), (512, 512)])
def test_neighbours_of_sparse_and_missing_ids(spark, monkeypatch, rows, blocks):
    """Ids in descending order, those that repeat and rows without one by the hashes of their texts; after the last comes the first."""
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", rows)
    monkeypatch.setattr(fingerprints, "BLOCKS", blocks)
    ids = [5, 7 << 50, -(9 << 55), 5, None, None, None, 0, 1 << 61, *range(40)]
    texts = [f"t{i}" for i in range(len(ids))]
    docs = frame(spark, texts, ids)
    order = [r.text for r in docs.selectExpr("text", "doc_id", "xxhash64(text) h").orderBy(F.desc_nulls_last("doc_id"), "h").collect()]
    got = {r.text: r.next_text for r in fingerprints.neighbours(docs).collect()}
    assert got == dict(zip(order, order[1:] + order[:1]))


def test_rows_without_ids_and_clashing_columns(spark):
    """A null id beside ids that no float can hold; repeated rows; columns that operators call theirs."""
    ids, texts = [None, BIG, BIG, BIG + 2], ["token=abcdef one", "two", "two", "three four"]
    docs = spark.createDataFrame([(i, t, "s", "a", 1, 2.0, "b", "c") for i, t in zip(ids, texts)], "doc_id long, text string, source string, Copy string, n int, mean double, of string, SHA string").coalesce(1)
    assert Counter((r.doc_id, r.n_words) for r in token_counts.token_counts(docs, VOCAB).collect()) == Counter([(None, 2), (BIG, 1), (BIG, 1), (BIG + 2, 2)])
    assert Counter((r.doc_id, r.n_assign) for r in secret_scan.scan(docs).collect()) == Counter([(None, 1), (BIG, 0), (BIG, 0), (BIG + 2, 0)])
    assert Counter((r.doc_id, r.kept) for r in exact_dedup.exact_dedup(docs).collect()) == Counter([(None, True), (BIG, True), (BIG, False), (BIG + 2, True)])
    assert Counter(r.doc_id for r in fingerprints.edited_likeness(docs).collect()) == Counter(ids)
    kept = exact_dedup.survivors(docs)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter({None: 1, BIG: 1, BIG + 2: 1})
    mixed = mixing.mix(docs, target_rows=400.0)
    assert mixed.columns == ["doc_id", "text", "source", "n", "mean", "of", "SHA", "copy", "shuffle_key"]
    assert {(r.doc_id, r.text) for r in mixed.collect()} == set(zip(ids, texts)) and mixed.filter("mean <> 2.0 or of <> 'b'").count() == 0


def test_mixing_means_and_reruns(spark):
    docs = spark.createDataFrame([(i, f"t{i}", None, "hot" if i % 3 == 0 else f"s{i % 5}", 1, "x") for i in range(6000)], SCHEMA)
    got = mixing.mix(docs, {"hot": 3.0, "s1": 1.0}, target_rows=8000)
    rows = got.collect()
    n = Counter(r.source for r in rows)
    assert set(n) == {"hot", "s1"} and abs(n["hot"] - 6000) < 400 and abs(n["s1"] - 2000) < 250
    assert Counter((r.doc_id, r.copy) for r in rows) == Counter((r.doc_id, r.copy) for r in mixing.mix(docs.repartition(7), {"hot": 3.0, "s1": 1.0}, target_rows=8000).collect())
    assert max(Counter((r.doc_id, r.copy) for r in rows).values()) == 1


def test_mixing_large_means(spark):
    docs = frame(spark, [f"t{i}" for i in range(40)], source=None)
    assert abs(mixing.mix(docs, None, target_rows=40 * 200.0).count() - 8000) < 450


VOCAB = "/opt/tokenizers/byte_bpe_50k.json"


def greedy(word, start, more):
    n, at = 0, 0
    while at < len(word):
        pieces = start if at == 0 else more
        for k in range(len(word) - at, 0, -1):
            if word[at : at + k] in pieces:
                n, at = n + 1, at + k
                break
        else:
            return 1
    return n


def test_token_counts(spark):
    start, more = map(set, token_counts.word_pieces(VOCAB))
    texts = [None, "", "  ", "The tokenizer's unbelievable words \t\n straße日本語", "x" * 5000, " ".join(random.Random(1).choices("ab the ing unthinkable qqqzzz".split(), k=500))]
    got = {r.doc_id: r for r in token_counts.token_counts(frame(spark, texts), VOCAB).collect()}
    for i, t in enumerate(texts, 1):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[i].n_words == len(words)
        assert got[i].n_tokens == sum(greedy(w.encode(), start, more) for w in words)


def test_longest_match_random_vocabularies():
    rng = random.Random(5)
    for _ in range(200):
        pieces = {bytes(rng.choices(b"ab", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        more = {bytes(rng.choices(b"ab", k=rng.randint(1, 5))) for _ in range(rng.randint(1, 8))}
        auto = token_counts.LongestMatch(sorted(pieces), sorted(more))
        for _ in range(40):
            w = bytes(rng.choices(b"ab", k=rng.randint(1, 12)))
            assert auto.count(w) == greedy(w, pieces, more), (w, pieces, more)


def brute_spans(t):
    out = []
    rules = ((r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I, 2, 6), (r"AKIA[A-Z0-9]+", 0, 0, 20), (r"[0-9a-f]+", 0, 0, 24))
    for k, (p, flags, group, least) in enumerate(rules):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t, flags) if len(m[group]) >= least]
    return sorted(out)


SECRETS = [
    None, "", "PassWord = 'abcdef12' token:short token:longenough", "api_key=" + "0123456789abcdef" * 3, "AKIA" + "A" * 15, "xAKIA" + "Z9" * 8 + "é", "é API-KEY apikey : \"q_w-e.r=\"",
    "deadbeef" * 3, "deadbee" * 3, "ſecret=abcdefgh toKen=abcdefgh", "secret secret=secret=abcdef passwd:passwd:abcdefg", "tok" * 9000 + "en=abcdefg",
]


def test_secret_scan(spark):
    got = {r.doc_id: r for r in secret_scan.scan(frame(spark, SECRETS)).collect()}
    kinds = ["assign", "access", "hex"]
    for i, t in enumerate(SECRETS, 1):
        spans = brute_spans(t or "")
        said = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (t, got[i], said)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(x[1] == k for x in spans) for k in range(3)]


@pytest.mark.parametrize("kind,text", [("private", "-----BEGIN RSA PRIVATE KEY-----"), ("github", "ghp_" + "aB3" * 12), ("slack", "xoxb-1234567890ab"), ("jwt", "eyJhbGciOiJI.eyJzdWIiOiIx.abcDEF12_-")])
def test_added_kinds_are_found_through_the_index(spark, kind, text):
    (row,) = secret_scan.scan(frame(spark, [f"see {text} here"])).collect()
    assert f"{kind}:4:{4 + len(text)}" in row.spans


def test_trigram_queries_never_miss():
    rng = random.Random(3)
    for rule in (*secret_scan.BASE, *secret_scan.MORE):
        query = secret_scan.trigram_query(rule.pattern)
        names = sorted(secret_scan._trigrams(query))
        for _ in range(50):
            filler = "".join(rng.choices("ab =:'\"", k=8))
            for s in ("Password=abc123", "api_key: 'xyzabc'", "AKIA" + "Q" * 17, "gho_" + "a" * 40, "xoxp-aaaaaaaaaaaa"):
                t = filler + s
                if rule.compiled().search(t):
                    import numpy as np

                    slots = np.zeros(1 << 24, dtype=np.int16)
                    for i, n in enumerate(names):
                        slots[int.from_bytes(n, "big")] = i + 1
                    assert secret_scan.Segment([t.encode()], slots, names).search(query)[0]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup_merges_sorted_rows(spark, keep):
    """Either end of the ids stays, a null id only where there is no other; each round sorts and merges."""
    rows = exact_dedup.exact_dedup(frame(spark, ["a"] * 500 + ["b", "b", "c"], [*range(BIG, BIG + 500), None, 4, None]), keep=keep)
    best = BIG + 499 if keep == "largest" else BIG
    assert Counter((r.keep_id, r.group_size, r.kept) for r in rows.collect()) == Counter({(best, 500, True): 1, (best, 500, False): 499, (4, 2, True): 1, (4, 2, False): 1, (None, 1, True): 1})
    assert rows._jdf.queryExecution().toString().count("SortAggregate") >= 8
