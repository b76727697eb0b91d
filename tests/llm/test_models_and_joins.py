"""Toxicity, piece sampling, the Jaccard join and the pipeline."""

import functools
import math
import random
from collections import Counter

import numpy as np
import pytest

from sluice.llm import jaccard_join, piece_sampling, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in zip(ids, texts)], SCHEMA)


def sets_of(texts):
    out = []
    for t in texts:
        w = "".join(c.lower() if c.isascii() else c for c in t or "").encode().split()
        out.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(texts, ids):
    sets, parent = sets_of(texts), list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[find(i)]) for i in range(len(texts))}


def near_copies(rng, n):
    line = [f"common{i}" for i in range(30)]
    out = [None, "", "  ", "one two", "One TWO", "one two three"]
    for _ in range(n):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(5, 200))] + rng.choice([[], line])
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 40))):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            out.append(" ".join(copy[rng.randint(0, 2) :]))
    return out


def test_jaccard_components(spark):
    texts = near_copies(random.Random(1), 60)
    ids = random.Random(2).sample(range(10**9), len(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, texts, ids)).collect()}
    assert got == brute_components(texts, ids)


@pytest.mark.parametrize("block, run", [(1 << 19, 1 << 18), (700, 1 << 18), (700, 16)])
def test_jaccard_families(spark, monkeypatch, block, run):
    """Families whose members link to some others only, each in a component of many or of one; groups cut into blocks, tokens into parts."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", block)
    monkeypatch.setattr(jaccard_join, "RUN_SETS", run)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(70):
        copy = list(base)
        for k in rng.sample(range(120), rng.randint(0, 5)):
            copy[k] = f"e{rng.randint(0, 10**6)}"
        texts.append(" ".join(copy[rng.randint(0, 9) :]))
    texts += [" ".join([f"x{i}_{j}" for j in range(60)] + base[:40]) for i in range(60)]
    ids = list(range(100, 100 + len(texts)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, texts, ids)).collect()}
    assert got == brute_components(texts, ids)
    assert len({c for _, c in got.values()}) > 60


def test_jaccard_long_text(spark):
    words = [f"w{i}" for i in range(60_000)]
    texts = [" ".join(words), " ".join(words[3000:]), " ".join(words[20_000:]), "w1 w2"]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, texts)).collect()}
    assert got == brute_components(texts, range(4))


def test_jaccard_counts_every_text(spark, monkeypatch):
    """All texts are on the counters, copies within a task once; a token is hot beyond RUN_SETS sets, counted and not estimated."""
    monkeypatch.setattr(jaccard_join, "RUN_SETS", 10)
    texts = [f"u{i} many" + " few" * (i < 10) for i in range(11)] + [None, ""]
    want = np.zeros(jaccard_join.SLOTS, np.int64)
    for t in texts:
        np.add.at(want, (jaccard_join.shingle_set(t, 1) % jaccard_join.SLOTS).astype(np.int64), 1)
    spread = jaccard_join._keyed(frame(spark, texts), "doc_id", "text").repartition(3)
    copied = jaccard_join._keyed(frame(spark, texts + texts), "doc_id", "text").coalesce(1)
    for docs in (spread, copied):
        assert (jaccard_join.token_counts(docs, 1) == want).all()
        found = [r for r in jaccard_join.described(docs, 1, 1).collect() if r.hot is not None]
        many, few = (int(jaccard_join.shingle_set(w, 1).view(np.int64)[0]) for w in ("many", "few"))
        assert len(found) == 11 and all(r.hot == [many] for r in found)
        assert sum(few in r.toks for r in found) == 10


BIG = (1 << 53) + 1


def test_jaccard_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = jaccard_join.jaccard_components(frame(spark, [text, text + " z", "other words", text], [None, BIG, BIG, BIG + 2]).coalesce(1)).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter([(None, BIG), (BIG, BIG), (BIG, BIG), (BIG + 2, BIG)])
    assert jaccard_join.jaccard_components(frame(spark, ["x"]).filter("false")).count() == 0


def test_jaccard_survivors(spark):
    """One row of each component stays; another text under a near copy's id does too, and columns may be called anything."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text), (9, text + " z"), (9, "another text"), (None, text + " y"), (None, "quite alone"), (5, text), (7, None), (7, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "a", "b", 3) for i, t in rows], "doc_id long, text string, TH string, No_Id string, d int").coalesce(1)
    kept = jaccard_join.survivors(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(5, text), (9, "another text"), (None, "quite alone"), (7, None), (7, None), (None, "")])
    assert jaccard_join.survivors(docs.filter("false")).count() == 0


INSULTS = ["moron", "idiot", "pathetic"]


def corpus(n, rng):
    texts, labels = [], []
    for i in range(n):
        words = ["".join(rng.choices(["th", "er", "an", "in", "re", "on"], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 6 == 0)
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(INSULTS)
        texts.append(" ".join(words))
        labels.append((i, toxic))
    return texts, labels


def test_toxicity_held_out(spark):
    texts, labels = corpus(1500, random.Random(7))
    texts += [None, "", " "]
    docs = frame(spark, texts)
    marked = spark.createDataFrame([*labels, (1, None), (3, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, marked).collect()}
    assert len(got) == len(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [(got[i].predicted, t) for i, t in labels if got[i].held_out]
    caught = sum(p for p, t in held if t) / sum(t for _, t in held)
    wrong = sum(p for p, t in held if not t)
    assert caught > 0.9 and wrong <= 0.01 * len(held)


def brute_log_ratios(rows):
    """(ratio of a word's n-gram) by the Kneser-Ney formula over (t, toxic), without any table of bounded size."""
    order, d = toxicity.ORDER, toxicity.DISCOUNT
    grams = lambda w: [(toxicity._START + w + b" ")[i : i + order] for i in range(len(w) + 1)]
    counts = Counter((g, label) for t, label in rows for w in toxicity.tokens(t) for g in grams(w))
    level = {order: {g for g, _ in counts}}
    before = {}
    for k in range(order - 1, 0, -1):
        before[k] = Counter(g[1:] for g in level[k + 1])
        level[k] = set(before[k])
    after = {k: Counter() for k in before}
    types = {k: Counter() for k in before}
    for k in before:
        for g, n in before[k].items():
            after[k][g[:-1]] += n
            types[k][g[:-1]] += 1

    def backoff(g):
        below = backoff(g[1:]) if len(g) > 1 else 1 / 256
        return (max(before[len(g)][g] - d, 0) + d * types[len(g)][g[:-1]] * below) / after[len(g)][g[:-1]]

    total, kinds = Counter(), Counter(g[:-1] for g in level[order])
    for (g, label), n in counts.items():
        total[g[:-1], label] += n
    share = lambda g, c: max(counts[g, c] - d, 0) / total[g[:-1], c] if total[g[:-1], c] else 0.0
    known = level[order]

    def ratio(g):
        if g not in known:
            return 0.0
        h = g[:-1]
        shared = d * kinds[h] / (total[h, 0] + total[h, 1]) * backoff(g[1:])
        return math.log((share(g, 1) + shared) / (share(g, 0) + shared))

    return lambda w: sum(map(ratio, grams(w)))


def brute_score(text, word, model):
    ws = toxicity.tokens(text)
    x = [0.0] * toxicity.FEATURES
    if ws:
        rate = lambda part: sum(map(word, part)) / sum(len(w) + 1 for w in part)
        best = [max(rate(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))) for k in toxicity.WINDOWS]
        x = [rate(ws), *best, math.log(len(ws))]
    z = sum(a * w for a, w in zip(x, model.weights)) + model.weights[-1]
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


@pytest.mark.parametrize("sent", [10, 1 << 20])
def test_toxicity_by_plain_kneser_ney(spark, monkeypatch, sent):
    """Scores of a model that is sent to workers, and of one that is joined, against the formula itself."""
    rng = random.Random(11)
    texts, labels = corpus(300, rng)
    texts = [t + " " + " ".join("".join(rng.choices("abcdefghij\u00e9", k=rng.randint(3, 9))) for _ in range(12)) for t in texts]
    texts += [None, "", "unseen wo\u00e9rds \U0001f642", texts[0] * 200]
    monkeypatch.setattr(toxicity, "MOST_SENT", sent)
    counted, count = [], toxicity.gram_counts
    monkeypatch.setattr(toxicity, "gram_counts", lambda rows: counted.extend((r.t, r.toxic) for r in rows.collect()) or count(rows))
    docs = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, Score string, row int, features string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "true")
    word = functools.cache(brute_log_ratios(counted))
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "row", "features", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.text == texts[r.doc_id] and math.isclose(r.score, brute_score(texts[r.doc_id], word, model), abs_tol=1e-6)


def test_toxicity_counts_all_usable_rows(spark):
    texts, labels = corpus(60, random.Random(12))
    model = toxicity.train(frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int"), "true")
    counted = model.ratios.groupBy().sum("n").first()[0]
    assert counted == sum(len(w) + 1 for t in texts for w in toxicity.tokens(t))


def test_toxicity_without_toxic_rows(spark):
    docs = frame(spark, ["a b c", "d e f"])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.predicted == 0 for r in toxicity.toxicity(docs, none).collect())
    ids = [None, BIG, BIG, 7]
    assert sorted((r.doc_id or 0, r.held_out) for r in toxicity.toxicity(frame(spark, ["a", "b", "b", "c"], ids).coalesce(1), none).collect())[0] == (0, False)
    assert toxicity.toxicity(docs.filter("false"), none).count() == 0


def test_pieces_round_trip(spark):
    texts = [None, "", " ", "▁ x ▁y", "日本語 テキスト\n\t \x00 é", "  lead  trail  ", "x" * 5000 + "é" * 3000, "🙂 the cat"]
    rows = {r.doc_id: r for r in piece_sampling.sample_pieces(frame(spark, texts), MODEL).collect()}
    again = {r.doc_id: r for r in piece_sampling.sample_pieces(frame(spark, texts).repartition(3), MODEL).collect()}
    pieces = piece_sampling.loaded(MODEL)
    for i, t in enumerate(texts):
        assert rows[i].lossless and pieces.decode(rows[i].pieces) == (t or "") and rows[i].n_pieces == len(rows[i].pieces)
        assert rows[i].pieces == again[i].pieces
    assert piece_sampling.sample_pieces(frame(spark, ["x"]).filter("false"), MODEL).count() == 0


def test_long_lattices_go_block_by_block(monkeypatch):
    """Runs without a space give the same pieces whole and in blocks."""
    pieces = piece_sampling.loaded(MODEL)
    rng = random.Random(6)
    texts = ["".join(rng.choices(["the", "ing", "on", "x", "é", "日本", "🙂", "tion", "aaaa", "▁"], k=400)) for _ in range(5)] + ["short one", "y" * 700]
    keys = [rng.getrandbits(64) for _ in texts]
    whole = piece_sampling.encode_batch(pieces, texts, keys)
    monkeypatch.setattr(piece_sampling, "LATTICE", 61)
    assert [x.tolist() for x in piece_sampling.encode_batch(pieces, texts, keys)] == [x.tolist() for x in whole]


def test_pieces_of_clashing_columns_and_ids(spark):
    docs = spark.createDataFrame([(None, "a b", 1, "x", 2), (BIG, "c d", 1, "x", 2), (BIG, "c d", 1, "x", 2)], "doc_id long, text string, id_to_seed int, text_to_cut string, Pieces int").coalesce(1)
    got = piece_sampling.sample_pieces(docs, MODEL)
    assert got.columns == ["doc_id", "id_to_seed", "text_to_cut", "pieces", "n_pieces", "decoded_sha256", "lossless"]
    rows = got.collect()
    assert Counter(r.doc_id for r in rows) == Counter([None, BIG, BIG]) and all(r.lossless and r.text_to_cut == "x" for r in rows)
    assert len({tuple(r.pieces) for r in rows if r.doc_id == BIG}) == 1


def test_pieces_follow_the_lattice():
    """Frequencies of sampled segmentations against the weights of all of them."""
    pieces = piece_sampling.loaded(MODEL)
    ids = {raw: i for i, raw in reversed(list(enumerate(pieces.raw))) if raw and pieces.weight[i] > piece_sampling.BYTE_WEIGHT}
    for i, raw in enumerate(pieces.raw):
        if raw and pieces.weight[i] > piece_sampling.BYTE_WEIGHT:
            ids.setdefault(raw, i)

    def every(s):
        if not s:
            yield (), 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in ids:
                for rest, p in every(s[k:]):
                    yield (ids[s[:k]], *rest), p * math.exp(pieces.weight[ids[s[:k]]])

    exact = dict(every(b" onions"))
    total, n = sum(exact.values()), 8000
    drawn = Counter(tuple(x.tolist()) for x in piece_sampling.encode_batch(pieces, ["onions"] * n, [hash(("k", i)) & (2**64 - 1) for i in range(n)]))
    assert set(drawn) <= set(exact)
    for segmentation, p in exact.items():
        share = p / total
        assert abs(drawn[segmentation] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-3


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts, labels = corpus(400, random.Random(9))
    long = " ".join(f"word{i}" for i in range(80))
    texts += [texts[1].upper(), texts[1].title(), long, long + " tail", None, ""]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", __import__("pyspark").sql.functions.lit(1)).write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "mixing", "sentencepiece"]
    kept = docs
    ids = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept = stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{i}")
        kept = spark.read.parquet(f"{tmp_path}/{i}")
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
        if i < 4:
            assert kept.columns == docs.columns
    toxic, n = {i for i, t in labels if t}, len(labels)
    assert len(toxic & ids[0]) <= 0.1 * len(toxic) and len(ids[0]) >= 0.98 * (len(texts) - len(toxic))
    assert (n in ids[1], n + 1 in ids[1]) == (False, True) and n + 4 not in ids[1] and n + 5 in ids[1]
    assert n + 2 in ids[2] and n + 3 not in ids[2] and n + 5 in ids[2]
    final = kept.collect()
    assert all(r.lossless for r in final) and {r.doc_id for r in final} == ids[3]
