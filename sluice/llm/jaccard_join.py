"""N-gram Jaccard self-join through a token-group matrix."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import discard, exact_id, fresh, small_or_shuffled, with_nulls, written
from sluice.llm.components import components

#: Words of a shingle and the least similarity in hundredths.
WORDS, PERCENT = 5, 80

#: The token order is by so many counters, which tokens share, of all texts. Whatever they hold, the join is exact.
SLOTS = 1 << 18

#: Sets of a token, as the counters have it, beyond which its row of the matrix is built in SALTS parts.
RUN_SETS, SALTS = 1 << 18, 256

#: Tokens of the queries, and of the members, that meet in one call; a larger group is cut into blocks.
BLOCK_TOKENS = 1 << 19

_C = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of ``words`` words, A-Z folded; of the whole sequence where it is shorter."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    k = min(words, len(h))
    s = _mix(h[: len(h) - k + 1] + np.uint64(k))
    for j in range(1, k):
        s = _mix(s * _C + h[j : len(h) - k + 1 + j])
    return np.unique(s)


def set_hash(s: np.ndarray) -> int:
    d = xxhash.xxh3_64_intdigest(s.tobytes())
    return d - (1 << 64) if d >> 63 else d


def _least_overlap(n: str, m: str, percent: int) -> str:
    """SQL: the smallest intersection with which sets of n and m tokens are similar: 100 i >= percent (n + m - i)."""
    return f"(({percent} * ({n} + {m}) + {99 + percent}) div {100 + percent})"


def _behind(n: str, percent: int) -> str:
    """SQL: the tokens behind the prefix of a set of n."""
    return f"(({percent} * {n} + 99) div 100 - 1)"


def prefix(s: np.ndarray, counts: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first tokens of a set in the token order, rare ones before frequent ones: similar sets share one of these."""
    n = len(s) - -(-percent * len(s) // 100) + 1
    return s[np.argsort(counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)], kind="stable")[:n]]


def token_counts(docs: DataFrame, words: int) -> np.ndarray:
    """How many tokens of all texts fall on each counter; copies within a task count once."""
    slots = SLOTS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, counts = set(), np.zeros(slots, np.int64)
        for batch in batches:
            for th, text in zip(batch["th"], batch["t"], strict=True):
                if th not in seen:
                    seen.add(th)
                    np.add.at(counts, (shingle_set(text, words) & np.uint64(slots - 1)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"slot": at.astype(np.int32), "n": counts[at]})

    found = docs.select("th", "t").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(slots, np.int64)
    counts[found["slot"]] = found["n"]
    return counts


def described(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, no_id, th, d (hash of the set), n, and once a task for each set its prefix: toks, and hot, tokens of very many sets."""
    sent = docs.sparkSession.sparkContext.broadcast(token_counts(docs, words))
    most = RUN_SETS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen = sent.value, set()
        for batch in batches:
            rows = []
            for text in batch["t"]:
                s = shingle_set(text, words)
                d = set_hash(s) if len(s) else 0
                if not len(s) or d in seen:
                    rows.append((d, len(s), None, None))
                    continue
                seen.add(d)
                p = prefix(s, counts, percent)
                hot = counts[(p & np.uint64(len(counts) - 1)).astype(np.int64)] > most
                rows.append((d, len(s), p[~hot].view(np.int64), p[hot].view(np.int64)))
            d, n, toks, hot = zip(*rows, strict=True) if rows else ((), (), (), ())
            made = {"d": np.array(d, np.int64), "n": np.array(n, np.int32), "toks": pd.Series(toks, dtype=object), "hot": pd.Series(hot, dtype=object)}
            yield batch[["doc_id", "no_id", "th"]].assign(**made)

    return docs.mapInPandas(run, "doc_id long, no_id boolean, th long, d long, n int, toks array<long>, hot array<long>")


def shared_tokens(base: DataFrame) -> DataFrame:
    """(tok, d, n, least): the prefix tokens that several sets have; ``least`` is the smallest of these sets.

    A token of very many sets has its row built in parts, each with a smallest set of its own; it counts as shared in any case.
    """
    rows = base.filter("toks is not null")
    cold = rows.select("d", "n", F.explode("toks").alias("tok")).select("d", "n", "tok", F.col("tok").alias("part"), F.lit(False).alias("hot"))
    hot = rows.select("d", "n", F.explode("hot").alias("tok")).select("d", "n", "tok", F.xxhash64("tok", F.pmod("d", F.lit(SALTS))).alias("part"), F.lit(True).alias("hot"))
    run = Window.partitionBy("part")
    found = cold.union(hot).withColumn("least", F.min("d").over(run)).withColumn("most", F.max("d").over(run)).filter("hot or least <> most")
    return written(found.select("tok", "d", "n", "least").dropDuplicates(["tok", "d"]), "shared")


def grouped(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, matrix). Sets: d, n, hub, g, total (its shared tokens). Sets of one hub and like sizes are a group: the hub is the
    smallest set with which a set shares a token, so that families and the users of one passage meet. Matrix: tok, d, n, g."""
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.1)))
    sets = shared.groupBy("d").agg(F.first("n").alias("n"), F.min("least").alias("hub"), F.count(F.lit(1)).alias("total"))
    sets = written(sets.withColumn("g", F.xxhash64("hub", size)), "grouped")
    return sets, written(shared.select("tok", "d", "n").join(sets.select("d", "g"), "d"), "matrix")


def qualifying(sets: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """(x, n, own, g): each query set and the groups that it may have a similar set in.

    For a pair, look at the set whose prefix ends first in the token order: the common tokens up to there are in both prefixes, so the
    group's union holds them, and behind lie the rest of its own tokens. That set's count suffices for the least overlap with the
    smallest size in the group that could be similar; the other set may ask in vain.
    """
    sizes = sets.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    unions = written(matrix.groupBy("tok", "g").agg(F.count(F.lit(1)).alias("holders")).join(sizes, "g"), "unions")
    asked = matrix.select("tok", F.col("d").alias("x"), "n", F.col("g").alias("own")).join(unions, "tok")
    asked = asked.filter(f"100 * n >= {percent} * low and 100 * high >= {percent} * n and (g <> own or holders > 1)")
    least = f"greatest(low, ({percent} * n + 99) div 100)"
    counted = asked.groupBy("x", "n", "own", "g", "low").agg(F.count(F.lit(1)).alias("common"))
    counted = counted.filter(f"common + {_behind('n', percent)} >= {_least_overlap('n', least, percent)}")
    return written(counted.select("x", "n", "own", "g"), "qualifying")


def opened(sets: DataFrame, asked: DataFrame, percent: int) -> DataFrame:
    """(d, n, g, total): the queries, and the members of asked groups with tokens enough in common with any other set to answer."""
    most = asked.groupBy("g").agg(F.max("n").alias("most"))
    x = f"least(most, (100 * n) div {percent})"
    enough = sets.join(most, "g").filter(f"total + 2 >= {_least_overlap('n', x, percent)} - {_behind(x, percent)}")
    queries = sets.join(asked.select(F.col("x").alias("d")).distinct(), "d", "left_semi")
    columns = ["d", "n", "g", "total"]
    return written(enough.select(*columns).union(queries.select(*columns)).distinct(), "opened")


def _cells(queries: DataFrame, members: DataFrame) -> DataFrame:
    """(call, cell, member, d): queries and members (k, d, tokens) of each key k dealt into cells where they meet.

    A key's queries and members are cut into blocks of about BLOCK_TOKENS, and each block of the ones meets each of the others. Small
    cells share a call.
    """
    asking = queries.groupBy("k").agg(F.sum("tokens").alias("asking"))
    sizes = asking.join(members.groupBy("k").agg(F.sum("tokens").alias("asked")), "k")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK_TOKENS)).cast("int")
    sizes = written(sizes.select("k", blocks("asking").alias("rows"), blocks("asked").alias("columns"), (F.col("asking") * blocks("asked") + F.col("asked") * blocks("asking")).alias("sent")), "sizes")
    calls = (sizes.agg(F.sum("sent")).first()[0] or 0) // BLOCK_TOKENS + 1
    block = lambda n: F.pmod(F.xxhash64("d"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(sizes, "k").select("k", "d", F.lit(0).alias("member"), block("rows").alias("i"), every("columns").alias("j"))
    right = members.join(sizes, "k").select("k", "d", F.lit(1).alias("member"), every("rows").alias("i"), block("columns").alias("j"))
    dealt = left.unionByName(right).select(F.xxhash64("k", "i", "j").alias("cell"), "member", "d")
    return dealt.withColumn("call", F.pmod("cell", F.lit(calls)))


class _Forest:
    """Union-find over the sets of one call; a tree's root is its smallest set."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        p = self.parent
        while p.setdefault(x, x) != x:
            p[x] = x = p[p[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.parent[max(x, y)] = min(x, y)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, r) for x in list(self.parent) if (r := self.find(x)) != x]


def spanning_pairs(left: pd.DataFrame, right: pd.DataFrame, accept) -> list[tuple[int, int]]:
    """What all accepted pairs of a query and a member (d, n, s) connect, as pairs with the smallest of each; ``accept(common, n, members' n)``."""
    ys, n_y, sizes = right["d"].to_numpy(), right["n"].to_numpy(), right["s"].map(len).to_numpy()
    toks, owner = np.concatenate(right["s"].tolist()), np.repeat(np.arange(len(ys)), sizes)
    order = np.argsort(toks, kind="stable")
    toks, owner = toks[order], owner[order]
    forest = _Forest()
    for x, n, s in zip(left["d"].tolist(), left["n"].tolist(), left["s"], strict=True):
        lo, hi = np.searchsorted(toks, s, "left"), np.searchsorted(toks, s, "right")
        k = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(k)[:-1]], k) + np.arange(k.sum())
        common = np.bincount(owner[at], minlength=len(ys))
        for y in ys[accept(common, n, n_y) & (ys != x)].tolist():
            forest.join(x, y)
    return forest.stars()


def _met(cells: DataFrame, accept) -> DataFrame:
    """(x, y): spanning pairs of each cell, over rows (call, cell, member, d, n, s); member is 2 for a query that is a member too."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        found = []
        for rows in batch.groupby("cell").indices.values():
            cell = batch.iloc[rows]
            role = cell["member"].to_numpy()
            if (role != 1).any() and (role != 0).any():
                found += spanning_pairs(cell[role != 1], cell[role != 0], accept)
        return pd.DataFrame(found, columns=["x", "y"]).astype("int64")

    return cells.groupBy("call").applyInPandas(run, "x long, y long")


def clusters(matrix: DataFrame, asked: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(d, n, total, c): the sets that are in a pair which its common prefix tokens do not rule out, and their cluster of such pairs."""
    sized = members.select("g", "d", F.col("total").alias("tokens")).withColumnRenamed("g", "k")
    queries = asked.select(F.col("g").alias("k"), F.col("x").alias("d")).join(members.select("d", F.col("total").alias("tokens")), "d")
    tokens = matrix.join(members.select("d"), "d", "left_semi").groupBy("d").agg(F.first("n").alias("n"), F.collect_list("tok").alias("s"))

    def accept(common, n, m):
        behind = -(-percent * np.maximum(n, m) // 100) - 1  # whichever prefix ends first
        fits = np.minimum(n, m) * 100 >= percent * np.maximum(n, m)
        return (common > 0) & fits & (common + behind >= -(-percent * (n + m) // (100 + percent)))

    found = _met(_cells(queries.select("k", "d", "tokens"), sized).join(tokens, "d"), accept)
    of = components(written(found, "candidates"), "x", "y")
    return written(members.select("d", "n", "total").join(of.select(F.col("node").alias("d"), F.col("label").alias("c")), "d"), "clusters")


def whole_sets(docs: DataFrame, base: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(d, c, n, s): all tokens of the wanted sets (d, c), from one text of each."""
    rep = base.join(wanted, "d").groupBy("d", "c").agg(F.min(F.struct("no_id", "doc_id", "th")).alias("r")).select("c", "r.*")
    rep = written(rep, "representatives")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = set()
        for batch in batches:
            rows = []
            for c, text in zip(batch["c"], batch["t"], strict=True):
                s = shingle_set(text, words)
                d = set_hash(s)
                if d not in seen:
                    seen.add(d)
                    rows.append((d, c, len(s), s.view(np.int64)))
            yield pd.DataFrame(rows, columns=["d", "c", "n", "s"]).astype({"d": "int64", "c": "int64", "n": "int32"})

    found = docs.join(small_or_shuffled(rep, 64), ["no_id", "doc_id", "th"]).select("c", "t")
    return written(found.mapInPandas(run, "d long, c long, n int, s array<long>"), "sets")


def linked_to_hub(whole: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """(d, hub): members of the clusters (c, hub) that are similar to the hub; the hub itself too."""
    of = whole.join(hubs, (whole["d"] == hubs["hub"]) & (whole["c"] == hubs["c"])).select(hubs["c"], "hub", F.col("s").alias("hub_s"))
    both = whole.join(of, "c").withColumn("i", F.size(F.array_intersect("s", "hub_s")))
    return written(both.filter(F.expr(f"100 * i >= {percent} * (size(s) + size(hub_s) - i)")).select("d", "hub").distinct(), "hub-links")


def links(docs: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    """(x, y): links that connect exactly the sets that all similar pairs connect.

    A cluster beyond a call is first compared with its hub. The sets that are not like the hub are then compared with all of the
    cluster in cells; those that are like it need no look at one another.
    """
    sets, matrix = grouped(shared_tokens(base))
    asked = qualifying(sets, matrix, percent)
    found = clusters(matrix, asked, opened(sets, asked, percent), percent)
    crowds = found.groupBy("c").agg(F.sum("n").alias("tokens"), F.max_by("d", F.struct("total", "d")).alias("hub")).filter(F.col("tokens") > BLOCK_TOKENS)
    crowds = written(crowds.select("c", "hub"), "crowds")
    whole = whole_sets(docs, base, found.select("d", "c"), words)

    def accept(common, n, m):
        return 100 * common >= percent * (n + m - common)

    plain = whole.join(crowds, "c", "left_anti")
    calls = (found.agg(F.sum("n")).first()[0] or 0) // BLOCK_TOKENS + 1
    plain = plain.select(F.pmod(F.xxhash64("c"), F.lit(calls)).alias("call"), F.col("c").alias("cell"), F.lit(2).alias("member"), "d", "n", "s")
    out = _met(plain, accept)
    if crowds.limit(1).count():
        near = linked_to_hub(whole, crowds, percent)
        crowded = whole.join(crowds, "c", "left_semi")
        members = crowded.select(F.col("c").alias("k"), "d", F.col("n").alias("tokens"))
        cells = _cells(members.join(near.select("d"), "d", "left_anti").select("k", "d", "tokens"), members)
        out = out.union(_met(cells.join(crowded.select("d", "n", "s"), "d"), accept)).union(near.filter("d <> hub"))
    out = written(out, "links")
    discard(sets, matrix, asked, found, whole)
    return out


def labelled(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(base, labels): base as ``described`` without prefixes; labels has (d, label) of each distinct set, label a set of its component."""
    base = written(described(docs, words, percent), "described")
    found = components(links(docs, base, words, percent), "x", "y")
    sets = base.filter("n > 0").select("d").distinct()
    labels = sets.join(found.withColumnRenamed("node", "d"), "d", "left").select("d", F.coalesce("label", "d").alias("label"))
    return base.drop("toks", "hot"), labels


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*exact_id(id_col), F.col(text_col).cast("string").alias("t")).withColumn("th", F.xxhash64("t"))


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable over links of ``percent`` or more, itself included).

    Sets: distinct shingles of whole texts, A-Z folded; shorter texts are one shingle. A null, empty or blank text has an empty set
    and no link. Equal sets are one set, so copies cost a row each and no comparison. Null ids belong to no one but keep their row
    (component_id is the smallest other id, or null). Rows that repeat repeat their result; other columns are ignored; an empty
    table gives an empty result.

    Tokens have one global order, rare before frequent; similar sets share a token of their prefixes. Only tokens that several sets
    have are kept: they are the rows of the matrix. Sets are partitioned into groups, and the matrix stores for each group the union
    of its members' tokens. What a query shares with a union, plus what lies behind its prefix, bounds its overlap with any member; only
    groups that reach the least overlap are opened. There the common prefix tokens bound each pair, and whole sets are intersected
    within the clusters of pairs that are left. What is larger than a call is cut into blocks; each call returns a spanning forest of
    its pairs, so a family of near copies makes no row for each of them.
    """
    base, labels = labelled(_keyed(docs, id_col, text_col), words, percent)
    ids = base.filter("n > 0").groupBy("d").agg(F.min(F.when(~F.col("no_id"), F.col("doc_id"))).alias("least"))
    named = written(labels.join(ids, "d"), "named")
    of = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("d", "component_id")
    rows = with_nulls(base.join(of, "d", "left").select("doc_id", "no_id", F.col("n").cast("long").alias("n_shingles"), "component_id"))
    return rows.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def survivors(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays, null ids after all others.

    Rows are told apart by id and text, so another text under the id of a near copy stays. Of rows that agree in both, one stays.
    Rows without words have no component and stay, each of them.
    """
    base, labels = labelled(_keyed(docs, id_col, text_col), words, percent)
    key = ["no_id", "doc_id", "th"]
    rows = written(base.filter("n > 0").join(labels, "d").groupBy("label", *key).agg(F.count(F.lit(1)).alias("copies")), "rows")
    first = rows.groupBy("label").agg(F.min(F.struct(*key)).alias("first"))
    rows = written(rows.join(first, "label").withColumn("stays", F.struct(*key) == F.col("first")), "judged")
    names = fresh(docs, *key)
    ident = F.col(id_col).cast("long")
    tagged = docs.withColumns({names[0]: ident.isNull(), names[1]: F.coalesce(ident, F.lit(0)), names[2]: F.xxhash64(F.col(text_col).cast("string"))})
    named = lambda side: side.select(*(F.col(k).alias(n) for k, n in zip(key, names, strict=True)))
    kept = tagged.join(small_or_shuffled(written(named(rows.filter("not stays")), "gone"), 64), names, "left_anti")
    repeated = written(named(rows.filter("stays and copies > 1")), "repeated")
    if repeated.limit(1).count():
        side = small_or_shuffled(repeated, 64)
        kept = kept.join(side, names, "left_anti").unionByName(kept.join(side, names, "left_semi").dropDuplicates(names))
    return kept.select(*docs.columns)
