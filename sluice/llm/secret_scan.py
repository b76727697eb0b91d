"""Secret scans through a trigram inverted index."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import exact_id, with_nulls

from re import _constants as sre
from re import _parser as sre_parser

#: More alternatives of a literal than this are not spelled out; the trigrams that they would give are not required then.
MOST_SPELLINGS = 64

#: Documents of one index segment; also bounded by SEGMENT_BYTES of text.
SEGMENT_DOCS, SEGMENT_BYTES = 2048, 8 << 20


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    def compiled(self):
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: The three base kinds, then kinds that the method adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE = (
    Rule("private", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


# A trigram query is True (no condition), a trigram (three lower-case bytes), ("and", parts) or ("or", parts).


def _both(parts):
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _either(parts):
    return True if any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", tuple(dict.fromkeys(parts)))


def _of_strings(strings) -> object:
    """What any text with one of the strings in it must hold."""
    every = []
    for s in strings:
        raw = s.lower().encode()
        every.append(_both([raw[i : i + 3] for i in range(len(raw) - 2)]))
    return _either(every) if every else True


def _spell(tree, limit: int):
    """(strings, query): all exact spellings of a parsed regex if there are few, else None and what every match must hold."""
    runs, query = [""], []

    def close():
        query.append(_of_strings(runs))
        runs[:] = [""]

    exact = True
    for op, arg in tree:
        options = None
        if op is sre.LITERAL:
            options = [chr(arg)]
        elif op is sre.IN:
            if all(o is sre.LITERAL for o, _ in arg):
                options = [chr(v) for _, v in arg]
        elif op is sre.SUBPATTERN:
            options, inner = _spell(arg[3], limit)
            if options is None:
                close()
                query.append(inner)
        elif op is sre.BRANCH:
            each = [_spell(t, limit) for t in arg[1]]
            if all(s is not None for s, _ in each):
                options = [x for s, _ in each for x in s]
            else:
                close()
                query.append(_either([_of_strings(s) if s is not None else q for s, q in each]))
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            strings, inner = _spell(body, limit)
            if strings is not None and low == 0 and high == 1:
                options = ["", *strings]
            elif low >= 1:
                close()
                query.append(inner if strings is None else _of_strings(strings))
        if options is None or len(options) * len(runs) > limit:
            if options is not None:
                close()
                query.append(_of_strings(options))
            elif runs != [""]:
                close()
            exact = False
        elif exact or options:
            runs[:] = [r + o for r in runs for o in options]
    if exact and not query:
        return list(runs), _of_strings(runs)
    close()
    return None, _both(query)


def trigram_query(pattern: str):
    """The Boolean trigram query of a regex, letters folded: a superset test. True if no trigram is mandatory."""
    strings, query = _spell(sre_parser.parse(pattern, re.ASCII), MOST_SPELLINGS)
    return _of_strings(strings) if strings is not None else query


def _trigrams(query) -> set[bytes]:
    return set() if query is True else {query} if isinstance(query, bytes) else set().union(*map(_trigrams, query[1]))


class Segment:
    """The inverted index of some documents, over the trigrams that the queries name: trigram to a bit for each document."""

    def __init__(self, texts: list[bytes], slots: np.ndarray, names: list[bytes]):
        self.names = {name: i for i, name in enumerate(names)}
        self.postings = np.zeros((len(names), len(texts)), dtype=bool)
        folded = np.frombuffer(b"\0\0".join(texts).lower() + b"\0\0", dtype=np.uint8)
        starts = np.cumsum([0] + [len(t) + 2 for t in texts])
        code = folded[:-2].astype(np.int32) << 16
        code |= folded[1:-1].astype(np.int32) << 8
        code |= folded[2:]
        hit = slots[code]
        at = np.flatnonzero(hit)
        self.postings[hit[at] - 1, np.searchsorted(starts, at, side="right") - 1] = True

    def search(self, query) -> np.ndarray:
        """A bit for each document that may match."""
        if query is True:
            return np.ones(self.postings.shape[1], dtype=bool)
        if isinstance(query, bytes):
            return self.postings[self.names[query]]
        found = [self.search(q) for q in query[1]]
        return np.logical_and.reduce(found) if query[0] == "and" else np.logical_or.reduce(found)


def _spans(rule: Rule, compiled, text: str):
    for m in compiled.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.start(), m.end()


def _quick(rule: Rule):
    """The compiled rule. A single class with a plus matches maximal runs, so its length is asked for in the pattern itself."""
    if rule.group == 0 and rule.least and re.fullmatch(r"\[[^\]\\]+\]\+", rule.pattern):
        rule = Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least},}}", 0, rule.least, rule.ignore_case)
    return rule.compiled()


def scan_segment(texts: list[str], rules: tuple[Rule, ...], queries: list, slots: np.ndarray, names: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of each text's spans. Indexes the segment, intersects postings, verifies candidates."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    index = Segment([t.encode() for t in texts], slots, names)
    for k, rule in enumerate(rules):
        compiled = _quick(rule)
        for i in np.flatnonzero(index.search(queries[k])):
            found[i].extend((start, k, end) for start, end in _spans(rule, compiled, texts[i]))
    return found


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_<kind> of each base kind, base_sha256, spans (kind:start:end by start, comma-joined; code points, end exclusive).

    Whole texts are scanned; a null text counts as empty and has no spans, as has an empty one. Rows that repeat give equal results;
    other columns are ignored; an empty table gives an empty result. Spans of base kinds are leftmost and do not overlap within a
    kind. Segments of bounded size are indexed and searched where they are read: nothing is shuffled, and a lost executor costs its
    tasks only. Rules without a mandatory trigram (a lone character class) scan every text.
    """
    rules = (*base, *more)
    queries = [trigram_query(r.pattern) for r in rules]
    names = sorted(set().union(*map(_trigrams, queries)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        slots = np.zeros(1 << 24, dtype=np.int16)
        for i, name in enumerate(names):
            slots[int.from_bytes(name, "big")] = i + 1

        def result(ids, texts) -> pd.DataFrame:
            rows = []
            for spans in scan_segment(texts, rules, queries, slots, names):
                spans.sort()
                own = [x for x in spans if x[1] < len(base)]
                say = lambda xs: ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in xs)
                rows.append([*(sum(x[1] == k for x in own) for k in range(len(base))), hashlib.sha256(say(own).encode()).hexdigest(), say(spans)])
            out = pd.DataFrame(rows, columns=[*(f"n_{r.kind}" for r in base), "base_sha256", "spans"])
            out.insert(0, "doc_id", [i for i, _ in ids])
            out.insert(1, "no_id", [null for _, null in ids])
            return out

        ids, texts, size = [], [], 0
        for batch in batches:
            for i, null, t in zip(batch["doc_id"], batch["no_id"], batch["t"], strict=True):
                ids.append((i, null))
                texts.append(t or "")
                size += len(texts[-1])
                if len(texts) >= SEGMENT_DOCS or size >= SEGMENT_BYTES:
                    yield result(ids, texts)
                    ids, texts, size = [], [], 0
        if texts:
            yield result(ids, texts)

    rows = docs.select(*exact_id(id_col), F.col(text_col).cast("string").alias("t"))
    counts = "".join(f", n_{r.kind} long" for r in base)
    return with_nulls(rows.mapInPandas(run, f"doc_id long, no_id boolean{counts}, base_sha256 string, spans string"))
