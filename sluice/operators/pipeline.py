"""Pipelines to frames: one stage after the other."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from sluice.errors import PlanFault
from sluice.operators import combining, grouping, ordering, rowlocal, windows
from sluice.operators.frame import HIDDEN, Frame
from sluice.operators.registry import CUSTOM
from sluice.plans.compiler import quoted
from sluice.plans.parser import WRITES, Pipeline, Source, Stage

_LOCAL = {"where": rowlocal.where, "derive": rowlocal.derive, "select": rowlocal.select, "rename": rowlocal.rename, "drop": rowlocal.drop, "root": rowlocal.root, "near": rowlocal.near, "unwind": rowlocal.unwind}
_BLOCKING = {"limit": ordering.limit, "skip": ordering.skip, "first": ordering.first, "single": ordering.single, "distinct": ordering.distinct, "count": ordering.count, "bucket": grouping.bucket, "window": windows.window}


def _needs_order(stages: list[Stage]) -> bool:
    """Whether a stage depends on the order of its input beyond what a bound after a sort sees."""
    for s in stages:
        if s.name == "distinct" and s.args["paths"] or s.name == "window":
            return True
        if s.name == "group" and any(m["fn"] in grouping.ORDERED for m in s.args.get("measures", ())):
            return True
        if s.name == "pivot" and s.args["aggregate"] in grouping.ORDERED:
            return True
        if s.name == "sort" and any(t.name == "sort" for t in stages[stages.index(s) + 1 :]):
            return True
    return False


class Planner:
    """Compiles pipelines against a catalog: ``source(spec)`` gives the frame of a source."""

    def __init__(self, catalog, seed: int | None = None):
        self.catalog, self.seed = catalog, seed
        self.moment = None  # the past state that all collections of the query are read at

    @contextmanager
    def reading(self, source: Source):
        """``as of`` of a query's source holds for every collection that it reads."""
        held = self.moment
        if source.as_of is not None:
            self.moment = source.as_of
        try:
            yield
        finally:
            self.moment = held

    def plan(self, p: Pipeline) -> Frame:
        if p.source is None:
            raise PlanFault("a query begins with 'on <collection>'")
        with self.reading(p.source):
            return self._planned(p)

    def _planned(self, p: Pipeline) -> Frame:
        frame = self.source(p.source, _needs_order(p.stages))
        reads = [s for s in p.stages if s.name not in WRITES]
        for s in p.stages[:-1]:
            if s.name in WRITES or s.name == "count":
                raise PlanFault(f"{s.name} ends a query")
        return self.run(frame, reads)

    def source(self, spec, ordered: bool = False) -> Frame:
        frame = self.catalog.source(spec, self)
        if ordered and not frame.order:
            if "_id" in frame.df.columns:
                return frame.of(frame.df, order=(("_id", False),))
            name = f"{HIDDEN}at"
            return frame.of(frame.df.withColumn(name, F.monotonically_increasing_id()), order=((name, False),))
        return frame

    def run(self, f: Frame, stages: list[Stage]) -> Frame:
        i = 0
        while i < len(stages):
            s, later = stages[i], stages[i + 1 :]
            i += 1
            if s.name in _LOCAL:
                f = _LOCAL[s.name](f, s.args)
            elif s.name in _BLOCKING:
                f = _BLOCKING[s.name](f, s.args)
            elif s.name == "sort":
                f = ordering.sort(f, s.args, keep=_needs_order(later) or bool(f.order))
            elif s.name == "sample":
                f = ordering.sample(f, s.args, self.seed)
            elif s.name == "group":
                certain = all(t.name in ("where", "limit", "skip", "sort", "derive") for t in stages[: i - 1])
                f = grouping.group(f, s.args, certain)
            elif s.name == "pivot":
                self._top(f, s)
                f = grouping.pivot(f, s.args)
            elif s.name == "fill":
                self._top(f, s)
                f = windows.fill(f, s.args)
            elif s.name == "union":
                self._top(f, s)
                f = combining.union(f, self.plan(s.args["pipeline"]))
            elif s.name == "lookup":
                inner = self.source(s.args["source"], _needs_order(s.args["stages"]))
                f, used = combining.lookup(f, s.args, inner, self.run, later)
                i += used
            elif s.name == "custom" and s.args["name"] in CUSTOM:
                out = CUSTOM[s.args["name"]](f.df.select(*map(quoted, f.visible())), [t.value for t in s.args["tokens"]])
                f = f.of(out, order=(), keys=())
            else:
                raise PlanFault(f"unknown stage {s.args.get('name', s.name)!r}")
        return f

    @staticmethod
    def _top(f: Frame, s: Stage) -> None:
        if f.per:
            raise PlanFault(f"{s.name} is not allowed inside a lookup")
