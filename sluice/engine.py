"""The engine: query texts in, DataFrames out."""

from __future__ import annotations

import json
import re
import time

from pyspark.sql import DataFrame, SparkSession

from sluice.errors import PlanFault
from sluice.operators.pipeline import Planner
from sluice.operators.registry import register_stage
from sluice.plans.binder import Views, bind, let_header, view_statement
from sluice.plans.compiler import quoted
from sluice.plans.lexer import piped
from sluice.plans.parser import ALIASES, WRITES, parse_tokens
from sluice.sources.catalog import Catalog

__all__ = ["Engine", "register_stage"]

#: The stage catalogue, in the language's order: fixed values. (name, flow, effect on the number of rows)
CATALOGUE = (
    ("where", "streaming", "reduce"), ("select", "streaming", "preserve"), ("derive", "streaming", "preserve"), ("rename", "streaming", "preserve"),
    ("drop", "streaming", "preserve"), ("root", "streaming", "preserve"), ("near", "streaming", "reduce"), ("sort", "blocking", "preserve"),
    ("limit", "streaming", "reduce"), ("skip", "streaming", "reduce"), ("first", "streaming", "reduce"), ("single", "streaming", "reduce"),
    ("sample", "blocking", "reduce"), ("unwind", "streaming", "expand"), ("distinct", "blocking", "reduce"), ("count", "streaming", "scalar"),
    ("group", "blocking", "reduce"), ("bucket", "blocking", "reduce"), ("fill", "blocking", "expand"), ("window", "blocking", "preserve"),
    ("pivot", "blocking", "unknown"), ("lookup", "blocking", "preserve"), ("union", "blocking", "expand"), ("insert", "write", "expand"),
    ("set", "write", "preserve"), ("delete", "write", "reduce"), ("into", "write", "preserve"), ("load", "write", "preserve"),
)


class Engine:
    """Compiles and runs queries of the pipeline language.

    ``root`` is a folder of Parquet tables; ``store`` a versioned store for writes; ``tables`` further frames; ``scope`` field values
    that every row a query reads must have.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, store: str | None = None, tables: dict[str, DataFrame] | None = None, scope: dict | None = None, seed: int | None = None):
        from sluice.sources.store import Store

        self.spark = spark
        self.store = Store(spark, store) if store else None
        self.catalog = Catalog(spark, root, self.store, tables)
        self.catalog.scope = dict(scope or {})
        self.views = Views(self)
        self.catalog.views = self.views
        self.planner = Planner(self.catalog, seed)
        self.observed: list[dict] = []
        self.catalog.system = {"_query_memory": self._observed, "_memory": self._memory, "_index_observations": self._shapes, "_memory_events": self._events, "_views": self.views.table, "_cache": self._kept}
        self._cache: dict = {}

    @staticmethod
    def stages() -> list[dict]:
        """The published stage catalogue."""
        other = {v: k for k, v in ALIASES.items()}
        return [{"name": n, "alias": other.get(n), "flow": flow, "rows": rows} for n, flow, rows in CATALOGUE]

    def query(self, text: str, params: dict | None = None) -> DataFrame:
        """The result of a read, or the statistics of a write as one row."""
        began = time.time()
        text = text.strip()
        if re.match(r"explain\b", text):
            return self.explain(text[7:], params)
        statement = view_statement(text)
        if statement is not None:
            return self.views.apply(statement)
        pipeline = self.read(text, params)
        if pipeline.stages and pipeline.stages[-1].name in WRITES:
            out = self._write([pipeline])
        else:
            out = self._visible(self.planner.plan(pipeline))
        self.observed.append({"query": text, "stages": [s.name for s in pipeline.stages], "collection": pipeline.source.name if pipeline.source else "", "seconds": time.time() - began})
        return out

    def read(self, text: str, params: dict | None = None):
        """Text to a pipeline without free parameters."""
        toks, values = let_header(piped(text), dict(params or {}), self)
        return bind(parse_tokens(toks), values)

    def _visible(self, frame) -> DataFrame:
        return frame.df.select(*map(quoted, frame.visible()))

    def execute_together(self, *texts: str) -> DataFrame:
        """Several writes, all reading the state before them, in one commit."""
        return self._write([self.read(t) for t in texts])

    def _write(self, pipelines) -> DataFrame:
        from sluice.operators.writing import write

        if self.store is None:
            raise PlanFault("this engine has no store to write to")
        return write(self, pipelines)

    def state(self) -> tuple:
        """The store's generation, and the state of the tables read since ``catalog.touched`` was emptied."""
        return self.store.generation() if self.store else 0, *sorted(self.catalog.touched.items())

    def cached(self, text: str, params: dict | None = None) -> DataFrame:
        """The result kept in memory while the store and the tables that it reads stay the same."""
        self.catalog.touched = {}
        out = self.query(text, params)
        key, state = (text, json.dumps(params or {}, sort_keys=True, default=str)), self.state()
        if key not in self._cache or self._cache[key][0] != state:
            if key in self._cache:
                self._cache.pop(key)[1].unpersist()
            self._cache[key] = (state, out.persist())
        return self._cache[key][1]

    def explain(self, text: str, params: dict | None = None) -> DataFrame:
        """One row: collection, access, read_only, mode, executor, operators, plan."""
        p = self.read(text, params)
        write = bool(p.stages) and p.stages[-1].name in WRITES
        plan = "" if write else self._visible(self.planner.plan(p))._jdf.queryExecution().toString()
        key = any(s.name == "where" for s in p.stages[:1]) and "_id" in text
        blocking = {n for n, flow, _ in CATALOGUE if flow == "blocking"}
        row = {
            "collection": p.source.name if p.source else "",
            "access": "primary_key" if key else "scan",
            "read_only": not write,
            "mode": "blocking" if any(s.name in blocking for s in p.stages) else "streaming",
            "executor": "spark",
            "operators": [s.name for s in p.stages],
            "plan": plan,
        }
        return self.spark.createDataFrame([row], "collection string, access string, read_only boolean, mode string, executor string, operators array<string>, plan string")

    # system collections, built when read

    def _observed(self) -> DataFrame:
        return self.spark.createDataFrame([(o["query"], o["seconds"]) for o in self.observed], "query string, seconds double")

    def _kept(self) -> DataFrame:
        return self.spark.createDataFrame([(k[0], k[1], str(k[2])) for k in self.views.kept], "view string, version long, state string")

    def _memory(self) -> DataFrame:
        r = self.spark.sparkContext._jvm.Runtime.getRuntime()
        used = r.totalMemory() - r.freeMemory()
        state = "high" if used > 0.85 * r.maxMemory() else "normal"
        return self.spark.createDataFrame([("global", used, r.maxMemory(), state)], "scope string, current_bytes long, limit_bytes long, pressure_state string")

    def _events(self) -> DataFrame:
        t = self.spark.sparkContext.statusTracker()
        return self.spark.createDataFrame([(int(j), "active_job") for j in t.getActiveJobsIds()], "id long, event string")

    def _shapes(self) -> DataFrame:
        seen: dict = {}
        for o in self.observed:
            k = (o["collection"], " | ".join(o["stages"]))
            seen[k] = seen.get(k, 0) + 1
        return self.spark.createDataFrame([(c, s, n) for (c, s), n in seen.items()], "collection string, shape string, count long")


