"""Stages that write. A request's writes all read the state before it and become one commit."""

from __future__ import annotations

import time
from dataclasses import replace

from pyspark.sql import functions as F

from sluice.errors import PlanFault, WriteConflict
from sluice.operators import rowlocal
from sluice.operators.frame import HIDDEN, Frame
from sluice.plans.compiler import compiled, constant, quoted
from sluice.sources.catalog import literal_rows

#: Pauses before further attempts, in milliseconds: fixed values of the language.
PAUSES = (5, 10, 20, 40)


def write(engine, pipelines):
    """One row of statistics: inserted, replaced, deleted, generation."""
    for attempt in range(len(PAUSES) + 1):
        base = engine.store.generation()
        changes: dict[str, list] = {}
        stats = {"inserted": 0, "replaced": 0, "deleted": 0}
        held = []
        for p in pipelines:
            for name, df, counts in _changes(engine, p):
                n = {k: df.filter(c).count() for k, c in counts.items()}
                for k, v in n.items():
                    stats[k] += v
                if sum(n.values()):
                    changes.setdefault(name, []).append(df)
                held.append(df)
        try:
            generation = engine.store.commit(changes, base) if changes else base
            break
        except WriteConflict:
            if attempt == len(PAUSES):
                raise
            time.sleep(PAUSES[attempt] / 1000)
        finally:
            for df in held:
                df.unpersist()
    row = {**stats, "generation": generation}
    return engine.spark.createDataFrame([row], "inserted long, replaced long, deleted long, generation long")


def _changes(engine, p):
    """(collection, rows of the change log, conditions that count them); rows are kept so that ids and counts stay the same."""
    if not p.stages:
        raise PlanFault("nothing to write")
    stage = p.stages[-1]
    target = stage.args.get("target") or (p.source.name if p.source else None)
    if target is None or target.startswith("_"):
        raise PlanFault(f"{stage.name} cannot write to {target!r}")
    if stage.name in ("insert", "load"):
        if len(p.stages) > 1:
            raise PlanFault(f"{stage.name} is the only stage")
        if stage.name == "load" and stage.args["form"] == "compact":
            return
        yield from _documents(engine, target, stage)
        return
    if p.source.kind != "collection":
        raise PlanFault(f"{stage.name} needs a collection")
    if (p.source.history or p.source.as_of is not None) and stage.name != "into":
        raise PlanFault(f"{stage.name} cannot write to the past")
    with engine.planner.reading(p.source):
        frame = engine.planner.run(engine.planner.source(p.source), p.stages[:-1])
    if stage.name == "into":
        if target == p.source.name:
            raise PlanFault("into: the target is the source")
        df = frame.df.select(*[quoted(c) for c in frame.visible() if c != "_id"])
        yield target, _logged(df, F.uuid(), F.lit(1), "insert").persist(), {"inserted": F.lit(True)}
        return
    if "_id" not in frame.visible():
        raise PlanFault(f"{stage.name} needs stored documents")
    version = F.coalesce(F.col("__s_version"), F.lit(0)) + 1 if "__s_version" in frame.df.columns else F.lit(1)
    if stage.name == "delete":
        df = frame.df.select(F.lit("delete").alias("_op"), F.col("_id").alias("_doc_id"), version.cast("long").alias("_version"))
        yield target, df.persist(), {"deleted": F.lit(True)}
        return
    yield target, _set(frame, stage, version).persist(), {"replaced": F.lit(True)}


def _logged(df, ident, version, op: str):
    return df.select(F.lit(op).alias("_op"), ident.alias("_doc_id"), version.cast("long").alias("_version"), *map(quoted, df.columns))


def _set(frame: Frame, stage, version):
    """Every value comes from the row before the stage, so fields may swap."""
    df, hold = frame.df, []
    for i, (target, e) in enumerate(stage.args["assign"]):
        v = compiled(e, frame.scope)
        name = f"__s_new{i}"
        df = df.withColumn(name, v.col.cast("string") if v.kind == "null" else v.col)
        hold.append((rowlocal.stripped(target, frame.alias, frame.df.columns), replace(v, col=F.col(name))))
    for parts, v in hold:
        df = rowlocal.put(df, parts, v)
    own = [c for c in df.columns if not c.startswith(HIDDEN) and c != "_id"]
    return df.select(F.lit("replace").alias("_op"), F.col("_id").alias("_doc_id"), version.cast("long").alias("_version"), *map(quoted, own))


def _documents(engine, target: str, stage):
    rows = [constant(d, stage.name) for d in stage.args["docs"]]
    if not rows:
        return
    ids = [r["_id"] for r in rows if "_id" in r]
    if len(set(ids)) < len(ids):
        raise PlanFault(f"{stage.name}: an _id appears twice")
    mode = "insert" if stage.name == "insert" else stage.args["mode"]
    df = literal_rows(engine.spark, [{k: v for k, v in r.items() if k != "_id"} | {"__s_given": r.get("_id")} for r in rows])
    df = df.withColumn("_doc_id", F.coalesce("__s_given", F.uuid())).drop("__s_given").persist()
    own = [c for c in df.columns if c != "_doc_id"]
    if engine.store.has(target):
        old = engine.store.current(target).select(F.col("_id").alias("_doc_id"), F.col("__s_version").alias("__s_v"), F.struct("*").alias("__s_old"))
        joined = df.join(old, "_doc_id", "left")
    else:
        joined = df.withColumn("__s_v", F.lit(None).cast("long")).withColumn("__s_old", F.lit(None).cast("struct<_id:string>"))
    there = F.col("__s_v").isNotNull()
    if mode == "insert" and joined.filter(there).limit(1).count():
        raise PlanFault("insert: a document with this _id exists")
    if mode == "update" and joined.filter(~there).limit(1).count():
        raise PlanFault("load: update needs documents that exist")
    fields = own
    columns = {c: F.col(quoted(c)) for c in own}
    if mode in ("merge", "update"):
        old_fields = [f for f in joined.schema["__s_old"].dataType.fields if f.name not in ("_id", "__s_version")]
        fields = list(dict.fromkeys([*own, *(f.name for f in old_fields)]))
        for f in old_fields:
            kept = F.col(f"__s_old.{quoted(f.name)}")
            columns[f.name] = F.coalesce(columns[f.name], kept.cast(df.schema[f.name].dataType)) if f.name in own else kept
    op = F.when(there, "replace").otherwise("insert")
    out = joined.select(op.alias("_op"), "_doc_id", (F.coalesce("__s_v", F.lit(0)) + 1).cast("long").alias("_version"), *[columns[c].alias(c) for c in fields])
    yield target, out.persist(), {"inserted": F.col("_op") == "insert", "replaced": F.col("_op") == "replace"}
