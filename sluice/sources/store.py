"""A versioned store of collections on any file system that Spark reads.

Every write is one commit: data files under ``data/<collection>/<commit id>`` and then one small file ``commits/<generation>.json``,
which appears whole and only if no other writer's has. What is not named by a commit does not exist, so a write is all or nothing and a lost
executor or driver leaves no half of one. The rows of all commits are the history; a collection's state is the latest row of each
document, as of any generation.
"""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.errors import PlanFault, WriteConflict
from sluice.plans.compiler import quoted

#: Columns of the change log besides a document's own: fixed names of the language.
HISTORY = ("_id", "_doc_id", "_version", "_op", "_generation", "_at", "_by", "_by_device")

#: Commits of a collection after which its state is written as one table.
SNAPSHOT_AFTER = 32


class Store:
    def __init__(self, spark: SparkSession, path: str, by: str | None = None, device: str | None = None):
        self.spark, self.path, self.by, self.device = spark, path.rstrip("/"), by, device
        self._seen: dict[str, dict] = {}

    # files

    def _fs(self, name: str = ""):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def read_text(self, name: str) -> str | None:
        p, fs = self._fs(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str, fresh: bool = False) -> bool:
        """Writes a small file whole or not at all; with ``fresh`` only if there is none of that name, and says whether it did.

        The text goes to a file of another name first. A hard link (local files) or a rename that does not overwrite then gives it its
        name, so readers never see half of it and of two writers one fails. Object stores without such a rename are not supported.
        """
        p, fs = self._fs(name)
        held, _ = self._fs(f"{name}.{uuid.uuid4().hex}.tmp")
        jvm = self.spark.sparkContext._jvm
        stream = fs.create(held, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        try:
            if fresh and fs.getScheme() == "file":
                path = lambda q: jvm.java.nio.file.Path.of(q.toUri().getPath(), self.spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
                jvm.java.nio.file.Files.createLink(path(p), path(held))
            else:
                kind = jvm.org.apache.hadoop.fs.Options.Rename
                options = self.spark.sparkContext._gateway.new_array(kind, 1)
                options[0] = kind.NONE if fresh else kind.OVERWRITE
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(held, p, options)
        except Exception as e:
            if fresh and "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(held, False)
        return True

    # commits

    def commits(self) -> list[dict]:
        """All commits in order. A commit's file never changes, so each is read once."""
        p, fs = self._fs("commits")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []
        for n in names:
            if n not in self._seen:
                self._seen[n] = json.loads(self.read_text(f"commits/{n}"))
        return [self._seen[n] for n in names]

    def generation(self) -> int:
        p, fs = self._fs("commits")
        if not fs.exists(p):
            return 0
        return max((int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")), default=0)

    def has(self, name: str) -> bool:
        return any(name in c["collections"] for c in self.commits())

    def commit(self, changes: dict[str, list[DataFrame]], base: int) -> int:
        """Writes the changes of each collection and makes them generation base + 1. Frames hold _op, _doc_id, _version and a document."""
        ident = uuid.uuid4().hex
        written = {}
        for name, frames in changes.items():
            for i, df in enumerate(frames):
                path = f"data/{name}/{ident}-{i}.parquet"
                wide = {c: {"int": "long", "smallint": "long", "tinyint": "long", "float": "double"}.get(t) for c, t in df.dtypes}
                df = df.withColumns({c: F.col(f"`{c}`").cast(t) for c, t in wide.items() if t})  # commits must agree on types
                df.withColumn("_commit", F.lit(ident)).withColumn("_pos", F.monotonically_increasing_id() + F.lit(i << 60)).write.parquet(f"{self.path}/{path}")
                written.setdefault(name, []).append(path)
        at = datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="milliseconds")
        record = {"generation": base + 1, "id": ident, "at": at, "by": self.by, "by_device": self.device, "collections": written}
        if not self.write_text(f"commits/{base + 1:012d}.json", json.dumps(record), fresh=True):
            raise WriteConflict(f"generation {base + 1} was committed by another writer")
        for name in written:
            since = self._snapshot(name, base + 1)[0]
            if sum(name in c["collections"] and c["generation"] > since for c in self.commits()) >= SNAPSHOT_AFTER:
                self.snapshot(name)
        return base + 1

    def _snapshot(self, name: str, upto: int) -> tuple[int, str | None]:
        """(generation, path) of the newest snapshot of a collection at or before a generation; (0, None) without one."""
        p, fs = self._fs(f"state/{name}")
        marks = [int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")] if fs.exists(p) else []
        best = max((m for m in marks if m <= upto), default=0)
        return best, json.loads(self.read_text(f"state/{name}/{best:012d}.json"))["path"] if best else None

    def snapshot(self, name: str) -> None:
        """Writes a collection's state as one table, so that later reads start from it and not from its first commit."""
        generation = self.generation()
        path = f"state/{name}/{uuid.uuid4().hex}.parquet"
        self._latest(name, generation).write.parquet(f"{self.path}/{path}")
        self.write_text(f"state/{name}/{generation:012d}.json", json.dumps({"path": path}), fresh=True)

    def at(self, moment) -> int:
        """The generation of a number, or the last one at or before an ISO time."""
        if isinstance(moment, int):
            if not 0 <= moment <= self.generation():
                raise PlanFault(f"as of {moment}: the store is at generation {self.generation()}")
            return moment
        t = datetime.datetime.fromisoformat(str(moment).replace("Z", "+00:00"))
        t = t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)
        return max((c["generation"] for c in self.commits() if datetime.datetime.fromisoformat(c["at"]) <= t), default=0)

    # rows

    def _log(self, name: str, upto: int | None = None, since: int = 0) -> DataFrame | None:
        commits = [c for c in self.commits() if name in c["collections"] and since < c["generation"] and (upto is None or c["generation"] <= upto)]
        if not commits:
            return None
        paths = [f"{self.path}/{p}" for c in commits for p in c["collections"][name]]
        rows = self.spark.read.option("mergeSchema", "true").parquet(*paths)
        known = self.spark.createDataFrame([(c["id"], c["generation"], c["at"], c["by"], c["by_device"]) for c in commits], "_commit string, _generation long, _at string, _by string, _by_device string")
        return rows.join(known, "_commit").drop("_commit")

    def history(self, name: str) -> DataFrame:
        """One row a stored write, in the order of commits."""
        log = self._log(name)
        event = F.concat(F.col("_generation").cast("string"), F.lit(":"), F.col("_pos").cast("string"))
        rows = log.withColumn("_id", event)
        own = [c for c in rows.columns if c not in (*HISTORY, "_pos")]
        return rows.orderBy("_generation", "_pos").select(*HISTORY, *own)

    def as_of(self, name: str, moment) -> DataFrame:
        return self._state(name, self.at(moment))

    def current(self, name: str) -> DataFrame:
        return self._state(name, None)

    def _latest(self, name: str, upto: int) -> DataFrame | None:
        """The last row of each document that is there, with what orders rows: the newest snapshot and the commits behind it."""
        since, path = self._snapshot(name, upto)
        log = self._log(name, upto, since)
        if path is not None:
            held = self.spark.read.parquet(f"{self.path}/{path}")
            log = held if log is None else held.unionByName(log, allowMissingColumns=True)
        if log is None:
            return None
        order = ["_generation", "_pos"]
        own = [c for c in log.columns if c not in ("_doc_id", *order)]
        last = log.groupBy("_doc_id").agg(F.max_by(F.struct(*map(quoted, own)), F.struct(*order)).alias("r"), F.max(F.struct(*order)).alias("o"))
        return last.filter("r._op <> 'delete'").select("_doc_id", *[F.col(f"r.{quoted(c)}").alias(c) for c in own], "o.*")

    def _state(self, name: str, upto: int | None) -> DataFrame:
        latest = self._latest(name, self.generation() if upto is None else upto)
        if latest is None:
            return self.spark.createDataFrame([], T.StructType([T.StructField("_id", T.StringType())]))
        own = [c for c in latest.columns if c not in (*HISTORY, "_pos")]
        return latest.select(F.col("_doc_id").alias("_id"), *map(quoted, own), F.col("_version").alias("__s_version"))

    # backup

    def backup(self, target: str, since: int = 0) -> dict:
        """Copies the commits after a generation, with their data, into a folder with a manifest."""
        commits = [c for c in self.commits() if c["generation"] > since]
        for c in commits:
            for paths in c["collections"].values():
                for p in paths:
                    self.spark.read.parquet(f"{self.path}/{p}").write.parquet(f"{target}/{p}")
        manifest = {"since": since, "generation": self.generation(), "commits": commits}
        Store(self.spark, target).write_text("manifest.json", json.dumps(manifest))
        return {"commits": len(commits), "generation": manifest["generation"]}

    def inspect(self, source: str) -> dict:
        text = Store(self.spark, source).read_text("manifest.json")
        if text is None:
            raise PlanFault("no backup there")
        m = json.loads(text)
        return {"since": m["since"], "generation": m["generation"], "commits": len(m["commits"]), "collections": sorted({n for c in m["commits"] for n in c["collections"]})}

    def restore(self, source: str) -> int:
        """Replays a backup onto the generation that it starts from; a chain of backups is restored in order."""
        m = json.loads(Store(self.spark, source).read_text("manifest.json"))
        if m["since"] != self.generation():
            raise PlanFault(f"the backup continues generation {m['since']}, the store is at {self.generation()}")
        for c in m["commits"]:
            for paths in c["collections"].values():
                for p in paths:
                    self.spark.read.parquet(f"{source}/{p}").write.parquet(f"{self.path}/{p}")
            if not self.write_text(f"commits/{c['generation']:012d}.json", json.dumps(c), fresh=True):
                raise WriteConflict(f"generation {c['generation']} was committed by another writer while the backup was restored")
        return self.generation()
