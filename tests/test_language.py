"""The language over three small collections of a garden."""

import json
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.engine import Engine, register_stage
from sluice.errors import PlanFault, QueryError, SyntaxFault, WriteConflict
from sluice.sources.store import Store

BEDS = [
    ("north", 12.5, 3, True, ["shade", "clay"], ("clay", 6.5)),
    ("south", 30.0, 5, False, [], ("loam", 7.25)),
    ("wall", 4.0, 1, True, ["sun"], ("sand", None)),
]
PLANTS = [
    (11, "leek", "north", 40, 0.5, "2023-03", "seed"),
    (12, "leek", "south", 25, 0.5, "2023-04", "seed"),
    (13, "fig", "wall", 1, 18.0, "2022-11", "pot"),
    (14, "kale", "north", 12, 1.25, "2023-04", "tray"),
    (15, "kale", "south", 30, 1.25, "2023-03", "tray"),
    (16, "bean", "south", 60, 0.25, None, "seed"),
    (17, "dill", "lost", 5, 0.75, "2023-04", "seed"),
]
COLOURS = [("leek", [0.0, 1.0]), ("fig", [3.0, 4.0]), ("kale", [1.0, 0.0])]


@pytest.fixture(scope="module")
def engine(spark):
    tables = {
        "beds": spark.createDataFrame(BEDS, "bed string, area double, rows long, fenced boolean, notes array<string>, soil struct<kind: string, ph: double>"),
        "plants": spark.createDataFrame(PLANTS, "no long, sort string, bed string, n long, cost double, month string, start string"),
        "colours": spark.createDataFrame(COLOURS, "sort string, rgb array<double>"),
    }
    return Engine(spark, tables={k: v.coalesce(1) for k, v in tables.items()})


def rows(df):
    return [json.loads(x) for x in df.toJSON().collect()]


def bag(found):
    return sorted(json.dumps(r, sort_keys=True) for r in found)


#: (query, rows in any order)
ANY_ORDER = [
    ('on plants | where start != "pot" and n >= 30 | select no, n * cost as paid', [{"no": 11, "paid": 20.0}, {"no": 15, "paid": 37.5}, {"no": 16, "paid": 15.0}]),
    ("on plants | where month == null | select sort", [{"sort": "bean"}]),
    ("on plants | group start", [{"start": "seed", "count": 4}, {"start": "tray", "count": 2}, {"start": "pot", "count": 1}]),
    ('on plants | where sort in ["leek", "kale"] | group sort, n', [{"sort": "leek", "n": 65}, {"sort": "kale", "n": 42}]),
    ("on plants | group | by bed | sum n as heads | max cost as dearest | count where cost < 1 as cheap | end | where heads > 20", [{"bed": "north", "heads": 52, "dearest": 1.25, "cheap": 1}, {"bed": "south", "heads": 115, "dearest": 1.25, "cheap": 2}]),
    ("on plants | group | by sort | first no by n as least | last no by n as most | end | where least != most", [{"sort": "leek", "least": 12, "most": 11}, {"sort": "kale", "least": 14, "most": 15}]),
    ("on beds | group fenced as closed, area", [{"closed": True, "area": 16.5}, {"closed": False, "area": 30.0}]),
    ("on beds | derive soil.deep = rows * 2 | drop soil.kind | select bed, soil.deep as deep, soil.ph as ph", [{"bed": "north", "deep": 6, "ph": 6.5}, {"bed": "south", "deep": 10, "ph": 7.25}, {"bed": "wall", "deep": 2}]),
    ("on beds | unwind notes with index i | select bed, notes, i", [{"bed": "north", "notes": "shade", "i": 0}, {"bed": "north", "notes": "clay", "i": 1}, {"bed": "wall", "notes": "sun", "i": 0}]),
    ("on beds | unwind notes keep empty | count as lines", [{"lines": 4}]),
    ("on beds as b | lookup plants as p | where p.bed == b.bed and p.n * p.cost >= b.area | sort no desc | select no | into dear | end | select bed, dear", [{"bed": "north", "dear": [{"no": 14}, {"no": 11}]}, {"bed": "south", "dear": [{"no": 15}]}, {"bed": "wall", "dear": [{"no": 13}]}]),
    ("on plants | lookup beds on bed == bed into at | where len(at) == 0 | select no", [{"no": 17}]),
    ("on plants as p | lookup beds as b | where b.bed == p.bed | select rows | into b | end | unwind b keep empty | group p.b.rows as rows", [{"rows": 3, "count": 2}, {"rows": 5, "count": 3}, {"rows": 1, "count": 1}, {"count": 1}]),
    ("on beds as b | lookup plants as p | where p.bed == b.bed | group start | into kinds | end | select bed, len(kinds) as kinds", [{"bed": "north", "kinds": 2}, {"bed": "south", "kinds": 2}, {"bed": "wall", "kinds": 1}]),
    ("on beds | select bed | union | on plants | where no < 13 | select sort | end", [{"bed": "north"}, {"bed": "south"}, {"bed": "wall"}, {"sort": "leek"}, {"sort": "leek"}]),
    ("on colours | near rgb, [6.0, 8.0] | where _distance < 0.25 | select sort", [{"sort": "fig"}, {"sort": "leek"}]),
    ("on plants | pivot | rows sort | columns start | values n | aggregate sum | end | where pot? == null", [{"sort": s, "seed": n} for s, n in (("leek", 65), ("bean", 60), ("dill", 5))] + [{"sort": "kale", "tray": 42}]),
    ("on values [{v: 7}, {v: null}, {v: 9}] | where v != 9", [{"v": 7}, {}]),
    ("on values [{big: 18446744073709551615}, {big: 3}] | where big > 9 | count", [{"count": 1}]),
    ("on values [{k: \"x\", at: 3}, {k: \"x\", at: 1}, {k: \"y\", at: 2}] | sort at | group | by k | list at | first at | last at | end", [{"k": "x", "list_at": [1, 3], "first_at": 1, "last_at": 3}, {"k": "y", "list_at": [2], "first_at": 2, "last_at": 2}]),
    ("on values [{__odd: 1}] | derive two = __odd + 1", [{"__odd": 1, "two": 2}]),
    ("on values [{t: \"a--b----c\"}] | select len(split(t, \"--\")) as n, len(split(t, \"\")) as chars", [{"n": 4, "chars": 9}]),
    ("on values [{t: 5}, {t: 9}] as v | lookup values [{u: 1, w: \"p\"}, {u: 5, w: \"q\"}, {u: 8, w: \"r\"}] as x | where x.u < v.t | sort u desc | first | select w | into x | end | select t, x", [{"t": 5, "x": [{"w": "p"}]}, {"t": 9, "x": [{"w": "r"}]}]),
]

#: (query, rows in this order)
IN_ORDER = [
    ("on plants | sort cost desc, no | select no | limit 3", [{"no": 13}, {"no": 14}, {"no": 15}]),
    ("on plants | sort month, no desc | skip 2 | limit 2 | select no", [{"no": 15}, {"no": 11}]),
    ("on plants | sort n desc | distinct sort | limit 2 | select no", [{"no": 16}, {"no": 11}]),
    ("on plants | group sort, n as heads | sort heads | first sort", [{"sort": "fig"}]),
    ("on values [{k: 2}, {k: 8}] | fill k from 0 to 8 step 4", [{"k": 0}, {"k": 2}, {"k": 4}, {"k": 8}]),
    ('on values [{m: "1999-12", q: 4}] | fill m from "1999-11" to "2000-01" step "month" with q = 0 | select m, q', [{"m": "1999-11", "q": 0}, {"m": "1999-12", "q": 4}, {"m": "2000-01", "q": 0}]),
    ("on plants | window | partition by sort | order by no | lag n as was | cumsum n as all | end | where was != null | select no, was, all", [{"no": 15, "was": 12, "all": 42}, {"no": 12, "was": 40, "all": 65}]),
]


@pytest.mark.parametrize("text,expected", ANY_ORDER)
def test_rows(engine, text, expected):
    assert bag(rows(engine.query(text))) == bag(expected)


@pytest.mark.parametrize("text,expected", IN_ORDER)
def test_rows_in_order(engine, text, expected):
    assert rows(engine.query(text)) == expected


@pytest.mark.parametrize("text,kind", [
    ("plants | count", SyntaxFault), ("on plants | where", SyntaxFault), ("on plants | prune 3", PlanFault), ("on plants | where height == 1", PlanFault),
    ("on plants | where n == \"2\"", PlanFault), ("on plants | where n", PlanFault), ("on plants | select n * 2", PlanFault), ("on plants | group | sum n | end", PlanFault),
    ("on plants | window | row_number | end", PlanFault), ("on plants | lookup beds | where true | end", PlanFault), ("on plants | select n | count | limit 1", PlanFault),
    ("on plants | derive a = grow(1)", PlanFault), ("on plants | derive a = abs(1, 2)", PlanFault), ("on plants | where n == $x", PlanFault), ("on plants | limit -1", PlanFault), ("on plants | group | by n | sum n as n | end", PlanFault), ("on plants | where n > 1 ; limit 2 | count", SyntaxFault),
])
def test_faults_before_any_job(engine, text, kind):
    with pytest.raises(kind):
        engine.query(text)


def test_single_checks_when_it_runs(engine):
    with pytest.raises(Exception, match="exactly one row"):
        engine.query("on plants | single").collect()


def test_params_and_let(engine):
    assert rows(engine.query("on plants | where sort == $s | count", {"s": 'fig" or true'})) == [{"count": 0}]
    assert rows(engine.query("let $least ?= 1, $beds = (on beds | where rows > $least | select bed) | on plants | where bed in $beds | count", {"least": 3})) == [{"count": 3}]


def test_views(engine):
    engine.query('define view sown | exec | on plants | where start == "seed" | end | end')
    engine.query('define view sown | description "many" | materialized | exec | on plants | where start == "seed" and n > 30 | end | end')
    assert rows(engine.query("on view sown | count")) == [{"count": 2}]
    assert rows(engine.query("on _cache | select view, version")) == [{"view": "sown", "version": 2}]
    assert rows(engine.query("on view sown version 1 | count")) == [{"count": 4}]
    engine.query("define view ring | exec | on view ring | end | end")
    with pytest.raises(QueryError):
        engine.query("on view ring | count")
    engine.query("undefine view sown")
    with pytest.raises(PlanFault):
        engine.query("on view sown | count")


def test_view_parameters(engine):
    engine.query("define view cheap | exec | let $most ?= 1 | on plants | where cost <= $most and bed == $bed | end | end")
    assert rows(engine.query('let $bed = "south" | on view cheap | count')) == [{"count": 2}]
    assert rows(engine.query("on view cheap | count", {"bed": "south", "most": 2})) == [{"count": 3}]
    assert rows(engine.query('let $bed = "north" | on beds | where bed == $bed | lookup view cheap as c | where c.bed == bed | into c | end | select len(c) as n')) == [{"n": 1}]
    with pytest.raises(PlanFault, match="bed"):
        engine.query("on view cheap | count")


def test_custom_stage(engine):
    register_stage("pick", lambda df, words: df.limit(int(words[0])))
    assert rows(engine.query("on plants | pick 3 | count")) == [{"count": 3}]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(engine):
    """Lookups whose rows nobody reads are counted, semi or plain joins; first rows of a key are picked before they are shuffled."""
    assert "LeftSemi" in plan(engine.query("on beds as b | lookup plants as p on p.bed == b.bed into ps | where len(ps) > 0 | select bed"))
    assert "collect_list" not in plan(engine.query("on beds | lookup plants on bed == bed into ps | unwind ps | select bed, ps.no as no"))
    assert "collect_list" not in plan(engine.query("on beds | lookup plants on bed == bed into ps | select bed, len(ps) as n"))
    assert "WindowGroupLimit" in plan(engine.query("on plants | sort n desc, no | distinct sort"))
    assert "Window" not in plan(engine.query("on plants | sort n desc | group | by sort | first no | list n | end"))
    assert "WindowGroupLimit" in plan(engine.query("on beds as b | lookup plants as p | where p.bed == b.bed | sort n desc | first | into best | end"))
    nearest = plan(engine.query("on plants as p | lookup plants as q | where q.sort == p.sort and q.n < p.n | sort n desc, no | first | into q | end"))
    assert "lead" not in nearest and "last(" in nearest


def test_bounds(engine, monkeypatch):
    from sluice.operators import combining, grouping

    monkeypatch.setattr(combining, "KEYLESS", 5)
    monkeypatch.setattr(grouping, "LABELS", 2)
    assert rows(engine.query("on beds | where rows == 1 | lookup plants as p | where p.no < 13 | into ps | end | select len(ps) as n")) == [{"n": 2}]
    with pytest.raises(Exception, match="at most 5 rows"):
        engine.query("on beds | lookup plants as p | sort no | into ps | end | select bed, at(ps, 0) as p").collect()
    with pytest.raises(PlanFault, match="more than 2 columns"):
        engine.query("on plants | pivot | rows bed | columns sort | values n | aggregate sum | end")


def test_stage_catalogue():
    assert len(Engine.stages()) == 28


def test_results_are_kept_until_tables_change(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    e = Engine(spark, f"file://{tmp_path}")
    assert e.cached("on t | count").first()["count"] == 3
    assert e.cached("on t | count") is e.cached("on t | count")
    spark.range(5).write.mode("append").parquet(f"{tmp_path}/t.parquet")
    assert e.cached("on t | count").first()["count"] == 8


def test_store(spark, tmp_path):
    e = Engine(spark, store=f"file://{tmp_path}/store")
    e.query('on tools | insert [{name: "rake", age: 3}, {name: "hoe", age: 5, parts: ["blade"]}]')
    e.query("on tools | set age = age + 1, was = age")
    e.query('on tools | where name == "hoe" | delete')
    assert rows(e.query("on tools | select name, age, was | drop _id")) == [{"name": "rake", "age": 4, "was": 3}]
    assert rows(e.query("on tools as of 1 | sort age | select age | drop _id")) == [{"age": 3}, {"age": 5}]
    assert [r["_op"] for r in e.query("on tools history").select("_op").collect()] == ["insert", "insert", "replace", "replace", "delete"]
    e.query("on tools | where age > 100 | into elsewhere")
    assert e.store.generation() == 3
    for text in ("on tools as of 1 | delete", "on tools history | delete", "on tools as of 9 | count"):
        with pytest.raises(PlanFault):
            e.query(text)
    e.query("on tools as of 1 | into restored")
    assert rows(e.query("on restored | count")) == [{"count": 2}]
    assert e.store.backup(f"file://{tmp_path}/backup") == {"commits": 4, "generation": 4}
    other = Engine(spark, store=f"file://{tmp_path}/other")
    assert other.store.restore(f"file://{tmp_path}/backup") == 4
    assert rows(other.query("on tools | count")) == [{"count": 1}]


def test_snapshots_change_nothing(spark, tmp_path, monkeypatch):
    from sluice.sources import store

    monkeypatch.setattr(store, "SNAPSHOT_AFTER", 2)
    e = Engine(spark, store=f"file://{tmp_path}/store")
    e.query("on c | insert [{_id: \"a\", n: 1}, {_id: \"b\", n: 2}]")
    for i in range(3):
        e.query(f'on c | where _id == "a" | set n = n + 10, x{i} = true')
    e.query('on c | where _id == "b" | delete')
    assert [rows(e.query(f"on c as of {g} | sort _id | select n | drop _id")) for g in range(1, 6)] == [[{"n": 1}, {"n": 2}], [{"n": 11}, {"n": 2}], [{"n": 21}, {"n": 2}], [{"n": 31}, {"n": 2}], [{"n": 31}]]
    assert e.store._snapshot("c", 5)[0] >= 2


def test_racing_writers(spark, tmp_path):
    """Of several writers of one generation one wins, readers meet whole commits only, and the language's writes try again."""
    path = f"file://{tmp_path}/store"
    won, seen = [], []

    def commit(i):
        if Store(spark, path).write_text("commits/000000000001.json", json.dumps({"generation": 1, "by": i, "collections": {}, "fill": "x" * 100_000}), fresh=True):
            won.append(i)
        seen.extend(c["by"] for c in Store(spark, path).commits())

    threads = [threading.Thread(target=commit, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and set(seen) == set(won) and len(seen) == 8
    e = Engine(spark, store=path)
    late = e.store.commit
    tried = []

    def beaten(changes, base):
        tried.append(base)
        if len(tried) == 1:
            late(changes, base)  # another writer's commit takes the generation
            raise WriteConflict("taken")
        return late(changes, base)

    e.store.commit = beaten
    e.query("on c | insert {n: 1}")
    assert tried == [1, 2] and rows(e.query("on c | count")) == [{"count": 2}]


def test_import(spark, tmp_path):
    from sluice.sources import importer

    (tmp_path / "a.csv").write_text('code;price;n\n007;"12,5";1\n010;3;2\n', encoding="utf-8")
    df = importer.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert [tuple(r) for r in df.collect()] == [("007", 12.5, 1), ("010", 3.0, 2)]
    roles = {r.name: r.role for r in importer.profile(df).collect()}
    assert set(roles) == {"code", "price", "n"}


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "cp1252", "latin-1"])
def test_import_of_other_encodings(spark, tmp_path, encoding):
    from sluice.sources import importer

    odd = "\x81" if encoding == "latin-1" else ""
    euro = "" if encoding == "latin-1" else "€"
    (tmp_path / "a.csv").write_bytes(f"név{euro};n\nBéla{odd};1\nÜlo{euro};2\n".encode(encoding))
    df = importer.read_csv(spark, f"file://{tmp_path}/a.csv")
    assert [tuple(r) for r in df.collect()] == [(f"Béla{odd}", 1), (f"Ülo{euro}", 2)] and df.columns == [f"név{euro}", "n"]


def test_import_by_a_mapping(spark):
    from sluice.sources import importer

    raw = spark.createDataFrame([("3/4/21", "1 234,5", "Oui"), ("2020-02-30", "x", "no"), ("2019.12.1", "-7", None), ("44927", "", "perhaps"), (None, None, "1")], "d string, n string, b string")
    got = importer.mapped(raw, {"day": ("d", "date"), "us": ("d", "date", "mdy"), "month": ("d", "month"), "amount": ("n", "number"), "ok": ("b", "boolean"), "text": ("b", "string")}).collect()
    assert [tuple(r) for r in got] == [("2021-04-03", "2021-03-04", "2021-04", 1234.5, True, "Oui"), (None, None, None, None, False, "no"), ("2019-12-01", "2019-12-01", "2019-12", -7.0, None, None), ("2023-01-01", "2023-01-01", "2023-01", None, None, "perhaps"), (None, None, None, None, True, "1")]


def test_search(spark):
    from sluice.sources import search

    docs = spark.createDataFrame([(1, "A heavy wet soil"), (2, "heavier than sand"), (3, "Sandy, dry soil")], "id long, text string")
    words = search.index(docs, "id", "text")
    assert [r.id for r in search.search(words, "heav").collect()] == [1, 2]
    assert [r.id for r in search.search(words, "siol").collect()] == []
    assert [r.id for r in search.search(words, "soul").collect()] == [1, 3]
    long = spark.createDataFrame([(1, "ab " * 900)], "id long, text string")
    assert search.passages(long, "id", "text").count() == 3


def test_subscribers_see_an_event_once(spark, tmp_path):
    from sluice.streaming import windows

    seen = []
    for i, ids in enumerate(([1, 2, 2], [2, 3])):
        spark.createDataFrame([(x, f"2024-01-01 00:0{i}:00") for x in ids], "event_id long, at string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("event_id long, at string").parquet(f"{tmp_path}/in").withColumn("at", F.col("at").cast("timestamp"))
        handler = lambda df, n: seen.extend(r.event_id for r in df.collect())
        windows.subscribe(stream, f"{tmp_path}/state", handler, time="at").trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [1, 2, 3]


def test_event_time_windows_on_a_stream(spark, tmp_path):
    """A stream gives each closed window once, without rows later than the watermark; so do sessions on a batch."""
    from sluice.streaming import windows

    def put(i, found):
        df = spark.createDataFrame(found, "at string, user string, value double").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/in")

    put(0, [("2024-01-01 00:01:00", "u", 1.0), ("2024-01-01 00:09:00", "v", 2.0), ("2024-01-01 00:31:00", "u", 4.0)])
    stream = spark.readStream.schema("at string, user string, value double").option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
    out = windows.tumbling(stream.withColumn("at", F.col("at").cast("timestamp")), "at", "10 minutes", [], late="5 minutes")
    out.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start().awaitTermination()
    put(1, [("2024-01-01 00:02:00", "late", 8.0), ("2024-01-01 01:00:00", "u", 16.0)])
    out.writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start().awaitTermination()
    assert sorted((r.n, r.total) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 4.0), (2, 3.0)]
    batch = spark.read.parquet(f"{tmp_path}/in")
    assert sorted((r.user, r.n) for r in windows.sessions(batch, "at", "20 minutes", "user").collect()) == [("late", 1), ("u", 1), ("u", 1), ("u", 1), ("v", 1)]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_beside_other_measures(spark, monkeypatch, accuracy):
    """Exact where a sketch is coarse, values tie, keys and values are null; without keys, and of nothing."""
    from sluice.operators import grouping

    monkeypatch.setattr(grouping, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    data = [(rng.choice([None, "a", "a", "b"]), rng.choice([None, 7.0, rng.random() * 20])) for _ in range(4000)] + [("lone", 1.5), ("none", None)]
    e = Engine(spark, tables={"t": spark.createDataFrame(data, "k string, v double").repartition(3), "none": spark.createDataFrame([], "k string, v double")})
    for p in (0, 0.003, 0.5, 0.9, 1):
        found = e.query(f"on t | group | by k | percentile v {p} as q | count as n | median v where v != 7 as m | end").collect()
        assert len(found) == 5
        for r in found:
            own = [v for k, v in data if k == r.k]
            usable = [v for v in own if v is not None]
            assert (r.q, r.n) == (pytest.approx(np.quantile(usable, p)) if usable else None, len(own))
            rest = [v for v in usable if v != 7]
            assert r.m == (pytest.approx(np.median(rest)) if rest else None)
    assert e.query("on none | group | by k | median v | end").count() == 0
    lookup = 'on t as o | where o.k == "lone" | lookup t as i | where i.k != o.k | group | by k | median v as m | end | into ms | end | select len(ms) as n'
    assert e.query(lookup).first().n >= 2


def _moved_unaggregated(node, above=False):
    """Scans whose rows meet an exchange before any aggregate."""
    name, children = node.nodeName(), node.children()
    above = "Exchange" in name or (above and "Aggregate" not in name)
    if children.isEmpty():
        return [name] if above else []
    return [x for i in range(children.size()) for x in _moved_unaggregated(children.apply(i), above)]


@pytest.mark.parametrize("keys", ["by k", "by k as a, round(v / 9) as b", "by 1 as all"])
def test_quantile_rows_are_counted_before_they_move(spark, keys):
    """No table is too large for it: a group's rows are not sent to one task and sorted there, nor all rows broadcast."""
    e = Engine(spark, tables={"t": spark.range(1000).selectExpr("nullif(id % 3, 2) as k", "cast(id as double) as v")})
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for most in ("-1", "1g"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            out = e.query(f"on t | group | {keys} | median v | percentile v 0.9 as p | sum v as s | end")
            assert _moved_unaggregated(out._jdf.queryExecution().executedPlan()) == []
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("large", [0, 1, 500, 10_000])
def test_quantiles_of_large_and_small_groups(spark, monkeypatch, large):
    """The same values with bounds, without, and with both kinds of groups."""
    from sluice.operators import grouping

    monkeypatch.setattr(grouping, "ACCURACY", 50)
    monkeypatch.setattr(grouping, "LARGE", large)
    rng = random.Random(large)
    data = [(rng.choice([None, "a", "a", "b"]), rng.choice([None, 7.0, rng.random() * 20])) for _ in range(3000)] + [("lone", 1.5), ("none", None)]
    e = Engine(spark, tables={"t": spark.createDataFrame(data, "k string, v double").repartition(3)})
    for p in (0, 0.01, 0.5, 0.99, 1):
        found = {r.k: r for r in e.query(f"on t | group | by k | percentile v {p} as q | median v where v < 3 as m | end").collect()}
        assert set(found) == {k for k, _ in data}
        for k, r in found.items():
            own = [v for x, v in data if x == k and v is not None]
            low = [v for v in own if v < 3]
            assert r.q == (pytest.approx(np.quantile(own, p)) if own else None)
            assert r.m == (pytest.approx(np.median(low)) if low else None)
        assert e.query(f"on t | group | by 1 as all | percentile v {p} as q | end").first().q == pytest.approx(np.quantile([v for _, v in data if v is not None], p))
