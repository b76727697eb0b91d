"""Times the headline queries and prints one JSON line: seconds per query (median of three runs after a warm-up) and their sum."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from sluice import catalogue
from sluice.engine import Engine
from sluice.sources import importer, search

#: Queries that stand for the reference's published measurements and for each kind of stage.
HEADLINE = (
    "flagship", "where_and_between", "select_computed_alias", "sort_limit", "distinct_key", "group_compact_sum", "group_compact_multi", "group_compound", "group_percentile",
    "pivot_sum", "window_cumsum", "window_row_number", "fill_month", "lookup_equi", "lookup_top1", "lookup_prefix", "lookup_unwind", "lookup_semi", "union_distinct", "near_topk", "fn_date", "documents_langs",
)


def sized(spark) -> dict:
    """The published measurements at their own sizes: a group and an import of 2 M rows, a view with a pushed filter over 1.8 M, a search."""
    folder = f"file://{tempfile.mkdtemp(prefix='bench-')}"
    made = spark.range(2_000_000).selectExpr("id", "concat('k', id % 40) as code", "id % 7 as qty", "(id % 13) * 1.5D as price", "concat(1 + id % 12, '-2025') as period", "id % 1000 as entity", "md5(cast(id as string)) as note")
    made.coalesce(8).write.parquet(f"{folder}/sales.parquet")
    made.coalesce(8).write.option("header", "true").csv(f"{folder}/sales.csv")
    engine = Engine(spark, folder)
    engine.query("define view statement | exec | on sales | where id < 1800000 | derive total = price * qty | end | end")
    texts = spark.range(180_000).selectExpr("id", "concat_ws(' ', md5(cast(id as string)), concat('item', id % 5000), concat('place', id % 300)) as text")
    search.index(texts, "id", "text").write.parquet(f"{folder}/words.parquet")
    words = spark.read.parquet(f"{folder}/words.parquet")
    return {
        "sized_group_computed": lambda *_: engine.query("on sales | group code, price * qty as total"),
        "sized_view_filter": lambda *_: engine.query("on view statement | where entity == 7 | group period, total"),
        "sized_csv_import": lambda *_: importer.read_csv(spark, f"{folder}/sales.csv"),
        "sized_search": lambda *_: search.search(words, "item77 place12"),
    }


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    own = sized(spark)
    found, queries = {}, catalogue.queries() | own
    for name in (*HEADLINE, *own):
        times = []
        for _ in range(4):
            began = time.time()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        found[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
