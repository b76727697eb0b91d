"""Named queries over the driver's tables, each with its SQL counterpart.

Every entry is (name, text of the pipeline language, DuckDB SQL or None). Where SQL cannot say the same, the tests do.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from sluice.engine import Engine, register_stage
from sluice.sources import importer, search
from sluice.streaming import windows

VECTOR = [1.0 if i == 0 else 0.5 if i == 7 else 0.0 for i in range(64)]
_V = str(VECTOR)

_PREFIXES = '[{prefix: "Brand#1", cat: "a"}, {prefix: "Brand#12", cat: "b"}, {prefix: "Brand#2", cat: "c"}]'

ENTRIES: list[tuple[str, str, str | None]] = [
    ("flagship",
     'on orders | where o_totalprice > 1000 | derive y = date_part(o_orderdate, "year") | group y, o_totalprice as revenue | derive revenue = round(revenue, 2) | sort revenue desc | limit 5',
     "SELECT * FROM (SELECT year(o_orderdate)::BIGINT AS y, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_totalprice > 1000 GROUP BY 1) ORDER BY revenue DESC LIMIT 5"),
    ("where_and_between",
     'on lineitem | where l_quantity between 10 and 20 and l_returnflag in ["A", "R"] and not (l_discount > 0.05) | select l_orderkey, l_linenumber, l_quantity, l_extendedprice',
     "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A','R') AND NOT (l_discount > 0.05)"),
    ("where_logic",
     'on customer | where (c_mktsegment == "BUILDING" or c_acctbal < 0) and c_nationkey not in [1, 2, 3] and c_custkey not between 10 and 50 | select c_custkey, c_mktsegment',
     "SELECT c_custkey, c_mktsegment FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND c_nationkey NOT IN (1,2,3) AND NOT (c_custkey BETWEEN 10 AND 50)"),
    ("where_null_safe",
     'on orders | derive s = nullif(o_orderstatus, "F") | where s == null or s != "O" | select o_orderkey, s',
     "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL OR nullif(o_orderstatus, 'F') IS DISTINCT FROM 'O'"),
    ("where_primary_key", "on orders | where o_orderkey == 42 | select o_orderkey, o_custkey, o_orderpriority", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderkey = 42"),
    ("where_time", 'on orders | where o_orderdate >= "1998-01-01" and o_orderdate < "1998-02-01" | select o_orderkey', "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1998-02-01'"),
    ("select_computed_alias",
     "on lineitem | select l_orderkey, l_extendedprice * (1 - l_discount) as net, net * (1 + l_tax) as gross | derive net = round(net, 7), gross = round(gross, 7)",
     "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 7) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS gross FROM lineitem"),
    ("derive_chain",
     'on part | derive a = p_size * 2, b = a + 1, a = a - 1, kind = if(b > 50, "big", "small") | select p_partkey, a, b, kind',
     "SELECT p_partkey, p_size::BIGINT * 2 - 1 AS a, p_size::BIGINT * 2 + 1 AS b, CASE WHEN p_size * 2 + 1 > 50 THEN 'big' ELSE 'small' END AS kind FROM part"),
    ("rename_drop", "on nation | rename n_name as name | drop n_regionkey, nothing", "SELECT n_nationkey, n_name AS name FROM nation"),
    ("root_struct",
     "on orders | select o_orderkey as o.key, o_totalprice as o.money.total, o_orderstatus as o.status | rename o.status as o.s | root o | select key, money.total as total, s",
     "SELECT o_orderkey AS key, o_totalprice AS total, o_orderstatus AS s FROM orders"),
    ("nested_paths",
     "on supplier | derive a.b.c = s_suppkey, a.b.d = s_acctbal | drop a.b.d | derive x = a.b.c + 1, n = len(a.b) | select s_suppkey, x, n",
     "SELECT s_suppkey, s_suppkey + 1 AS x, 1::BIGINT AS n FROM supplier"),
    ("sort_limit", "on orders | select o_orderkey, o_totalprice | sort o_totalprice desc, o_orderkey | limit 20", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    ("sort_expr_skip",
     "on customer | sort abs(c_acctbal - 1000), c_custkey | skip 5 | limit 10 | select c_custkey, c_acctbal",
     "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal - 1000), c_custkey LIMIT 10 OFFSET 5"),
    ("sort_nulls_first",
     'on orders | derive s = nullif(o_orderstatus, "F") | sort s, o_orderkey | limit 10 | select o_orderkey, s',
     "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey LIMIT 10"),
    ("distinct_all", "on customer | select c_mktsegment, c_nationkey | distinct", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer"),
    ("distinct_key",
     "on orders | sort o_totalprice desc, o_orderkey | distinct o_custkey | select o_custkey, o_orderkey",
     "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    ("count_as", 'on lineitem | where l_returnflag == "R" | count as returned', "SELECT count(*) AS returned FROM lineitem WHERE l_returnflag = 'R'"),
    ("count_empty", 'on lineitem | where l_returnflag == "none" | count', 'SELECT count(*) AS "count" FROM lineitem WHERE l_returnflag = \'none\''),
    ("first_row", "on orders | sort o_orderkey desc | first o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 1"),
    ("single_row", "on nation | where n_nationkey == 7 | single n_name", "SELECT n_name FROM nation WHERE n_nationkey = 7"),
    ("unknown_collection", "on nowhere | count", 'SELECT 0::BIGINT AS "count"'),
    ("group_compact_count", "on orders | group o_orderstatus", 'SELECT o_orderstatus, count(*) AS "count" FROM orders GROUP BY 1'),
    ("group_compact_sum",
     "on lineitem | group l_returnflag, l_quantity | derive l_quantity = round(l_quantity, 2)",
     "SELECT l_returnflag, round(sum(l_quantity), 2) AS l_quantity FROM lineitem GROUP BY 1"),
    ("group_compact_multi",
     "on lineitem | group l_returnflag as flag, l_linestatus, l_extendedprice * (1 - l_discount) as rev, l_linenumber as lines | derive rev = round(rev, 2)",
     "SELECT l_returnflag AS flag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS rev, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1, 2"),
    ("group_compact_unknown",
     "on orders | rename o_custkey as who | group o_orderstatus, o_orderpriority, who",
     "SELECT o_orderstatus, o_orderpriority, sum(o_custkey)::BIGINT AS who FROM orders GROUP BY 1, 2"),
    ("group_compound",
     "on orders | group | by o_orderstatus, date_part(o_orderdate, \"year\") as y | sum o_totalprice as total | avg o_totalprice | min o_orderkey | max o_orderkey | count as n | count o_custkey | first o_orderkey by o_totalprice as cheapest | last o_orderkey by o_totalprice as dearest | end | derive total = round(total, 2), avg_o_totalprice = round(avg_o_totalprice, 4)",
     "SELECT o_orderstatus, year(o_orderdate)::BIGINT AS y, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS avg_o_totalprice, min(o_orderkey) AS min_o_orderkey, max(o_orderkey) AS max_o_orderkey, count(*) AS n, count(o_custkey) AS count_o_custkey, arg_min(o_orderkey, o_totalprice) AS cheapest, arg_max(o_orderkey, o_totalprice) AS dearest FROM orders GROUP BY 1, 2"),
    ("group_where",
     'on orders | group | by o_orderpriority | sum o_totalprice where o_orderstatus == "F" as f_total | count where o_totalprice > 200000 as big | avg o_totalprice where o_orderstatus != "F" as rest | last o_orderkey by o_orderkey where o_totalprice < 100000 as small | end | derive f_total = round(f_total, 2), rest = round(rest, 4)',
     "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS f_total, count(*) FILTER (WHERE o_totalprice > 200000) AS big, round(avg(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 4) AS rest, max(o_orderkey) FILTER (WHERE o_totalprice < 100000) AS small FROM orders GROUP BY 1"),
    ("group_list",
     "on orders | sort o_orderdate, o_orderkey | group | by o_custkey | list o_orderkey as keys | first o_orderstatus | last o_orderstatus | end | derive n = len(keys), head = at(keys, 0), tail = at(keys, -1) | drop keys",
     "SELECT o_custkey, len(list(o_orderkey)) AS n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS head, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS tail, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS first_o_orderstatus, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS last_o_orderstatus FROM orders GROUP BY 1"),
    ("group_percentile",
     "on lineitem | group | by l_returnflag | median l_quantity | percentile l_extendedprice 0.9 as p90 | stddev l_discount as sd | end | derive p90 = round(p90, 4), sd = round(sd, 6)",
     "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median_l_quantity, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(stddev_samp(l_discount), 6) AS sd FROM lineitem GROUP BY 1"),
    ("group_limit",
     "on part | group p_type | limit 3",
     'SELECT p_type, count(*) AS "count" FROM part GROUP BY 1 ORDER BY strlen(p_type), p_type LIMIT 3'),
    ("group_nested_key",
     "on orders | group | by o_orderstatus as k.status, o_orderpriority as k.prio | count | end | derive s = k.status, p = k.prio | drop k",
     'SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS "count" FROM orders GROUP BY 1, 2'),
    ("count_distinct", "on lineitem | distinct l_partkey | count as parts", "SELECT count(DISTINCT l_partkey) AS parts FROM lineitem"),
    ("bucket_default",
     "on part | bucket p_size by [5, 10, 25, 40] default -1 as size",
     "SELECT CASE WHEN p_size >= 5 AND p_size < 10 THEN 5 WHEN p_size >= 10 AND p_size < 25 THEN 10 WHEN p_size >= 25 AND p_size < 40 THEN 25 ELSE -1 END::BIGINT AS size, count(*) AS \"count\" FROM part GROUP BY 1"),
    ("pivot_sum",
     "on orders | pivot | rows o_orderpriority | columns o_orderstatus | values o_totalprice | aggregate sum | end | derive F = round(F, 2), O = round(O, 2), P = round(P, 2)",
     "SELECT o_orderpriority, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 2) AS \"F\", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS \"O\", round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P'), 2) AS \"P\" FROM orders GROUP BY 1"),
    ("pivot_two_measures",
     "on lineitem | pivot | rows l_linestatus | columns l_returnflag | values l_linenumber as lines, l_orderkey as ok | aggregate max | end",
     "SELECT l_linestatus, " + ", ".join(f"(max(l_linenumber) FILTER (WHERE l_returnflag = '{c}'))::BIGINT AS \"{c}.lines\", max(l_orderkey) FILTER (WHERE l_returnflag = '{c}') AS \"{c}.ok\"" for c in "ANR") + " FROM lineitem GROUP BY 1"),
    ("pivot_count_expr",
     'on events | pivot | rows date_part(ts, "week") as w | columns event_type | values value * 2 as v | aggregate count | end',
     "SELECT weekofyear(ts)::BIGINT AS w, " + ", ".join(f"nullif(count(*) FILTER (WHERE event_type = '{c}'), 0) AS {c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1"),
    ("window_lag_lead",
     "on events | window | partition by user_id | order by ts, event_id | lag value as prev | lead event_type 2 as later | end | select event_id, prev, later",
     "SELECT event_id, lag(value) OVER w AS prev, lead(event_type, 2) OVER w AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    ("window_cumsum",
     "on orders | window | partition by o_custkey | order by o_orderdate, o_orderkey | cumsum o_totalprice as run | cumsum o_orderkey as keys | end | select o_orderkey, round(run, 2) as run, keys",
     "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS run, (sum(o_orderkey) OVER w)::BIGINT AS keys FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)"),
    ("window_first_last",
     "on conversations | window | partition by conv_id | order by turn | first role as opener | last turn as turns | end | select conv_id, turn, opener, turns",
     "SELECT conv_id, turn, first_value(role) OVER w AS opener, last_value(turn) OVER w AS turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"),
    ("window_row_number",
     "on customer | window | partition by c_nationkey | order by c_acctbal desc, c_custkey | row_number as place | lag place as before | end | where place <= 3 | select c_custkey, place, before",
     "SELECT c_custkey, place, CASE WHEN place > 1 THEN place - 1 END AS before FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 3"),
    ("fill_numeric",
     "on part | group | by p_type, p_size | count as n | end | fill p_size from 0 to 63 step 7 by p_type with n = 0 | select p_type, to_int(p_size) as p_size, n",
     "WITH g AS (SELECT p_type, p_size::BIGINT AS p_size, count(*) AS n FROM part GROUP BY 1, 2), w AS (SELECT DISTINCT p_type, unnest(range(0, 64, 7)) AS p_size FROM g) SELECT p_type, p_size, n FROM g UNION ALL SELECT p_type, p_size, 0 FROM w ANTI JOIN g USING (p_type, p_size)"),
    ("fill_month",
     'on orders | where o_orderstatus == "P" | derive m = date_format(o_orderdate, "%Y-%m") | group | by o_custkey, m | count as n | end | fill m from "1996-01" to "1996-12" step "month" by o_custkey with n = 0',
     "WITH g AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS m, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1, 2), w AS (SELECT DISTINCT o_custkey, strftime(t, '%Y-%m') AS m FROM g, range(DATE '1996-01-01', DATE '1997-01-01', INTERVAL 1 MONTH) r(t)) SELECT o_custkey, m, n FROM g UNION ALL SELECT o_custkey, m, 0 FROM w ANTI JOIN g USING (o_custkey, m)"),
    ("lookup_equi",
     "on customer as c | lookup orders as o on o.o_custkey == c.c_custkey into os | select c_custkey, len(os) as n",
     "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"),
    ("lookup_correlated",
     "on customer as c | lookup orders as o | where o.o_custkey == c.c_custkey and o.o_totalprice > c.c_acctbal * 20 | select o_orderkey | into os | end | select c_custkey, len(os) as n",
     "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > c_acctbal * 20 GROUP BY 1"),
    ("lookup_outer_derive",
     "on customer as c | lookup orders as o | where o.o_custkey == c.c_custkey | derive share = o_totalprice - c.c_acctbal | where share > 150000 | select c.c_nationkey, share | into os | end | unwind os | select c_custkey, os.c_nationkey as nation, round(os.share, 2) as share",
     "SELECT c_custkey, c_nationkey::BIGINT AS nation, round(o_totalprice - c_acctbal, 2) AS share FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice - c_acctbal > 150000"),
    ("lookup_top1",
     "on customer as c | lookup orders as o | where o.o_custkey == c.c_custkey | sort o_totalprice desc, o_orderkey | first | select o_orderkey | into best | end | select c_custkey, at(best, 0) as b | derive k = b.o_orderkey | drop b",
     "SELECT c_custkey, k FROM customer LEFT JOIN (SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey"),
    ("lookup_group",
     "on nation as n | lookup customer as c | where c.c_nationkey == n.n_nationkey | group c_mktsegment | sort count desc, c_mktsegment | limit 2 | into segs | end | unwind segs keep empty | select n_nationkey, segs.c_mktsegment as seg, segs.count as cnt",
     "SELECT n_nationkey, seg, cnt FROM nation LEFT JOIN (SELECT * FROM (SELECT c_nationkey, c_mktsegment AS seg, count(*) AS cnt, row_number() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC, c_mktsegment) AS r FROM customer GROUP BY 1, 2) WHERE r <= 2) ON c_nationkey = n_nationkey"),
    ("lookup_prefix",
     f"on part as p | lookup values {_PREFIXES} as r | where starts_with(p.p_brand, r.prefix) | derive l = len(prefix) | sort l desc | first | select cat | into rule | end | select p_partkey, at(rule, 0) as r0 | derive cat = r0.cat | drop r0",
     "SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#12') THEN 'b' WHEN starts_with(p_brand, 'Brand#1') THEN 'a' WHEN starts_with(p_brand, 'Brand#2') THEN 'c' END AS cat FROM part"),
    ("lookup_as_of",
     "on orders as o | lookup orders as p | where p.o_custkey == o.o_custkey and p.o_orderdate < o.o_orderdate | sort o_orderdate desc, o_orderkey | first | select o_orderkey | into prev | end | select o_orderkey, at(prev, 0) as p0 | derive before = p0.o_orderkey | drop p0",
     "SELECT o.o_orderkey, arg_min(p.o_orderkey, (-epoch_ms(p.o_orderdate), p.o_orderkey)) AS before FROM orders o LEFT JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate GROUP BY 1"),
    ("lookup_following",
     "on orders as o | lookup orders as p | where p.o_custkey == o.o_custkey and p.o_orderdate >= o.o_orderdate | sort o_orderdate, o_totalprice desc, o_orderkey | limit 1 | select o_totalprice | into next | end | select o_orderkey, at(next, 0) as n0 | derive price = n0.o_totalprice | drop n0",
     "SELECT o.o_orderkey, arg_min(p.o_totalprice, (epoch_us(p.o_orderdate), -p.o_totalprice, p.o_orderkey)) AS price FROM orders o LEFT JOIN orders p ON p.o_custkey = o.o_custkey AND p.o_orderdate >= o.o_orderdate GROUP BY 1"),
    ("distinct_limit",
     "on orders | sort o_totalprice desc, o_orderkey | distinct o_custkey | limit 7 | select o_custkey, o_orderkey",
     "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1 ORDER BY o_totalprice DESC, o_orderkey LIMIT 7"),
    *[(f"pivot_{fn}",
       f"on orders | sort o_orderkey | pivot | rows o_orderpriority | columns o_orderstatus | values o_totalprice | aggregate {fn} | end | derive F = {call.format('F')}, O = {call.format('O')}, P = {call.format('P')}",
       "SELECT o_orderpriority, " + ", ".join(sql.format(c) + f' AS "{c}"' for c in "FOP") + " FROM orders GROUP BY 1")
      for fn, call, sql in (
          ("avg", "round({}, 4)", "round(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{}'), 4)"),
          ("min", "{}", "min(o_totalprice) FILTER (WHERE o_orderstatus = '{}')"),
          ("first", "{}", "arg_min(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = '{}')"),
          ("last", "{}", "arg_max(o_totalprice, o_orderkey) FILTER (WHERE o_orderstatus = '{}')"),
          ("list", "len({})", "count(*) FILTER (WHERE o_orderstatus = '{}')"))],
    ("now_is_now", "on region | select r_regionkey, date_diff(now(), now(), \"day\") as d, now() > parse_date(\"2020-01-01\") as later", "SELECT r_regionkey, 0::BIGINT AS d, true AS later FROM region"),
    ("lookup_nested",
     "on region as r | lookup nation as n | where n.n_regionkey == r.r_regionkey | lookup supplier as s | where s.s_nationkey == n.n_nationkey | select s_suppkey | into ss | end | derive k = len(ss) | select n_name, k | into ns | end | unwind ns | select r_name, ns.n_name as n_name, ns.k as k",
     "SELECT r_name, n_name, count(s_suppkey) AS k FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY r_name, n_name, n_nationkey"),
    ("lookup_theta",
     "on region as r | lookup nation as n | where n.n_nationkey < r.r_regionkey * 3 | into ns | end | select r_regionkey, len(ns) as n",
     "SELECT r_regionkey, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_nationkey < r_regionkey * 3 GROUP BY 1"),
    ("lookup_unwind",
     "on orders as o | lookup customer as c | where c.c_custkey == o.o_custkey | select c_name, c_nationkey | into c | end | unwind c | select o_orderkey, c.c_name as name",
     "SELECT o_orderkey, c_name AS name FROM orders JOIN customer ON c_custkey = o_custkey"),
    ("lookup_keep_empty",
     'on customer | lookup orders on o_custkey == c_custkey into o | unwind o keep empty | select c_custkey, o.o_orderkey as k',
     "SELECT c_custkey, o_orderkey AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey"),
    ("lookup_semi", "on documents as d | lookup labels as l | where l.doc_id == d.doc_id and l.toxic == 1 | into ls | end | where len(ls) > 0 | select doc_id, lang", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"),
    ("lookup_anti", "on documents | lookup labels on doc_id == doc_id into ls | where len(ls) == 0 | select doc_id, source", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    ("union_all", "on customer | select c_nationkey as k, c_acctbal as bal | union | on supplier | select s_nationkey as k, s_acctbal as bal | end", "SELECT c_nationkey::BIGINT AS k, c_acctbal AS bal FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier"),
    ("union_ragged",
     "on region | union | on nation | where n_nationkey < 5 | end | select r_name?, n_name?",
     "SELECT r_name, NULL AS n_name FROM region UNION ALL SELECT NULL, n_name FROM nation WHERE n_nationkey < 5"),
    ("union_distinct", "on customer | select c_nationkey as k | union | on supplier | select s_nationkey as k | end | distinct", "SELECT c_nationkey::BIGINT AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    ("union_branch_pipeline",
     "on orders | group o_orderstatus as k | union | on lineitem | group l_returnflag as k | sort count desc, k | limit 2 | end",
     "SELECT o_orderstatus AS k, count(*) AS \"count\" FROM orders GROUP BY 1 UNION ALL (SELECT l_returnflag, count(*) FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2)"),
    ("unwind_index", 'on part | derive w = split(p_name, " ") | unwind w with index i | select p_partkey, w, i', "SELECT p_partkey, w, (i - 1) AS i FROM part, unnest(split(p_name, ' ')) WITH ORDINALITY u(w, i)"),
    ("unwind_keep_empty",
     'on nation | derive w = if(n_nationkey % 3 == 0, range(0, 0), range(0, n_nationkey % 3)) | unwind w with index i keep empty | select n_nationkey, w, i',
     "SELECT n_nationkey, w::BIGINT AS w, w::BIGINT AS i FROM nation LEFT JOIN LATERAL (SELECT unnest(range(0, n_nationkey % 3)) AS w) ON true"),
    ("near_topk",
     f"on embeddings | near embedding, {_V} | sort _distance, vec_id | limit 10 | select vec_id, round(_distance, 6) as d",
     f"SELECT vec_id, round(d, 6) AS d FROM (SELECT vec_id, 1 - list_cosine_similarity(embedding::DOUBLE[], {_V}::DOUBLE[]) AS d FROM embeddings) ORDER BY d, vec_id LIMIT 10"),
    ("near_radius",
     f"on embeddings | near embedding, {_V} | where _distance < 0.8 | group label",
     f"SELECT label, count(*) AS \"count\" FROM embeddings WHERE 1 - list_cosine_similarity(embedding::DOUBLE[], {_V}::DOUBLE[]) < 0.8 GROUP BY 1"),
    ("fn_numeric",
     "on supplier | select s_suppkey, abs(s_acctbal) as a, floor(s_acctbal) as f, ceil(s_acctbal) as c, round(s_acctbal) as r0, round(s_acctbal, 1) as r1, trunc(s_acctbal) as t, pow(s_suppkey, 2) as p, sign(s_acctbal) as sg, sqrt(abs(s_acctbal)) as q, min(s_suppkey, 7, 50) as mn, max([s_suppkey, 7, 50]) as mx, sum(s_suppkey, 1, null) as sm, avg([1, 2, 4]) as av, median(3, 1, 2, 10) as md, percentile([10, 20, 30], 0.25) as pc, stddev(1, 2, 3, 4) as sd, div(s_acctbal, 0, -1) as dv, ln(exp(2)) as l, log10(1000) as lt, log(8, 2) as l2, s_suppkey % 7 as md7, s_suppkey / 4 as dq | derive q = round(q, 6), sd = round(sd, 6), l = round(l, 6), av = round(av, 6)",
     "SELECT s_suppkey, abs(s_acctbal) AS a, floor(s_acctbal)::BIGINT AS f, ceil(s_acctbal)::BIGINT AS c, round(s_acctbal)::BIGINT AS r0, round(s_acctbal, 1) AS r1, trunc(s_acctbal)::BIGINT AS t, (s_suppkey * s_suppkey)::BIGINT AS p, sign(s_acctbal)::BIGINT AS sg, round(sqrt(abs(s_acctbal)), 6) AS q, least(s_suppkey, 7, 50) AS mn, greatest(s_suppkey, 7, 50) AS mx, s_suppkey + 1 AS sm, round(7/3.0::DOUBLE, 6) AS av, 2.5::DOUBLE AS md, 15.0::DOUBLE AS pc, round(1.2909944487358056::DOUBLE, 6) AS sd, -1.0::DOUBLE AS dv, 2.0::DOUBLE AS l, 3.0::DOUBLE AS lt, 3.0::DOUBLE AS l2, s_suppkey % 7 AS md7, s_suppkey / 4 AS dq FROM supplier"),
    ("fn_text",
     'on part | select p_partkey, len(p_name) as n, lower(p_type) as lo, upper(p_name) as up, trim(concat("  ", p_name, " ")) as tr, ltrim("  x ") as lt, rtrim(" x  ") as rt, concat(p_name, "-", p_size, null) as cc, contains(p_name, "o") as co, starts_with(p_name, "s") as st, ends_with(p_name, "t") as en, substr(p_name, 1, 3) as s1, substr(p_name, -3) as s2, substr(p_name, -99, 2) as s3, at(split(p_name, " "), 1) as w2, replace(p_name, "o", "0") as rp, index_of(p_name, "w") as ix, pad_left(to_string(p_partkey), 3, "0") as pl, pad_right(p_brand, 10) as pr, reverse(split("a.b.c", ".")) as rv | derive rv = at(rv, 0)',
     "SELECT p_partkey, length(p_name) AS n, lower(p_type) AS lo, upper(p_name) AS up, p_name AS tr, 'x ' AS lt, ' x' AS rt, p_name || '-' || p_size AS cc, contains(p_name, 'o') AS co, starts_with(p_name, 's') AS st, ends_with(p_name, 't') AS en, substr(p_name, 2, 3) AS s1, right(p_name, 3) AS s2, left(p_name, 2) AS s3, split(p_name, ' ')[2] AS w2, replace(p_name, 'o', '0') AS rp, strpos(p_name, 'w') - 1 AS ix, CASE WHEN length(p_partkey::VARCHAR) >= 3 THEN p_partkey::VARCHAR ELSE lpad(p_partkey::VARCHAR, 3, '0') END AS pl, rpad(p_brand, 10, ' ') AS pr, 'c' AS rv FROM part"),
    ("fn_array",
     "on nation | derive a = range(0, n_nationkey), b = [3, 1, 2, 3] | select n_nationkey, len(a) as n, at(a, -1) as l, at(slice(b, 1, 2), 0) as s, at(reverse(b), 1) as r, at(sort_array(b), 0) as lo, at(sort_array(b, \"desc\"), 0) as hi, len(unique(b)) as u, len(flatten([b, a])) as f, index_of(b, 2) as i, contains(b, 9) as c, n_nationkey in a as self, sum(a) as t, len(range(10, 0, -3)) as back",
     "SELECT n_nationkey, n_nationkey::BIGINT AS n, CASE WHEN n_nationkey > 0 THEN n_nationkey - 1 END::BIGINT AS l, 1::BIGINT AS s, 2::BIGINT AS r, 1::BIGINT AS lo, 3::BIGINT AS hi, 3::BIGINT AS u, (4 + n_nationkey)::BIGINT AS f, 2::BIGINT AS i, false AS c, false AS self, (n_nationkey * (n_nationkey - 1) / 2)::BIGINT AS t, 4::BIGINT AS back FROM nation"),
    ("fn_object",
     'on nation | derive o = {"b": n_name, "a": n_nationkey}, m = merge(o, {"a": 7, "z": true}) | select n_nationkey, at(keys(o), 0) as k, has(o, "b") as h, get(o, "a") as g, get(o, "nope", -1) as d, m.a as ma, m.z as mz, len(m) as n, type(o) as t, len(values({"x": 1, "y": 2})) as v',
     "SELECT n_nationkey, 'a' AS k, true AS h, n_nationkey::BIGINT AS g, -1::BIGINT AS d, 7::BIGINT AS ma, true AS mz, 3::BIGINT AS n, 'object' AS t, 2::BIGINT AS v FROM nation"),
    ("fn_date",
     'on orders | select o_orderkey, parse_date(o_orderdate) as ms, date_trunc(o_orderdate, "month") as mo, date_trunc(o_orderdate, "week") as wk, date_add(o_orderdate, 1, "month") as nx, date_add("2024-01-31", 1, "month") as clamp, date_diff("1995-12-31", o_orderdate, "quarter") as dq, date_diff("1995-12-31", o_orderdate, "day") as dd, date_diff("1995-12-31", o_orderdate, "week") as dw, date_part(o_orderdate, "week") as iw, date_part(o_orderdate, "weekday") as wd, date_part(o_orderdate, "day_of_year") as dy, date_format(o_orderdate, "%Y/%m/%d %j %u") as fm, month_end(o_orderdate) as me, days_in(o_orderdate, "month") as di, days_in(o_orderdate, "year") as dyr, date_part(o_orderdate, "quarter") as q',
     "SELECT o_orderkey, epoch_ms(o_orderdate) AS ms, epoch_ms(date_trunc('month', o_orderdate)) AS mo, epoch_ms(date_trunc('week', o_orderdate)) AS wk, epoch_ms(o_orderdate + INTERVAL 1 MONTH) AS nx, epoch_ms(TIMESTAMP '2024-02-29') AS clamp, date_diff('quarter', TIMESTAMP '1995-12-31', o_orderdate) AS dq, date_diff('day', TIMESTAMP '1995-12-31', o_orderdate) AS dd, ((epoch_ms(date_trunc('week', o_orderdate)) - epoch_ms(date_trunc('week', TIMESTAMP '1995-12-31'))) / 604800000)::BIGINT AS dw, weekofyear(o_orderdate) AS iw, isodow(o_orderdate) AS wd, dayofyear(o_orderdate) AS dy, strftime(o_orderdate, '%Y/%m/%d %j ') || isodow(o_orderdate) AS fm, epoch_ms(last_day(o_orderdate)::TIMESTAMP) AS me, day(last_day(o_orderdate)) AS di, CASE WHEN year(o_orderdate) % 4 = 0 AND (year(o_orderdate) % 100 <> 0 OR year(o_orderdate) % 400 = 0) THEN 366 ELSE 365 END AS dyr, quarter(o_orderdate) AS q FROM orders"),
    ("fn_fiscal",
     "on orders | select o_orderkey, fiscal_year(o_orderdate, 3) as fy, fiscal_month(o_orderdate, 3) as fm, fiscal_start(o_orderdate, 3) as fs, fiscal_end(o_orderdate, 3) as fe, fiscal_year(o_orderdate, 12) as cal",
     "SELECT o_orderkey, year(o_orderdate) + (month(o_orderdate) > 3)::INT AS fy, (month(o_orderdate) + 8) % 12 + 1 AS fm, epoch_ms(make_timestamp(year(o_orderdate) + (month(o_orderdate) > 3)::INT - 1, 4, 1, 0, 0, 0)) AS fs, epoch_ms(make_timestamp(year(o_orderdate) + (month(o_orderdate) > 3)::INT, 3, 31, 0, 0, 0)) AS fe, year(o_orderdate) AS cal FROM orders"),
    ("fn_logic",
     'on customer | select c_custkey, coalesce(nullif(c_mktsegment, "BUILDING"), "none") as s, case(c_acctbal < 0, "debt", c_acctbal < 1000, "low", "ok") as k, if(exists(c_name), 1, 0) as e, exists(nothing) as x, coalesce(nothing?, c_nationkey) as n, between(c_nationkey, 3, 9) as b, bucket(c_nationkey, [0, 10, 20]) as bk, optional(missing) as o',
     "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS s, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS k, 1::BIGINT AS e, false AS x, c_nationkey::BIGINT AS n, c_nationkey BETWEEN 3 AND 9 AS b, CASE WHEN c_nationkey < 10 THEN 0 WHEN c_nationkey < 20 THEN 10 END::BIGINT AS bk, NULL AS o FROM customer"),
    ("fn_convert",
     'on orders | select o_orderkey, to_int(o_totalprice) as i, to_int(" -3.9 ") as neg, to_float("2.5") as f, to_string(o_orderkey) as s, to_bool("Yes") as y, to_bool(0) as z, to_int(true) as t, type(o_orderstatus) as ty, type(null) as tn, type(o_orderkey) as tk',
     "SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS i, -3::BIGINT AS neg, 2.5::DOUBLE AS f, o_orderkey::VARCHAR AS s, true AS y, false AS z, 1::BIGINT AS t, 'string' AS ty, 'null' AS tn, 'number' AS tk FROM orders"),
    ("let_params_view", "let $low ?= 5000, $names = (on region | where r_regionkey < 2 | select r_name) | on supplier as s | where s.s_acctbal > $low | lookup nation on n_nationkey == s_nationkey into n | unwind n | lookup region as r | where r.r_regionkey == s.n.n_regionkey | into r | end | unwind r | where r.r_name in $names | select s_suppkey, r.r_name as region",
     "SELECT s_suppkey, r_name AS region FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE s_acctbal > 5000 AND r_name IN (SELECT r_name FROM region WHERE r_regionkey < 2)"),
    ("values_lookup",
     'on values [{code: "F", label: "finished"}, {code: "O", label: "open"}] as v | lookup orders as o on o.o_orderstatus == v.code into os | select code, label, len(os) as n',
     "SELECT code, label, (SELECT count(*) FROM orders WHERE o_orderstatus = code) AS n FROM (VALUES ('F', 'finished'), ('O', 'open')) t(code, label)"),
    ("separators",
     "on lineitem\nwhere l_quantity > 45\ngroup l_returnflag, l_quantity as q\nderive q = round(q, 2)",
     "SELECT l_returnflag, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_quantity > 45 GROUP BY 1"),
    ("conversations_turns",
     "on conversations | group | by conv_id | count as turns | first role by turn as opens | last role by turn as closes | end | group | by opens, closes | count as n | sum turns | end",
     "SELECT opens, closes, count(*) AS n, sum(turns)::BIGINT AS turns FROM (SELECT conv_id, count(*) AS turns, arg_min(role, turn) AS opens, arg_max(role, turn) AS closes FROM conversations GROUP BY 1) GROUP BY 1, 2"),
    ("documents_langs",
     'on documents | derive words = len(split(text, " ")) | group | by lang, source | count as docs | sum words | max n_chars as longest | end | where docs > 1',
     "SELECT lang, source, count(*) AS docs, sum(len(split(text, ' ')))::BIGINT AS words, max(n_chars) AS longest FROM documents GROUP BY 1, 2 HAVING count(*) > 1"),
    ("labels_join",
     "on labels | lookup documents on doc_id == doc_id into d | unwind d | group | by d.lang as lang, toxic | end | sort lang",
     "SELECT lang, toxic, count(*) AS \"count\" FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2"),
    ("sample_n", "on lineitem | sample 25 | count", 'SELECT 25::BIGINT AS "count"'),
]


def _runner(text: str):
    return lambda spark, sf_dir: Engine(spark, sf_dir).query(text)


def queries() -> dict:
    return {name: _runner(text) for name, text, _ in ENTRIES} | _extra()


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in ENTRIES if sql} | EXTRA_SQL


def _fresh(spark) -> Engine:
    """An engine with an empty store of its own, for queries that write."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='store-')}"
    return Engine(spark, store=f"{base}/store-{uuid.uuid4().hex}")


def _copied(spark, sf_dir: str, table: str) -> Engine:
    """A store with a copy of a table, written by the language itself."""
    e = _fresh(spark)
    e.catalog.root = sf_dir
    e.query(f"on {table} | into copy")
    return e


def write_set(spark, sf_dir):
    e = _copied(spark, sf_dir, "nation")
    e.query("on copy | where n_nationkey < 10 | set n_nationkey = n_regionkey, n_regionkey = n_nationkey, tag = upper(n_name)")
    return e.query("on copy | select n_nationkey, n_regionkey, n_name, tag | drop _id")


def write_delete(spark, sf_dir):
    e = _copied(spark, sf_dir, "nation")
    e.query("on copy | sort n_nationkey desc | limit 5 | delete")
    return e.query("on copy | select n_nationkey, n_name | drop _id")


def write_load_merge(spark, sf_dir):
    e = _fresh(spark)
    e.query('on stock | insert [{_id: "a", sku: "A", qty: 1, note: "old"}, {_id: "b", sku: "B", qty: 2, note: "old"}]')
    e.query('on stock | load | with merge | chunk [{_id: "b", qty: 5}] | chunk [{_id: "c", sku: "C", qty: 3}] | end')
    e.query('on stock | load | with replace | chunk [{_id: "a", sku: "AA", qty: 9}] | end')
    return e.query("on stock | select _id, sku, qty, note")


def write_together(spark, sf_dir):
    e = _copied(spark, sf_dir, "region")
    e.execute_together("on copy | where r_regionkey == 0 | delete", "on copy | where r_regionkey > 2 | into high")
    return e.query("on copy | select r_regionkey | derive side = \"copy\" | union | on high | select r_regionkey | derive side = \"high\" | end | drop _id")


def time_travel(spark, sf_dir):
    e = _copied(spark, sf_dir, "nation")
    e.query("on copy | where n_regionkey == 1 | set n_name = \"gone\"")
    e.query("on copy | where n_regionkey == 2 | delete")
    now, then = e.query("on copy | group n_name | count as now"), e.query("on copy as of 1 | count as then")
    return then.crossJoin(now)


def history_rows(spark, sf_dir):
    e = _copied(spark, sf_dir, "region")
    e.query("on copy | where r_regionkey < 2 | set r_name = lower(r_name)")
    e.query("on copy | where r_regionkey == 4 | delete")
    return e.query("on copy history | group | by _generation, _op, _version | count as n | end")


def views(spark, sf_dir):
    e = Engine(spark, sf_dir)
    e.query("define view open_orders | description \"orders not finished\" | exec | on orders | where o_orderstatus == \"O\" | end | end")
    e.query("define view rich | exec | on view open_orders as o | where o.o_totalprice > 300000 | end | end")
    return e.query("on view rich | lookup view open_orders as w | where w.o_custkey == o_custkey | into w | end | select o_orderkey")


def scoped(spark, sf_dir):
    return Engine(spark, sf_dir, scope={"o_orderstatus": "P"}).query("on orders | group o_orderpriority")


def explained(spark, sf_dir):
    return Engine(spark, sf_dir).query("explain on orders | where o_orderkey == 3 | sort o_custkey | limit 2").select("collection", "read_only", "mode", F.array_join("operators", " ").alias("operators"))


def search_words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = search.index(docs, "doc_id", "text")
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum("hits").alias("hits"))


def as_of_lookup(spark, sf_dir):
    e = _copied(spark, sf_dir, "nation")
    e.query("on region | into areas")
    e.query("on areas | where r_regionkey < 2 | delete")
    e.query("on copy | where n_nationkey > 3 | delete")
    return e.query("on copy as of 2 | lookup areas on r_regionkey == n_regionkey into found | select n_nationkey, len(found) as areas | drop _id")


def as_of_union(spark, sf_dir):
    e = _copied(spark, sf_dir, "nation")
    e.query("on region | into areas")
    e.query('on areas | set r_name = "changed"')
    return e.query("on copy as of 2 | select n_name as name | union | on areas | select r_name as name | end | drop _id")


def view_params(spark, sf_dir):
    e = Engine(spark, sf_dir)
    e.query("define view balances | exec | let $least ?= 0 | on supplier as s | where s.s_acctbal > $least and s.s_nationkey in $nations | end | end")
    e.query("define view wide | exec | let $nations = [1, 2, 3, 4] | on view balances | select s_suppkey | end | end")
    return e.query("let $least = 2000, $nations = [3] | on view balances | select s_suppkey | derive side = 1 | union | on view wide | derive side = 2 | end")


def store_snapshots(spark, sf_dir):
    """More commits than a snapshot waits for; the present and the past before it."""
    e = _copied(spark, sf_dir, "nation")
    for i in range(4):
        e.query(f"on copy | where n_regionkey == {i} | set n_name = lower(n_name)")
        e.store.snapshot("copy")
    e.query("on copy | where n_regionkey == 4 | delete")
    return e.query('on copy | select n_nationkey, n_name | derive at = "now" | union | on copy as of 3 | select n_nationkey, n_name | derive at = "then" | end | drop _id')


def backup_restored(spark, sf_dir):
    e = _copied(spark, sf_dir, "nation")
    e.query("on copy | where n_regionkey == 2 | delete")
    folder = f"{e.store.path}-backup"
    e.store.backup(folder)
    other = _fresh(spark)
    other.store.restore(folder)
    return other.query("on copy | select n_nationkey, n_name | drop _id")


def load_update(spark, sf_dir):
    e = _fresh(spark)
    e.query('on stock | insert [{_id: "a", sku: "A", qty: 1}, {_id: "b", sku: "B", qty: 2}]')
    e.query('on stock | load | with update | chunk [{_id: "b", qty: 7}] | end')
    return e.query("on stock | select _id, sku, qty")


def import_csv(spark, sf_dir):
    """A table written as CSV and read back by the importer, which finds out separators and types."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.mkdtemp(prefix='csv-')}"
    path = f"{base}/customer-{uuid.uuid4().hex}.csv"
    spark.read.parquet(f"{sf_dir}/customer.parquet").write.option("header", "true").csv(path)
    return importer.read_csv(spark, path)


def custom_stage(spark, sf_dir):
    register_stage("cheapest", lambda df, words: df.groupBy(words[0]).agg(F.min(words[1]).alias("least")))
    return Engine(spark, sf_dir).query("on orders | where o_totalprice > 5000 | cheapest o_orderstatus o_totalprice | derive least = round(least, 2)")


def stream_tumbling(spark, sf_dir):
    return windows.tumbling(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "1 hour", ["event_type"]).select(F.unix_millis("start").alias("start_ms"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sessions(spark, sf_dir):
    return windows.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", "30 minutes", "user_id").select(F.unix_millis("start").alias("start_ms"), "user_id", "n")


def _extra() -> dict:
    named = (as_of_lookup, as_of_union, view_params, store_snapshots, backup_restored, load_update, import_csv, custom_stage, write_set, write_delete, write_load_merge, write_together, time_travel, history_rows, views, scoped, explained, search_words, stream_tumbling, stream_sessions)
    return {f.__name__: f for f in named}


EXTRA_SQL: dict[str, str] = {
    "write_set": "SELECT CASE WHEN n_nationkey < 10 THEN n_regionkey ELSE n_nationkey END::BIGINT AS n_nationkey, CASE WHEN n_nationkey < 10 THEN n_nationkey ELSE n_regionkey END::BIGINT AS n_regionkey, n_name, CASE WHEN n_nationkey < 10 THEN upper(n_name) END AS tag FROM nation",
    "write_delete": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_nationkey < 20",
    "write_load_merge": "SELECT * FROM (VALUES ('a', 'AA', 9::BIGINT, NULL), ('b', 'B', 5, 'old'), ('c', 'C', 3, NULL)) t(_id, sku, qty, note)",
    "write_together": "SELECT r_regionkey, 'copy' AS side FROM region WHERE r_regionkey <> 0 UNION ALL SELECT r_regionkey, 'high' FROM region WHERE r_regionkey > 2",
    "time_travel": "SELECT (SELECT count(*) FROM nation) AS \"then\", (SELECT count(DISTINCT CASE WHEN n_regionkey = 1 THEN 'gone' ELSE n_name END) FROM nation WHERE n_regionkey <> 2) AS now",
    "history_rows": "SELECT * FROM (VALUES (1::BIGINT, 'insert', 1::BIGINT, 5::BIGINT), (2, 'replace', 2, 2), (3, 'delete', 2, 1)) t(_generation, _op, _version, n)",
    "views": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 300000",
    "scoped": "SELECT o_orderpriority, count(*) AS \"count\" FROM orders WHERE o_orderstatus = 'P' GROUP BY 1",
    "explained": "SELECT 'orders' AS collection, true AS read_only, 'blocking' AS mode, 'where sort limit' AS operators",
    "search_words": "SELECT word, count(*) AS docs, sum(hits)::BIGINT AS hits FROM (SELECT doc_id, word, count(*) AS hits FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1, 2) GROUP BY 1",
    "as_of_lookup": "SELECT n_nationkey::BIGINT AS n_nationkey, 1::BIGINT AS areas FROM nation",
    "as_of_union": "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region",
    "view_params": "SELECT s_suppkey, 1::BIGINT AS side FROM supplier WHERE s_acctbal > 2000 AND s_nationkey = 3 UNION ALL SELECT s_suppkey, 2 FROM supplier WHERE s_acctbal > 2000 AND s_nationkey IN (1, 2, 3, 4)",
    "store_snapshots": "SELECT n_nationkey::BIGINT AS n_nationkey, lower(n_name) AS n_name, 'now' AS at FROM nation WHERE n_regionkey < 4 UNION ALL SELECT n_nationkey, CASE WHEN n_regionkey < 2 THEN lower(n_name) ELSE n_name END, 'then' FROM nation",
    "backup_restored": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation WHERE n_regionkey <> 2",
    "load_update": "SELECT * FROM (VALUES ('a', 'A', 1::BIGINT), ('b', 'B', 7)) t(_id, sku, qty)",
    "import_csv": "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
    "custom_stage": "SELECT o_orderstatus, round(min(o_totalprice), 2) AS least FROM orders WHERE o_totalprice > 5000 GROUP BY 1",
    "stream_tumbling": "SELECT epoch_ms(date_trunc('hour', ts)) AS start_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_sessions": "SELECT epoch_us(min(ts)) // 1000 AS start_ms, user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s",
}
