"""The shapes of structured questions the read-only SQL tool must answer, on the relational tables."""

from corvane.plans.registry import statement

statement("bird_join_count", """SELECT count(*) AS n FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  WHERE n.n_name = (SELECT min(n_name) FROM {nation}) AND c.c_mktsegment = 'BUILDING'""")
statement("bird_count_distinct_between", """SELECT count(DISTINCT o.o_custkey) AS customers FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey
  WHERE o.o_totalprice BETWEEN 50000 AND 150000 AND c.c_acctbal > 0""")
statement("bird_four_way_scalar", """SELECT n.n_name, count(*) AS lines, round(sum(l.l_extendedprice), 2) AS price FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey
  JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
  WHERE l.l_extendedprice > (SELECT (max(l_extendedprice) - min(l_extendedprice)) / 2 FROM {lineitem})
    AND o.o_orderkey <> (SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) GROUP BY n.n_name""")
statement("bird_group_without_aggregate", "SELECT c_mktsegment, c_nationkey FROM {customer} WHERE c_acctbal < 0 GROUP BY c_mktsegment, c_nationkey")
statement("bird_year_filter", "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM {orders} WHERE year(o_orderdate) = 1997")
statement("bird_argmax", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
statement("bird_argmin", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 1")
statement("bird_ratio_percent", "SELECT o_orderstatus AS status, round(count_if(o_orderpriority = '1-URGENT') * CAST(100.0 AS DOUBLE) / count(o_orderkey), 6) AS share FROM {orders} GROUP BY o_orderstatus")
statement("bird_ratio_of_sums", """SELECT l_returnflag, round(sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE 0 END) * CAST(100.0 AS DOUBLE) / nullif(sum(l_extendedprice), 0), 6) AS open_share
  FROM {lineitem} GROUP BY l_returnflag""")
statement("bird_cast_arithmetic", "SELECT p_brand, round(sum(CAST(p_size AS DOUBLE)) / count(*), 6) AS mean_size, max(p_size) - min(p_size) AS span FROM {part} GROUP BY p_brand")
statement("bird_top_groups", "SELECT n.n_name, count(*) AS customers FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name ORDER BY customers DESC, n.n_name LIMIT 5")
statement("bird_or_in_list", """SELECT count(*) AS n FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
  WHERE (p.p_size < 10 OR p.p_size > 40) AND l.l_returnflag IN ('A', 'R') AND l.l_quantity >= 20""")
statement("bird_second_largest", "SELECT c_custkey, c_acctbal FROM {customer} WHERE c_acctbal = (SELECT c_acctbal FROM {customer} ORDER BY c_acctbal DESC, c_custkey LIMIT 1 OFFSET 1)")
statement("bird_month_prefix", "SELECT DISTINCT o_custkey FROM {orders} WHERE date_format(o_orderdate, 'yyyy-MM') = '1996-01'", "SELECT DISTINCT o_custkey FROM {orders} WHERE strftime(o_orderdate, '%Y-%m') = '1996-01'")
statement("bird_below_average", "SELECT l_returnflag, count(*) AS n FROM {lineitem} WHERE l_extendedprice < (SELECT avg(l_extendedprice) FROM {lineitem}) GROUP BY l_returnflag")
statement("bird_not_equal_duplicates", "SELECT c.c_mktsegment FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey <> 1 AND c.c_acctbal > 9000")
statement("bird_derived_table", """SELECT c.c_mktsegment, round(avg(t.total), 4) AS mean_total FROM (SELECT o_custkey, sum(o_totalprice) AS total FROM {orders} GROUP BY o_custkey) t
  JOIN {customer} c ON c.c_custkey = t.o_custkey GROUP BY c.c_mktsegment""")
statement("bird_two_key_join", """SELECT count(*) AS n FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey AND year(l.l_shipdate) = year(o.o_orderdate) WHERE o.o_orderstatus = 'O'""")
statement("bird_as_of_age", "SELECT o_orderkey, CAST(datediff(DATE'2000-01-01', CAST(o_orderdate AS DATE)) AS INT) AS days FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000",
          "SELECT o_orderkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '2000-01-01') AS INTEGER) AS days FROM {orders} WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 200000")
statement("bird_like_prefix", "SELECT p_partkey, p_name FROM {part} WHERE p_type LIKE 'P%' AND p_size BETWEEN 1 AND 5")
statement("sales_aggregates", """SELECT r.r_name AS region, count(*) AS order_count, round(avg(o.o_totalprice), 2) AS average_amount, round(sum(o.o_totalprice), 2) AS total_amount
  FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey
  WHERE year(o.o_orderdate) = 1996 GROUP BY r.r_name""")
statement("percentiles_latency", """SELECT event_type, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value), 6) AS p50, round(percentile_cont(0.95) WITHIN GROUP (ORDER BY value), 6) AS p95,
  round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean FROM {events} WHERE value IS NOT NULL GROUP BY event_type""")
statement("ledger_counts", """SELECT (SELECT count(*) FROM {documents}) AS documents, (SELECT count(DISTINCT source) FROM {documents}) AS sources,
  (SELECT count(*) FROM {conversations}) AS turns, (SELECT count(DISTINCT conv_id) FROM {conversations}) AS sessions, (SELECT count(*) FROM {labels}) AS labels""")
statement("correlated_counts", """SELECT c.c_custkey, (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS orders,
  (SELECT count(*) FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F') AS finished FROM {customer} c WHERE c.c_nationkey < 5""")
