"""Evaluation runs: rates, intervals, percentiles, funnels, comparisons, gold sets, routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import evaluation
from corvane.plans.registry import DOCS, query, statement
from corvane.sources import model

#: One record a question: a lineitem order stands for a question, its flags for outcomes.
RUN = """run AS (SELECT o_orderkey AS query_id, o_orderpriority AS category, o_totalprice / 1000.0::DOUBLE AS latency, o_orderkey % 3 <> 0 AS in_candidates, o_orderkey % 4 = 1 AS base_top, o_orderkey % 5 < 2 AND o_orderkey % 3 <> 0 AS final_top FROM orders)"""


def runs(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return model.table(spark, sf_dir, "orders").select(
        k.alias("query_id"), F.col("o_orderpriority").alias("category"), (F.col("o_totalprice") / 1000.0).alias("latency"), (k % 3 != 0).alias("in_candidates"), (k % 4 == 1).alias("base_top"), ((k % 5 < 2) & (k % 3 != 0)).alias("final_top"))


@query(f"WITH {RUN} SELECT category, round(avg(CAST(final_top AS INTEGER)), 4) AS accuracy, round(avg(CAST(in_candidates AS INTEGER)), 4) AS recall, count(*) AS n FROM run GROUP BY category")
def rates_by_category(spark, sf_dir):
    return runs(spark, sf_dir).groupBy("category").agg(evaluation.rate(F.col("final_top")).alias("accuracy"), evaluation.rate(F.col("in_candidates")).alias("recall"), F.count(F.lit(1)).alias("n"))


WIL = f"""WITH {RUN}, g AS (SELECT category, count(*) FILTER (final_top)::DOUBLE AS h, count(*)::DOUBLE AS n FROM run GROUP BY category UNION ALL SELECT 'empty', 0, 0),
 w AS (SELECT category, h / greatest(n, 1) AS p, greatest(n, 1) AS m, n, 1 + 3.8416 / greatest(n, 1) AS base FROM g)
 SELECT category, round(CASE WHEN n > 0 THEN greatest(0.0, (p + 3.8416 / (2 * m)) / base - 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m)) / base) ELSE 0 END, 6) AS low,
  round(CASE WHEN n > 0 THEN least(1.0, (p + 3.8416 / (2 * m)) / base + 1.96 * sqrt(p * (1 - p) / m + 3.8416 / (4 * m * m)) / base) ELSE 0 END, 6) AS high FROM w"""


def intervals(spark, sf_dir) -> DataFrame:
    g = runs(spark, sf_dir).groupBy("category").agg(F.count_if(F.expr("final_top")).alias("h"), F.count(F.lit(1)).alias("n"))
    g = g.unionByName(spark.createDataFrame([("empty", 0, 0)], "category string, h long, n long"))
    return g.select("category", evaluation.wilson(F.col("h"), F.col("n")).alias("w")).select("category", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


@query(WIL)
def wilson_ci(spark, sf_dir):
    return intervals(spark, sf_dir)


@query(WIL.replace(" SELECT category, round(", ", ci AS (SELECT category, round(", 1) + """), th AS (SELECT * FROM (VALUES ('1-URGENT', 0.2), ('2-HIGH', 0.3), ('5-LOW', 0.25), ('absent', 0.1)) t(category, threshold))
 SELECT category, threshold::DOUBLE AS threshold, CASE WHEN low IS NULL THEN 'missing' WHEN low >= threshold THEN 'pass' ELSE 'fail' END AS verdict FROM th LEFT JOIN ci USING (category)""")
def threshold_gates(spark, sf_dir):
    """A gate passes on the lower bound of its interval."""
    th = spark.createDataFrame([("1-URGENT", 0.2), ("2-HIGH", 0.3), ("5-LOW", 0.25), ("absent", 0.1)], "category string, threshold double")
    verdict = F.when(F.col("low").isNull(), "missing").when(F.col("low") >= F.col("threshold"), "pass").otherwise("fail")
    return th.join(intervals(spark, sf_dir), "category", "left").select("category", "threshold", verdict.alias("verdict"))


@query(f"""WITH {RUN}, s AS (SELECT category, list_sort(list(latency)) AS v FROM run GROUP BY category)
 SELECT category, v[CAST(round_even((len(v) - 1) * 0.5, 0) AS BIGINT) + 1] AS p50, v[CAST(round_even((len(v) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95 FROM s""")
def percentiles_nearest_rank(spark, sf_dir):
    v = F.collect_list("latency")
    return runs(spark, sf_dir).groupBy("category").agg(evaluation.nearest_rank(v, 0.5).alias("p50"), evaluation.nearest_rank(v, 0.95).alias("p95"))


@query(f"""WITH {RUN}, r AS (SELECT * FROM run WHERE query_id < 2000) SELECT count(*) AS queries, count(*) FILTER (in_candidates) AS candidates, count(*) FILTER (base_top) AS base, count(*) FILTER (final_top) AS final,
 count(*) FILTER (final_top AND NOT base_top) AS rescued, count(*) FILTER (base_top AND NOT final_top) AS lost, count(*) FILTER (NOT in_candidates) AS outside,
 array_to_string(list_sort(list(query_id) FILTER (final_top AND NOT base_top)), ',') AS rescued_ids FROM r""")
def candidate_funnel(spark, sf_dir):
    return evaluation.funnel(runs(spark, sf_dir).where("query_id < 2000"))


@query(f"WITH {RUN} SELECT category, count(*) FILTER (base_top AND final_top) AS both, count(*) FILTER (base_top AND NOT final_top) AS losses, count(*) FILTER (NOT base_top AND final_top) AS wins, count(*) FILTER (NOT base_top AND NOT final_top) AS neither FROM run GROUP BY category")
def paired_counts(spark, sf_dir):
    """Two controlled runs paired by question id."""
    r = runs(spark, sf_dir)
    a, b = r.select("query_id", "category", F.col("base_top").alias("a")), r.select("query_id", F.col("final_top").alias("b"))
    return a.join(b, "query_id", "full").groupBy("category").agg(F.count_if(F.expr("a AND b")).alias("both"), F.count_if(F.expr("a AND NOT b")).alias("losses"), F.count_if(F.expr("NOT a AND b")).alias("wins"), F.count_if(F.expr("NOT a AND NOT b")).alias("neither"))


REPORT = """m AS (SELECT year(l_shipdate) AS y, l_returnflag || '-' || l_linestatus AS metric, round(avg(l_discount), 4) AS value FROM lineitem GROUP BY ALL)"""


@query(f"""WITH {REPORT}, o AS (SELECT metric, value AS old FROM m WHERE y = 1995), n AS (SELECT metric, value AS new FROM m WHERE y = 1996)
 SELECT metric, old, new, CASE WHEN new IS NULL THEN 'missing' WHEN old IS NULL THEN 'new' WHEN new < old - 0.001 THEN 'worse' WHEN new > old + 0.001 THEN 'better' ELSE 'same' END AS verdict FROM o FULL JOIN n USING (metric)""")
def report_diff(spark, sf_dir):
    m = model.table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("y"), F.concat_ws("-", "l_returnflag", "l_linestatus").alias("metric")).agg(F.round(F.avg("l_discount"), 4).alias("value"))
    return evaluation.difference(m.where("y = 1995").drop("y"), m.where("y = 1996").drop("y"), 0.001)


@query("""WITH c AS (SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey % 2 = 0), t AS (SELECT o_orderkey AS query_id FROM orders WHERE o_orderkey % 3 = 0)
 SELECT count(*) FILTER (c.query_id IS NOT NULL AND t.query_id IS NOT NULL) AS aligned, count(*) FILTER (t.query_id IS NULL) AS only_candidates, count(*) FILTER (c.query_id IS NULL) AS only_trace FROM c FULL JOIN t ON c.query_id = t.query_id""")
def trace_alignment(spark, sf_dir):
    o = model.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query_id"))
    c, t = o.where("query_id % 2 = 0").withColumn("c", F.lit(True)), o.where("query_id % 3 = 0").withColumn("t", F.lit(True))
    return c.join(t, "query_id", "full").agg(F.count_if(F.expr("c AND t")).alias("aligned"), F.count_if(F.expr("t IS NULL")).alias("only_candidates"), F.count_if(F.expr("c IS NULL")).alias("only_trace"))


@query("""SELECT l_orderkey AS query_id, l_linenumber AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS base_rank, l_linenumber AS final_rank FROM lineitem WHERE l_orderkey < 2000""")
def base_and_final_ranks(spark, sf_dir):
    l = model.table(spark, sf_dir, "lineitem").where("l_orderkey < 2000")
    return l.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("item"), F.row_number().over(W.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")).alias("base_rank"), F.col("l_linenumber").alias("final_rank"))


@query(f"WITH {RUN}, k AS (SELECT query_id, category, CASE WHEN final_top AND NOT base_top THEN 'rescue' WHEN base_top AND NOT final_top THEN 'regression' ELSE 'stable' END AS kind FROM run) SELECT kind, query_id FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY query_id) = 1")
def example_per_kind(spark, sf_dir):
    kind = F.when(F.col("final_top") & ~F.col("base_top"), "rescue").when(F.col("base_top") & ~F.col("final_top"), "regression").otherwise("stable")
    return runs(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.min("query_id").alias("query_id"))


@query("""SELECT l_orderkey AS query_id, l_partkey AS candidate, l_linenumber AS rank FROM lineitem l WHERE l_orderkey < 3000 AND NOT EXISTS (SELECT 1 FROM lineitem p WHERE p.l_orderkey = l.l_orderkey AND p.l_partkey = l.l_partkey AND p.l_returnflag = 'R')""")
def hard_negatives(spark, sf_dir):
    """Candidates that are no positives, with their rank."""
    l = model.table(spark, sf_dir, "lineitem").where("l_orderkey < 3000").select(F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("candidate"), F.col("l_linenumber").alias("rank"), "l_returnflag")
    return l.join(l.where("l_returnflag = 'R'").select("query_id", "candidate").distinct(), ["query_id", "candidate"], "left_anti").select("query_id", "candidate", "rank")


statement("model_selection", """SELECT s_suppkey AS model, s_acctbal AS recall FROM {supplier} WHERE s_nationkey % 2 = 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 1""")


@query(f"""WITH {DOCS}, b AS (SELECT CASE WHEN contains(lower(content), 'licen') THEN 'legal' WHEN contains(lower(content), 'password') OR contains(lower(content), 'token') THEN 'secret' WHEN length(content) > 5000 THEN 'long' ELSE 'general' END AS class FROM docs) SELECT class, count(*) AS n FROM b GROUP BY class""")
def quality_classes(spark, sf_dir):
    """First matching bucket of keywords."""
    low = F.lower("content")
    c = F.when(F.contains(low, F.lit("licen")), "legal").when(F.contains(low, F.lit("password")) | F.contains(low, F.lit("token")), "secret").when(F.length("content") > 5000, "long").otherwise("general")
    return model.documents(spark, sf_dir).groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 5 = 0 THEN 2 ELSE 3 END AS priority FROM documents) SELECT doc_id, priority FROM p ORDER BY priority, doc_id LIMIT 300""")
def deterministic_fill(spark, sf_dir):
    """Base set, contexts, referenced, then filler, up to 300."""
    i = F.col("doc_id")
    p = F.when(i % 11 == 0, 0).when(i % 7 == 0, 1).when(i % 5 == 0, 2).otherwise(3)
    return model.table(spark, sf_dir, "documents").select("doc_id", p.alias("priority")).orderBy("priority", "doc_id").limit(300)


@query(f"""WITH {DOCS}, g AS (SELECT document_id, CASE WHEN doc_id % 7 = 0 THEN 'unauthorized' WHEN status = 'draft' THEN 'no_evidence' WHEN doc_id % 3 = 0 THEN 'exact_search' ELSE 'rag' END AS category, doc_id FROM docs),
 n AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY doc_id) AS n FROM g QUALIFY n <= 40) SELECT CASE category WHEN 'unauthorized' THEN 'acl' WHEN 'no_evidence' THEN 'no-evidence' WHEN 'exact_search' THEN 'exact' ELSE 'rag' END || '-' || lpad(CAST(n AS VARCHAR), 3, '0') AS id, category, document_id FROM n""")
def gold_builders(spark, sf_dir):
    i = F.col("doc_id")
    cat = F.when(i % 7 == 0, "unauthorized").when(F.col("status") == "draft", "no_evidence").when(i % 3 == 0, "exact_search").otherwise("rag")
    g = model.documents(spark, sf_dir).withColumn("category", cat).withColumn("n", F.row_number().over(W.partitionBy("category").orderBy("doc_id"))).where("n <= 40")
    prefix = F.when(F.col("category") == "unauthorized", "acl").when(F.col("category") == "no_evidence", "no-evidence").when(F.col("category") == "exact_search", "exact").otherwise("rag")
    return g.select(F.concat(prefix, F.lit("-"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("id"), "category", "document_id")


@query("""SELECT d.doc_id AS id, coalesce(CASE WHEN l.quality = 0 THEN 'rejected' ELSE 'accepted' END, 'unreviewed') AS review FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) = 0 AND d.lang IN ('en', 'de')""".replace("coalesce(CASE WHEN l.quality = 0 THEN 'rejected' ELSE 'accepted' END, 'unreviewed')", "CASE WHEN l.quality IS NULL THEN 'unreviewed' WHEN l.quality = 0 THEN 'rejected' ELSE 'accepted' END"))
def gold_curation(spark, sf_dir):
    """Decisions laid over a gold set; scored unless disabled, some categories only."""
    d = model.table(spark, sf_dir, "documents").join(model.table(spark, sf_dir, "labels"), "doc_id", "left")
    review = F.when(F.col("quality").isNull(), "unreviewed").when(F.col("quality") == 0, "rejected").otherwise("accepted")
    return d.where((F.coalesce("toxic", F.lit(0)) == 0) & F.col("lang").isin("en", "de")).select(F.col("doc_id").alias("id"), review.alias("review"))


@query("""WITH c AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'graph' ELSE 'other' END AS kind FROM conversations GROUP BY conv_id) SELECT conv_id, kind FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY conv_id) <= CASE kind WHEN 'graph' THEN 2 ELSE 6 END""")
def sample_selection(spark, sf_dir):
    """First two graph questions and first six others."""
    c = model.table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("kind", F.when(F.col("conv_id") % 4 == 0, "graph").otherwise("other"))
    n = F.row_number().over(W.partitionBy("kind").orderBy("conv_id"))
    return c.withColumn("n", n).where(F.col("n") <= F.when(F.col("kind") == "graph", 2).otherwise(6)).select("conv_id", "kind")


#: Fixed patterns of the rule router, by precedence: route, confidence, graph expansion.
ROUTES = [
    ("handoff_or_refuse", 0.98, False, [r"^\s*(?:please\s+)?(?:create|delete|update|approve|submit|cancel)\b", r"请.{0,12}(?:创建|删除|修改|审批|提交|取消|执行)"]),
    ("tool", 0.92, False, [r"销售额|订单数量|总计|合计|平均值|最大值|最小值|多少条", r"\b(total|sum|average|count|revenue|sales)\b"]),
    ("rag", 0.9, True, [r"跨文档|关联文档|引用的文档|引用了哪些|替代版本|后续版本", r"\b(?:referenced|related|linked|superseding|replacement)\s+document\b", r"\bfollow\s+(?:the|its)\s+(?:documented\s+)?reference\b"]),
    ("exact_search", 0.9, False, [r"错误码|编号|版本号|文档号|条款号", r"\b[A-Z]{2,10}-\d{2,10}\b", r"\bswg\w+\b", r"\bdocument\s+(?:id|number)\b"]),
]
QUESTIONS = ["Please delete the old policy", "What is the total revenue in 2026Q1?", "Which related document explains this?", "Explain error VPN-401", "How do I connect?", "请帮我删除文件", "swg123 details", "document id of the guide", "follow its reference"]


def routed(questions: DataFrame, text: str = "question") -> DataFrame:
    """route, confidence and graph of each question: the first rule with a match, else plain retrieval."""
    hit = [(T._any(F.col(text), ["(?i)" + p for p in patterns]), r, c, g) for r, c, g, patterns in ROUTES]
    pick = lambda k, other: _chain([(h, F.lit(x[k])) for (h, *x) in hit], F.lit(other))
    return questions.select("*", pick(0, "rag").alias("route"), pick(1, 0.75).alias("confidence"), pick(2, False).alias("graph"))


def _chain(cases, other):
    c = F.when(*cases[0])
    for case in cases[1:]:
        c = c.when(*case)
    return c.otherwise(other)


def _duck_routes() -> str:
    def of(k, other):
        lit = lambda x: f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" if isinstance(x, float) else str(x).lower()
        whens = " ".join("WHEN " + " OR ".join(f"regexp_matches(question, '{p}', 'i')" for p in ps) + f" THEN {lit((r, c, g)[k])}" for r, c, g, ps in ROUTES)
        return f"CASE {whens} ELSE {lit(other)} END"

    rows = ", ".join(f"('{q}')" for q in QUESTIONS)
    return f"SELECT question, {of(0, 'rag')} AS route, {of(1, 0.75)} AS confidence, {of(2, False)} AS graph FROM (SELECT * FROM (VALUES {rows}) t(question) UNION ALL SELECT text FROM benchmark)"


@query(_duck_routes())
def route_questions(spark, sf_dir):
    q = spark.createDataFrame([(x,) for x in QUESTIONS], "question string")
    return routed(q.unionByName(model.table(spark, sf_dir, "benchmark").select(F.col("text").alias("question"))))
