"""A read-only SQL tool: questions to parameterised SQL, statements checked on Spark's own parse tree before they run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Nodes of Spark's parsed plans that read; anything else is refused.
READING = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Join", "SubqueryAlias", "UnresolvedRelation", "UnresolvedHaving", "UnresolvedSubqueryColumnAliases", "OneRowRelation", "LimitAndOffset",
    "UnresolvedInlineTable", "WithWindowDefinition", "LateralJoin", "UnresolvedTableValuedFunction", "UnresolvedOrderBy",
}


class NotReadOnly(ValueError):
    """The statement isn't a single SELECT over allowed tables."""


def _children(node) -> list:
    """Plans below a node, those inside its expressions (sub-queries) too."""
    out = [node.children().apply(i) for i in range(node.children().size())]
    found = node.subqueries()
    return out + [found.apply(i) for i in range(found.size())]


def check(spark: SparkSession, sql: str, allowed: set[str]) -> set[str]:
    """The tables a statement reads; raises NotReadOnly unless it is one SELECT, reads at least one table, and only `allowed` ones.

    Leading WITH and top-level set operations are refused: their names would count as tables, their top node is no SELECT.
    """
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise NotReadOnly(f"not one statement: {str(e).splitlines()[0]}") from None
    tables: set[str] = set()
    todo = [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "UnresolvedRelation":
            tables.add(node.tableName().replace("`", "").lower())
        if name not in READING:
            raise NotReadOnly(f"{name} is not allowed")
        todo += _children(node)
    if not tables:
        raise NotReadOnly("no table")
    if tables - {t.lower() for t in allowed}:
        raise NotReadOnly(f"tables not allowed: {', '.join(sorted(tables - allowed))}")
    return tables


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], limit: int = 1000, **values) -> DataFrame:
    """Check a statement, then run it over the given tables with named parameters bound (never spliced into the text)."""
    check(spark, sql, set(tables))
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql, args=values or None).limit(limit)


#: What a question says, and the part of the statement it stands for. Of the rules for one part the first that a question meets holds.
RULES = [
    ("measure", "COUNT(*) AS order_count", ["count", "how many", "订单数量", "多少条"]),
    ("measure", "ROUND(AVG(amount), 2) AS average_amount", ["average", "平均"]),
    ("measure", "ROUND(SUM(amount), 2) AS total_amount", [""]),
    ("region", "华东", ["east", "华东"]),
    ("region", "华南", ["south", "华南"]),
    ("period", "2026Q1", ["2026q1", "2026 q1", "2026年第一季度"]),
    ("period", "2026Q2", ["2026q2", "2026 q2", "2026年第二季度"]),
]


def plan(question: str) -> tuple[str, dict[str, str]]:
    """A question about sales as SQL and its parameters, by `RULES`: one measure, and conditions on columns whose values are bound."""
    met: dict[str, str] = {}
    for part, value, words in RULES:
        if any(w in question.lower() for w in words):
            met.setdefault(part, value)
    measure = met.pop("measure")
    conditions = " AND ".join(f"{column} = :{column}" for column in met) or "true"
    return f"SELECT {measure} FROM sales WHERE {conditions} LIMIT 100", met


def seed_sales(spark: SparkSession) -> DataFrame:
    """The table the tool's questions are asked of: order_id, region, period, amount (four orders; made up)."""
    rows = [("SO-1", "华东", "2026Q1", 1200.0), ("SO-2", "华东", "2026Q2", 800.5), ("SO-3", "华南", "2026Q1", 640.25), ("SO-4", "华南", "2026Q2", 99.0)]
    return spark.createDataFrame(rows, "order_id string, region string, period string, amount double")


def answer(rows: list[dict]) -> str:
    """Rows as text: none, one cell, or many."""
    if not rows:
        return "no rows"
    if len(rows) == 1 and len(rows[0]) == 1:
        (k, v), = rows[0].items()
        return f"{k}: {v}"
    return f"{len(rows)} rows: " + "; ".join(", ".join(f"{k}={v}" for k, v in r.items()) for r in rows[:10])
