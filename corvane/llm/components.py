"""Connected components of links between many nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, release


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by smallest-label propagation with pointer jumping.

    `nodes` (code, doc) holds the smallest id of each node; `edges` (a, b). Returns (code, doc) with the smallest id of
    the component, for nodes that have an edge. Each round is written to the shared folder, so lineage stays short and a lost executor repeats one
    round at most; the round before it is deleted then.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "components-edges")
    ends = both.select(F.col("a").alias("code")).distinct()
    big = F.lit(2**63 - 1)
    label = materialize(
        ends.join(nodes, "code").select("code", F.struct(F.coalesce("doc", big).alias("doc"), F.col("code").alias("root")).alias("low"), F.lit(True).alias("moved")),
        "components-labels",
    )
    for _ in range(rounds):
        seen = both.join(label.select(F.col("code").alias("b"), "low"), "b").groupBy(F.col("a").alias("code")).agg(F.min("low").alias("near"))
        step = label.select("code", "low").join(seen, "code").select("code", F.col("low").alias("was"), F.least("low", "near").alias("low"))
        jump = label.select(F.col("code").alias("root"), F.col("low").alias("far"))
        step = step.withColumn("root", F.col("low.root")).join(jump, "root").select("code", F.least("low", "far").alias("low"), (F.least("low", "far") != F.col("was")).alias("moved"))
        before, label = label, materialize(step, "components-labels")
        release(before)
        if label.where("moved").isEmpty():
            release(both)
            return label.select("code", F.when(F.col("low.doc") < big, F.col("low.doc")).alias("doc"))
    raise RuntimeError("components did not settle")
