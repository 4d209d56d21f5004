"""Connected components by least label and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsift.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> node, comp (the least node of its component) for every
    node of an edge.  Each round takes the least label among the neighbours
    and then the label's label; a star needs two.  Hot nodes combine their
    neighbours' labels before the shuffle.  The joins are merge joins on small
    tables, too: each broadcast of a round would stay in the driver's memory
    until its old generation is collected."""
    both = materialise(edges.select("a", "b").where("a <> b")
                       .unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                         .select("node", F.least("node", "m").alias("comp")))
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "comp").hint("merge"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m")))
        step = (labels.join(near.hint("merge"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("to")))
        jump = labels.select(F.col("node").alias("to"), F.col("comp").alias("up"))
        step = materialise(step.join(jump.hint("merge"), "to").select("node", "was", F.least("to", "up").alias("comp")))
        labels = step.select("node", "comp")
        if not step.where("comp <> was").limit(1).count():
            return labels
