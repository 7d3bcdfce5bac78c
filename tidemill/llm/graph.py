"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import scratch


def components(links: DataFrame) -> DataFrame:
    """``id, comp`` of every end of ``links`` (``a, b`` long), where comp is the smallest id reachable.

    Each round takes the smallest label among the neighbours and then the label of
    that label, so paths shrink geometrically; a round is a table in the shared
    folder. No links: no rows; a link with a null end, or to itself, is none.
    """
    both = scratch.table(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        closer = labels.join(near, "id").select("id", F.col("comp").alias("old"), F.least("comp", "near").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("comp").alias("comp"))
        found = scratch.table(closer.join(jump, "via").select("id", "comp", (F.col("comp") < F.col("old")).alias("moved")), "labels")
        labels = found.select("id", "comp")
        if found.where("moved").isEmpty():
            return labels
