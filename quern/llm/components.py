"""Connected components of a link table, by minimum labels and pointer jumping.

Labels and links stay distributed; each round joins them on plain shuffled columns
(so that adaptive execution can split a node of very many links) and is written to
the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.storage import materialize


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """node, label (the smallest node it is linked to, itself included) for every node of ``links``."""
    both = materialize(
        links.select(F.col(a).alias("src"), F.col(b).alias("dst")).union(links.select(F.col(b), F.col(a)))
        .filter("src <> dst").distinct(), "links",
    )
    labels = materialize(both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("node"), F.least("src", "low").alias("label")), "labels")
    while True:
        heard = both.join(labels, both.src == labels.node).groupBy("dst").agg(F.min("label").alias("heard"))
        lower = materialize(
            labels.join(heard, labels.node == heard.dst, "left")
            .select("node", F.least("label", F.coalesce("heard", "label")).alias("label"), F.col("label").alias("was")), "lower",
        )
        ahead = lower.select(F.col("node").alias("_at"), F.col("label").alias("_next"))
        labels = materialize(
            lower.join(ahead, F.col("label") == F.col("_at"), "left")
            .select("node", F.coalesce("_next", "label").alias("label"), "was"), "labels",
        )
        if labels.filter("label <> was").isEmpty():
            return labels.select("node", "label")
        labels = labels.drop("was")
