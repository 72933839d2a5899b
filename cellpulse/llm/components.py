"""Connected components of a link table, by rounds of joins; nothing is gathered on the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.session import materialise


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable from every node of ``links`` (a, b).

    A round takes the smallest label next door, then the label of that label, so long chains shrink
    by halves. Each round's labels are a written table, so a lost executor costs one round at most.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(edges.filter("a <> b").distinct(), "edges")
    labels = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        by_b = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        near = edges.join(by_b, "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("label").alias("up"))
        # A label is a node of the table, so the look-up always succeeds.
        stepped = lower.join(up, "low").select("node", "label", F.least("low", "up").alias("low"))
        stepped = materialise(stepped, "labels")
        moved = not stepped.filter("low < label").isEmpty()
        labels = stepped.select("node", F.col("low").alias("label"))
        if not moved:
            return labels
