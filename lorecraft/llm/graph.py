"""Connected components by joins, for links of any number and shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that is reachable over links(a, b).

    Each round every node takes the smallest label among its neighbours', then the label of
    that label, so paths halve; rounds end when none changes. Rounds are written tables, and
    nothing but a count comes to the driver.
    """
    ends = [links.select(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in (("a", "b"), ("b", "a"))]
    both = stored(ends[0].unionByName(ends[1]).distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        # a hub or the label of a giant component is a key of many rows on one side and of one row
        # on the other: adaptive execution cuts such a partition of a join
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        pulled = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = pulled.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") < F.col("old")).alias("moved"))
        old, labels = labels, stored(new, "labels")
        drop_stored(old)
        if not labels.filter("moved").limit(1).count():
            drop_stored(both)
            return labels.select("node", "label")
