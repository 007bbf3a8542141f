"""Connected components by minimum labels with pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): for every end of the edges (a, b), the smallest id of its component. Null ends are ignored.

    Labels only sink, so the rounds end; jumping makes them few even on long chains."""
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    e = stored(e.union(e.select("b", "a")).distinct(), "edges")
    label = stored(e.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), "labels")
    while True:
        seen = e.join(label.select(F.col("id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("id")).agg(F.min("comp").alias("near"))
        step = label.join(seen, "id").select("id", "comp", F.least("comp", "near").alias("low"))
        jump = step.join(label.select(F.col("id").alias("low"), F.col("comp").alias("far")), "low", "left")
        new = stored(jump.select("id", F.least("low", F.coalesce("far", "low")).alias("comp"), (F.least("low", F.coalesce("far", "low")) < F.col("comp")).alias("moved")), "labels")
        label = new.select("id", "comp")
        if new.where("moved").limit(1).count() == 0:
            return label
