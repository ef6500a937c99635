"""Connected components of verified links, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterway.llm.shared import written

#: Links (both ways) of a file of the tables here, and files that even small ones may have.
FILE_LINKS, LEAST_FILES = 250_000, 12


def components(links: DataFrame) -> DataFrame:
    """(node, class) for every node of ``links`` (a, b); class is the smallest node it reaches.

    Each round takes the smallest class among a node and its neighbours and then
    the class of that class, until a round changes nothing.  All state stays in
    tables in the shared folder; only a count comes to the driver.  Every round writes a
    table, so these get files by the number of links, not one for each shuffle partition.
    """
    links = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = written(links)
    files = max(LEAST_FILES, -(-links.count() // FILE_LINKS))
    labels = written(links.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("class")).coalesce(files))
    while True:
        near = links.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("class").alias("near"))
        step = labels.join(near, "node").select("node", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        jump = labels.select(F.col("node").alias("class"), F.col("class").alias("next"))
        labels = written(step.join(jump, "class", "left").select("node", "was", F.coalesce("next", "class").alias("class")).coalesce(files))
        if not labels.where("was <> class").limit(1).count():
            return labels.select("node", "class")
        labels = labels.select("node", "class")
