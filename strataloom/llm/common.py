"""Shared pieces: scratch tables in the shared checkpoint folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import prepare, shared_dir

#: Words are maximal runs of characters other than these six.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Written tables that cut lineage. A lost executor costs only the tasks that run, as the files are shared."""

    def __init__(self, spark: SparkSession):
        self.spark = prepare(spark)
        self.root = f"{shared_dir(spark)}/strataloom-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, tag: str, **options: str) -> DataFrame:
        path = f"{self.root}/{tag}"
        df.write.mode("errorifexists").options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, tag: str) -> None:
        """Only for tables that no DataFrame handed out still reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{tag}")
        path.getFileSystem(conf).delete(path, True)


def connected(scratch: Scratch, edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components of edges(a, b): one row (node, root) per node, root the least node reachable.

    Each round every node takes the least root among its neighbours' roots and its root's root; the
    rounds end when none changes. Round tables are written, never collected. Self-loops and repeated
    edges are harmless; no edges give no rows.
    """
    # written before both directions are taken: which edges span a group may differ from one evaluation to the next
    given = scratch.write(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")), f"{tag}-given")
    e = scratch.write(given.union(given.select("dst", "src")).distinct(), f"{tag}-edges")
    labels = scratch.write(
        e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("near")).select("node", F.least("node", "near").alias("root")),
        f"{tag}-0",
    )
    step = 0
    while True:
        step += 1
        at = labels.select(F.col("node").alias("at"), F.col("root").alias("to"))
        near = e.join(at, F.col("dst") == F.col("at")).select(F.col("src").alias("node"), "to", F.lit(None).cast("long").alias("old"))
        jump = labels.join(at, F.col("root") == F.col("at")).select("node", "to", F.col("root").alias("old"))
        new = scratch.write(near.union(jump).groupBy("node").agg(F.min("to").alias("root"), F.max("old").alias("old")), f"{tag}-{step}")
        labels = new.select("node", "root")
        changed = new.filter("root <> old").limit(1).count()
        if step > 1:
            scratch.drop(f"{tag}-{step - 1}")
        if not changed:
            return labels
