"""The retrieval tables, derived from the driver's: documents are sources, their lines units, embeddings chunks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lexical import Index
from ..runtime import prepare, shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table, dealt by a hash of the key where its files have fewer row groups than tasks can run at once: a group is one task's."""
    n = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select(F.spark_partition_id().alias("p")).distinct().count()  # reads no column
    return rows if parts >= n else rows.repartition(2 * n, F.xxhash64(key))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_objects: one for each document; a document labelled of low quality is held, so it serves no parse; every 97th is deactivated."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    bad = table(spark, sf_dir, "labels").filter("quality = 0").select("doc_id", F.lit(True).alias("held"))
    return docs.join(bad, "doc_id", "left").select(
        F.col("doc_id").alias("source_id"), F.when(F.col("held").isNull(), F.col("doc_id")).alias("active_parse_id"), F.when(F.col("doc_id") % 97 == 0, F.lit("2024-01-01")).alias("deactivated_at"))


SOURCES = """sources AS (SELECT d.doc_id AS source_id, CASE WHEN l.doc_id IS NULL THEN d.doc_id END AS active_parse_id,
  CASE WHEN d.doc_id % 97 = 0 THEN '2024-01-01' END AS deactivated_at FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) l USING (doc_id))"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("source_id"), F.lit("fs").alias("source_system"), F.concat_ws("/", "source", "doc_id").alias("native_uri"),
        F.when(F.col("doc_id") % 5 == 0, "deleted").when(F.col("doc_id") % 11 == 0, "access_lost").otherwise("current").alias("status"), F.col("source").alias("governance_domain"))


LOCATIONS = """locations AS (SELECT doc_id AS source_id, 'fs' AS source_system, source || '/' || doc_id AS native_uri,
  CASE WHEN doc_id % 5 = 0 THEN 'deleted' WHEN doc_id % 11 = 0 THEN 'access_lost' ELSE 'current' END AS status, source AS governance_domain FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("parse_id"), "text")


_indexes: dict[tuple[str, str, str], Index] = {}


def index(spark: SparkSession, sf_dir: str, parse: str = "source") -> Index:
    """The written lexical index of documents as chunks, built at the first use in an application, as an ingestion would.

    A chunk's parse is its source, as in chunks(), or with `parse` doc_id the document itself.
    """
    key = (spark.sparkContext.applicationId, sf_dir, parse)
    if key not in _indexes:
        docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
        _indexes[key] = Index.build(docs, f"{shared_dir(spark)}/lexical-{uuid.uuid4().hex}", "doc_id", parse)
    return _indexes[key]


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with vectors: vec_id is the chunk, label the parse; chunk c holds units c and c + 1."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), F.col("label").alias("parse_id"), F.col("embedding").alias("vector"), F.array(F.col("vec_id"), F.col("vec_id") + 1).alias("unit_ids"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    """One stored vector, as the query: one row."""
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []
