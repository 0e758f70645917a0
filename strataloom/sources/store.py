"""Files in and out: folder scans, the content-addressed store, bundles, table export and import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import mime


def scan(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """(native_uri, mtime, size, mime, source_hash, content) of a folder's files; hidden ones are left out.

    Without `content` only the listing is read, for the prescreen by time and size.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    shown = files.filter(~F.col("path").rlike(r"/\.[^/]*(/|$)"))
    cols = [F.col("path").alias("native_uri"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), mime(F.col("path")).alias("mime")]
    return shown.select(*cols, *([F.sha2("content", 256).alias("source_hash"), "content"] if content else []))


def put(spark: SparkSession, path: str, blobs: DataFrame) -> DataFrame:
    """Adds blobs(content) to the store at path, each hash once; what is there stays as written. Returns the new hashes."""
    fresh = blobs.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"])
    try:
        fresh = fresh.join(spark.read.schema("hash string, content binary").parquet(path).select("hash"), "hash", "left_anti")
    except Exception as e:  # the store does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    fresh.write.mode("append").parquet(path)
    return fresh.select("hash")


def get(spark: SparkSession, path: str, hashes: DataFrame) -> DataFrame:
    """(hash, content) of the hashes; content that no longer has its hash is an error."""
    got = spark.read.schema("hash string, content binary").parquet(path).join(hashes.select("hash").distinct(), "hash", "left_semi")
    return got.withColumn("content", F.when(F.sha2("content", 256) == F.col("hash"), F.col("content")).otherwise(F.raise_error(F.lit("stored content is damaged")).cast("binary")))


def export_json(df: DataFrame) -> DataFrame:
    """Rows as JSON lines with their sha256; nulls are left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value")).withColumn("sha256", F.sha2("value", 256))


def import_json(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Exported lines as rows again; a line that does not fit, or whose hash differs, is an error."""
    sound = F.when(F.sha2("value", 256) == F.col("sha256"), F.col("value")).otherwise(F.raise_error(F.lit("a line does not have its hash")))
    return lines.select(F.from_json(sound, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def manifest(files: DataFrame) -> DataFrame:
    """(path, size, sha256) of files(path, content)."""
    return files.select("path", F.octet_length("content").alias("size"), F.sha2("content", 256).alias("sha256"))


def verified(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files that a manifest does not list, or that differ from it, and listed ones that are not there; empty if all is well."""
    both = manifest(files).join(listed.select("path", F.col("size").alias("_s"), F.col("sha256").alias("_h")), "path", "full_outer")
    return both.filter(~(F.col("size").eqNullSafe(F.col("_s")) & F.col("sha256").eqNullSafe(F.col("_h")))).select("path")
