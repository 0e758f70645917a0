"""All queries over the engine's own operators, with their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import grain_queries, graph_queries, lifecycle_queries, retrieval, retrieval_queries, served_queries

_PARTS = (retrieval_queries, graph_queries, lifecycle_queries, grain_queries, served_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole retrieval query over documents and embeddings."""
    return retrieval.document_engine(spark, sf_dir).query({"query": retrieval_queries.QUERY, "include_relationships": True, "include_annotations": True})


def fused_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lists of the flagship's request, consolidated and fused."""
    return retrieval.fused_candidates(spark, sf_dir)


QUERIES |= {"retrieval_query": flagship, "fused_candidates": fused_candidates}
ORACLES["fused_candidates"] = retrieval.fused_candidates_sql()
