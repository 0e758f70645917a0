"""Dense search: exact cosine scans, section-guided nomination, chunk hits resolved to units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, maxsim
from .ranking import fuse, top, top_per


def search(vectors: DataFrame, query: Sequence[float], k: int = 100, key: str = "chunk_id", vector: str = "vector", order: Sequence[str] = ("parse_id", "chunk_id")) -> DataFrame:
    """The k rows nearest by cosine, (similarity desc, order). Rows without length are not ranked.

    One scan; each task keeps its k best, so only k rows a task are moved.
    """
    scored = vectors.withColumn("similarity", cosine(F.col(vector), query)).drop(vector).filter("similarity is not null and not isnan(similarity)")
    return top(scored, [F.col("similarity").desc(), *(F.col(c).asc() for c in order)], k)


def resolve_units(hits: DataFrame, members: DataFrame, best: str = "similarity", highest: bool = True) -> DataFrame:
    """Chunk hits to units over members(chunk_id, unit_ids): each unit's best value, ranked (best first, unit_id)."""
    each = hits.join(members.select("chunk_id", F.explode("unit_ids").alias("unit_id")), "chunk_id")
    agg = (F.max if highest else F.min)(best).alias(best)
    unit = each.groupBy("unit_id").agg(agg)
    order = [F.col(best).desc() if highest else F.col(best).asc(), F.col("unit_id").asc()]
    return top_per(unit.withColumn("_q", F.lit(0)), ["_q"], order).drop("_q")


def section_nominate(windows: DataFrame, chunks: DataFrame, query: Sequence[float], windows_k: int = 20, per_window: int = 5) -> DataFrame:
    """Units by way of their section: the best windows, then in each the units of the best chunks.

    windows(window_id, parse_id, vector, unit_ids), chunks(chunk_id, parse_id, vector, unit_ids). Windows go by
    (similarity desc, parse_id, window_id). A unit's chunk is the one of most similarity, the first by (parse_id, chunk_id)
    of equals. A unit keeps its first nomination, by window and place in it.
    """
    best = search(windows, query, windows_k, "window_id", order=("parse_id", "window_id")).select("window_id", "unit_ids", F.col("rank").alias("window_rank"))
    wanted = best.select("window_id", "window_rank", F.explode("unit_ids").alias("unit_id"))
    scored = chunks.withColumn("similarity", cosine(F.col("vector"), query)).filter("similarity is not null")
    of_unit = scored.select("parse_id", "chunk_id", "similarity", F.explode("unit_ids").alias("unit_id")).join(wanted.select("unit_id").distinct(), "unit_id", "left_semi")
    # the least (-similarity, parse, chunk): a map-side minimum
    first = of_unit.groupBy("unit_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "parse_id", "chunk_id")).alias("b"))
    each = wanted.join(first, "unit_id").select("window_id", "window_rank", "unit_id", (-F.col("b.s")).alias("similarity"), F.col("b.chunk_id").alias("chunk_id"))
    ranked = top_per(each, ["window_id"], [F.col("similarity").desc(), F.col("unit_id").asc()], per_window, "place")
    once = Window.partitionBy("unit_id").orderBy("window_rank", "place")
    kept = ranked.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n")
    return top_per(kept.withColumn("_q", F.lit(0)), ["_q"], [F.col("window_rank").asc(), F.col("place").asc()]).drop("_q")


def merge_section(passages: DataFrame, sections: DataFrame, k: int = 60, limit: int = 100) -> DataFrame:
    """Passage and section ranks of units fused; places count as they are, as each list has a unit once."""
    lists = passages.select(F.lit("passage").alias("list"), F.col("unit_id").alias("key"), F.col("rank").alias("position")).union(
        sections.select(F.lit("section"), "unit_id", "rank"))
    return fuse(lists, k=k, limit=limit, distinct=False).withColumnRenamed("key", "unit_id")


def maxsim_rank(windows: DataFrame, query: Sequence[Sequence[float]], key: str = "window_id", matrix: str = "matrix", limit: int | None = None) -> DataFrame:
    """Late-interaction ranks of windows that have a matrix, (score desc, key)."""
    scored = windows.filter(F.size(matrix) > 0).withColumn("score", maxsim(F.col(matrix), query)).drop(matrix)
    order = [F.col("score").desc(), F.col(key).asc()]
    return top(scored, order, limit) if limit else top_per(scored.withColumn("_q", F.lit(0)), ["_q"], order).drop("_q")


def pool_windows(fused: DataFrame, members: DataFrame, windows: DataFrame, cap: int) -> DataFrame:
    """The distinct windows of fused units, in fused order, capped before any matrix is read.

    fused(unit_id, rank), members(chunk_id, unit_ids), windows(window_id, chunk_ids).
    """
    chunk = fused.join(members.select("chunk_id", F.explode("unit_ids").alias("unit_id")), "unit_id").groupBy("chunk_id").agg(F.min("rank").alias("rank"))
    window = chunk.join(windows.select("window_id", F.explode("chunk_ids").alias("chunk_id")), "chunk_id").groupBy("window_id").agg(F.min("rank").alias("unit_rank"))
    return top(window, [F.col("unit_rank").asc(), F.col("window_id").asc()], cap)


def rerank(passages: DataFrame, scorer, text: str = "ranking_text", key: str = "candidate_id") -> DataFrame:
    """Ranks by a pluggable scorer (a Column function or pandas UDF of the text), (score desc, key)."""
    scored = passages.withColumn("score", scorer(F.col(text)))
    return top_per(scored.withColumn("_q", F.lit(0)), ["_q"], [F.col("score").desc(), F.col(key).asc()]).drop("_q")
