"""Queries over grains, annotations, passages and parsed pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical_json
from ..functions.text import evidence_text, model_input
from ..operators import annotations, packing, passages
from ..sources import html
from .tables import spread, table


def _units(spark: SparkSession, d: str) -> DataFrame:
    return _paragraph_units(table(spark, d, "documents"))


def _paragraph_units(docs: DataFrame) -> DataFrame:
    p = packing.paragraphs(docs)
    return p.select(F.col("doc_id").alias("parse_id"), F.col("paragraph").alias("sequence_index"), F.concat_ws(":", F.col("doc_id").cast("string"), F.lpad(F.col("paragraph").cast("string"), 6, "0")).alias("unit_id"), "text")


def paragraph_units(spark: SparkSession, d: str) -> DataFrame:
    return packing.paragraphs(table(spark, d, "documents")).select("doc_id", "paragraph", "start", "end", F.md5("text").alias("text_md5"))


def chunk_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), packing.FINE)


def colbert_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), packing.COLBERT)


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), packing.CONTEXT, whole=True)


def excerpt_runs(spark: SparkSession, d: str) -> DataFrame:
    return packing.excerpts(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "excerpt", "n", F.md5("text").alias("text_md5"))


def fragment_coalesce(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 300).alias("window_id"), (F.col("l_partkey") % 40).alias("unit_id"), (F.col("l_linenumber") * 10).alias("start_char"), (F.col("l_linenumber") * 10 + 10).alias("end_char")).distinct()
    return packing.coalesce_fragments(li, ["window_id"])


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("window_id"), (F.col("l_partkey") % 900).alias("unit_id"), (F.col("l_linenumber") * 10).alias("start_char"), (F.col("l_linenumber") * 10 + 15).alias("end_char"))


def _refs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("annotation_id"), (F.col("o_custkey") % 900).alias("unit_id"), F.when(F.col("o_orderkey") % 9 != 0, (F.col("o_orderkey") % 7) * 10 + 3).alias("start_char"), ((F.col("o_orderkey") % 7) * 10 + 8).alias("end_char"))


def annotation_window_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return annotations.overlapping(_refs(spark, d), _windows(spark, d))


def cohort_grouping(spark: SparkSession, d: str) -> DataFrame:
    inputs = table(spark, d, "orders").select(F.col("o_orderkey").alias("annotation_id"), F.md5("o_orderpriority").alias("content_hash"))
    return annotations.overlap_cohorts(_refs(spark, d), _windows(spark, d), inputs)


def single_window_of_unit(spark: SparkSession, d: str) -> DataFrame:
    return annotations.only_window(_windows(spark, d).groupBy("window_id").agg(F.collect_set("unit_id").alias("unit_ids")))


def evidence_text_by_type(spark: SparkSession, d: str) -> DataFrame:
    u = html.units(table(spark, d, "pages"))
    return u.select("page_id", "sequence_index", "type", evidence_text(F.col("type"), F.col("text"), F.col("text")).alias("evidence"), model_input(F.array(F.col("path")), F.col("text")).alias("model_input"))


def html_units(spark: SparkSession, d: str) -> DataFrame:
    return html.units(table(spark, d, "pages"))


def href_resolve(spark: SparkSession, d: str) -> DataFrame:
    return html.links(table(spark, d, "pages"))


def table_grid(spark: SparkSession, d: str) -> DataFrame:
    return html.units(table(spark, d, "pages")).filter("type = 'table_cell'").select("page_id", "parent_index", "row", "column", "text")


@F.pandas_udf(T.StringType())
def _clean(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.clean_prose(t))


def prose_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", _clean("text").alias("text"))


def canonical_json_hash(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", canonical_json(F.to_json(F.struct("event_type", "user_id", "value"))).alias("json"))
    return e.select("event_id", "json", F.sha2("json", 256).alias("hash"))


def _runs(words: Column, n: Column | int) -> Column:
    """Distinct runs of n words, joined by spaces; none if there are fewer."""
    n = F.lit(n) if isinstance(n, int) else n
    at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " ")))


#: Up to so many runs of quotes are known to each task, which drops the rest of a text's; of more, all runs of texts are joined.
FEW_RUNS = 1 << 18


def fuzzy_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item, with its third word left out, against the documents that share a run of its words.

    Words are lower-cased letters and digits. A run is half the quote's words, four at most and one at least, so that a change of
    any one word leaves a run whole; a document that shares no run is not looked at.
    """
    words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    b = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", r"^(\S+\s+\S+)\s+\S+", "$1").alias("quote")).withColumn("w", words("quote"))
    b = b.withColumn("n", F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.size("w") / 2).cast("int"))))
    of = b.select("item_id", "quote", F.explode(_runs(F.col("w"), F.col("n"))).alias("run"))
    docs = spread(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    lengths = [r["n"] for r in b.select("n").distinct().collect()]  # four at most
    wanted = [r["run"] for r in of.select("run").distinct().limit(FEW_RUNS + 1).collect()]
    near = annotations.shared_runs(docs, lengths, wanted if len(wanted) <= FEW_RUNS else None).withColumnRenamed("id", "doc_id")
    hit = near.join(of, "run").select("doc_id", "item_id", "quote").distinct()
    return hit.join(docs, "doc_id").select("doc_id", "item_id", annotations.grounded_col("text", "quote").alias("grounded"))


def _seeds(spark: SparkSession, d: str) -> DataFrame:
    """Three queries over lines: seeds are pairs of neighbouring paragraphs, scored by a hash."""
    from ..operators.ranking import top_per

    # a pair is named by its first paragraph, and ranked without its texts; those of the chosen are read then
    g = F.expr("sequence_index div 2").alias("g")
    pair = _units(spark, d).filter("sequence_index = 1 or sequence_index % 2 = 0").select("parse_id", g)
    score = (F.pmod(F.hash("parse_id", "g"), F.lit(1000)) / 1000.0).alias("score")
    rows = pair.select((F.col("parse_id") % 3).alias("query_id"), F.concat_ws(":", F.col("parse_id").cast("string"), F.col("g").cast("string")).alias("key"), score, "parse_id", "g")
    best = top_per(rows, ["query_id"], [F.col("score").desc(), F.col("key").asc()], 100)
    docs = table(spark, d, "documents")
    of = docs.join(F.broadcast(best.select(F.col("parse_id").alias("doc_id")).distinct()), "doc_id", "left_semi")  # 300 rows
    part = F.struct("unit_id", F.lit(0).alias("start_char"), F.length("text").alias("end_char"), "text")
    parts = _paragraph_units(of).select("parse_id", g, part.alias("part")).groupBy("parse_id", "g").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return best.join(parts, ["parse_id", "g"]).select("query_id", "key", "score", F.col("parse_id").cast("string").alias("source_id"), "parts", "rank")


def passage_admission(spark: SparkSession, d: str) -> DataFrame:
    return passages.passages(_seeds(spark, d).drop("rank"), 20)


def evidence_pack(spark: SparkSession, d: str) -> DataFrame:
    return passages.evidence_pack(passage_admission(spark, d))


def passage_provenance(spark: SparkSession, d: str) -> DataFrame:
    u = _units(spark, d)
    hits = u.filter("sequence_index % 2 = 0").select("unit_id", F.lit("dense").alias("channel")).union(u.filter("sequence_index % 3 = 0").select("unit_id", F.lit("lexical")))
    return passages.provenance(passage_admission(spark, d), hits)


QUERIES = {f.__name__: f for f in (
    paragraph_units, chunk_packing, colbert_windows, context_windows, excerpt_runs, fragment_coalesce, annotation_window_overlap_join, cohort_grouping, single_window_of_unit,
    evidence_text_by_type, html_units, href_resolve, table_grid, prose_cleanup, canonical_json_hash, fuzzy_grounding, passage_admission, evidence_pack, passage_provenance)}

_OVERLAP = """o AS (SELECT DISTINCT o_orderkey AS annotation_id, l_orderkey % 500 AS window_id FROM orders JOIN lineitem ON o_custkey % 900 = l_partkey % 900
  WHERE (o_orderkey % 9 = 0 OR ((o_orderkey % 7) * 10 + 3 < l_linenumber * 10 + 15 AND l_linenumber * 10 < (o_orderkey % 7) * 10 + 8)))"""

ORACLES = {
    "paragraph_units": """WITH l AS (SELECT doc_id, text, i, ls[i] AS line, coalesce(list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)), 0) AS s FROM (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)),
        g AS (SELECT *, sum(CASE WHEN trim(regexp_replace(line, '\\s', ' ', 'g')) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l),
        p AS (SELECT doc_id, g, min(s)::int AS start, max(s + length(line))::int AS "end", any_value(text) AS t FROM g WHERE trim(regexp_replace(line, '\\s', ' ', 'g')) <> '' GROUP BY doc_id, g)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start)::int AS paragraph, start, "end", md5(substring(t, start + 1, "end" - start)) AS text_md5 FROM p""",
    "excerpt_runs": """SELECT conv_id, excerpt, count(*)::int AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn, text)) AS text_md5 FROM (
        SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 4)::int AS excerpt FROM conversations) GROUP BY ALL""",
    "fragment_coalesce": """WITH f AS (SELECT DISTINCT l_orderkey % 300 AS window_id, l_partkey % 40 AS unit_id, l_linenumber * 10 AS s FROM lineitem),
        g AS (SELECT *, sum(CASE WHEN s = p + 10 THEN 0 ELSE 1 END) OVER (PARTITION BY window_id, unit_id ORDER BY s) AS g FROM (SELECT *, lag(s) OVER (PARTITION BY window_id, unit_id ORDER BY s) AS p FROM f))
        SELECT window_id, unit_id, min(s) AS start_char, max(s) + 10 AS end_char FROM g GROUP BY window_id, unit_id, g""",
    "annotation_window_overlap_join": f"WITH {_OVERLAP} SELECT * FROM o",
    "cohort_grouping": f"WITH {_OVERLAP} SELECT window_id, count(*)::int AS n_members, sha256(string_agg(annotation_id || ':' || md5(o_orderpriority), ',' ORDER BY annotation_id)) AS input_hash FROM o JOIN orders ON o_orderkey = annotation_id GROUP BY 1",
    "single_window_of_unit": "SELECT l_partkey % 900 AS unit_id, CASE WHEN count(DISTINCT l_orderkey % 500) = 1 THEN min(l_orderkey % 500) END AS window_id FROM lineitem GROUP BY 1",
}
