"""Queries over the retrieval operators, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..operators import dense, lexical, ranking, scope
from . import tables as T

QUERY = "The idiot, a clown from there"
BROAD = "to of it"
VEC = 7
SIM = 6


def _bm25(query: str, k: int) -> str:
    terms, strict = query_terms(query)
    tf = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS tf{i}" for i, q in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (WHERE tf{i} > 0) AS df{i}" for i in range(len(terms)))
    score = " + ".join(
        f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * (tf{i} * 2.2) / (tf{i} + 1.2 * (0.25 + 0.75 * dl / av))" for i in range(len(terms)))
    match = (" AND " if strict else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""
  t AS (SELECT doc_id AS chunk_id, source AS parse_id, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents),
  c AS (SELECT parse_id, chunk_id, len(t) AS dl, {tf} FROM t),
  s AS (SELECT count(*) AS n, avg(dl) AS av, {df} FROM c),
  m AS (SELECT parse_id, chunk_id, {score} AS score FROM c, s WHERE {match}),
  bm AS (SELECT parse_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY parse_id ORDER BY score DESC, chunk_id) AS rank FROM m QUALIFY rank <= {k})"""


_Q = f"q AS (SELECT embedding::double[] AS q FROM embeddings WHERE vec_id = {VEC})"
_COS = "list_dot_product({v}::double[], q) / (sqrt(list_dot_product({v}::double[], {v}::double[])) * sqrt(list_dot_product(q, q)))"
_SIM = f"sims AS (SELECT vec_id, label, {_COS.format(v='embedding')} AS sim FROM embeddings, q)"


def lexical_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return T.index(spark, d).search(QUERY, 10).withColumn("score", F.round("score", 6))


def lexical_strict_vs_broad(spark: SparkSession, d: str) -> DataFrame:
    c = T.index(spark, d)
    both = [c.search(q, 5).select(F.lit(name).alias("mode"), "parse_id", "chunk_id", F.round("score", 6).alias("score"), "rank") for name, q in (("strict", QUERY), ("broad", BROAD))]
    return both[0].union(both[1])


def lexical_scoped(spark: SparkSession, d: str) -> DataFrame:
    """Statistics stay those of the corpus when the scope is two parses."""
    c = T.chunks(spark, d)
    within = c.select("parse_id").distinct().filter(F.col("parse_id").isin("src1", "src2"))
    return T.index(spark, d).search(BROAD, 10, scope=within).withColumn("score", F.round("score", 6))


def lexical_postings(spark: SparkSession, d: str) -> DataFrame:
    return lexical.postings(T.chunks(spark, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses"))


def dense_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    got = dense.search(T.vectors(spark, d), T.query_vector(spark, d, VEC), 20)
    return got.select("chunk_id", "parse_id", F.round("similarity", SIM).alias("similarity"), "rank")


def dense_topk_per_label(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.vectors import cosine

    scored = T.vectors(spark, d).select("chunk_id", "parse_id", cosine(F.col("vector"), T.query_vector(spark, d, VEC)).alias("similarity"))
    got = ranking.top_per(scored.filter("similarity is not null"), ["parse_id"], [F.col("similarity").desc(), F.col("chunk_id").asc()], 3)
    return got.withColumn("similarity", F.round("similarity", SIM))


def _windows(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    return v.groupBy(F.expr("chunk_id div 8").alias("window_id")).agg(
        F.min_by("parse_id", "chunk_id").alias("parse_id"), F.min_by("vector", "chunk_id").alias("vector"), F.array_sort(F.collect_list("chunk_id")).alias("unit_ids"))


def section_guided_dense(spark: SparkSession, d: str) -> DataFrame:
    single = T.vectors(spark, d)
    got = dense.section_nominate(_windows(spark, d), single, T.query_vector(spark, d, VEC))
    return got.select("unit_id", "window_id", "chunk_id", F.round("similarity", SIM).alias("similarity"), "rank")


_SECTION = f"""
  {_Q}, {_SIM},
  w AS (SELECT vec_id // 8 AS window_id, arg_min(label, vec_id) AS parse_id, arg_min(sim, vec_id) AS sim FROM sims GROUP BY 1),
  bw AS (SELECT window_id, row_number() OVER (ORDER BY sim DESC, parse_id, window_id) AS wr FROM w QUALIFY wr <= 20),
  mem AS (SELECT bw.window_id, wr, e.vec_id AS unit_id FROM bw JOIN embeddings e ON e.vec_id // 8 = bw.window_id),
  fan AS (SELECT vec_id AS chunk_id, label AS parse_id, sim, vec_id + u.o AS unit_id FROM sims, (VALUES (0), (1)) u(o)),
  bc AS (SELECT unit_id, sim, chunk_id FROM fan WHERE unit_id IN (SELECT unit_id FROM mem) QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY sim DESC, parse_id, chunk_id) = 1),
  pl AS (SELECT window_id, wr, unit_id, sim, chunk_id, row_number() OVER (PARTITION BY window_id ORDER BY sim DESC, unit_id) AS place FROM mem JOIN bc USING (unit_id) QUALIFY place <= 5),
  sec AS (SELECT unit_id, window_id, chunk_id, sim, row_number() OVER (ORDER BY wr, place) AS rank FROM (SELECT * FROM pl QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY wr, place) = 1))"""


def unit_resolution_dense(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    hits = dense.search(v.drop("unit_ids"), T.query_vector(spark, d, VEC), 50).select("chunk_id", "similarity")
    return dense.resolve_units(hits, v).withColumn("similarity", F.round("similarity", SIM))


_UNITS = f"""
  {_Q}, {_SIM},
  hits AS (SELECT vec_id, sim FROM sims ORDER BY sim DESC, label, vec_id LIMIT 50),
  unit AS (SELECT unit_id, max(sim) AS sim FROM (SELECT vec_id + u.o AS unit_id, sim FROM hits, (VALUES (0), (1)) u(o)) GROUP BY 1),
  ranked AS (SELECT unit_id, sim, row_number() OVER (ORDER BY sim DESC, unit_id) AS rank FROM unit)"""


def unit_resolution_lexical(spark: SparkSession, d: str) -> DataFrame:
    c = T.chunks(spark, d)
    hits = T.index(spark, d).search(BROAD, 20).select("chunk_id", F.round(-F.col("score"), 6).alias("bm25"))
    members = c.select("chunk_id", F.array(F.expr("chunk_id div 2"), F.expr("chunk_id div 2 + 1")).alias("unit_ids"))
    return dense.resolve_units(hits, members, "bm25", highest=False).withColumn("bm25", F.round("bm25", 6))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """The dense list repeats units; a unit votes once, at its first place."""
    v = T.vectors(spark, d)
    near = dense.search(v, T.query_vector(spark, d, VEC), 40).select(F.lit("dense").alias("list"), F.expr("chunk_id div 2").alias("key"), F.col("rank").alias("position"))
    lex = T.index(spark, d).search(BROAD, 1).select(F.lit("lexical").alias("list"), F.expr("chunk_id div 4").alias("key"), (F.col("chunk_id") + 1).alias("position"))
    return ranking.fuse(near.union(lex), limit=30).withColumn("score", F.round("score", 9))


def grouped_rrf(spark: SparkSession, d: str) -> DataFrame:
    """Four levels: semantic, dense with source, annotation of graph and semantic, and all."""
    lists = _channel_lists(spark, d)
    return grouped_fusion(lists, 100, 100).withColumn("score", F.round("score", 9))


def grouped_fusion(lists: DataFrame, channel_cap: int, pool_cap: int, k: int = 60) -> DataFrame:
    """Grouped fusion of (list, key, position), list one of dense, source, graph, lexical or any semantic kind."""
    as_list = lambda fused, name: fused.select(F.lit(name).alias("list"), "key", F.col("rank").alias("position"))
    pick = lambda *names: lists.filter(F.col("list").isin(*names))
    semantic = ranking.fuse(lists.filter(~F.col("list").isin("dense", "source", "graph", "lexical")), k=k, limit=channel_cap)
    near = ranking.fuse(pick("dense", "source"), k=k, limit=channel_cap)
    annotation = ranking.fuse(pick("graph").union(as_list(semantic, "semantic")), k=k, limit=pool_cap)
    return ranking.fuse(as_list(near, "dense").union(pick("lexical")).union(as_list(annotation, "annotation")), k=k, limit=pool_cap)


def _channel_lists(spark: SparkSession, d: str) -> DataFrame:
    """Six lists over vec_id: places by residues, the same in SQL."""
    e = T.table(spark, d, "embeddings").select("vec_id")
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("list"), F.lit(m).alias("m")) for n, m in _LISTS.items()))).alias("l")
    return e.select("vec_id", each).select(F.col("l.list").alias("list"), F.col("vec_id").alias("key"), ((F.col("vec_id") * F.col("l.m")) % 501 + 1).alias("position")).filter("position <= 60")


_LISTS = {"dense": 7, "source": 11, "graph": 13, "lexical": 17, "entity": 19, "summary": 23}


def _grouped_sql() -> str:
    rows = ", ".join(f"('{n}', {m})" for n, m in _LISTS.items())

    def fuse(name: str, src: str, cap: int) -> str:
        return f"""{name} AS (SELECT key, score, row_number() OVER (ORDER BY score DESC, key) AS rank FROM (
  SELECT key, list_sum(list(1.0::double / (60 + r) ORDER BY list)) AS score FROM (SELECT list, key, row_number() OVER (PARTITION BY list ORDER BY position, key) AS r
  FROM (SELECT list, key, min(position) AS position FROM ({src}) GROUP BY ALL)) GROUP BY key) QUALIFY rank <= {cap})"""

    return f"""WITH l AS (SELECT n AS list, vec_id AS key, vec_id * m % 501 + 1 AS position FROM embeddings, (VALUES {rows}) x(n, m) WHERE vec_id * m % 501 + 1 <= 60),
{fuse("sem", "SELECT * FROM l WHERE list NOT IN ('dense', 'source', 'graph', 'lexical')", 100)},
{fuse("den", "SELECT * FROM l WHERE list IN ('dense', 'source')", 100)},
{fuse("ann", "SELECT * FROM l WHERE list = 'graph' UNION ALL SELECT 'semantic', key, rank FROM sem", 100)},
{fuse("fin", "SELECT 'dense' AS list, key, rank AS position FROM den UNION ALL SELECT * FROM l WHERE list = 'lexical' UNION ALL SELECT 'annotation', key, rank FROM ann", 100)}
SELECT key, round(score, 9) AS score, rank FROM fin"""


def maxsim_windows(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "embeddings")
    q = [[float(x) for x in r[0]] for r in e.filter("vec_id div 8 = 2").orderBy("vec_id").select("embedding").collect()]  # one window
    m = e.groupBy(F.expr("vec_id div 8").alias("window_id")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("m"))
    m = m.select("window_id", F.col("m.embedding").alias("matrix"))
    return dense.maxsim_rank(m, q, limit=100).withColumn("score", F.round("score", 5))


def capped_pool_windows(spark: SparkSession, d: str) -> DataFrame:
    v = T.vectors(spark, d)
    hits = dense.search(v.drop("unit_ids"), T.query_vector(spark, d, VEC), 50).select("chunk_id", "similarity")
    fused = dense.resolve_units(hits, v).select("unit_id", "rank")
    windows = v.groupBy(F.expr("chunk_id div 4").alias("window_id")).agg(F.collect_list("chunk_id").alias("chunk_ids"))
    return dense.pool_windows(fused, v, windows, 15)


def active_scope_all(spark: SparkSession, d: str) -> DataFrame:
    return scope.active(T.sources(spark, d))


def scope_source_set(spark: SparkSession, d: str) -> DataFrame:
    return scope.active(T.sources(spark, d), ids=[1, 2, 3, 97, 150, 151], most=100)


def scope_domain_set(spark: SparkSession, d: str) -> DataFrame:
    return scope.active(T.sources(spark, d), T.locations(spark, d), domains=["src1", "src2"])


def scope_conjunction(spark: SparkSession, d: str) -> DataFrame:
    return scope.active(T.sources(spark, d), T.locations(spark, d), ids=list(range(60)), domains=["src1", "src2", "src3"])


_ACTIVE = "SELECT source_id, active_parse_id AS parse_id FROM sources WHERE active_parse_id IS NOT NULL AND deactivated_at IS NULL"
_CURRENT = "source_id IN (SELECT source_id FROM locations WHERE status = 'current' AND governance_domain IN ({}))"


def locations_per_source(spark: SparkSession, d: str) -> DataFrame:
    got = scope.locations_per_source(T.locations(spark, d))
    return got.select("source_id", F.size("locations").alias("n_locations"), F.col("locations")[0]["native_uri"].alias("first_uri"))


QUERIES = {f.__name__: f for f in (
    lexical_bm25_topk, lexical_strict_vs_broad, lexical_scoped, lexical_postings, dense_cosine_topk, dense_topk_per_label, section_guided_dense, unit_resolution_dense,
    unit_resolution_lexical, rrf_fusion, grouped_rrf, maxsim_windows, capped_pool_windows, active_scope_all, scope_source_set, scope_domain_set, scope_conjunction, locations_per_source)}

ORACLES = {
    "lexical_bm25_topk": f"WITH {_bm25(QUERY, 10)} SELECT parse_id, chunk_id, score, rank FROM bm",
    "lexical_strict_vs_broad": f"SELECT * FROM (WITH {_bm25(QUERY, 5)} SELECT 'strict' AS mode, * FROM bm) UNION ALL SELECT * FROM (WITH {_bm25(BROAD, 5)} SELECT 'broad' AS mode, * FROM bm)",
    "lexical_scoped": f"WITH {_bm25(BROAD, 10)} SELECT * FROM bm WHERE parse_id IN ('src1', 'src2')",
    "lexical_postings": """SELECT term, count(*) AS df, sum(tf)::bigint AS uses FROM (SELECT doc_id, term, count(*) AS tf FROM (
        SELECT doc_id, unnest(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+')) AS term FROM documents) WHERE term <> '' GROUP BY ALL) GROUP BY term""",
    "dense_cosine_topk": f"WITH {_Q}, {_SIM} SELECT vec_id AS chunk_id, label AS parse_id, round(sim, 6) AS similarity, row_number() OVER (ORDER BY sim DESC, label, vec_id) AS rank FROM sims QUALIFY rank <= 20",
    "dense_topk_per_label": f"WITH {_Q}, {_SIM} SELECT vec_id AS chunk_id, label AS parse_id, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY label ORDER BY sim DESC, vec_id) AS rank FROM sims QUALIFY rank <= 3",
    "section_guided_dense": f"WITH {_SECTION} SELECT unit_id, window_id, chunk_id, round(sim, 6) AS similarity, rank FROM sec",
    "unit_resolution_dense": f"WITH {_UNITS} SELECT unit_id, round(sim, 6) AS similarity, rank FROM ranked",
    "unit_resolution_lexical": f"""WITH {_bm25(BROAD, 20)}, u AS (SELECT chunk_id // 2 + o AS unit_id, min(-score) AS bm25 FROM bm, (VALUES (0), (1)) x(o) GROUP BY 1)
        SELECT unit_id, round(bm25, 6) AS bm25, row_number() OVER (ORDER BY bm25, unit_id) AS rank FROM u""",
    "rrf_fusion": f"""WITH {_Q}, {_SIM}, {_bm25(BROAD, 1)},
        l AS (SELECT 'dense' AS list, vec_id // 2 AS key, row_number() OVER (ORDER BY sim DESC, label, vec_id) AS position FROM sims QUALIFY position <= 40
              UNION ALL SELECT 'lexical', chunk_id // 4, chunk_id + 1 FROM bm),
        r AS (SELECT list, key, row_number() OVER (PARTITION BY list ORDER BY position, key) AS r FROM (SELECT list, key, min(position) AS position FROM l GROUP BY ALL)),
        f AS (SELECT key, sum(1.0::double / (60 + r)) AS score FROM r GROUP BY key)
        SELECT key, round(score, 9) AS score, row_number() OVER (ORDER BY round(score, 12) DESC, key) AS rank FROM f QUALIFY rank <= 30""",
    "grouped_rrf": _grouped_sql(),
    "maxsim_windows": """WITH q AS (SELECT vec_id AS qi, embedding::double[] AS q FROM embeddings WHERE vec_id // 8 = 2),
        b AS (SELECT e.vec_id // 8 AS window_id, qi, max(list_dot_product(e.embedding::double[], q)) AS best FROM embeddings e, q GROUP BY ALL),
        s AS (SELECT window_id, sum(best) AS score FROM b GROUP BY 1)
        SELECT window_id, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, window_id) AS rank FROM s QUALIFY rank <= 100""",
    "capped_pool_windows": f"""WITH {_UNITS},
        c AS (SELECT e.vec_id AS chunk_id, min(rank) AS rank FROM ranked r, embeddings e WHERE r.unit_id IN (e.vec_id, e.vec_id + 1) GROUP BY 1),
        w AS (SELECT chunk_id // 4 AS window_id, min(rank) AS unit_rank FROM c GROUP BY 1)
        SELECT window_id, unit_rank, row_number() OVER (ORDER BY unit_rank, window_id) AS rank FROM w QUALIFY rank <= 15""",
    "active_scope_all": f"WITH {T.SOURCES} {_ACTIVE}",
    "scope_source_set": f"WITH {T.SOURCES} {_ACTIVE} AND source_id IN (1, 2, 3, 97, 150, 151)",
    "scope_domain_set": f"WITH {T.SOURCES}, {T.LOCATIONS} {_ACTIVE} AND " + _CURRENT.format("'src1', 'src2'"),
    "scope_conjunction": f"WITH {T.SOURCES}, {T.LOCATIONS} {_ACTIVE} AND source_id < 60 AND " + _CURRENT.format("'src1', 'src2', 'src3'"),
    "locations_per_source": f"WITH {T.LOCATIONS} SELECT source_id, count(*)::int AS n_locations, min(native_uri) AS first_uri FROM locations GROUP BY 1",
}
