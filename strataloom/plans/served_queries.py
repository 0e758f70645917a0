"""Queries over served state, scalar functions, vectors and retained lists, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import annotations, conformance, dense, graph, lifecycle, scope, served
from . import tables as T
from .tables import table

_KIND = "CASE o_orderkey % 6 WHEN 0 THEN 'section' WHEN 1 THEN 'text_block' WHEN 2 THEN 'caption' WHEN 3 THEN 'table' WHEN 4 THEN 'table_cell' ELSE 'code_block' END"
#: Orders as units of their customer's parse; the same text in both dialects.
_U = f"""SELECT o_orderkey AS unit_id, o_custkey AS parse_id, o_custkey % 7 AS source_id, {_KIND} AS type, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 11 END AS sequence_index,
  CASE WHEN o_orderkey % 17 = 0 THEN ' ' ELSE o_orderpriority END AS text, CASE WHEN o_orderkey % 5 = 0 THEN 'heading' END AS role, CASE WHEN o_orderkey % 3 = 0 THEN 'unknown' WHEN o_orderkey % 4 <> 0 THEN 'chapter' END AS kind,
  o_orderkey % 9 AS level, CASE WHEN o_orderkey % 10 <> 4 THEN o_orderkey END AS row_id FROM orders"""


def units(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_U.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders"))


def _annotations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    body = F.concat(F.lit('{"name":"n'), F.col("o_custkey").cast("string"), F.lit('","entityType":"T","subject":"s","predicate":"p","object":"o","text":"'), F.col("o_orderpriority"), F.lit('"}'))
    return o.select(
        k.alias("annotation_id"), F.col("o_custkey").alias("source_id"), (k % 4).alias("parse_id"), F.when(k % 7 == 0, "stale").otherwise("fresh").alias("freshness"), F.when(k % 5 == 0, "2024").alias("deleted_at"),
        F.when(k % 4 == 0, "entity").when(k % 4 == 1, "relation").when(k % 4 == 2, "summary").otherwise("topic").alias("type"), F.when(k % 23 == 0, "[]").otherwise(body).alias("body"))


_A = """SELECT o_orderkey AS annotation_id, o_custkey AS source_id, o_orderkey % 4 AS parse_id, CASE WHEN o_orderkey % 7 = 0 THEN 'stale' ELSE 'fresh' END AS freshness, CASE WHEN o_orderkey % 5 = 0 THEN '2024' END AS deleted_at,
  CASE o_orderkey % 4 WHEN 0 THEN 'entity' WHEN 1 THEN 'relation' WHEN 2 THEN 'summary' ELSE 'topic' END AS type, o_orderkey % 23 = 0 AS marker, o_custkey, o_orderpriority FROM orders"""


def unit_ownership(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") + F.when(F.col("l_partkey") % 17 == 0, 100_000_000).otherwise(0)).alias("unit_id"), (F.col("l_suppkey") % 7).alias("source_id"))
    return served.ownership_conflicts(li, units(spark, d))


def selected_relationships(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"))
    chosen = table(spark, d, "orders").filter("o_orderkey % 3 = 0").select((F.col("o_custkey") % 50).alias("unit_id"))
    return scope.selected_relationships(e, chosen).select("l_orderkey", "l_linenumber", "from_id", "to_id")


def annotations_of_units(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").select(F.col("o_orderkey").alias("annotation_id"), F.array("o_custkey", F.col("o_custkey") + 1).alias("unit_ids"))
    return served.annotations_of(a, table(spark, d, "customer").filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("unit_id")))


def _cohorts(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("cohort_id"), (F.col("o_orderkey") + F.when(F.col("o_orderkey") % 19 == 0, 100_000_000).otherwise(0)).alias("a"))
    return o.groupBy("cohort_id").agg(F.collect_list("a").alias("annotation_ids"))


def cohort_input_state(spark: SparkSession, d: str) -> DataFrame:
    return served.cohort_inputs(_cohorts(spark, d), _annotations(spark, d))


def dependent_projections(spark: SparkSession, d: str) -> DataFrame:
    changed = table(spark, d, "orders").filter("o_orderkey % 50 = 0").select(F.col("o_orderkey").alias("annotation_id"))
    return served.dependents(_cohorts(spark, d).withColumnRenamed("cohort_id", "projection_id"), changed)


def counts_by_type(spark: SparkSession, d: str) -> DataFrame:
    got = conformance.counts_by_type(units(spark, d))
    return got.select("parse_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("counts"))


def decomposition_rate(spark: SparkSession, d: str) -> DataFrame:
    """A unit's parent is the one of a thirtieth of its number."""
    u = units(spark, d)
    contains = u.filter("unit_id >= 30").select(F.expr("unit_id div 30").alias("parent_id"), "unit_id")
    return conformance.decomposition(u, contains, "table", "table_cell", depth=8)


def section_kind_coverage(spark: SparkSession, d: str) -> DataFrame:
    return served.section_kinds(units(spark, d))


def parse_metrics(spark: SparkSession, d: str) -> DataFrame:
    return served.metrics(units(spark, d), ["section", "table", "code_block"])


def warning_report(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 10).alias("parse_id"), F.col("event_type").alias("code"), F.col("event_id").alias("locator"), F.col("ts").alias("position"))
    return served.warnings_by_code(e)


def current_paths(spark: SparkSession, d: str) -> DataFrame:
    loc = T.locations(spark, d).withColumn("source_id", F.col("source_id") % 100)
    return served.current_paths(loc).select("source_id", F.array_join("paths", ",").alias("paths"))


def active_unit_read(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_custkey") % 4).alias("active_parse_id"))
    return scope.active_units(_annotations(spark, d).select("source_id", "parse_id", F.col("annotation_id").alias("unit_id")), o)


def fresh_annotations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), F.when(F.col("c_custkey") % 6 != 0, F.col("c_custkey") % 4).alias("active_parse_id"))
    return scope.fresh_annotations(_annotations(spark, d), o).select("annotation_id", "source_id", "parse_id")


def unit_relationships_read(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"),
        F.when(F.col("l_linenumber") < 5, "contains").otherwise("precedes").alias("type"), F.when(F.col("l_linenumber") != 2, F.col("l_linenumber")).alias("sequence_index"))
    parts = [scope.relationships_of(e, 7, way, kind).select(F.lit(way).alias("direction"), "id", "from_id", "to_id", "type") for way, kind in (("out", None), ("in", None), ("both", "contains"))]
    return parts[0].union(parts[1]).union(parts[2])


def evidence_members(spark: SparkSession, d: str) -> DataFrame:
    return units(spark, d).filter(text.evidence_member(F.col("type"), F.col("role"), F.col("text"), F.col("row_id"))).select("unit_id", "type")


def scalar_text(spark: SparkSession, d: str) -> DataFrame:
    """Slices, cuts, keys, guarded reads and relative uris of every document."""
    docs = table(spark, d, "documents")
    return docs.select(
        "doc_id", text.char_slice(F.col("text"), F.lit(3), F.lit(10)).alias("slice"), text.short(F.col("text"), 12).alias("cut"), text.source_key(F.lit("fs"), F.col("source")).alias("key"),
        F.octet_length(text.guarded(F.col("text"), 1 << 30)).alias("n_bytes"), served.relative_uri(F.concat(F.lit("/corpus/"), F.when(F.col("doc_id") % 5 == 0, "../").otherwise(""), F.col("source")), "/corpus").alias("uri"),
        text.mime(F.concat(F.col("source"), F.when(F.col("doc_id") % 2 == 0, ".TXT").otherwise(".epub"))).alias("mime"))


def unresolved_operations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("operation_id"), F.when(F.col("user_id") % 2 == 0, "rebuild").otherwise("scan").alias("kind"), F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "running").otherwise("completed").alias("state"))
    return served.unresolved(e, "rebuild")


def dense_evidence(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "lineitem").select((F.col("l_partkey") % 300).alias("unit_id"), F.when(F.col("l_linenumber") % 2 == 0, "passage").otherwise("section").alias("kind"), (F.col("l_suppkey") % 20).alias("match_id"))
    got = served.evidence_of_units(m)
    return got.select("unit_id", F.array_join(F.transform("matches", lambda x: F.concat_ws(":", x["kind"], x["match_id"].cast("string"))), ",").alias("matches"))


def attribution(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "lineitem").select((F.col("l_linenumber") % 4).alias("list"), (F.col("l_suppkey") % 30).alias("key"), (F.col("l_partkey") % 100).alias("target"), (F.col("l_orderkey") % 40).alias("annotation_id"))
    kept = table(spark, d, "orders").select((F.col("o_orderkey") % 3).cast("int").alias("list"), (F.col("o_custkey") % 9).alias("key"))
    return served.attribution(hits, kept).select("target", F.array_join(F.transform("annotation_ids", lambda x: x.cast("string")), ",").alias("annotation_ids"))


def annotation_framing(spark: SparkSession, d: str) -> DataFrame:
    return served.annotation_text(_annotations(spark, d))


def summary_materialization(spark: SparkSession, d: str) -> DataFrame:
    return served.summaries(_annotations(spark, d).withColumn("parse_id", F.col("source_id")))


def markdown_view(spark: SparkSession, d: str) -> DataFrame:
    return served.markdown(units(spark, d)).select("parse_id", "n_units", F.md5("markdown").alias("markdown_md5"))


def held_decisions(spark: SparkSession, d: str) -> DataFrame:
    from .lifecycle_queries import parses

    decisions = table(spark, d, "events").filter("event_id % 3 <> 0").select(F.col("event_id").alias("parse_id"), F.when(F.col("event_id") % 3 == 1, "accept").otherwise("discard").alias("verdict"))
    return served.decide_held(parses(spark, d), decisions)


def cohort_publication(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    wanted = o.filter("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("cohort_id"), (F.col("o_orderkey") % 10).cast("string").alias("input_hash"))
    of = lambda kind, m: o.filter(f"o_orderkey % {m} <> 0").select(F.col("o_orderkey").alias("cohort_id"), F.lit(kind).alias("kind"), (F.col("o_orderkey") % (10 if kind == "dense" else 20)).cast("string").alias("input_hash"))
    return served.publications(wanted, of("dense", 5).union(of("multivector", 7)))


def queue_claims(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.claim(_queue(spark, d), 50).select("source_key", "state", "attempts")


def _queue(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        o.cast("string").alias("source_key"), F.col("o_orderdate").alias("detected_at"), F.when(o % 3 == 0, "in_flight").when(o % 3 == 1, "pending").otherwise("failed").alias("state"), (o % 4).cast("int").alias("attempts"), F.lit(None).cast("string").alias("error"))


def queue_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Claimed entries that are done leave the queue, those that failed keep the error's first characters."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("source_key"))
    left = lifecycle.complete(_queue(spark, d), o.filter("o_orderkey % 2 = 0"))
    return lifecycle.fail(left, o.filter("o_orderkey % 5 = 0").select("source_key", F.lit("broken pipe").alias("error")), most=6).select("source_key", "state", "attempts", "error")


def valid_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the right length and norm, their codec round trip, and their norm once scaled."""
    e = table(spark, d, "embeddings")
    v = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 5)).when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: x * 0)).otherwise(F.col("embedding"))
    width = F.size(F.col("embedding"))
    got = e.withColumn("v", v.cast("array<float>")).withColumn("ok", vectors.valid_vector(F.col("v"), width))
    return got.select("vec_id", "ok", (vectors.decode(vectors.encode("v")) == F.col("v")).alias("same"), F.round(vectors.norm(vectors.unit(F.col("v"))), 4).alias("norm"))


def excerpt_maxsim(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_partkey") % 400).alias("key"), F.when(F.col("l_linenumber") == 1, "source").otherwise("entity").alias("kind"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber") * 3) % 1000 / 8.0).alias("score"))
    return served.best_excerpts(li, 50)


def merged_sections(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id")
    ranked = lambda m, n: e.select(F.col("vec_id").alias("unit_id"), (F.col("vec_id") * m % 499 + 1).alias("rank")).filter(f"unit_id < 499 and rank <= {n}")
    return dense.merge_section(ranked(7, 80), ranked(13, 60), limit=70).withColumn("score", F.round("score", 9))


def consolidated_hits(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 2000).alias("window_id")).agg(F.collect_set("l_partkey").alias("unit_ids"))
    hits = table(spark, d, "part").select(F.col("p_partkey").alias("unit_id"))
    chosen = table(spark, d, "orders").filter("o_orderkey % 2 = 0").select((F.col("o_orderkey") % 2000).alias("window_id"))
    return annotations.consolidate(hits, w, chosen).select("unit_id", "key")


def best_per_kind(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_linenumber") % 3).alias("kind"), (F.col("l_partkey") % 500).alias("key"), F.col("l_suppkey").alias("vector_id"), (F.col("l_orderkey") * 31 % 1009 / 1009.0).alias("similarity"))
    return annotations.best_per_kind(li, 40).withColumn("similarity", F.round("similarity", 9))


def semantic_entry(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("parse_id"), F.concat(F.lit("n"), (F.col("o_orderkey") % 30).cast("string")).alias("name"), "o_orderkey")
    matched = o.filter("o_orderkey % 5 = 0").select("parse_id", "name").distinct().withColumn("class", F.lit("exact"))
    return graph.add_semantic(matched, o.filter("o_orderkey % 3 = 0"))


def stored_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of each parse, ascending, each once."""
    o = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("parse_id"), F.concat(F.lit("n"), (F.col("o_orderkey") % 300).cast("string")).alias("name"))
    return o.distinct().orderBy("parse_id", "name")


def canonical_unit_ids(spark: SparkSession, d: str) -> DataFrame:
    return conformance.canonical_ids(units(spark, d)).select("unit_id", "canonical_id")


def relationship_rebuild(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select((F.col("l_orderkey") % 20).alias("parse_id"), (F.col("l_partkey") % 60).alias("from_id"), (F.col("l_suppkey") % 60).alias("to_id"), F.when(F.col("l_linenumber") == 1, "precedes").otherwise("contains").alias("type"), F.lit(None).cast("string").alias("role"))
    mapping = table(spark, d, "customer").filter("c_custkey < 60 and c_custkey % 4 = 1").select(F.col("c_custkey").alias("unit_id"), (F.col("c_custkey") - 1).alias("kept_id"))
    siblings = table(spark, d, "customer").filter("c_custkey % 4 <> 1").select((F.col("c_custkey") % 20).alias("parse_id"), (F.col("c_custkey") % 3).alias("parent_id"), F.col("c_custkey").alias("unit_id"), (F.col("c_custkey") * 7 % 101).alias("sequence_index"))
    return conformance.rebuild_relationships(li, mapping, siblings)


def relation_batches(spark: SparkSession, d: str) -> DataFrame:
    return graph.batches(units(spark, d).select("parse_id", "unit_id", F.length("text").cast("long").alias("size")), "size", 40, ["unit_id"])


def reranked(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_custkey % 10 = 0").select(F.col("o_orderkey").alias("candidate_id"), ((F.col("o_orderkey") * 37 % 1009 - 500) / 100.0).alias("ranking_text"))
    return dense.rerank(o, lambda x: F.round(vectors.sigmoid(x), 9)).select("candidate_id", "score", "rank")


def memo_recorded(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    memo = o.filter("o_orderkey % 3 = 0").groupBy((F.col("o_custkey") % 90).alias("memo_key")).agg(F.max("o_orderkey").alias("result"))
    return lifecycle.memo_record(memo, o.select((F.col("o_custkey") % 120).alias("memo_key"), F.col("o_orderkey").alias("result")))


def acquisition_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id", F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("outcome"))
    return served.log_acquisitions(e.filter("id % 2 = 0"), e.filter("id % 3 = 0").withColumn("outcome", F.lit("again")))


QUERIES = {f.__name__: f for f in (
    unit_ownership, selected_relationships, annotations_of_units, cohort_input_state, dependent_projections, counts_by_type, decomposition_rate, section_kind_coverage, parse_metrics, warning_report, current_paths,
    active_unit_read, fresh_annotations, unit_relationships_read, evidence_members, scalar_text, unresolved_operations, dense_evidence, attribution, annotation_framing, summary_materialization, markdown_view, held_decisions,
    cohort_publication, queue_claims, queue_outcomes, valid_vectors, excerpt_maxsim, merged_sections, consolidated_hits, best_per_kind, semantic_entry, stored_names, canonical_unit_ids, relationship_rebuild, relation_batches,
    reranked, memo_recorded, acquisition_log)}

_W = f"WITH u AS ({_U}), a AS ({_A})"
_OBJ = "o AS (SELECT c_custkey AS source_id, CASE WHEN c_custkey % 6 <> 0 THEN c_custkey % 4 END AS active_parse_id FROM customer)"
_COH = "c AS (SELECT o_custkey AS cohort_id, o_orderkey + CASE WHEN o_orderkey % 19 = 0 THEN 100000000 ELSE 0 END AS x FROM orders)"
_TEXTS = """CASE type WHEN 'entity' THEN 'Entity: n' || o_custkey || chr(10) || 'Type: T' WHEN 'relation' THEN 'Subject: s' || chr(10) || 'Relationship: p' || chr(10) || 'Object: o' WHEN 'summary' THEN 'Summary: ' || o_orderpriority END"""
_PARSES = """p AS (SELECT user_id AS source_id, event_id AS parse_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'ready' WHEN 'view' THEN 'building' ELSE 'active' END AS status,
  CASE WHEN event_type = 'click' AND value > 20 THEN 'regression' END AS held_reason FROM events)"""
_REL = "e AS (SELECT l_orderkey || ':' || l_linenumber AS id, l_partkey AS from_id, l_suppkey AS to_id, CASE WHEN l_linenumber < 5 THEN 'contains' ELSE 'precedes' END AS type FROM lineitem)"

ORACLES = {
    "unit_ownership": f"""{_W}, k AS (SELECT DISTINCT l_orderkey + CASE WHEN l_partkey % 17 = 0 THEN 100000000 ELSE 0 END AS unit_id, l_suppkey % 7 AS source_id FROM lineitem)
        SELECT k.unit_id, k.source_id, CASE WHEN u.unit_id IS NULL THEN 'missing' ELSE 'source' END AS conflict FROM k LEFT JOIN u ON u.unit_id = k.unit_id WHERE u.unit_id IS NULL OR u.source_id <> k.source_id""",
    "selected_relationships": """WITH s AS (SELECT DISTINCT o_custkey % 50 AS unit_id FROM orders WHERE o_orderkey % 3 = 0)
        SELECT l_orderkey, l_linenumber, l_partkey AS from_id, l_suppkey AS to_id FROM lineitem WHERE l_partkey IN (SELECT unit_id FROM s) AND l_suppkey IN (SELECT unit_id FROM s)""",
    "annotations_of_units": "SELECT o_orderkey AS annotation_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0) OR o_custkey + 1 IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 0)",
    "cohort_input_state": f"{_W}, {_COH} SELECT cohort_id, count(*) FILTER (WHERE a.annotation_id IS NULL) AS n_missing, count(*) FILTER (WHERE freshness <> 'fresh') AS n_stale FROM c LEFT JOIN a ON a.annotation_id = c.x GROUP BY 1",
    "dependent_projections": f"WITH {_COH} SELECT DISTINCT cohort_id AS projection_id FROM c WHERE x IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0)",
    "counts_by_type": f"{_W} SELECT parse_id, string_agg(type || '=' || n, ',' ORDER BY type) AS counts FROM (SELECT parse_id, type, count(*) AS n FROM u GROUP BY ALL) GROUP BY 1",
    "decomposition_rate": f"""WITH RECURSIVE u AS ({_U}), up AS (SELECT unit_id, unit_id // 30 AS anc FROM u WHERE unit_id >= 30 AND type = 'table_cell' UNION ALL SELECT unit_id, anc // 30 FROM up WHERE anc >= 30 AND anc IN (SELECT unit_id FROM u))
        SELECT parse_id, round(avg(CASE WHEN unit_id IN (SELECT anc FROM up) THEN 1 ELSE 0 END), 6) AS rate FROM u WHERE type = 'table' GROUP BY 1""",
    "section_kind_coverage": f"{_W} SELECT parse_id, round(coalesce(avg(CASE WHEN type = 'section' THEN coalesce(kind <> 'unknown', false)::int END), 1), 6) AS coverage FROM u GROUP BY 1",
    "parse_metrics": f"{_W} SELECT parse_id, count(*) AS n_units, count(*) FILTER (WHERE type = 'section') AS n_section, count(*) FILTER (WHERE type = 'table') AS n_table, count(*) FILTER (WHERE type = 'code_block') AS n_code_block FROM u GROUP BY 1",
    "warning_report": "SELECT user_id % 10 AS parse_id, event_type AS code, count(*) AS n, arg_min(event_id, (ts, event_id)) AS first_locator FROM events GROUP BY ALL",
    "current_paths": f"WITH {T.LOCATIONS} SELECT source_id % 100 AS source_id, string_agg(DISTINCT native_uri, ',' ORDER BY native_uri) AS paths FROM locations WHERE status = 'current' GROUP BY 1",
    "active_unit_read": f"{_W}, {_OBJ} SELECT a.source_id, a.parse_id, annotation_id AS unit_id FROM a JOIN o ON a.source_id = o.source_id AND a.parse_id = active_parse_id",
    "fresh_annotations": f"{_W}, {_OBJ} SELECT annotation_id, a.source_id, a.parse_id FROM a JOIN o ON a.source_id = o.source_id AND a.parse_id = active_parse_id WHERE freshness = 'fresh' AND deleted_at IS NULL",
    "unit_relationships_read": f"WITH {_REL} SELECT 'out' AS direction, * FROM e WHERE from_id = 7 UNION ALL SELECT 'in', * FROM e WHERE to_id = 7 UNION ALL SELECT 'both', * FROM e WHERE (from_id = 7 OR to_id = 7) AND type = 'contains'",
    "evidence_members": f"{_W} SELECT unit_id, type FROM u WHERE trim(text) <> '' AND NOT (type = 'text_block' AND role IS NOT NULL) AND (type <> 'table_cell' OR row_id IS NOT NULL)",
    "scalar_text": """SELECT doc_id, substring(text, 4, 7) AS slice, substring(text, 1, 12) AS cut, 'fs:' || source AS key, octet_length(encode(text))::int AS n_bytes, CASE WHEN doc_id % 5 <> 0 THEN source END AS uri,
        CASE WHEN doc_id % 2 = 0 THEN 'text/plain' ELSE 'application/epub+zip' END AS mime FROM documents""",
    "unresolved_operations": "SELECT event_id AS operation_id, 'rebuild' AS kind, 'running' AS state FROM events WHERE user_id % 2 = 0 AND event_type = 'click'",
    "dense_evidence": """SELECT unit_id, string_agg(kind || ':' || m, ',' ORDER BY kind, m) AS matches FROM (SELECT DISTINCT l_partkey % 300 AS unit_id, CASE WHEN l_linenumber % 2 = 0 THEN 'passage' ELSE 'section' END AS kind, l_suppkey % 20 AS m FROM lineitem) GROUP BY 1""",
    "attribution": """SELECT target, string_agg(a::varchar, ',' ORDER BY a) AS annotation_ids FROM (SELECT DISTINCT l_partkey % 100 AS target, l_orderkey % 40 AS a FROM lineitem
        WHERE (l_linenumber % 4, l_suppkey % 30) IN (SELECT (o_orderkey % 3, o_custkey % 9) FROM orders)) GROUP BY 1""",
    "annotation_framing": f"{_W} SELECT annotation_id, type, {_TEXTS} AS text FROM a WHERE NOT marker AND type <> 'topic'",
    "summary_materialization": f"{_W} SELECT source_id AS parse_id, coalesce(string_agg(o_orderpriority, chr(10) || chr(10) ORDER BY annotation_id) FILTER (WHERE NOT marker), '') AS summary, count(*) FILTER (WHERE marker) AS n_empty FROM a WHERE type = 'summary' GROUP BY 1",
    "markdown_view": f"""{_W}, l AS (SELECT parse_id, sequence_index, unit_id, CASE type WHEN 'section' THEN repeat('#', greatest(1, least(6, level))::int) || ' ' || text WHEN 'caption' THEN '*' || text || '*'
          WHEN 'code_block' THEN '```' || chr(10) || text || chr(10) || '```' WHEN 'table' THEN NULL ELSE text END AS line FROM u WHERE trim(text) <> '')
        SELECT parse_id, count(*)::int AS n_units, md5(string_agg(line, chr(10) || chr(10) ORDER BY sequence_index NULLS LAST, unit_id)) AS markdown_md5 FROM l WHERE line IS NOT NULL GROUP BY 1""",
    "held_decisions": f"""WITH {_PARSES}, m AS (SELECT *, CASE WHEN status = 'ready' AND held_reason IS NOT NULL THEN CASE parse_id % 3 WHEN 1 THEN 'accept' WHEN 2 THEN 'discard' END END AS v FROM p),
        n AS (SELECT source_id, max(parse_id) AS new FROM m WHERE v = 'accept' GROUP BY 1)
        SELECT m.source_id, parse_id, CASE WHEN parse_id = new THEN 'active' WHEN status = 'active' AND new IS NOT NULL THEN 'superseded' WHEN v = 'discard' THEN 'discarded' ELSE status END AS status,
          CASE WHEN parse_id = new OR v = 'discard' THEN NULL ELSE held_reason END AS held_reason FROM m LEFT JOIN n USING (source_id)""",
    "cohort_publication": """SELECT o_orderkey AS cohort_id, CASE WHEN o_orderkey % 4 = 0 THEN 'retired' WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 20 = o_orderkey % 10 THEN 'published' ELSE 'building' END AS state
        FROM orders WHERE o_orderkey % 4 <> 0 OR o_orderkey % 5 <> 0 OR o_orderkey % 7 <> 0""",
    "queue_claims": "SELECT o_orderkey::varchar AS source_key, 'in_flight' AS state, (o_orderkey % 4 + 1)::int AS attempts FROM orders WHERE o_orderkey % 3 <> 2 ORDER BY o_orderdate, source_key LIMIT 50",
    "queue_outcomes": """SELECT o_orderkey::varchar AS source_key, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 3 = 0 THEN 'in_flight' WHEN o_orderkey % 3 = 1 THEN 'pending' ELSE 'failed' END AS state,
        (o_orderkey % 4)::int AS attempts, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 = 0 THEN 'broken' END AS error FROM orders WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 2 = 0)""",
    "valid_vectors": "SELECT vec_id, vec_id % 7 <> 0 AND vec_id % 11 <> 0 AS ok, true AS same, CASE WHEN vec_id % 7 <> 0 AND vec_id % 11 = 0 THEN 0.0 ELSE 1.0 END::double AS norm FROM embeddings",
    "excerpt_maxsim": """WITH s AS (SELECT l_partkey % 400 AS key, l_linenumber = 1 AS src, ((l_suppkey * 7 + l_linenumber * 3) % 1000 / 8.0)::double AS score FROM lineitem), g AS (SELECT key, max(score) AS score, max(score) FILTER (WHERE src) AS source_score FROM s GROUP BY 1)
        SELECT *, row_number() OVER (ORDER BY score DESC, source_score DESC NULLS LAST, key) AS rank FROM g QUALIFY rank <= 50""",
    "merged_sections": """WITH l AS (SELECT vec_id AS unit_id, vec_id * 7 % 499 + 1 AS r, 0 AS o FROM embeddings WHERE vec_id < 499 AND vec_id * 7 % 499 + 1 <= 80 UNION ALL SELECT vec_id, vec_id * 13 % 499 + 1, 1 FROM embeddings WHERE vec_id < 499 AND vec_id * 13 % 499 + 1 <= 60),
        f AS (SELECT unit_id, list_sum(list(1.0::double / (60 + r) ORDER BY o)) AS score FROM l GROUP BY 1) SELECT unit_id, round(score, 9) AS score, row_number() OVER (ORDER BY score DESC, unit_id) AS rank FROM f QUALIFY rank <= 70""",
    "consolidated_hits": """WITH w AS (SELECT l_partkey AS unit_id, min(l_orderkey % 2000) AS a, max(l_orderkey % 2000) AS b FROM lineitem GROUP BY 1)
        SELECT p_partkey AS unit_id, CASE WHEN a = b AND a IN (SELECT o_orderkey % 2000 FROM orders WHERE o_orderkey % 2 = 0) THEN 'w' || a ELSE 'u' || p_partkey END AS key FROM part LEFT JOIN w ON unit_id = p_partkey""",
    "best_per_kind": """WITH s AS (SELECT l_linenumber % 3 AS kind, l_partkey % 500 AS key, l_suppkey AS v, (l_orderkey * 31 % 1009 / 1009.0)::double AS sim FROM lineitem),
        b AS (SELECT kind, key, sim, v FROM s QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY sim DESC, v) = 1)
        SELECT kind, key, round(sim, 9) AS similarity, v AS vector_id, row_number() OVER (PARTITION BY kind ORDER BY sim DESC, key) AS rank FROM b QUALIFY rank <= 40""",
    "semantic_entry": """WITH n AS (SELECT o_custkey % 20 AS parse_id, 'n' || (o_orderkey % 30) AS name, o_orderkey FROM orders), m AS (SELECT DISTINCT parse_id, name FROM n WHERE o_orderkey % 5 = 0)
        SELECT parse_id, name, 'exact' AS class FROM m UNION ALL SELECT *, 'semantic' FROM (SELECT parse_id, name FROM n WHERE o_orderkey % 3 = 0 EXCEPT SELECT * FROM m)""",
    "stored_names": "SELECT DISTINCT o_custkey % 20 AS parse_id, 'n' || (o_orderkey % 300) AS name FROM orders",
    "canonical_unit_ids": f"{_W} SELECT unit_id, parse_id || ':unit:' || lpad((row_number() OVER (PARTITION BY parse_id ORDER BY sequence_index NULLS LAST, unit_id) - 1)::varchar, 8, '0') AS canonical_id FROM u",
    "relationship_rebuild": """WITH l AS (SELECT l_orderkey % 20 AS parse_id, l_partkey % 60 AS f, l_suppkey % 60 AS t FROM lineitem WHERE l_linenumber <> 1), c AS (SELECT c_custkey FROM customer WHERE c_custkey < 60 AND c_custkey % 4 = 1),
        k AS (SELECT parse_id, CASE WHEN f IN (SELECT * FROM c) THEN f - 1 ELSE f END AS from_id, CASE WHEN t IN (SELECT * FROM c) THEN t - 1 ELSE t END AS to_id FROM l)
        SELECT DISTINCT parse_id, from_id, to_id, 'contains' AS type, NULL::varchar AS role FROM k WHERE from_id <> to_id UNION ALL
        SELECT * FROM (SELECT c_custkey % 20 AS parse_id, c_custkey AS from_id, lead(c_custkey) OVER (PARTITION BY c_custkey % 20, c_custkey % 3 ORDER BY c_custkey * 7 % 101, c_custkey) AS to_id, 'precedes' AS type, NULL::varchar FROM customer WHERE c_custkey % 4 <> 1) WHERE to_id IS NOT NULL""",
    "relation_batches": f"{_W} SELECT parse_id, unit_id, length(text) AS size, (coalesce(sum(length(text)) OVER (PARTITION BY parse_id ORDER BY unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 40)::int AS batch FROM u",
    "reranked": """WITH s AS (SELECT o_orderkey AS candidate_id, round(1 / (1 + exp(-((o_orderkey * 37 % 1009 - 500) / 100.0)::double)), 9) AS score FROM orders WHERE o_custkey % 10 = 0) SELECT *, row_number() OVER (ORDER BY score DESC, candidate_id) AS rank FROM s""",
    "memo_recorded": """WITH m AS (SELECT o_custkey % 90 AS memo_key, max(o_orderkey) AS result FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
        SELECT * FROM m UNION ALL SELECT o_custkey % 120, min(o_orderkey) FROM orders WHERE o_custkey % 120 NOT IN (SELECT memo_key FROM m) GROUP BY 1""",
    "acquisition_log": "SELECT event_id AS id, user_id, CASE WHEN event_id % 2 <> 0 THEN 'again' WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS outcome FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0",
}
