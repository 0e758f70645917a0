"""Queries over the lifecycle operators. Parses, queue entries and annotations are derived from events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import conformance, lifecycle, scope
from . import tables as T
from .tables import table

_PARSES = """parses AS (SELECT user_id AS source_id, event_id AS parse_id, ts AS started_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'ready' WHEN 'view' THEN 'building' ELSE 'active' END AS status,
  CASE WHEN event_type = 'click' AND value > 20 THEN 'regression' END AS held_reason FROM events)"""


def parses(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("user_id").alias("source_id"), F.col("event_id").alias("parse_id"), F.col("ts").alias("started_at"),
        F.when(e == "error", "failed").when(e == "click", "ready").when(e == "view", "building").otherwise("active").alias("status"),
        F.when((e == "click") & (F.col("value") > 20), "regression").alias("held_reason"))


def content_dedup(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.dedup(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


def latest_acquisition(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        F.lit("fs").alias("source_system"), F.col("user_id").cast("string").alias("native_uri"), F.col("ts").alias("acquired_at"), F.col("event_id").alias("id"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("outcome"))
    return lifecycle.latest_acquisition(e).select("native_uri", "id", "acquired_at")


def prescreen(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    listing = docs.select(F.col("doc_id").alias("native_uri"), F.col("n_chars").alias("mtime"), F.length("text").cast("long").alias("size"))
    known = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").alias("native_uri"), (F.col("n_chars") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("mtime"), F.length("text").cast("long").alias("size"))
    return lifecycle.prescreen(listing, known)


def upsert_locations(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    stored = o.filter("o_orderkey % 3 <> 0").select(F.lit("fs").alias("source_system"), F.col("o_orderkey").alias("native_uri"), F.col("o_custkey").alias("source_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "deleted").otherwise("current").alias("status"), F.col("o_orderdate").alias("first_seen_at"), F.col("o_orderdate").alias("last_seen_at"))
    seen = o.filter("o_orderkey % 2 = 0").select(F.lit("fs").alias("source_system"), F.col("o_orderkey").alias("native_uri"),
        (F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)).alias("source_id"), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz").alias("seen_at"))
    return lifecycle.upsert_locations(stored, seen)


def deactivation_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.deactivation_candidates(T.sources(spark, d), T.locations(spark, d), "src5").select("source_id")


def reactivation_candidates(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.reactivation_candidates(T.sources(spark, d), T.locations(spark, d)).select("source_id")


def enumeration_deletions(spark: SparkSession, d: str) -> DataFrame:
    loc = T.locations(spark, d)
    return lifecycle.inferred_deletions(loc, loc.filter("source_id % 3 <> 0"), "src1/").select("source_id", "native_uri")


def coalescing_queue(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("source_key"), F.col("ts").alias("detected_at"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("operation_id"))
    return lifecycle.coalesced(e)


def queue_depths(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "click", "in_flight").otherwise("pending").alias("state"), (F.col("event_id") % 4).alias("coalesced_count"))
    return lifecycle.queue_depths(e)


def fabric_counts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("status")
    return lifecycle.counts(parses(spark, d), held=(s == "ready") & F.col("held_reason").isNotNull(), building=s == "building", failed=s == "failed", active=s == "active")


def annotation_progress(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("doc"), F.col("event_type").alias("type")).agg(F.count_if(F.col("value") > 10).alias("completed"), F.count("*").alias("total"))


def failed_latest_uncleared(spark: SparkSession, d: str) -> DataFrame:
    cleared = table(spark, d, "events").filter("event_type = 'error' and event_id % 4 = 0").select(F.lit("failure_cleared").alias("event_type"), F.col("event_id").alias("subject_id"))
    return lifecycle.failed_latest(parses(spark, d), cleared).select("source_id", "parse_id")


def source_observations(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.source_observations(T.sources(spark, d), parses(spark, d), T.locations(spark, d))


def retry_locations(spark: SparkSession, d: str) -> DataFrame:
    loc = T.locations(spark, d)
    return lifecycle.retry_locations(loc.filter("source_id % 13 = 0").select("native_uri"), loc)


def held_parses(spark: SparkSession, d: str) -> DataFrame:
    return scope.held_parses(parses(spark, d)).select("source_id", "parse_id", "held_reason")


def retry_guard(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.retry_guard(parses(spark, d))


def snapshot_compare(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 101 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    return lifecycle.compare(o.filter("o_orderkey % 97 <> 0"), o.filter("o_orderkey % 89 <> 0").withColumn("o_totalprice", price), ["o_orderkey"])


def freshness_steps(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    h = table(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.when(e == "error", "failed").when(e == "click", "fresh").when(e == "view", "stale").when(e == "signup", "building").otherwise("superseded").alias("state"))
    return lifecycle.illegal_steps(h)


def required_projections_fresh(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("parse_id"), F.col("event_type").alias("projection_type"), F.when(F.col("value") > 30, "fresh").otherwise("stale").alias("freshness"))
    return scope.missing_projections(e, ["click", "view", "signup", "purchase", "error", "chunk"]).select("parse_id", F.array_join("missing", ",").alias("missing"))


def work_discovery(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    need = docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_key"))
    return lifecycle.undone_work(need, need.filter("doc_id % 3 = 0"))


def memo_lookup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("memo_key"))
    memo = docs.groupBy("memo_key").agg(F.min("doc_id").alias("result")).filter("result % 2 = 0")
    return lifecycle.memo_lookup(docs, memo).select("doc_id", "result", "memoized")


def policy_versions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("policy_id"), F.col("ts").alias("loaded_at"), F.col("event_id").alias("load_id"), F.expr("user_id div 20").alias("hash"))
    return lifecycle.policy_versions(e).select("policy_id", "load_id", "version")


def retry_ladder(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures")).select("user_id", "failures", lifecycle.retry_delay(F.col("failures"), 500, 60_000).alias("delay_ms"))


def adaptive_cadence(spark: SparkSession, d: str) -> DataFrame:
    """Cycles of 20 events of a user each."""
    e = table(spark, d, "events").select(
        F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("value") * 100).cast("long").alias("scan_ms"), (F.col("event_id") % 3).alias("changes"), F.lit(60_000).alias("spacing_ms"), F.when(F.col("event_id") % 5 == 0, 2).otherwise(0).alias("backlog"))
    return lifecycle.cadence(e)


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Orders as parses by customer, lines as units: sections, blocks, captions, tables and cells by line number."""
    k = F.col("l_linenumber") % 5
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 50).alias("parse_id"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("unit_id"),
        F.when(k == 1, "section").when(k == 2, "text_block").when(k == 3, "caption").when(k == 4, "table").otherwise("table_cell").alias("type"),
        F.when(F.col("l_quantity") > 10, 1).otherwise(0).alias("n_locators"))


_UNITS = """units AS (SELECT l_orderkey % 50 AS parse_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS unit_id,
  CASE l_linenumber % 5 WHEN 1 THEN 'section' WHEN 2 THEN 'text_block' WHEN 3 THEN 'caption' WHEN 4 THEN 'table' ELSE 'table_cell' END AS type,
  CASE WHEN l_quantity > 10 THEN 1 ELSE 0 END AS n_locators FROM lineitem)"""


def conformance_report(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    edges = units.filter("type = 'caption'").select("parse_id", F.col("unit_id").alias("from_id"), F.col("unit_id").alias("to_id"), F.when(F.length("unit_id") % 2 == 0, "caption_of").otherwise("contains").alias("type"))
    return conformance.report(units, edges)


def dominance_gate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    dims = lambda cond: o.filter(cond).groupBy((F.col("o_custkey") % 60).alias("source_id"), F.col("o_orderpriority").alias("dimension")).agg((F.round(F.avg("o_totalprice") / 1000)).alias("value"))
    return lifecycle.dominance(dims("o_orderkey % 2 = 0 and o_custkey % 7 <> 0"), dims("o_orderkey % 2 = 1")).select("source_id", "verdict", F.array_join("worse", ",").alias("worse"))


def hard_gate_violations(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    units = li.select((F.col("l_orderkey") % 50).alias("parse_id"), F.col("l_linenumber").cast("long").alias("sequence_index"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("unit_id"),
        F.when(F.col("l_returnflag") == "A", "text_block").when(F.col("l_returnflag") == "N", "caption").otherwise("weird").alias("type"),
        F.when(F.col("l_linenumber") > 1, F.concat_ws("-", "l_orderkey", F.col("l_linenumber") - 1)).alias("parent_id"))
    return conformance.gate_violations(units, ["text_block", "caption"])


def timestamp_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.time import format_ms, parse_ms

    e = table(spark, d, "events").select("event_id", format_ms(F.col("ts")).alias("text"))
    return e.select("event_id", "text", (format_ms(parse_ms(F.col("text"))) == F.col("text")).alias("same"), parse_ms(F.concat("text", F.lit("x"))).isNull().alias("strict"))


QUERIES = {f.__name__: f for f in (
    content_dedup, latest_acquisition, prescreen, upsert_locations, deactivation_candidates, reactivation_candidates, enumeration_deletions, coalescing_queue, queue_depths,
    fabric_counts, annotation_progress, failed_latest_uncleared, source_observations, retry_locations, held_parses, retry_guard, snapshot_compare, freshness_steps,
    required_projections_fresh, work_discovery, memo_lookup, policy_versions, retry_ladder, adaptive_cadence, conformance_report, dominance_gate, hard_gate_violations, timestamp_roundtrip)}

ORACLES = {
    "content_dedup": "SELECT sha256(text) AS source_hash, min(doc_id) AS id, count(*) AS n_copies FROM documents GROUP BY 1",
    "latest_acquisition": "SELECT user_id::varchar AS native_uri, event_id AS id, ts AS acquired_at FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "prescreen": "SELECT doc_id AS native_uri, n_chars AS mtime, length(text) AS size FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0",
    "upsert_locations": """WITH s AS (SELECT o_orderkey AS k, o_custkey AS id, o_orderdate AS at, CASE WHEN o_orderkey % 4 = 0 THEN 'deleted' ELSE 'current' END AS status FROM orders WHERE o_orderkey % 3 <> 0),
        n AS (SELECT o_orderkey AS k, o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS id FROM orders WHERE o_orderkey % 2 = 0)
        SELECT 'fs' AS source_system, k AS native_uri, coalesce(n.id, s.id) AS source_id, CASE WHEN n.id IS NOT NULL THEN 'current' ELSE s.status END AS status,
          CASE WHEN n.id <> s.id OR s.id IS NULL THEN timestamp '2024-06-01' ELSE s.at END AS first_seen_at, CASE WHEN n.id IS NOT NULL THEN timestamp '2024-06-01' ELSE s.at END AS last_seen_at,
          CASE WHEN n.id IS NULL THEN 'kept' WHEN s.id IS NULL THEN 'inserted' WHEN n.id <> s.id THEN 'rebound' ELSE 'refreshed' END AS action FROM s FULL JOIN n USING (k)""",
    "deactivation_candidates": f"WITH {T.SOURCES}, {T.LOCATIONS} SELECT source_id FROM sources s WHERE active_parse_id IS NOT NULL AND deactivated_at IS NULL AND EXISTS (SELECT 1 FROM locations l WHERE l.source_id = s.source_id AND governance_domain = 'src5') AND NOT EXISTS (SELECT 1 FROM locations l WHERE l.source_id = s.source_id AND status = 'current')",
    "reactivation_candidates": f"WITH {T.SOURCES}, {T.LOCATIONS} SELECT source_id FROM sources s WHERE deactivated_at IS NOT NULL AND EXISTS (SELECT 1 FROM locations l WHERE l.source_id = s.source_id AND status = 'current')",
    "enumeration_deletions": f"WITH {T.LOCATIONS} SELECT source_id, native_uri FROM locations WHERE status = 'current' AND native_uri LIKE 'src1/%' AND source_id % 3 = 0",
    "coalescing_queue": """SELECT user_id || ':' || event_type AS source_key, min(ts) AS first_detected_at, max(ts) AS detected_at, count(*) - 1 AS coalesced_count,
        arg_max(event_id, (ts, event_id)) FILTER (WHERE event_id % 3 = 0) AS operation_id, 'pending' AS state FROM events GROUP BY 1""",
    "queue_depths": "SELECT CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'in_flight' ELSE 'pending' END AS state, count(*) AS n, sum(event_id % 4)::bigint AS coalesced FROM events GROUP BY 1",
    "fabric_counts": f"WITH {_PARSES} SELECT count(*) FILTER (WHERE status = 'ready' AND held_reason IS NOT NULL) AS held, count(*) FILTER (WHERE status = 'building') AS building, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'active') AS active FROM parses",
    "annotation_progress": "SELECT user_id AS doc, event_type AS type, count(*) FILTER (WHERE value > 10) AS completed, count(*) AS total FROM events GROUP BY ALL",
    "failed_latest_uncleared": f"WITH {_PARSES} SELECT source_id, parse_id FROM (SELECT * FROM parses QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, parse_id DESC) = 1) WHERE status = 'failed' AND parse_id % 4 <> 0",
    "source_observations": f"""WITH {_PARSES}, {T.SOURCES}, {T.LOCATIONS}, p AS (SELECT source_id, status FROM parses QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY started_at DESC, parse_id DESC) = 1)
        SELECT s.source_id, p.status AS latest_status, coalesce(l.c, false) AS has_current, l.u AS first_uri FROM sources s LEFT JOIN p USING (source_id)
        LEFT JOIN (SELECT source_id, bool_or(status = 'current') AS c, min(native_uri) AS u FROM locations GROUP BY 1) l USING (source_id)""",
    "retry_locations": f"WITH {T.LOCATIONS} SELECT native_uri FROM locations WHERE source_id % 13 = 0 UNION SELECT native_uri FROM locations WHERE status = 'access_lost'",
    "held_parses": f"WITH {_PARSES} SELECT source_id, parse_id, held_reason FROM parses WHERE status = 'ready' AND held_reason IS NOT NULL",
    "retry_guard": f"""WITH {_PARSES} SELECT source_id, CASE min(CASE WHEN status = 'ready' AND held_reason IS NULL THEN 1 WHEN status IN ('failed', 'active') OR held_reason IS NOT NULL THEN 2 WHEN status = 'building' THEN 3 END)
        WHEN 1 THEN 'gate' WHEN 2 THEN 'settled' WHEN 3 THEN 'building' ELSE 'free' END AS guard FROM parses GROUP BY 1""",
    "snapshot_compare": """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'missing' WHEN o_orderkey % 89 = 0 THEN 'extra' ELSE 'different' END AS state FROM orders
        WHERE (o_orderkey % 97 = 0) <> (o_orderkey % 89 = 0) OR (o_orderkey % 101 = 0 AND o_orderkey % 97 <> 0 AND o_orderkey % 89 <> 0)""",
    "freshness_steps": """WITH h AS (SELECT user_id AS id, event_id AS seq, CASE event_type WHEN 'error' THEN 'failed' WHEN 'click' THEN 'fresh' WHEN 'view' THEN 'stale' WHEN 'signup' THEN 'building' ELSE 'superseded' END AS state FROM events),
        s AS (SELECT *, lag(state) OVER (PARTITION BY id ORDER BY seq) AS before FROM h)
        SELECT id, seq, before, state FROM s WHERE NOT coalesce((before IS NULL AND state = 'building') OR (before = 'building' AND state IN ('fresh', 'failed')) OR (before = 'fresh' AND state IN ('stale', 'superseded'))
          OR (before = 'stale' AND state IN ('building', 'superseded')) OR (before = 'failed' AND state = 'building'), false)""",
    "required_projections_fresh": """SELECT parse_id, coalesce(string_agg(t, ',' ORDER BY t) FILTER (WHERE NOT f), '') AS missing FROM (
        SELECT u.user_id AS parse_id, t, coalesce(bool_or(e.value > 30), false) AS f FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('click'), ('view'), ('signup'), ('purchase'), ('error'), ('chunk')) x(t)
        LEFT JOIN events e ON e.user_id = u.user_id AND e.event_type = t GROUP BY ALL) GROUP BY 1""",
    "work_discovery": "SELECT doc_id, sha256(text) AS content_key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0)",
    "memo_lookup": "WITH m AS (SELECT sha256(text) AS k, min(doc_id) AS r FROM documents GROUP BY 1 HAVING r % 2 = 0) SELECT doc_id, r AS result, r IS NOT NULL AS memoized FROM documents LEFT JOIN m ON sha256(text) = k",
    "policy_versions": """SELECT policy_id, load_id, sum(s) OVER (PARTITION BY policy_id ORDER BY ts, load_id)::bigint AS version FROM (
        SELECT event_type AS policy_id, event_id AS load_id, ts, CASE WHEN lag(user_id // 20) OVER (PARTITION BY event_type ORDER BY ts, event_id) IS NOT DISTINCT FROM user_id // 20 THEN 0 ELSE 1 END AS s FROM events)""",
    "retry_ladder": "SELECT user_id, f AS failures, CASE WHEN f > 0 THEN least(60000.0::double, 500 * pow(2.0::double, f - 1)) ELSE 0 END::bigint AS delay_ms FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS f FROM events GROUP BY 1)",
    "conformance_report": f"""WITH {_UNITS}, e AS (SELECT parse_id, unit_id, length(unit_id) % 2 = 0 AS c FROM units WHERE type = 'caption')
        SELECT u.parse_id, count(*) AS n_units, count(*) FILTER (WHERE type = 'section') AS n_sections, round(avg((n_locators > 0)::int), 6) AS locator_coverage,
          round(avg(CASE WHEN u.unit_id IN (SELECT unit_id FROM e) THEN 1 ELSE 0 END), 6) AS relationship_coverage,
          round(avg(CASE WHEN u.unit_id IN (SELECT unit_id FROM e WHERE c) THEN 1 ELSE 0 END) FILTER (WHERE type = 'caption'), 6) AS caption_pairing FROM units u GROUP BY 1""",
    "dominance_gate": """WITH v AS (SELECT o_custkey % 60 AS source_id, o_custkey, o_orderkey, o_orderpriority AS dim, o_totalprice AS p FROM orders),
        a AS (SELECT source_id, dim, round(avg(p) / 1000) AS v FROM v WHERE o_orderkey % 2 = 0 AND o_custkey % 7 <> 0 GROUP BY ALL), c AS (SELECT source_id, dim, round(avg(p) / 1000) AS v FROM v WHERE o_orderkey % 2 = 1 GROUP BY ALL),
        w AS (SELECT source_id, string_agg(dim, ',' ORDER BY dim) AS worse FROM a LEFT JOIN c USING (source_id, dim) WHERE c.v IS NULL OR c.v < a.v GROUP BY 1)
        SELECT source_id, CASE WHEN worse IS NULL THEN 'activate' ELSE 'hold' END AS verdict, coalesce(worse, '') AS worse FROM (SELECT DISTINCT source_id FROM c) LEFT JOIN w USING (source_id)""",
    "hard_gate_violations": """WITH u AS (SELECT l_orderkey % 50 AS parse_id, l_linenumber::bigint AS s, l_orderkey || '-' || l_linenumber AS unit_id, CASE l_returnflag WHEN 'A' THEN 'text_block' WHEN 'N' THEN 'caption' ELSE 'weird' END AS type,
        CASE WHEN l_linenumber > 1 THEN l_orderkey || '-' || (l_linenumber - 1) END AS parent_id FROM lineitem)
        SELECT parse_id, 'duplicate_unit' AS gate, count(*) AS n FROM (SELECT parse_id, unit_id FROM u GROUP BY ALL HAVING count(*) > 1) GROUP BY 1
        UNION ALL SELECT parse_id, 'unknown_type', count(*) FROM u WHERE type = 'weird' GROUP BY 1
        UNION ALL SELECT parse_id, 'missing_parent', count(*) FROM u WHERE parent_id IS NOT NULL AND (parse_id, parent_id) NOT IN (SELECT (parse_id, unit_id) FROM u) GROUP BY 1
        UNION ALL SELECT parse_id, 'sequence', count(*) FROM (SELECT parse_id, s, row_number() OVER (PARTITION BY parse_id ORDER BY s NULLS LAST, unit_id) - 1 AS r FROM u) WHERE s IS DISTINCT FROM r GROUP BY 1""",
    "timestamp_roundtrip": "SELECT event_id, strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS text, true AS same, true AS strict FROM events",
}
