"""Queries over the entity graph. Annotations come from suppliers, nations and regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from .tables import table

QUERY = "is  Nation_3 near NATION_7 or europe"


def entity_annotations(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's nation and region, named in changing forms; a parse is s_suppkey mod 5, a unit s_suppkey div 2."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    key = F.col("s_suppkey")
    form = lambda c: F.when(key % 3 == 0, F.lower(c)).when(key % 3 == 1, F.concat(F.lit("  "), F.col(c), F.lit("\t"))).otherwise(F.col(c))
    kind = lambda a, b: F.when(key % 4 == 0, F.lit(a)).otherwise(F.lit(b))
    rows = F.array(
        F.struct((key * 2).alias("annotation_id"), form("n_name").alias("name"), kind("Country", "nation").alias("entity_type")),
        F.struct((key * 2 + 1).alias("annotation_id"), form("r_name").alias("name"), kind("Area", "region").alias("entity_type")))
    return j.select((key % 5).alias("parse_id"), key.alias("source_id"), F.array(F.expr("s_suppkey div 2")).alias("unit_ids"), F.explode(rows).alias("r")).select(
        "parse_id", "source_id", "unit_ids", "r.*")


_ANN = """ann AS (SELECT s_suppkey % 5 AS parse_id, s_suppkey AS source_id, s_suppkey // 2 AS unit_id, s_suppkey * 2 + k AS annotation_id,
  CASE s_suppkey % 3 WHEN 0 THEN lower(nm) WHEN 1 THEN '  ' || nm || chr(9) ELSE nm END AS raw,
  CASE WHEN s_suppkey % 4 = 0 THEN CASE k WHEN 0 THEN 'Country' ELSE 'Area' END ELSE CASE k WHEN 0 THEN 'nation' ELSE 'region' END END AS entity_type
  FROM (SELECT s_suppkey, 0 AS k, n_name AS nm FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT s_suppkey, 1, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)),
 named AS (SELECT *, lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'))) AS name FROM ann),
 nodes AS (SELECT parse_id, name, arg_min(lower(entity_type), annotation_id) AS entity_type, count(DISTINCT lower(entity_type)) AS n_types, list_sort(list(DISTINCT unit_id)) AS unit_ids FROM named GROUP BY ALL),
 links AS (SELECT s_suppkey % 5 AS parse_id, s_suppkey AS annotation_id, lower(n_name) AS from_name, 'lies in' AS predicate, lower(r_name) AS to_name, 100000 + s_suppkey AS unit_id
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def relation_annotations(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    j = s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    key = F.col("s_suppkey")
    return j.select((key % 5).alias("parse_id"), key.alias("annotation_id"), key.alias("source_id"), F.col("n_name").alias("subject"),
                    F.when(key % 2 == 0, " Lies   in ").otherwise("lies in").alias("predicate"), F.col("r_name").alias("object"), F.array(key + 100000).alias("unit_ids"), F.lit("rel").alias("entity_type"))


def entity_mentions(spark: SparkSession, d: str) -> DataFrame:
    return graph.mentions(entity_annotations(spark, d)).select("parse_id", "name", "entity_type", "n_types", "unit_ids")


def relation_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges(relation_annotations(spark, d)).select("parse_id", "annotation_id", "from_name", "predicate", "to_name", F.col("unit_ids")[0].alias("unit_id"))


def _vocabulary(rows: DataFrame) -> DataFrame:
    return rows.select("name", "uses", F.size("forms").alias("n_forms"), "n_sources", F.array_join("types", "|").alias("types"))


def entity_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(graph.vocabulary(entity_annotations(spark, d), "name"))


def relation_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return _vocabulary(graph.vocabulary(relation_annotations(spark, d), "predicate"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.mentions(entity_annotations(spark, d)), graph.edges(relation_annotations(spark, d))


def graph_exact_match(spark: SparkSession, d: str) -> DataFrame:
    return graph.match_names(_graph(spark, d)[0], QUERY)


def graph_one_hop(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = _graph(spark, d)
    return graph.reach(graph.match_names(nodes, QUERY), nodes, links).select("parse_id", "unit_id", "name", "class", "direct").distinct()


def graph_tiers(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = _graph(spark, d)
    return graph.channel(graph.reach(graph.match_names(nodes, QUERY), nodes, links), 200)


def _names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select((F.col("p_partkey") % 3).alias("parse_id"), F.lower("p_name").alias("name")).distinct()


def graph_acronym(spark: SparkSession, d: str) -> DataFrame:
    return graph.match_names(_names(spark, d), "the hg or rb", acronyms=True)


def graph_token_prefix(spark: SparkSession, d: str) -> DataFrame:
    return graph.match_names(_names(spark, d), "hot gea red", acronyms=True, prefixes=True, most=10)


def section_ancestry(spark: SparkSession, d: str) -> DataFrame:
    """A tree over parts: the parent of k is k div 3."""
    parts = table(spark, d, "part").filter("p_partkey > 0").select(F.col("p_partkey").alias("unit_id"), F.expr("p_partkey div 3").alias("parent_id"))
    return graph.ancestry(parts.filter("parent_id > 0"))


_MATCH = "m AS (SELECT parse_id, name, 'exact' AS class FROM nodes WHERE name IN ('nation_3', 'nation_7', 'europe'))"
_REACH = f"""{_MATCH},
 direct AS (SELECT m.parse_id, unnest(unit_ids) AS unit_id, name, class, true AS direct FROM m JOIN nodes USING (parse_id, name)),
 both_ways AS (SELECT parse_id, from_name AS name, to_name AS far, unit_id FROM links UNION ALL SELECT parse_id, to_name, from_name, unit_id FROM links),
 hop AS (SELECT m.parse_id, m.name, class, far, unit_id FROM m JOIN both_ways USING (parse_id, name)),
 reach AS (SELECT * FROM direct UNION ALL SELECT parse_id, unit_id, name, class, false FROM hop
  UNION ALL SELECT parse_id, unnest(unit_ids), hop_name, class, false FROM (SELECT DISTINCT parse_id, far AS name, name AS hop_name, class FROM hop) JOIN nodes USING (parse_id, name))"""

_PARTS = "nm AS (SELECT DISTINCT p_partkey % 3 AS parse_id, lower(p_name) AS name FROM part)"
_FUZZY = """, x AS (SELECT *, row_number() OVER (PARTITION BY parse_id ORDER BY class, length(name) DESC, name) AS r FROM f WHERE class IS NOT NULL QUALIFY r <= {})
 SELECT parse_id, name, class FROM x UNION ALL SELECT parse_id, name, 'exact' FROM nm WHERE name IN ({})"""

QUERIES = {f.__name__: f for f in (
    entity_mentions, relation_edges, entity_vocabulary, relation_vocabulary, graph_exact_match, graph_one_hop, graph_tiers, graph_acronym, graph_token_prefix, section_ancestry)}

ORACLES = {
    "entity_mentions": f"WITH {_ANN} SELECT * FROM nodes",
    "relation_edges": f"WITH {_ANN} SELECT * FROM links",
    "entity_vocabulary": f"WITH {_ANN} SELECT name, count(*) AS uses, count(DISTINCT raw)::int AS n_forms, count(DISTINCT source_id) AS n_sources, string_agg(DISTINCT entity_type, '|' ORDER BY entity_type) AS types FROM named GROUP BY name",
    "relation_vocabulary": "SELECT 'lies in' AS name, count(*) AS uses, count(DISTINCT s_suppkey % 2)::int AS n_forms, count(DISTINCT s_suppkey) AS n_sources, 'rel' AS types FROM supplier",
    "graph_exact_match": f"WITH {_ANN}, {_MATCH} SELECT * FROM m",
    "graph_one_hop": f"WITH {_ANN}, {_REACH} SELECT DISTINCT * FROM reach",
    "graph_tiers": f"""WITH {_ANN}, {_REACH},
        u AS (SELECT parse_id, unit_id, count(DISTINCT CASE WHEN direct THEN name END) AS nd, min((-length(name), name)) AS b FROM reach GROUP BY ALL),
        t AS (SELECT parse_id, unit_id, CASE WHEN nd > 1 THEN 1 WHEN nd = 1 THEN 2 ELSE 3 END AS tier, b FROM u)
        SELECT parse_id, unit_id, tier, b[2] AS name, row_number() OVER (ORDER BY tier, b, unit_id, parse_id) AS rank, -(row_number() OVER (ORDER BY tier, b, unit_id, parse_id)) AS score FROM t QUALIFY rank <= 200""",
    "graph_acronym": f"""WITH {_PARTS}, f AS (SELECT *, CASE WHEN name LIKE '% %' AND name NOT LIKE '% % %' AND left(name, 1) || left(split_part(name, ' ', 2), 1) IN ('hg', 'rb', 'or')
        THEN 'acronym' END AS class FROM nm WHERE name NOT IN ('the', 'hg', 'or', 'rb', 'the hg', 'hg or', 'or rb'))""" + _FUZZY.format(20, "'the', 'hg', 'or', 'rb'"),
    "graph_token_prefix": f"""WITH {_PARTS}, f AS (SELECT *, CASE WHEN name NOT IN ('hot', 'gea', 'red') AND (name LIKE 'hot%' OR name LIKE 'gea%' OR name LIKE 'red%'
        OR regexp_matches(name, '^hot[^ ]* gea') OR regexp_matches(name, '^gea[^ ]* red')) THEN 'token_prefix' END AS class
        FROM nm WHERE name NOT IN ('hot', 'gea', 'red', 'hot gea', 'gea red', 'hot gea red'))""" + _FUZZY.format(10, "'hot', 'gea', 'red', 'hot gea', 'gea red', 'hot gea red'"),
    "section_ancestry": """WITH RECURSIVE p AS (SELECT p_partkey AS unit_id, p_partkey // 3 AS parent_id FROM part WHERE p_partkey // 3 > 0),
        a AS (SELECT unit_id, parent_id AS ancestor_id, 1 AS hops FROM p UNION ALL SELECT a.unit_id, p.parent_id, a.hops + 1 FROM a JOIN p ON a.ancestor_id = p.unit_id) SELECT * FROM a""",
}
