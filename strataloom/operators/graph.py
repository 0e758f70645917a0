"""The entity graph: derivation from annotations, vocabulary, and the graph channel with its tiers."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import acronym, ngrams, normal_name_col, prefix_match
from ..runtime import shared_dir
from .ranking import top_per

#: Classes of a match, strongest first.
CLASSES = ("exact", "acronym", "token_prefix", "semantic")


def mentions(annotations: DataFrame) -> DataFrame:
    """(parse_id, name, entity_type, unit_ids, n_types): one node for each normalised name of a parse.

    annotations(parse_id, annotation_id, name, entity_type, unit_ids). Units are the sorted union; the type is
    that of the least annotation_id; n_types over 1 says that types diverged. Names without text are no nodes.
    """
    named = annotations.withColumn("name", normal_name_col(F.col("name"))).filter("name <> ''").withColumn("entity_type", normal_name_col(F.col("entity_type")))
    units = named.select("parse_id", "name", F.explode("unit_ids").alias("u")).groupBy("parse_id", "name").agg(F.array_sort(F.collect_set("u")).alias("unit_ids"))
    kinds = named.groupBy("parse_id", "name").agg(F.min_by("entity_type", "annotation_id").alias("entity_type"), F.count_distinct("entity_type").alias("n_types"))
    return kinds.join(units, ["parse_id", "name"], "left")


def edges(relations: DataFrame) -> DataFrame:
    """One edge for each relation annotation: names and predicate normalised; an empty predicate is an error."""
    p = normal_name_col(F.col("predicate"))
    return relations.select(
        "parse_id", "annotation_id", normal_name_col(F.col("subject")).alias("from_name"),
        F.when(p == "", F.raise_error(F.lit("a relation without a predicate"))).otherwise(p).alias("predicate"),
        normal_name_col(F.col("object")).alias("to_name"), "unit_ids")


def vocabulary(annotations: DataFrame, field: str, row_cap: int | None = None, group_cap: int | None = None) -> DataFrame:
    """Groups of the normalised field: uses, raw forms, types, distinct sources. annotations(annotation_id, source_id, field, entity_type).

    With caps, rows by annotation_id and groups by name are cut, and `truncated` says so.
    """
    rows, cut = annotations, F.lit(False)
    if row_cap is not None:
        over = annotations.orderBy("annotation_id").limit(row_cap + 1)
        cut = F.lit(over.count() > row_cap)
        rows = over.orderBy("annotation_id").limit(row_cap)
    named = rows.select("source_id", F.col(field).alias("raw"), normal_name_col(F.col(field)).alias("name"), "entity_type")
    forms = named.groupBy("name", "raw").agg(F.count("*").alias("n"))
    per_form = forms.groupBy("name").agg(F.sum("n").alias("uses"), F.array_sort(F.collect_list(F.struct("raw", "n"))).alias("forms"))
    per_name = named.groupBy("name").agg(F.count_distinct("source_id").alias("n_sources"), F.array_sort(F.collect_set("entity_type")).alias("types"))
    got = per_form.join(per_name, "name")
    if group_cap is not None:
        got = got.orderBy("name").limit(group_cap)
    return got.withColumn("truncated", cut)


def match_names(nodes: DataFrame, query: str, acronyms: bool = False, prefixes: bool = False, most: int = 20, most_tokens: int = 6, least_acronym: int = 2, least_prefix: int = 3) -> DataFrame:
    """(parse_id, name, class) of nodes named by the query.

    Exact names by an equi-join with the query's n-grams (a few rows: a literal). Fuzzy classes are evaluated as
    predicates on each stored name; a disabled class costs nothing. Per parse the first `most` fuzzy names by
    (class, longest name, name) are kept.
    """
    grams = ngrams(query, most_tokens)
    if not grams:
        return nodes.select("parse_id", "name", F.lit("exact").alias("class")).limit(0)
    exact = nodes.filter(F.col("name").isin(grams)).select("parse_id", "name", F.lit("exact").alias("class"))
    if not (acronyms or prefixes):
        return exact
    kind = F.lit(None).cast("string")
    if prefixes:
        hit = F.lit(False)
        for g in grams:
            hit = hit | prefix_match(F.lit(g), F.col("name"), least_prefix)
        kind = F.when(hit, "token_prefix")
    if acronyms:
        kind = F.when(acronym(F.col("name"), least_acronym).isin([g for g in grams if " " not in g]), "acronym").otherwise(kind)
    fuzzy = nodes.filter(~F.col("name").isin(grams)).select("parse_id", "name", kind.alias("class")).filter("class is not null")
    order = [F.col("class").asc(), F.length("name").desc(), F.col("name").asc()]  # 'acronym' sorts before 'token_prefix'
    return exact.unionByName(top_per(fuzzy, ["parse_id"], order, most).drop("rank"))


def add_semantic(matched: DataFrame, semantic: DataFrame) -> DataFrame:
    """Names (parse_id, name) of the semantic shortlist, unless matched already."""
    fresh = semantic.select("parse_id", "name").distinct().join(matched, ["parse_id", "name"], "left_anti")
    return matched.unionByName(fresh.withColumn("class", F.lit("semantic")))


def reach(matched: DataFrame, nodes: DataFrame, links: DataFrame, hops: int = 1) -> DataFrame:
    """(parse_id, unit_id, name, class, direct): units of matched names, and with a hop those of edges and far names."""
    own = nodes.select("parse_id", "name", "unit_ids")
    direct = matched.join(own, ["parse_id", "name"]).select("parse_id", F.explode("unit_ids").alias("unit_id"), "name", "class", F.lit(True).alias("direct"))
    if hops < 1:
        return direct
    out = links.select("parse_id", F.col("from_name").alias("name"), F.col("to_name").alias("far"), F.col("unit_ids").alias("edge_units"))
    back = links.select("parse_id", F.col("to_name").alias("name"), F.col("from_name").alias("far"), F.col("unit_ids").alias("edge_units"))
    hop = matched.join(out.unionByName(back), ["parse_id", "name"])
    on_edge = hop.select("parse_id", F.explode("edge_units").alias("unit_id"), "name", "class", F.lit(False).alias("direct"))
    far = hop.select("parse_id", "far", "name", "class").distinct().join(own.withColumnRenamed("name", "far"), ["parse_id", "far"])
    return direct.unionByName(on_edge).unionByName(far.select("parse_id", F.explode("unit_ids").alias("unit_id"), "name", "class", F.lit(False).alias("direct")))


def channel(reached: DataFrame, cap: int | None = None) -> DataFrame:
    """Ranked units: tier 1 is named by several matched names directly, 2 by one, 3 only by a hop.

    Order: tier, the strongest match (class, longest name, name), unit_id, parse_id. score = -rank.
    """
    code = sum((F.when(F.col("class") == c, i).otherwise(0) for i, c in enumerate(CLASSES)), F.lit(0))
    unit = reached.groupBy("parse_id", "unit_id").agg(
        F.count_distinct(F.when(F.col("direct"), F.col("name"))).alias("n_direct"),
        F.min(F.struct(code.alias("c"), (-F.length("name")).alias("l"), "name")).alias("best"))
    tier = F.when(F.col("n_direct") > 1, 1).when(F.col("n_direct") == 1, 2).otherwise(3)
    rows = unit.select("parse_id", "unit_id", tier.alias("tier"), "n_direct", F.col("best.name").alias("name"), "best").withColumn("_q", F.lit(0))
    got = top_per(rows, ["_q"], [F.col(c).asc() for c in ("tier", "best.c", "best.l", "best.name", "unit_id", "parse_id")], cap)
    return got.select("parse_id", "unit_id", "tier", "name", "rank", (-F.col("rank")).alias("score"))


def ancestry(parents: DataFrame, roots: Sequence | None = None, depth: int = 64) -> DataFrame:
    """(unit_id, ancestor_id, hops) along contains(parent_id, unit_id).

    Each unit's way up doubles in a round, by the way of its last ancestor: as many rounds as the depth has binary digits, each written
    to the shared folder. Two parents of a unit, a cycle, or a way longer than `depth` are errors.
    """
    spark = parents.sparkSession
    folder = f"{shared_dir(spark)}/ancestry-{uuid.uuid4().hex}"

    def written(rows: DataFrame, n: int) -> DataFrame:
        rows.write.parquet(f"{folder}/{n}")
        return spark.read.parquet(f"{folder}/{n}")

    ends = parents.groupBy("unit_id").agg(F.array(F.min("parent_id")).alias("way"), (F.min("parent_id") != F.max("parent_id")).alias("two"))
    ways = written(ends, 0)
    if ways.filter("two").limit(1).count():
        raise ValueError("a unit has two parents")
    ways, most = ways.select("unit_id", "way"), 1
    while longest := ways.agg(F.max(F.size("way"))).first()[0]:
        if longest > depth:
            raise ValueError("a cycle, or a way deeper than allowed")
        if longest < most:  # no way can go on
            break
        on = ways.select(F.col("unit_id").alias("_u"), F.col("way").alias("_w")).hint("merge")
        further = ways.withColumn("_last", F.element_at("way", -1)).join(on, F.col("_last") == F.col("_u"), "left")
        ways, most = written(further.select("unit_id", F.when(F.col("_w").isNull(), F.col("way")).otherwise(F.concat("way", "_w")).alias("way")), most), 2 * most
    if roots is not None:
        ways = ways.filter(F.col("unit_id").isin(*roots))
    return ways.select("unit_id", F.posexplode("way").alias("_at", "ancestor_id")).select("unit_id", "ancestor_id", (F.col("_at") + 1).alias("hops"))


def batches(rows: DataFrame, size: str, most: int, order: Sequence[str]) -> DataFrame:
    """Consecutive rows in batches by running size: a batch id is the running sum before the row over `most`."""
    w = Window.partitionBy("parse_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("batch", F.floor(F.coalesce(F.sum(size).over(w), F.lit(0)) / most).cast("int"))
