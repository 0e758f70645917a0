"""Conformance dimensions and hard gates of parsed units."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def report(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Per parse: counts and coverages. units(parse_id, unit_id, type, n_locators), edges(parse_id, from_id, to_id, type).

    A coverage of nothing is 1; a rate without subjects (captions) is null, which a gate takes as a missing dimension.
    """
    touched = edges.select("parse_id", F.col("from_id").alias("unit_id")).union(edges.select("parse_id", "to_id")).distinct().withColumn("_t", F.lit(1))
    paired = edges.filter("type = 'caption_of'").select("parse_id", F.col("from_id").alias("unit_id")).distinct().withColumn("_p", F.lit(1))
    u = units.join(touched, ["parse_id", "unit_id"], "left").join(paired, ["parse_id", "unit_id"], "left")
    share = lambda c: F.round(F.coalesce(F.avg(c), F.lit(1.0)), 6)
    return u.groupBy("parse_id").agg(
        F.count("*").alias("n_units"), F.count_if(F.col("type") == "section").alias("n_sections"), share((F.col("n_locators") > 0).cast("int")).alias("locator_coverage"),
        share(F.coalesce("_t", F.lit(0))).alias("relationship_coverage"), F.round(F.avg(F.when(F.col("type") == "caption", F.coalesce("_p", F.lit(0)))), 6).alias("caption_pairing"))


def counts_by_type(units: DataFrame) -> DataFrame:
    per = units.groupBy("parse_id", "type").agg(F.count("*").alias("n"))
    return per.groupBy("parse_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("counts"))


def decomposition(units: DataFrame, contains: DataFrame, subject: str, part: str, depth: int = 64) -> DataFrame:
    """Per parse the share of units of type `subject` with a descendant of type `part`; null without subjects."""
    from .graph import ancestry

    up = ancestry(contains.select("parent_id", "unit_id"), depth=depth)
    parts = units.filter(F.col("type") == part).select("unit_id")
    has = up.join(parts, "unit_id", "left_semi").select(F.col("ancestor_id").alias("unit_id")).distinct().withColumn("_h", F.lit(1))
    return units.filter(F.col("type") == subject).join(has, "unit_id", "left").groupBy("parse_id").agg(F.round(F.avg(F.coalesce("_h", F.lit(0))), 6).alias("rate"))


def gate_violations(units: DataFrame, types: Sequence[str]) -> DataFrame:
    """(parse_id, gate, n): repeated ids, undeclared types, parents that don't exist, sequence numbers that are not the place (from 0)."""
    count = lambda df, gate: df.groupBy("parse_id").agg(F.count("*").alias("n")).select("parse_id", F.lit(gate).alias("gate"), "n")
    twice = units.groupBy("parse_id", "unit_id").agg(F.count("*").alias("_c")).filter("_c > 1")
    odd = units.filter(~F.col("type").isin(*types))
    lost = units.filter("parent_id is not null").join(units.select("parse_id", F.col("unit_id").alias("parent_id")), ["parse_id", "parent_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy("parse_id").orderBy(F.col("sequence_index").asc_nulls_last(), "unit_id")) - 1
    moved = units.withColumn("_r", place).filter(~F.col("sequence_index").eqNullSafe(F.col("_r")))
    return count(twice, "duplicate_unit").unionAll(count(odd, "unknown_type")).unionAll(count(lost, "missing_parent")).unionAll(count(moved, "sequence"))


def canonical_ids(units: DataFrame, width: int = 8) -> DataFrame:
    """<parse>:unit:<zero-padded place> as canonical_id."""
    place = F.row_number().over(Window.partitionBy("parse_id").orderBy(F.col("sequence_index").asc_nulls_last(), "unit_id")) - 1
    return units.withColumn("canonical_id", F.concat(F.col("parse_id").cast("string"), F.lit(":unit:"), F.lpad(place.cast("string"), width, "0")))


def rebuild_relationships(edges: DataFrame, mapping: DataFrame, siblings: DataFrame) -> DataFrame:
    """After cleanup: `precedes` dropped, ends mapped to kept units, self-loops and repeats dropped, `precedes` made anew between
    adjacent siblings(parse_id, parent_id, unit_id, sequence_index). mapping(unit_id, kept_id)."""
    m = mapping.select("unit_id", "kept_id")
    kept = edges.filter("type <> 'precedes'")
    for end in ("from_id", "to_id"):
        kept = kept.join(m.withColumnRenamed("unit_id", end), end, "left").withColumn(end, F.coalesce("kept_id", end)).drop("kept_id")
    kept = kept.filter("from_id <> to_id").select("parse_id", "from_id", "to_id", "type", "role").distinct()
    nxt = F.lead("unit_id").over(Window.partitionBy("parse_id", "parent_id").orderBy("sequence_index", "unit_id"))
    pairs = siblings.select("parse_id", F.col("unit_id").alias("from_id"), nxt.alias("to_id"), F.lit("precedes").alias("type"), F.lit(None).cast("string").alias("role")).filter("to_id is not null")
    return kept.unionByName(pairs)
