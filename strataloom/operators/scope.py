"""Scope and reads of the served state: active sources, units, relationships, locations, freshness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ScopeError(ValueError):
    pass


def active(objects: DataFrame, locations: DataFrame | None = None, ids: Sequence | None = None, domains: Sequence[str] | None = None, most: int | None = None) -> DataFrame:
    """(source_id, parse_id) of served sources: all, by ids, by the domain of a current location, or by both.

    An empty list sets no limit. More than `most` sources are an error, not a cut.
    """
    got = objects.filter("active_parse_id is not null and deactivated_at is null")
    if ids:
        got = got.filter(F.col("source_id").isin(*ids))
    if domains:
        current = locations.filter((F.col("status") == "current") & F.col("governance_domain").isin(*domains))
        got = got.join(current, "source_id", "left_semi")
    got = got.select("source_id", F.col("active_parse_id").alias("parse_id"))
    if most is not None and got.limit(most + 1).count() > most:
        raise ScopeError(f"scope has more than {most} sources")
    return got


def active_units(units: DataFrame, objects: DataFrame) -> DataFrame:
    """Units of the one parse that their source serves."""
    serving = objects.filter("active_parse_id is not null").select("source_id", F.col("active_parse_id").alias("parse_id"))
    return units.join(serving, ["source_id", "parse_id"])


def relationships_of(relationships: DataFrame, unit_id, direction: str = "both", kind: str | None = None) -> DataFrame:
    out, into = F.col("from_id") == unit_id, F.col("to_id") == unit_id
    got = relationships.filter({"out": out, "in": into, "both": out | into}[direction])
    if kind is not None:
        got = got.filter(F.col("type") == kind)
    return got.orderBy(F.col("sequence_index").asc_nulls_last(), "id")


def selected_relationships(relationships: DataFrame, selected: DataFrame) -> DataFrame:
    """Edges with both ends among selected(unit_id)."""
    ids = selected.select("unit_id").distinct()
    got = relationships.join(ids.withColumnRenamed("unit_id", "from_id"), "from_id", "left_semi")
    return got.join(ids.withColumnRenamed("unit_id", "to_id"), "to_id", "left_semi")


def locations_per_source(locations: DataFrame) -> DataFrame:
    row = F.struct("source_system", "native_uri", "status")
    return locations.groupBy("source_id").agg(F.array_sort(F.collect_list(row)).alias("locations"))


def citations(passages: DataFrame, locations: DataFrame, most: int = 256) -> DataFrame:
    """passages with their source's locations in order; more than `most` are an error."""
    of = locations_per_source(locations)
    checked = F.when(F.size("locations") > most, F.raise_error(F.lit(f"more than {most} locations"))).otherwise(F.col("locations"))
    return passages.join(of, "source_id", "left").withColumn("locations", checked)


def held_parses(parses: DataFrame) -> DataFrame:
    return parses.filter("status = 'ready' and held_reason is not null").orderBy("source_id", "parse_id")


def fresh_annotations(annotations: DataFrame, objects: DataFrame) -> DataFrame:
    """Fresh, not deleted, of the parse being served."""
    serving = objects.filter("active_parse_id is not null").select("source_id", F.col("active_parse_id").alias("parse_id"))
    return annotations.filter("freshness = 'fresh' and deleted_at is null").join(serving, ["source_id", "parse_id"], "left_semi")


def missing_projections(projections: DataFrame, required: Sequence[str]) -> DataFrame:
    """Per parse the required projection types that are not fresh, sorted."""
    have = F.collect_set(F.when(F.col("freshness") == "fresh", F.col("projection_type")))
    return projections.groupBy("parse_id").agg(F.array_sort(F.array_except(F.array(*map(F.lit, required)), have)).alias("missing"))
