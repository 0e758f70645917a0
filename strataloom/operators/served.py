"""Reads and checks of served state: ownership, dependencies, publications, warnings, rendered views, retained lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import top_per

BLANK = " \t\n\r\x0b\x0c"


def told(text: Column) -> Column:
    """The text, or null if it is blank."""
    return F.when(F.length(F.btrim(text, F.lit(BLANK))) > 0, text)


def ownership_conflicts(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """Candidates (unit_id, source_id) whose unit does not exist, or belongs to another source; none may reach a result."""
    own = units.select("unit_id", F.col("source_id").alias("_own"))
    got = candidates.select("unit_id", "source_id").distinct().join(own, "unit_id", "left")
    return got.select("unit_id", "source_id", F.when(F.col("_own").isNull(), "missing").when(F.col("_own") != F.col("source_id"), "source").alias("conflict")).filter("conflict is not null")


def annotations_of(annotations: DataFrame, selected: DataFrame) -> DataFrame:
    """Ids of annotations(annotation_id, unit_ids) that cite one of selected(unit_id)."""
    each = annotations.select("annotation_id", F.explode("unit_ids").alias("unit_id"))
    return each.join(selected.select("unit_id"), "unit_id", "left_semi").select("annotation_id").distinct()


def cohort_inputs(cohorts: DataFrame, annotations: DataFrame) -> DataFrame:
    """How many of each cohort's annotation_ids are missing, or there but not fresh; annotations(annotation_id, freshness)."""
    each = cohorts.select("cohort_id", F.explode_outer("annotation_ids").alias("annotation_id"))
    got = each.join(annotations.select("annotation_id", "freshness"), "annotation_id", "left")
    named = F.col("annotation_id").isNotNull()
    return got.groupBy("cohort_id").agg(
        F.count_if(named & F.col("freshness").isNull()).alias("n_missing"), F.count_if(named & (F.col("freshness") != "fresh")).alias("n_stale"))


def dependents(projections: DataFrame, changed: DataFrame) -> DataFrame:
    """Ids of projections(projection_id, annotation_ids) that rest on one of changed(annotation_id)."""
    each = projections.select("projection_id", F.explode("annotation_ids").alias("annotation_id"))
    return each.join(changed.select("annotation_id"), "annotation_id", "left_semi").select("projection_id").distinct()


def section_kinds(units: DataFrame) -> DataFrame:
    """Per parse the share of sections whose kind is known; 1 without sections."""
    known = F.when(F.col("type") == "section", F.coalesce(F.col("kind") != "unknown", F.lit(False)).cast("int"))
    return units.groupBy("parse_id").agg(F.round(F.coalesce(F.avg(known), F.lit(1.0)), 6).alias("coverage"))


def metrics(units: DataFrame, types: Sequence[str]) -> DataFrame:
    """Per parse the number of units, and of those of each type, a column a type."""
    return units.groupBy("parse_id").agg(F.count("*").alias("n_units"), *(F.count_if(F.col("type") == t).alias(f"n_{t}") for t in types))


def warnings_by_code(warnings: DataFrame) -> DataFrame:
    """Per parse and code: how many, and the locator of the first by position; map-side, whatever a code's share."""
    return warnings.groupBy("parse_id", "code").agg(F.count("*").alias("n"), F.min_by("locator", F.struct("position", "locator")).alias("first_locator"))


def current_paths(locations: DataFrame) -> DataFrame:
    """Per source its current uris, each once, in order."""
    return locations.filter("status = 'current'").groupBy("source_id").agg(F.array_sort(F.collect_set("native_uri")).alias("paths"))


def unresolved(operations: DataFrame, kind: str) -> DataFrame:
    return operations.filter((F.col("kind") == kind) & ~F.col("state").isin("completed", "failed"))


def evidence_of_units(matches: DataFrame) -> DataFrame:
    """Per unit its matches (kind, match_id), each once, in order."""
    return matches.groupBy("unit_id").agg(F.array_sort(F.collect_set(F.struct("kind", "match_id"))).alias("matches"))


def attribution(hits: DataFrame, retained: DataFrame) -> DataFrame:
    """Per target the annotations that nominated it, from lists (list, key) that were retained alone; hits(list, key, target, annotation_id)."""
    kept = hits.join(retained.select("list", "key").distinct(), ["list", "key"], "left_semi")
    return kept.groupBy("target").agg(F.array_sort(F.collect_set("annotation_id")).alias("annotation_ids"))


def annotation_text(annotations: DataFrame) -> DataFrame:
    """annotations(annotation_id, type, body JSON) with the text that is embedded; empty markers and other types have none and go.

    A field that is missing or blank is an error, named by the annotation.
    """
    def field(name: str) -> Column:
        value = told(F.get_json_object("body", f"$.{name}"))
        return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit("annotation "), F.col("annotation_id").cast("string"), F.lit(f" has no {name}"))))

    lines = lambda *parts: F.concat_ws("\n", *(F.concat(F.lit(f"{title}: "), field(name)) for title, name in parts))
    text = (
        F.when(F.col("type") == "entity", lines(("Entity", "name"), ("Type", "entityType")))
        .when(F.col("type") == "relation", lines(("Subject", "subject"), ("Relationship", "predicate"), ("Object", "object")))
        .when(F.col("type") == "summary", lines(("Summary", "text"))))
    live = annotations.filter(F.regexp_replace("body", r"\s", "") != "[]")
    return live.withColumn("text", text).filter("text is not null").select("annotation_id", "type", "text")


def markdown(units: DataFrame) -> DataFrame:
    """Per parse the Markdown of its units in order, by blank lines, and how many have a part in it.

    units(parse_id, unit_id, sequence_index, type, text, level). Headings have 1 to 6 marks, captions are emphasised, code is fenced,
    blocks and cells are as they are; blank texts and containers give nothing. One parse is one document.
    """
    t, kind = told(F.col("text")), F.col("type")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce("level", F.lit(1)))).cast("int")
    line = (
        F.when(kind == "section", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), t)).when(kind == "caption", F.concat(F.lit("*"), t, F.lit("*")))
        .when(kind == "code_block", F.concat(F.lit("```\n"), t, F.lit("\n```"))).when(kind.isin("text_block", "table_cell"), t))
    rows = units.withColumn("_line", line).filter("_line is not null").groupBy("parse_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("sequence_index").isNull().alias("n"), "sequence_index", "unit_id", "_line"))).alias("a"))
    return rows.select("parse_id", F.size("a").alias("n_units"), F.array_join(F.col("a")["_line"], "\n\n").alias("markdown"))


def summaries(annotations: DataFrame) -> DataFrame:
    """Per parse the texts of its summary annotations by id, by blank lines, and the number of empty markers that were passed over."""
    empty = F.regexp_replace("body", r"\s", "") == "[]"
    text = F.get_json_object("body", "$.text")
    sound = F.when(text.isNotNull(), text).otherwise(F.raise_error(F.concat(F.lit("no text in summary "), F.col("annotation_id").cast("string"))))
    row = F.when(~empty, F.struct("annotation_id", sound.alias("t")))
    got = annotations.filter("type = 'summary'").groupBy("parse_id").agg(F.array_sort(F.collect_list(row)).alias("a"), F.count_if(empty).alias("n_empty"))
    return got.select("parse_id", F.array_join(F.col("a")["t"], "\n\n").alias("summary"), "n_empty")


def decide_held(parses: DataFrame, decisions: DataFrame) -> DataFrame:
    """Parses after decisions(parse_id, verdict accept or discard) on held ones: an accepted one is active and what its source served before is
    superseded, a discarded one is discarded; decisions on parses that are not held change nothing. One acceptance a source, the greatest id."""
    held = (F.col("status") == "ready") & F.col("held_reason").isNotNull()
    marked = parses.join(decisions.select("parse_id", "verdict"), "parse_id", "left").withColumn("verdict", F.when(held, F.col("verdict")))
    chosen = marked.filter("verdict = 'accept'").groupBy("source_id").agg(F.max("parse_id").alias("_new"))
    both = marked.join(chosen, "source_id", "left")
    status = F.when(F.col("parse_id") == F.col("_new"), "active").when((F.col("status") == "active") & F.col("_new").isNotNull(), "superseded").when(F.col("verdict") == "discard", "discarded").otherwise(F.col("status"))
    reason = F.when((F.col("parse_id") == F.col("_new")) | (F.col("verdict") == "discard"), F.lit(None)).otherwise(F.col("held_reason"))
    return both.select("source_id", "parse_id", status.alias("status"), reason.alias("held_reason"))


def publications(cohorts: DataFrame, built: DataFrame) -> DataFrame:
    """What becomes of each cohort(cohort_id, input_hash): published if its dense and its multi-vector projection are both of this hash,
    else building; built(cohort_id, kind, input_hash) of no cohort is retired."""
    has = lambda k: F.max(F.when((F.col("kind") == k) & (F.col("input_hash") == F.col("_want")), 1)).isNotNull()
    want = cohorts.select("cohort_id", F.col("input_hash").alias("_want"))
    both = want.join(built, "cohort_id", "full_outer").groupBy("cohort_id").agg(F.max("_want").alias("w"), has("dense").alias("d"), has("multivector").alias("m"))
    return both.select("cohort_id", F.when(F.col("w").isNull(), "retired").when(F.col("d") & F.col("m"), "published").otherwise("building").alias("state"))


def best_excerpts(scores: DataFrame, cap: int) -> DataFrame:
    """Late-interaction scores (key, kind, score) of excerpts: the best over the source's and the annotations' matrices, never their sum,
    ranked (score desc, source score desc, key); kind is source or anything else."""
    got = scores.filter("not isnan(score) and abs(score) < double('inf')").groupBy("key").agg(F.max("score").alias("score"), F.max(F.when(F.col("kind") == "source", F.col("score"))).alias("source_score"))
    ranked = got.orderBy(F.col("score").desc(), F.col("source_score").desc_nulls_last(), "key").limit(cap).withColumn("_q", F.lit(0))
    return top_per(ranked, ["_q"], [F.col("score").desc(), F.col("source_score").desc_nulls_last(), F.col("key").asc()], cap).drop("_q")


def relative_uri(uri: Column, root: str) -> Column:
    """The uri without the corpus root; null for one that is not under it, or climbs out of it."""
    bare = root.rstrip("/") + "/"
    rest = F.substring(uri, len(bare) + 1, 1 << 30)
    return F.when(F.startswith(uri, F.lit(bare)) & (F.length(rest) > 0) & ~F.array_contains(F.split(rest, "/"), ".."), rest)


def log_acquisitions(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """The log with new records, successes and failures alike; a record that is there, by id, is never written again."""
    return log.unionByName(fresh.dropDuplicates(["id"]).join(log.select("id"), "id", "left_anti").select(*log.columns))
