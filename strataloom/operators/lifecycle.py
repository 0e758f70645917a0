"""Ingestion and lifecycle: acquisition, queue, deletion inference, gates, freshness, memoisation, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import latest


def prescreen(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Listed items (native_uri, mtime, size) that are new or changed against known state: a left join, not an anti join, as nulls count as changed."""
    k = known.select(F.col("native_uri").alias("_u"), F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    got = listing.join(k, F.col("native_uri") == F.col("_u"), "left")
    same = F.coalesce((F.col("mtime") == F.col("_m")) & (F.col("size") == F.col("_s")), F.lit(False))
    return got.filter(~same).select(*listing.columns)


def latest_acquisition(records: DataFrame) -> DataFrame:
    """The latest succeeded record of each location, by (acquired_at, id)."""
    return latest(records.filter("outcome = 'succeeded'"), ["source_system", "native_uri"], ["acquired_at", "id"])


def dedup(contents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """New source objects: one for each sha256 of content, the least id of its rows; hashes known already are left out."""
    got = contents.groupBy(F.sha2(F.col("content").cast("binary"), 256).alias("source_hash")).agg(F.min("id").alias("id"), F.count("*").alias("n_copies"))
    return got.join(known.select("source_hash"), "source_hash", "left_anti") if known is not None else got


def upsert_locations(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Locations after a scan, on (source_system, native_uri): new ones are inserted, seen ones refreshed (evidence of
    deletion cleared), ones with other content rebound (first_seen_at starts anew); the others stay."""
    s = seen.select("source_system", "native_uri", F.col("source_id").alias("_id"), F.col("seen_at").alias("_at"))
    both = stored.join(s, ["source_system", "native_uri"], "full_outer")
    hit = F.col("_at").isNotNull()
    rebound = hit & F.col("source_id").isNotNull() & (F.col("source_id") != F.col("_id"))
    return both.select(
        "source_system", "native_uri", F.coalesce("_id", "source_id").alias("source_id"),
        F.when(hit, "current").otherwise(F.col("status")).alias("status"),
        F.when(rebound | F.col("first_seen_at").isNull(), F.col("_at")).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.coalesce("_at", "last_seen_at").alias("last_seen_at"),
        F.when(~hit, "kept").when(rebound, "rebound").when(F.col("source_id").isNull(), "inserted").otherwise("refreshed").alias("action"))


def in_scope(uri: Column, scope: str) -> Column:
    """Whether a path lies under a scope, by whole components."""
    bare = scope.rstrip("/")
    return (uri == bare) | F.startswith(uri, F.lit(bare + "/"))


def inferred_deletions(locations: DataFrame, enumerated: DataFrame, scope: str) -> DataFrame:
    """Current locations under the scope that a complete enumeration did not list."""
    return locations.filter((F.col("status") == "current") & in_scope(F.col("native_uri"), scope)).join(enumerated.select("source_system", "native_uri"), ["source_system", "native_uri"], "left_anti")


def deactivation_candidates(objects: DataFrame, locations: DataFrame, domain: str) -> DataFrame:
    """Active sources that have a location of the domain and no current location anywhere."""
    live = objects.filter("active_parse_id is not null and deactivated_at is null")
    return live.join(locations.filter(F.col("governance_domain") == domain), "source_id", "left_semi").join(locations.filter("status = 'current'"), "source_id", "left_anti")


def reactivation_candidates(objects: DataFrame, locations: DataFrame) -> DataFrame:
    """Deactivated sources that have a current location."""
    return objects.filter("deactivated_at is not null").join(locations.filter("status = 'current'"), "source_id", "left_semi")


def coalesced(detections: DataFrame) -> DataFrame:
    """The queue after detections(source_key, detected_at, operation_id): one pending entry a key, the latest time, how often
    it absorbed another, the latest operation that has an id. Map-side maxima, so a hot key costs one row a task."""
    named = F.when(F.col("operation_id").isNotNull(), F.struct("detected_at", "operation_id"))
    got = detections.groupBy("source_key").agg(F.min("detected_at").alias("first_detected_at"), F.max("detected_at").alias("detected_at"), (F.count("*") - 1).alias("coalesced_count"), F.max(named).alias("o"))
    return got.select("source_key", "first_detected_at", "detected_at", "coalesced_count", F.col("o.operation_id").alias("operation_id"), F.lit("pending").alias("state"))


def merge_queue(queue: DataFrame, fresh: DataFrame) -> DataFrame:
    """coalesced() detections laid on a stored queue: any entry of the key, in whatever state, absorbs them and pends again."""
    f = fresh.select("source_key", F.col("first_detected_at").alias("_f"), F.col("detected_at").alias("_d"), F.col("coalesced_count").alias("_c"), F.col("operation_id").alias("_o"))
    both = queue.join(f, "source_key", "full_outer")
    hit = F.col("_d").isNotNull()
    return both.select(
        "source_key", F.coalesce("first_detected_at", "_f").alias("first_detected_at"), F.greatest("detected_at", "_d").alias("detected_at"),
        F.when(hit & F.col("state").isNotNull(), F.col("coalesced_count") + F.col("_c") + 1).otherwise(F.coalesce("coalesced_count", "_c")).alias("coalesced_count"),
        F.coalesce("_o", "operation_id").alias("operation_id"), F.when(hit, "pending").otherwise(F.col("state")).alias("state"),
        F.when(hit, 0).otherwise(F.coalesce("attempts", F.lit(0))).alias("attempts"), F.when(~hit, F.col("error")).alias("error"))


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The next n entries: pending, or in flight from a run that broke off; oldest first; one attempt more."""
    return queue.filter("state in ('pending', 'in_flight')").orderBy("detected_at", "source_key").limit(n).withColumns({"state": F.lit("in_flight"), "attempts": F.coalesce("attempts", F.lit(0)) + 1})


def complete(queue: DataFrame, done: DataFrame) -> DataFrame:
    """The queue without the claimed entries done(source_key); one that was detected anew meanwhile pends and stays."""
    keys = done.select("source_key").distinct().withColumn("state", F.lit("in_flight"))
    return queue.join(keys, ["source_key", "state"], "left_anti").select(*queue.columns)


def fail(queue: DataFrame, failures: DataFrame, most: int = 1000) -> DataFrame:
    """Claimed entries of failures(source_key, error) as failed, with the first `most` characters of the error; the last by order of text, if several."""
    f = failures.groupBy("source_key").agg(F.max(F.substring("error", 1, most)).alias("_e"))
    got = queue.join(f, "source_key", "left")
    hit = (F.col("state") == "in_flight") & F.col("_e").isNotNull()
    return got.withColumns({"error": F.when(hit, F.col("_e")).otherwise(F.col("error")), "state": F.when(hit, "failed").otherwise(F.col("state"))}).select(*queue.columns)


def queue_depths(queue: DataFrame) -> DataFrame:
    return queue.groupBy("state").agg(F.count("*").alias("n"), F.coalesce(F.sum("coalesced_count"), F.lit(0)).alias("coalesced"))


def counts(rows: DataFrame, **conditions: Column) -> DataFrame:
    """One row of counts, each under its own condition, in one pass."""
    return rows.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def failed_latest(parses: DataFrame, events: DataFrame, kind: str = "failure_cleared") -> DataFrame:
    """Sources whose latest parse failed and has no event of the kind."""
    last = latest(parses, ["source_id"], ["started_at", "parse_id"]).filter("status = 'failed'")
    cleared = events.filter(F.col("event_type") == kind).select(F.col("subject_id").alias("parse_id"))
    return last.join(cleared, "parse_id", "left_anti")


def source_observations(objects: DataFrame, parses: DataFrame, locations: DataFrame) -> DataFrame:
    """Each source with the status of its latest parse, whether it has a current location, and its first uri."""
    last = latest(parses, ["source_id"], ["started_at", "parse_id"]).select("source_id", F.col("status").alias("latest_status"))
    where = locations.groupBy("source_id").agg(F.max(F.col("status") == "current").alias("has_current"), F.min("native_uri").alias("first_uri"))
    return objects.select("source_id").join(last, "source_id", "left").join(where, "source_id", "left").withColumn("has_current", F.coalesce("has_current", F.lit(False)))


def retry_locations(failed_queue: DataFrame, locations: DataFrame) -> DataFrame:
    """Locations to be tried again: those of failed queue entries, with those that had lost access; each once."""
    of_queue = failed_queue.select("native_uri").join(locations.select("native_uri"), "native_uri", "left")
    return of_queue.union(locations.filter("status = 'access_lost'").select("native_uri")).distinct()


def compare(hot: DataFrame, archived: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows missing from either side or different, by key; empty if the two agree. Nulls equal nulls."""
    rest = [c for c in hot.columns if c not in key]
    a = hot.select(*key, F.struct(*rest).alias("_a"))
    b = archived.select(*key, F.struct(*rest).alias("_b"))
    state = F.when(F.col("_b").isNull(), "extra").when(F.col("_a").isNull(), "missing").when(~F.col("_a").eqNullSafe(F.col("_b")), "different")
    return a.join(b, list(key), "full_outer").select(*key, state.alias("state")).filter("state is not null")


def dominance(active: DataFrame, candidate: DataFrame) -> DataFrame:
    """Gate of a candidate's dimensions(source_id, dimension, value): any dimension of the active parse that it lacks or where
    it is lower holds it; without an active parse it is activated."""
    c = candidate.select("source_id", "dimension", F.col("value").alias("_c"))
    worse = active.join(c, ["source_id", "dimension"], "left").filter("_c is null or _c < value").groupBy("source_id").agg(F.array_sort(F.collect_list("dimension")).alias("worse"))
    each = candidate.select("source_id").distinct().join(worse, "source_id", "left")
    return each.select("source_id", F.when(F.col("worse").isNull(), "activate").otherwise("hold").alias("verdict"), F.coalesce("worse", F.array().cast("array<string>")).alias("worse"))


def retry_guard(parses: DataFrame) -> DataFrame:
    """What stands against parsing a source anew: a ready parse not yet gated, then a terminal or held one, then one being built."""
    code = F.when((F.col("status") == "ready") & F.col("held_reason").isNull(), 1).when(F.col("status").isin("failed", "active") | F.col("held_reason").isNotNull(), 2).when(F.col("status") == "building", 3)
    least = parses.groupBy("source_id").agg(F.min(code).alias("c"))
    return least.select("source_id", F.when(F.col("c") == 1, "gate").when(F.col("c") == 2, "settled").when(F.col("c") == 3, "building").otherwise("free").alias("guard"))


#: Legal steps of projection and annotation freshness.
STEPS = {"building": ("fresh", "failed"), "fresh": ("stale", "superseded"), "stale": ("building", "superseded"), "failed": ("building",), "superseded": ()}


def illegal_steps(history: DataFrame, key: str = "id", order: str = "seq", state: str = "state") -> DataFrame:
    """Steps of a history that the freshness machine does not allow; the first state has to be building."""
    w = Window.partitionBy(key).orderBy(order)
    legal = F.col("_before").isNull() & (F.col(state) == "building")
    for a, to in STEPS.items():
        legal = legal | ((F.col("_before") == a) & F.col(state).isin(*to)) if to else legal
    return history.withColumn("_before", F.lag(state).over(w)).filter(~F.coalesce(legal, F.lit(False))).select(key, order, F.col("_before").alias("before"), state)


def undone_work(required: DataFrame, satisfied: DataFrame) -> DataFrame:
    """Required content keys without a satisfied one."""
    return required.join(satisfied.select("content_key").distinct(), "content_key", "left_anti")


def memo_lookup(work: DataFrame, memo: DataFrame) -> DataFrame:
    return work.join(memo.select("memo_key", "result"), "memo_key", "left").withColumn("memoized", F.col("result").isNotNull())


def memo_record(memo: DataFrame, fresh: DataFrame) -> DataFrame:
    """The memo with new keys added; a key once written stays as it is."""
    new = fresh.groupBy("memo_key").agg(F.min("result").alias("result")).join(memo.select("memo_key"), "memo_key", "left_anti")
    return memo.select("memo_key", "result").unionByName(new)


def policy_versions(loads: DataFrame) -> DataFrame:
    """Versions of each policy by time: one more whenever its hash differs from the one before."""
    w = Window.partitionBy("policy_id").orderBy("loaded_at", "load_id")
    step = F.when(F.lag("hash").over(w).eqNullSafe(F.col("hash")), 0).otherwise(1)
    return loads.withColumn("_s", step).withColumn("version", F.sum("_s").over(w)).drop("_s")


def retry_delay(failures: Column, base_ms: int, cap_ms: int) -> Column:
    return F.when(failures > 0, F.least(F.lit(float(cap_ms)), base_ms * F.pow(F.lit(2.0), failures - 1))).otherwise(0.0).cast("long")


def cadence(cycles: DataFrame, least_ms: int = 1000, most_ms: int = 3_600_000, quiet: float = 1.5, pressure: float = 2.0, weight: float = 0.3) -> DataFrame:
    """Delay after each scan cycle of a key: cycles(key, seq, scan_ms, changes, spacing_ms, backlog) -> delay_ms, pressed (edge or null).

    A fold over a key's cycles in order, as an aggregate over an array; keys are independent. The floor is the scan's
    own time within bounds; changes pull the delay down to their smoothed spacing, quiet cycles let it grow, a
    backlog multiplies it, the ceiling and the floor hold throughout.
    """
    start = F.struct(F.lit(None).cast("double").alias("delay"), F.lit(None).cast("double").alias("ema"), F.lit(False).alias("on"),
                     F.array().cast("array<struct<seq:bigint,delay_ms:bigint,pressed:boolean>>").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        floor = F.least(F.lit(float(most_ms)), F.greatest(F.lit(float(least_ms)), c["scan_ms"].cast("double")))
        delay = F.coalesce(acc["delay"], floor)
        seen = F.greatest(F.lit(float(least_ms)), c["spacing_ms"] / c["changes"])
        ema = F.when(c["changes"] > 0, F.when(acc["ema"].isNull(), seen).otherwise(weight * seen + (1 - weight) * acc["ema"])).otherwise(acc["ema"])
        moved = F.when(c["changes"] > 0, F.greatest(F.least(F.floor(ema).cast("double"), delay), floor)).otherwise(F.least(F.ceil(delay * quiet).cast("double"), F.lit(float(most_ms))))
        pressed = c["backlog"] > 0
        slowed = F.when(pressed, F.least(F.floor(moved * pressure).cast("double"), F.lit(float(most_ms)))).otherwise(moved)
        final = F.greatest(slowed, floor)
        row = F.struct(c["seq"].cast("long").alias("seq"), final.cast("long").alias("delay_ms"), F.when(pressed != acc["on"], pressed).alias("pressed"))
        return F.struct(final.alias("delay"), ema.alias("ema"), pressed.alias("on"), F.concat(acc["out"], F.array(row)).alias("out"))

    each = cycles.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("seq", "scan_ms", F.greatest("changes", F.lit(0)).alias("changes"), "spacing_ms", "backlog"))).alias("c"))
    return each.select("key", F.explode(F.aggregate("c", start, step)["out"]).alias("r")).select("key", "r.*")
