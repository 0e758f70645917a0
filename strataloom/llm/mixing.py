"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
BLOCKS = 1024
SHARDS = 8
SEED = 11
#: Sources up to which a row a source is broadcast; beyond, such rows are joined by source.
FEW = 20_000


def n_words(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white spaces; 0 for null."""
    bare = F.btrim(text, F.lit(SPACE))
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def _key(doc_id: Column, text: Column, seed: int, what: str) -> Column:
    """60 keyed bits that depend on the row's id and text alone."""
    row = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), row).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: list[tuple[str | None, int]]) -> dict[str | None, float]:
    """Words to take of each source: shares by weight, none above MOST times its size, the excess shared again.

    Sources reach their bound in the order of bound over weight, so the end of the resharing is found in one pass.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, (s, _) in enumerate(order)}
    left, open_weight, out = SHARE * sum(n for _, n in order), sum(weight.values()), {}
    for s, n in sorted(order, key=lambda x: (MOST * x[1] / weight[x[0]], x[0] is None, x[0] or "")):
        share = left * weight[s] / open_weight
        out[s] = float(min(MOST * n, share))
        left, open_weight = left - out[s], open_weight - weight[s]
    return out


def split(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """quotas per source dealt to shards: [shard, source]. Each node of the tree gives its left half a multivariate-hypergeometric draw."""
    if shards == 1:
        return quotas[None, :]
    half = shards // 2
    left = rng.multivariate_hypergeometric(quotas, int(quotas.sum()) * half // shards, method="marginals")
    return np.concatenate([split(left, half, rng), split(quotas - left, shards - half, rng)])


def _plan(blocks: DataFrame, shards: int, seed: int, scratch: Scratch) -> tuple[DataFrame, dict[str | None, float]]:
    """blocks(source, block, words) -> (source, block, takes array<struct<pass, shard>>), and the targets.

    Whole passes come first, then a partial pass of blocks in permuted order, each taken if it still fits; then, of the
    others, the block that comes nearest to what is still wanted (ties: first in order), if that brings the total nearer.
    """
    sizes = blocks.groupBy("source").agg(F.sum("words").alias("n"), F.count("*").alias("blocks")).collect()  # one row a source
    few = F.broadcast if len(sizes) <= FEW else lambda df: df
    want = targets([(r["source"], r["n"]) for r in sizes])
    passes = {r["source"]: int(want[r["source"]] // r["n"]) if r["n"] else 0 for r in sizes}
    given = [{"s": r["source"], "passes": passes[r["source"]], "rest": int(want[r["source"]] - passes[r["source"]] * r["n"])} for r in sizes]
    spark = scratch.spark

    def literal(rows: list[dict], schema: str) -> DataFrame:
        return spark.range(1, numPartitions=1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")

    def order(which: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(seed), which, F.coalesce("source", F.lit("")), "block").cast("binary"))

    asked = literal(given, "s:string,passes:int,rest:bigint")
    on = F.col("source").eqNullSafe(F.col("s"))
    # at most BLOCKS entries a source, whatever its rows
    row = F.struct(order(F.lit("part")).alias("o"), "block", "words")
    lists = blocks.groupBy("source").agg(F.array_sort(F.collect_list(row)).alias("all"))
    start = F.struct(F.col("rest"), F.array().cast("array<bigint>").alias("got"))
    fits = lambda acc, x: (x["words"] > 0) & (x["words"] <= acc["rest"])
    fold = F.aggregate("all", start, lambda acc, x: F.when(
        fits(acc, x), F.struct((acc["rest"] - x["words"]).alias("rest"), F.concat(acc["got"], F.array(x["block"])).alias("got"))).otherwise(acc))
    folded = lists.join(few(asked), on).select("source", "passes", "all", fold.alias("f"))
    left = F.filter("all", lambda x: (x["words"] > 0) & ~F.array_contains(F.col("f.got"), x["block"]))
    nearest = F.array_min(F.transform(left, lambda x: F.struct(F.abs(x["words"] - F.col("f.rest")).alias("d"), x["o"].alias("o"), x["block"].alias("b"))))
    chosen = folded.withColumn("next", nearest).select(
        "source", "passes", "all", F.when(F.col("next.d") < F.col("f.rest"), F.concat("f.got", F.array("next.b"))).otherwise(F.col("f.got")).alias("part"))
    whole = chosen.select("source", F.explode("all").alias("x"), F.explode(F.expr("sequence(0, passes)")).alias("pass"), "passes", "part")
    taken = whole.filter((F.col("pass") < F.col("passes")) | F.array_contains("part", F.col("x.block"))).select("source", "x.block", "pass")
    taken = scratch.write(taken, "taken")
    quotas = {r["source"]: r["n"] for r in taken.groupBy("source").agg(F.count("*").alias("n")).collect()}
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    dealt = split(np.array([quotas[s] for s in names], dtype=np.int64), shards, np.random.Generator(np.random.PCG64(seed))) if names else np.zeros((shards, 0), int)
    ends = literal([{"s": s, "ends": [int(x) for x in dealt[:, i].cumsum()]} for i, s in enumerate(names)], "s:string,ends:array<bigint>")
    # each shard draws the next blocks of its source's permuted sequence: disjoint, and as many as its quota
    seq = taken.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("pass", order(F.col("pass").cast("string")).alias("o"), "block"))).alias("all"))
    at = seq.join(few(ends), on).select("source", "ends", F.posexplode("all").alias("at", "x"))
    placed = at.select("source", "x.block", F.struct("x.pass", F.size(F.filter("ends", lambda e: e <= F.col("at"))).alias("shard")).alias("take"))
    return placed.groupBy("source", "block").agg(F.array_sort(F.collect_list("take")).alias("takes")), want


def sized(rows: DataFrame, doc_id: str, text: str, seed: int = SEED) -> DataFrame:
    """rows with _size (words; null has none) and _block, which depends on the row's id and text alone."""
    return rows.select(
        "*", n_words(F.col(text)).alias("_size"), F.pmod(_key(F.col(doc_id), F.col(text), seed, "block"), F.lit(BLOCKS)).alias("_block"))


def mixed(rows: DataFrame, source: str, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Rows of sized() with _source_size, _target and _takes, an array of (pass, shard) for each time that a row is taken.

    A source has BLOCKS blocks at most, so quotas, draws and the permutation are over blocks and stay small however large a
    source is. Rows with equal id and text share a block. A source without words has target 0 and none of its rows is taken.
    """
    scratch = Scratch(rows.sparkSession)
    blocks = scratch.write(
        rows.groupBy(F.col(source).alias("source"), F.col("_block").alias("block")).agg(F.sum("_size").alias("words")), "blocks")
    plan, want = _plan(blocks, shards, seed, scratch)
    few = F.broadcast if len(want) <= FEW else lambda df: df
    sums = blocks.groupBy("source").agg(F.sum("words").alias("_source_size"))
    goal = F.from_json(F.lit(json.dumps([{"s": s, "t": t} for s, t in want.items()])), "array<struct<s:string,t:double>>")
    goals = rows.sparkSession.range(1, numPartitions=1).select(F.explode(goal).alias("g")).select("g.s", F.col("g.t").alias("_target"))
    every = (
        blocks.select("source", "block").join(plan.select(F.col("source").alias("ps"), F.col("block").alias("pb"), "takes"),
            F.col("source").eqNullSafe(F.col("ps")) & (F.col("block") == F.col("pb")), "left")
        .join(few(sums.withColumnRenamed("source", "ss")), F.col("source").eqNullSafe(F.col("ss")))
        .join(few(goals), F.col("source").eqNullSafe(F.col("s")))
        .select(F.col("source").alias("_ps"), F.col("block").alias("_pb"), "_source_size", "_target", F.coalesce("takes", F.expr("cast(array() as array<struct<pass:int,shard:int>>)")).alias("_takes"))
    )
    every = scratch.write(every, "plan")
    small = every.count() <= 200_000  # a row is some 50 bytes; beyond this the plan is joined by its key, which BLOCKS spread
    return rows.join(F.broadcast(every) if small else every, F.col(source).eqNullSafe(F.col("_ps")) & (F.col("_block") == F.col("_pb"))).drop("_ps", "_pb", "_block")


def mix_digest(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) and shards (one for each time taken, as the tree deals them), of all docs.

    Texts are read once, for their sizes and blocks. Null texts have size 0, a null source is one of its own, repeated rows
    each answer, an empty table gives no rows; other columns are not read.
    """
    light = Scratch(docs.sparkSession).write(sized(docs.select("doc_id", "source", "text"), "doc_id", "text").drop("text"), "sized")
    return mixed(light, "source").select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.size("_takes")).alias("taken"), F.col("_takes.shard").alias("shards"),
    )


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of the mix, each as often as it is taken, with the columns of docs; see mixed() for nulls and ties.

    Rows lie in shard order, and within a shard in a shuffled order: keyed bits of shard, pass and row.
    An empty table gives no rows.
    """
    names = docs.columns
    held = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    at = {c: f"c{i}" for i, c in enumerate(names)}
    got = mixed(sized(held, at["doc_id"], at["text"], seed), at["source"], shards, seed)
    each = got.withColumn("_take", F.explode("_takes"))
    local = F.xxhash64("_take.shard", "_take.pass", _key(F.col(at["doc_id"]), F.col(at["text"]), seed, "local"))
    shuffled = each.select(*at.values(), F.col("_take.shard").alias("_shard"), local.alias("_o"))
    # ranges, so that shards are cut as finely as their rows ask for
    shuffled = shuffled.repartitionByRange("_shard", "_o").sortWithinPartitions("_shard", "_o")
    return shuffled.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))


#: DuckDB: all but `shards`, whose draw SQL does not make; the tests hold both against it and against enumerated draws.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size,
         ('0x' || substr(md5('11:block:' || coalesce(cast(doc_id AS varchar), 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::bigint % 1024 AS block
  FROM documents),
b AS (SELECT source, block, sum(size)::bigint AS words FROM d GROUP BY ALL),
s AS (SELECT source, sum(words)::bigint AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM b GROUP BY source),
w AS (SELECT *, [3, 1, 2][(i % 3 + 1)::int] AS weight FROM s),
q AS (SELECT *, row_number() OVER (ORDER BY 2 * n / weight, source NULLS LAST) AS k FROM w),
t AS (
  SELECT 0::bigint AS k, NULL::varchar AS source, 0::double AS target, 1.5::double * (SELECT sum(n) FROM q)::double AS room, (SELECT sum(weight) FROM q)::double AS open_weight
  UNION ALL
  SELECT q.k, q.source, least(2 * q.n, t.room * q.weight / t.open_weight), t.room - least(2 * q.n, t.room * q.weight / t.open_weight), t.open_weight - q.weight
  FROM t JOIN q ON q.k = t.k + 1),
g AS (
  SELECT q.source, q.n, t.target, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::bigint AS passes
  FROM q JOIN t ON q.k = t.k),
o AS (
  SELECT b.source, b.block, b.words, floor(g.target - g.passes * g.n)::bigint AS rest,
         row_number() OVER (PARTITION BY b.source ORDER BY md5('11:part:' || coalesce(b.source, '') || ':' || b.block), b.block) AS p
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
f AS (
  SELECT source, block, p, (words > 0 AND words <= rest) AS got, CASE WHEN words > 0 AND words <= rest THEN rest - words ELSE rest END AS rest
  FROM o WHERE p = 1
  UNION ALL
  SELECT o.source, o.block, o.p, (o.words > 0 AND o.words <= f.rest), CASE WHEN o.words > 0 AND o.words <= f.rest THEN f.rest - o.words ELSE f.rest END
  FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.p = f.p + 1),
r AS (SELECT source, min(rest) AS rest FROM f GROUP BY source),
x AS (
  SELECT o.source, arg_min(o.block, [abs(o.words - r.rest), o.p]) AS block
  FROM o JOIN f ON o.source IS NOT DISTINCT FROM f.source AND o.block = f.block JOIN r ON o.source IS NOT DISTINCT FROM r.source
  WHERE NOT f.got AND o.words > 0 AND abs(o.words - r.rest) < r.rest GROUP BY o.source)
SELECT d.doc_id, d.size::bigint AS size, g.n AS source_size, g.target,
       (d.size * (g.passes + (f.got OR coalesce(x.block = d.block, false))::int))::bigint AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
JOIN f ON f.source IS NOT DISTINCT FROM d.source AND f.block = d.block
LEFT JOIN x ON x.source IS NOT DISTINCT FROM d.source
"""
