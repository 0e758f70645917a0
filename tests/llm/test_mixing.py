"""Mixing against the SQL text on a small table, its laws, and the edge cases of its docstrings."""

import itertools
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, _size int, takes string"


def rows():
    rng = random.Random(2)
    out = [(i, " ".join("w" * (j % 5 + 1) for j in range(rng.randrange(60))), rng.choice(["a", "b", "b", "c", "d", None]), 7, "x") for i in range(900)]
    return out + [(None, "x y", "a", 7, "x"), (5000, None, "a", 7, "x"), (5001, "", "only empty", 7, "x"), (1, out[1][1], out[1][2], 7, "x"), (1, out[1][1], out[1][2], 7, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def test_against_sql(docs):
    got = sorted((tuple(r) for r in mixing.mix_digest(docs).drop("shards").collect()), key=str)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = sorted(con.sql(mixing.ORACLE).fetchall(), key=str)
    assert [tuple(r) for r in got] == want


def test_laws(docs):
    got = mixing.mix_digest(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").toPandas()
    for _, part in got.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 0.02 * part.target.iloc[0] + 10
    assert (got.taken <= 2 * got["size"]).all()


def test_mix_repeats_what_it_takes(docs):
    taken = {}
    for r in mixing.mix_digest(docs).collect():
        if r["size"]:
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"] // r["size"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    seen = {}
    for r in mixed.filter("trim(text) <> ''").collect():
        seen[r["doc_id"]] = seen.get(r["doc_id"], 0) + 1
    assert seen == {k: v for k, v in taken.items() if v}


def test_targets_by_resharing():
    def slow(sizes):
        order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
        weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(order)}
        cap, fixed = {s: 2 * n for s, n in order}, {}
        while True:
            left = 1.5 * sum(n for _, n in order) - sum(fixed.values())
            live = [s for s in weight if s not in fixed]
            share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
            over = [s for s in live if share[s] > cap[s]]
            if not over:
                return fixed | share
            fixed |= {s: cap[s] for s in over}

    for sizes in ([("a", 10), ("b", 5), ("c", 1000)], [("x", 3), (None, 90), ("m", 0), ("z", 40)], [("k", 5)]):
        got = mixing.targets(sizes)
        assert got == pytest.approx(slow(sizes))


def test_draws_are_hypergeometric():
    """The shares of all outcomes of a small tree, against their exact probabilities."""
    quotas = np.array([3, 2, 1])
    seen = Counter()
    for i in range(6000):
        got = mixing.split(quotas, 4, np.random.default_rng(i))
        seen[tuple(map(tuple, got))] += 1
    left = Counter()
    for got, n in seen.items():
        left[tuple(np.array(got[:2]).sum(axis=0))] += n
    half = 3
    for a in itertools.product(range(4), range(3), range(2)):
        if sum(a) == half:
            p = math.prod(math.comb(q, k) for q, k in zip(quotas.tolist(), a, strict=True)) / math.comb(6, half)
            assert abs(left[a] / 6000 - p) < 5 * math.sqrt(p * (1 - p) / 6000)
    assert sum(left.values()) == 6000


def test_shards_are_the_trees(docs):
    """Blocks of each source in each shard, as many as the tree's draw of the quotas; every take is in one shard."""
    rows_ = mixing.sized(docs.select("doc_id", "source", "text"), "doc_id", "text").withColumn("block", F.col("_block"))
    got = mixing.mixed(rows_, "source").select("source", "block", F.col("_takes.shard").alias("shards")).collect()
    blocks = {(r["source"], r["block"]): r["shards"] for r in got}
    quotas, dealt = Counter(), Counter()
    for (s, _), at in ((k, v) for k, v in blocks.items() if v):
        quotas[s] += len(at)
        dealt.update((s, x) for x in at)
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    want = mixing.split(np.array([quotas[s] for s in names]), mixing.SHARDS, np.random.Generator(np.random.PCG64(mixing.SEED)))
    assert {(s, h): n for (s, h), n in dealt.items()} == {(s, h): int(want[h, i]) for i, s in enumerate(names) for h in range(mixing.SHARDS) if want[h, i]}


def test_a_source_of_few_large_documents(spark):
    rows = [(1, "w " * 1000, "a"), (2, "w " * 900, "a"), *((10 + i, "x " * 30, "b") for i in range(10))]
    got = mixing.mix_digest(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken = sum(r["taken"] for r in got if r["doc_id"] < 10)
    target = next(r["target"] for r in got if r["doc_id"] == 1)
    assert taken > 0 and abs(taken - target) <= 500


def test_tree_keeps_quotas():
    quotas = np.array([7, 0, 100, 33])
    got = mixing.split(quotas, 5, np.random.default_rng(1))
    assert (got.sum(axis=0) == quotas).all() and got.sum(axis=1).max() - got.sum(axis=1).min() <= 2


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_digest(empty).collect() == [] and mixing.mix(empty).collect() == []
