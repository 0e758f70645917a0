"""Feistel sharding against its own Python integers, and the laws of its docstrings."""

import zlib

import pytest

from strataloom.llm.sharding import Feistel, shard, shard_digest


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 97, 1000, 4097])
def test_a_permutation(n):
    f = Feistel(n)
    assert sorted(map(f, range(n))) == list(range(n))


def test_columns_equal_integers(spark):
    for n in (1, 7, 500):
        f = Feistel(n, seed=9)
        got = f.columns(spark.range(n), "id", "p").collect()
        assert {r["id"]: r["p"] for r in got} == {i: f(i) for i in range(n)}


def rows():
    out = [(i * 3, f"text {i} é") for i in range(200)]
    return out + [(None, "x"), (None, None), (1, None), (1, ""), (6, "text 2 é"), (6, "text 2 é"), (2, "w " * 5000)]


def places(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_python(spark):
    data = rows()
    key = lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()))
    f = Feistel(len(data))
    want = []
    for i, (d, t) in enumerate(sorted(data, key=key)):
        b, p = (t or "").encode(), f(i)
        want.append((d, len(b) + 1, zlib.crc32(b), "rows", p % 8, p // 8, None))
    docs = spark.createDataFrame([(d, t, 5, "z") for d, t in data], "doc_id long, text string, _row int, slot string")
    assert places(shard_digest(docs)) == sorted(want, key=str)
    assert places(shard_digest(docs.repartition(3))) == sorted(want, key=str)


def test_whole_rows(spark):
    docs = spark.createDataFrame([(d, t, 5, "z") for d, t in rows()], "doc_id long, text string, _p int, slot string")
    got = shard(docs, shards=3)
    assert got.columns == ["doc_id", "text", "_p", "shard", "slot"]
    by = {}
    for r in got.collect():
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shard_digest(docs).collect() == [] and shard(docs).collect() == []
