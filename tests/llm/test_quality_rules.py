"""Rule counts and thresholds against brute force and SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from strataloom.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, n_words string, stratum int"


def rows():
    rng = random.Random(4)
    out = []
    for i in range(300):
        words = [rng.choice("abcdefgh") * rng.randrange(1, 9) + rng.choice(["", "#", "é😀"]) for _ in range(rng.randrange(0, 80))]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t", " \r\n"]) for w in words)
        if i % 7 == 0:
            text += "\n" + text
        out.append((i, text, rng.choice(["en", "fr", None]), "x", 1))
    long = " ".join(str(j % 3001) for j in range(9000))
    return out + [(None, "a b", "en", "x", 1), (900, None, None, "x", 1), (901, "", "en", "x", 1), (902, "a a a a a a a a a a a", "en", "x", 1), (903, long, "fr", "x", 1), (1, out[1][1], "en", "x", 1)]


def slow(text):
    t = text or ""
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t) if x]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    c = Counter(grams)
    inside = {i + j for i, g in enumerate(grams) if c[g] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if x.strip(" \t\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(x in Q.SYMBOLS for x in t), len(lines) - len(set(lines)), len(inside)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    labels = spark.createDataFrame([(i, int("#" not in (rows()[i][1] or "")[:60])) for i in range(250)] + [(None, 1), (3, None), (4, 0)], "doc_id long, quality int")
    return docs, labels


def test_counts(tables):
    got = sorted(((r["doc_id"], *r[1:6]) for r in Q.judge(*tables).collect()), key=str)
    want = sorted(((d, *slow(t)) for d, t, *_ in rows()), key=str)
    assert got == want


def test_against_sql(tables):
    con = duckdb.connect()
    con.register("documents", tables[0].select("doc_id", "text", "lang").toArrow())
    con.register("labels", tables[1].toArrow())
    got = sorted((tuple(r) for r in Q.judge(*tables).collect()), key=str)
    assert got == sorted(con.sql(Q.oracle()).fetchall(), key=str)


def test_exact_bound(spark):
    risk = math.log(0.01)
    ns = [1, 50, 300, 2000]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", Q.most_allowed(F.col("n"), 0.02, F.lit(risk)).alias("x")).collect()
    for r in got:
        total, x = 0.0, -1
        for k in range(r["n"] + 1):
            total += math.comb(r["n"], k) * 0.02**k * 0.98 ** (r["n"] - k)
            if total > 0.01:
                break
            x = k
        assert r["x"] == x


def test_good_documents_stay(spark):
    rng = random.Random(8)
    make = lambda bad: " ".join(rng.choice(["tree", "river", "stone"]) + str(rng.randrange(400)) + ("###" if bad else "") for _ in range(40))
    data = [(i, make(i % 5 == 0), "en") for i in range(4000)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(4000)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in Q.judge(docs, labels).collect()}
    assert not any(got[i] for i in range(0, 4000, 5)) and all(got[i] for i in range(4000) if i % 5)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Q.judge(empty, spark.createDataFrame([], "doc_id long, quality int")).collect() == []
