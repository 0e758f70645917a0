"""Licence digests against SQL, and what normalising makes equal."""

import duckdb

from strataloom.llm import licenses as L


def rows():
    return [
        (1, "Copyright (c) 2024 A. Person\nAll rights reserved.\n\n" + L.MIT), (2, L.MIT.upper().replace(" ", "\n  ")), (3, L.MIT + " more"), (4, None), (5, " .,\n"),
        (6, L.ZLIB.replace("acknowledgment", "acknowledgement")), (7, "# © someone\n" + L.APACHE_NOTICE + "\n"), (None, "Released under the MIT licence"), (1, L.UNLICENSE),
        (8, "word " * 30000), (9, "no license at all"), (10, "Copyright 2020 x"), (11, "Ein Wort, über")]


def docs(spark):
    return spark.createDataFrame([(d, t, "x") for d, t in rows()], "doc_id long, text string, license_id string")


def test_known_texts(spark):
    got = [(r["doc_id"], r["license_id"]) for r in L.scan(docs(spark)).collect()]
    want = [(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (6, "Zlib"), (7, "Apache-2.0"), (None, "MIT"), (1, "Unlicense"), (8, None), (9, None), (10, None), (11, None)]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_against_sql(spark):
    con = duckdb.connect()
    con.register("documents", docs(spark).select("doc_id", "text").toArrow())
    got = sorted((tuple(r) for r in L.scan(docs(spark)).collect()), key=str)
    assert got == sorted(con.sql(L.oracle()).fetchall(), key=str)


def test_empty(spark):
    assert L.scan(docs(spark).limit(0)).collect() == []
