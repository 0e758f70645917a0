"""Queries over small tables of their own, against brute force: no part of the input may be left out."""

import hashlib
from collections import defaultdict

import pytest

from strataloom.plans.catalog import QUERIES


@pytest.fixture
def put(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


LINES = "l_orderkey long, l_partkey long, l_linenumber int"
LINEITEM = [(k * 37 % 1100, k * 7 % 30, k % 7 + 1) for k in range(200)]
ORDERS = [(k, k * 11 % 30, str(k % 3)) for k in range(1, 61)]


def overlaps():
    pairs = set()
    for k, unit, _ in ORDERS:
        a, b = (None if k % 9 == 0 else k % 7 * 10 + 3), k % 7 * 10 + 8
        for order, part, line in LINEITEM:
            if unit % 900 == part % 900 and (a is None or (a < line * 10 + 15 and line * 10 < b)):
                pairs.add((k, order % 500))
    return pairs


def test_overlap_of_all_annotations(spark, put):
    put("lineitem", LINEITEM, LINES)
    d = put("orders", ORDERS, "o_orderkey long, o_custkey long, o_orderpriority string")
    want = overlaps()
    assert {tuple(r) for r in QUERIES["annotation_window_overlap_join"](spark, d).select("annotation_id", "window_id").collect()} == want
    members = defaultdict(list)
    for k, w in sorted(want):
        members[w].append(f"{k}:{hashlib.md5(ORDERS[k - 1][2].encode()).hexdigest()}")
    hashes = {(w, len(m), hashlib.sha256(",".join(m).encode()).hexdigest()) for w, m in members.items()}
    assert {tuple(r) for r in QUERIES["cohort_grouping"](spark, d).select("window_id", "n_members", "input_hash").collect()} == hashes


def test_seeds_of_all_documents(spark, put):
    d = put("documents", [(i, "\n\n".join(f"words {i} {j}" for j in range(3))) for i in range(1, 13)], "doc_id long, text string")
    admitted = QUERIES["passage_admission"](spark, d).collect()
    assert {(r["query_id"], int(r["source_id"])) for r in admitted} == {(i % 3, i) for i in range(1, 13)}
    units = {f"{i}:{j:06}" for i in range(1, 13) for j in range(1, 4)}
    assert {r["unit_id"] for r in QUERIES["evidence_pack"](spark, d).collect()} == units
    assert {r["unit_id"] for r in QUERIES["passage_provenance"](spark, d).collect()} == units


def test_guard_of_all_parses(spark, put):
    kinds = ["error", "purchase", "click", "view"]
    rows = [(i, i % 9, kinds[i * 7 % 4] if i % 9 < 6 else kinds[i % 9 - 5], 30.0 if i % 5 else 10.0, f"2024-01-01 00:00:{i:02}") for i in range(60)]
    d = put("events", spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double, ts string").selectExpr("event_id", "user_id", "event_type", "value", "cast(ts as timestamp) ts").collect(),
            "event_id long, user_id long, event_type string, value double, ts timestamp")
    of = defaultdict(set)
    for _, user, kind, value, _ in rows:
        of[user].add("gate" if kind == "click" and value <= 20 else "building" if kind == "view" else "settled")
    want = {(u, next(g for g in ("gate", "settled", "building") if g in s)) for u, s in of.items()}
    assert {tuple(r) for r in QUERIES["retry_guard"](spark, d).select("source_id", "guard").collect()} == want


def test_window_of_unit_over_all_windows(spark, put):
    d = put("lineitem", LINEITEM + [(3, 40, 1), (503, 40, 2), (3, 41, 1), (120, 41, 1), (499, 42, 1)], LINES)
    of = defaultdict(set)
    for order, part, _ in [*LINEITEM, (3, 40, 1), (503, 40, 2), (3, 41, 1), (120, 41, 1), (499, 42, 1)]:
        of[part % 900].add(order % 500)
    want = {(u, min(w) if len(w) == 1 else None) for u, w in of.items()}
    assert {(40, 3), (41, None), (42, 499)} <= want
    assert {tuple(r) for r in QUERIES["single_window_of_unit"](spark, d).select("unit_id", "window_id").collect()} == want


def test_postings_of_rare_terms(spark, put):
    d = put("documents", [(i, "s", f"common word{i} word{i}") for i in range(25)], "doc_id long, source string, text string")
    want = {("common", 25, 25)} | {(f"word{i}", 1, 2) for i in range(25)}
    assert {tuple(r) for r in QUERIES["lexical_postings"](spark, d).select("term", "df", "uses").collect()} == want


def test_grounding_of_changed_and_short_items(spark, put):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    put("benchmark", [(1, item), (2, "quebec romeo sierra tango")], "item_id long, text string")
    texts = [f"before {item} after", f"before {item.replace('lima', 'limo')} after", item.upper(), item.replace("kilo lima", "kilo, lima!"), item.replace("hotel", "hotol"),
             "the Quebec, Romeo sierra; tango here", "nothing of it"]
    d = put("documents", list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["fuzzy_grounding"](spark, d).collect() if r["grounded"]}
    assert got == {(i, 1) for i in range(5)} | {(5, 2)}
