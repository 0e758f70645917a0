"""The retrieval engine: lists, windows, flags and budgets, on small tables."""

import math
import random

import pytest

from strataloom.operators.annotations import scan
from strataloom.operators.packing import count_tokens
from strataloom.operators.passages import Passage, candidate_id, clipped
from strataloom.plans.retrieval import Engine


def cosine(a, b):
    return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))


def test_scan_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["source", "entity", "summary"]), rng.randrange(12), i, [float(rng.randrange(-2, 3)) for _ in range(2)]) for i in range(80)]
    rows += [("entity", 99, 200, [1.0, 0.0]), (None, 1, 201, None), ("source", 3, 202, None)]
    query, cap = [1.0, 2.0], 5
    best = {}
    for kind, window, number, vector in rows:
        if vector and any(vector):
            s = round(cosine(vector, query), 12)
            if (kind, window) not in best or (-s, number) < best[kind, window]:
                best[kind, window] = (-s, number)
    want = []
    for kind in ("source", "entity", "summary"):
        own = [(round(best[k][0], 12), best["source", k[1]][0], str(k[1])) for k in best if k[0] == kind and ("source", k[1]) in best]
        want += [(kind, int(w), at) for at, (_, _, w) in enumerate(sorted(own)[:cap], 1)]
    got = scan(spark.createDataFrame(rows, "kind string, window_id long, vector_id long, vector array<double>"), query, cap)
    found = [(r["list"], r["window_id"], r["position"]) for r in got.collect()]
    # equal directions may differ in the last bit of their cosine, so the order is compared by scores
    score = lambda k, w: round(-best[k, w][0], 9)
    assert sorted((k, at, score(k, w)) for k, w, at in found) == sorted((k, at, score(k, w)) for k, w, at in want)
    assert 99 not in {w for _, w, _ in found}  # no source vector, no nomination


@pytest.mark.parametrize(("parts", "kept"), [([("a", 0, 11), ("b", 0, 11)], 1), ([("a", 0, 11)], 1), ([("a", 0, 3), ("b", 0, 3)], 2)])
def test_clipped(parts, kept):
    # two special tokens are counted with the words
    text = {"a": "one two six", "b": "ten two six"}
    out = clipped(Passage(1.0, "k", "s", parts, text, ["a", "b"]), max_tokens=4)
    assert len(out.parts) == kept and count_tokens(out.text()) <= 4 and out.text()
    assert out.text() == "\n\n".join(text[u][:7] if kept == 1 else text[u][:3] for u, _, _ in out.parts)


def test_clipped_without_words():
    assert clipped(Passage(1.0, "k", "s", [("a", 0, 0)], {"a": ""}, ["a"])).parts == [("a", 0, 0)]
    assert clipped(Passage(1.0, "k", "s", [("a", 0, 3)], {"a": "one"}, ["a"]), max_tokens=2).parts == []


def test_candidate_id_is_of_source_and_ranges():
    p = Passage(1.0, "k", "s", [("a", 0, 3)], {"a": "one"})
    assert candidate_id(p) == candidate_id(Passage(2.0, "x", "s", [("a", 0, 3)], {"a": "two"})) != candidate_id(Passage(1.0, "k", "t", p.parts, p.text_of))


@pytest.fixture(scope="module")
def tables(spark):
    n = 12
    frame = spark.createDataFrame
    return {
        "objects": frame([(i, i if i != 5 else None, None) for i in range(n)], "source_id long, active_parse_id long, deactivated_at string"),
        "locations": frame([(i, "fs", f"/{i}", "current", "d") for i in range(n)], "source_id long, source_system string, native_uri string, status string, governance_domain string"),
        "chunks": frame([(i, i, None if i == 7 else f"river number {i} " + "word " * (700 if i == 2 else 3), [i]) for i in range(n)], "chunk_id long, parse_id long, text string, unit_ids array<long>"),
        "vectors": frame([(i, i, [1.0, i / 4.0], [i]) for i in range(n)], "chunk_id long, parse_id long, vector array<double>, unit_ids array<long>"),
    }


def test_all_lists_and_flags(spark, tables):
    frame = spark.createDataFrame
    engine = Engine(
        **tables, embed=lambda _: [1.0, 0.5], embed_tokens=lambda _: [[1.0, 0.5], [0.0, 1.0]],
        nodes=frame([(9, "river", [9]), (5, "river", [5])], "parse_id long, name string, unit_ids array<long>"), links=frame([], "parse_id long, from_name string, to_name string, unit_ids array<long>"),
        names=frame([(8, "lake", [1.0, 0.5])], "parse_id long, name string, vector array<double>"),
        windows=frame([(0, 0, [1.0, 0.0], [0, 1, 2]), (1, 3, [0.0, 1.0], [3, 4, 5])], "window_id long, parse_id long, vector array<double>, unit_ids array<long>"),
        published=frame([("source", 0, 0, 1, [1.0, 0.0]), ("entity", 0, 0, 2, [0.0, 1.0])], "kind string, parse_id long, window_id long, vector_id long, vector array<double>"),
        matrices=frame([(i, [i], [[1.0, i / 4.0]]) for i in range(12)], "window_id long, chunk_ids array<long>, matrix array<array<double>>"),
        relationships=frame([(i, i + 1, "precedes") for i in range(12)] * 2, "from_id long, to_id long, type string"), annotations=frame([(70 + i, [i]) for i in range(12)], "annotation_id long, unit_ids array<long>"))
    from strataloom.plans.retrieval import Request

    lists = engine.channels(Request.parse({"query": "river"})).collect()
    assert {r["list"] for r in lists} == {"dense", "lexical", "graph", "source", "entity"}
    assert "w0" in {r["key"] for r in lists} and not {"u0", "u1", "u2", "u5"} & {r["key"] for r in lists}
    got = engine.query({"query": "river", "max_results": 100, "include_relationships": True, "include_annotations": True}).collect()
    units = {u for r in got for u in r["unit_ids"]}
    assert units == {str(i) for i in range(12)} - {"5", "7"}  # 5 serves no parse, 7 has no text
    assert all(count_tokens(r["text"]) <= 512 for r in got) and [r["rank"] for r in sorted(got, key=lambda r: r["rank"])] == list(range(1, len(got) + 1))
    for r in got:
        assert [(e["from_id"], e["to_id"]) for e in r["relationships"] or []] == sorted((u, str(int(u) + 1)) for u in r["unit_ids"] if str(int(u) + 1) in units)
        assert r["annotations"] == [70 + int(u) for u in r["unit_ids"]]


def test_only_the_least_tables(tables):
    engine = Engine(**tables, embed=lambda _: [1.0, 0.5])
    got = engine.query({"query": "river", "include_relationships": True, "include_locators": False, "max_results": 3}).collect()
    assert len(got) == 3 and "relationships" not in got[0].asDict() and "locations" not in got[0].asDict()


def test_nothing_in_scope(tables):
    assert Engine(**tables, embed=lambda _: [1.0, 0.5]).query({"query": "river", "source_ids": [5]}).collect() == []
