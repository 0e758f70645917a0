"""Micro-fixtures for the folds and functions that SQL cannot check."""

import itertools
import json
import random
import zipfile
from io import BytesIO

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strataloom.functions import canonical, text
from strataloom.operators import annotations, packing, passages
from strataloom.plans.retrieval import Request, RequestError
from strataloom.sources import epub, html


def test_query_terms():
    assert text.query_terms("The Cat, the dog of it") == (["cat", "dog"], True)
    assert text.query_terms("of it an") == (["of", "it", "an"], False)
    assert text.query_terms(" ,, ") == ([], False)
    assert text.query_terms("Élan vital")[0] == ["elan", "vital"]


@given(st.text(max_size=30))
def test_normal_name_is_idempotent(raw):
    once = text.normal_name(raw)
    assert text.normal_name(once) == once


def test_ngrams():
    assert text.ngrams("A  b c", 2) == ["a", "a b", "b", "b c", "c"]


def test_unfence():
    assert text.unfence(" ```json\n{}\n``` ") == "{}" and text.unfence("```x") == "```x" and text.unfence(" a ") == "a"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n?", min_size=1, max_size=60), max_size=8), st.integers(6, 20))
def test_packing_keeps_the_cap_and_all_words(texts, cap):
    members = [packing.Member(i, t) for i, t in enumerate(texts)]
    runs = packing.pack(members, cap)
    assert all(packing.count_tokens(r.text) == r.tokens <= cap for r in runs)
    assert sum(r.tokens < cap // 2 for r in runs[:-1]) == 0
    words = lambda parts: [w for t in parts for w in t.split()]
    cut = "".join("".join(m.text.split()) for r in runs for m in r.members)
    assert cut == "".join(words(texts))
    for r in runs:
        for m in r.members:
            assert texts[m.unit][m.start : m.start + len(m.text)] == m.text


def test_prefix_counts():
    t = "one two, three (four)\n\nfive"
    assert packing.count_tokens.prefixes(t, list(range(len(t) + 1))) == [packing.count_tokens(t[:i]) for i in range(len(t) + 1)]


def slow_grounded(source, quote):
    q, s = annotations.plain(quote), annotations.plain(source)
    if not q:
        return False
    if q in s:
        return True
    repairs, omissions = min(len(q) // 4, max(4, len(q) * 3 // 20)), max(32, len(q))
    best = {(0, j): 0 for j in range(len(s) + 1)}  # (repairs, place) -> omissions
    for c in q:
        nxt = {}

        def put(e, j, o):
            if e <= repairs and o <= omissions and o < nxt.get((e, j), omissions + 1):
                nxt[e, j] = o

        for (e, j), o in best.items():
            put(e + 1, j, o)
            if j < len(s):
                put(e + (s[j] != c), j + 1, o)
        for e in range(repairs + 1):
            for j in range(1, len(s) + 1):
                if (e, j - 1) in nxt:
                    put(e, j, nxt[e, j - 1] + 1)
        best = nxt
    return bool(best)


def test_grounding():
    rng = random.Random(1)
    for _ in range(120):
        s = "".join(rng.choices("abc", k=rng.randrange(1, 40)))
        q = list(s[rng.randrange(len(s)) :][: rng.randrange(1, 20)])
        for _ in range(rng.randrange(5)):
            q[rng.randrange(len(q))] = rng.choice("abcx")
        assert annotations.grounded(s, "".join(q)) == slow_grounded(s, "".join(q))
    for _ in range(25):  # sources far longer than a window, the quote somewhere in them with letters left out
        q = "".join(rng.choices("abcdefgh", k=30))
        cut = "".join(c + rng.choice(["", "", "", "xy"]) for c in q if rng.random() > 0.1)
        s = "".join(rng.choices("abcdefgh", k=rng.randrange(200))) + rng.choice([cut, q[:15]]) + "".join(rng.choices("abcdefgh", k=rng.randrange(200)))
        assert annotations.grounded(s, q) == slow_grounded(s, q)
    assert not annotations.grounded("abc", " .,")


def test_attribution_falls_back_to_all():
    targets = [("a", "the red fox"), ("b", "a blue whale")]
    assert annotations.attributed(targets, ["blue whale"]) == ["b"] and annotations.attributed(targets, ["zzzzzzzzzzzz"]) == ["a", "b"]


def _p(score, key, parts, source="s"):
    return passages.Passage(score, key, source, parts, {u: "word " * 100 for u, _, _ in parts}, [key])


def test_admission():
    got = passages.admit([_p(3, "a", [("u", 0, 50)]), _p(2, "b", [("u", 10, 40)]), _p(1, "c", [("u", 40, 80)]), _p(0, "d", [("v", 0, 9)])], 10)
    assert [(p.parts, p.matches) for p in got] == [([("u", 0, 80)], ["a", "b", "c"]), ([("v", 0, 9)], ["d"])]
    tight = passages.admit([_p(3, "a", [("u", 0, 50)]), _p(1, "c", [("u", 40, 80)])], 10, max_tokens=12)
    assert [p.parts for p in tight] == [[("u", 0, 50)]]
    assert [p.key for p in passages.admit([_p(1, "b", [("u", 0, 9)]), _p(1, "a", [("w", 0, 9)])], 1)] == ["a"]


@given(st.lists(st.tuples(st.sampled_from("uv"), st.integers(0, 20), st.integers(1, 9)), max_size=6))
def test_union_of_parts(raw):
    parts = [(u, a, a + n) for u, a, n in raw]
    cells = lambda ps: {(u, x) for u, a, b in ps for x in range(a, b)}
    got = passages.union(parts)
    assert cells(got) == cells(parts) and all(x[0] != y[0] or x[2] < y[1] for x, y in itertools.pairwise(got))


def test_canonical_json():
    assert canonical.canonical({"b": 1, "a": ["é", None, True]}) == '{"a":["é",null,true],"b":1}'
    with pytest.raises(ValueError):
        canonical.canonical({"é": 1, "é": 2})
    with pytest.raises(ValueError):
        canonical.canonical(float("inf"))
    assert canonical.canonical_hash({"a": 1, "h": "x"}, without="h") == canonical.canonical_hash({"a": 1})
    assert canonical.canonical_lines([{}, []]) == "{}\n[]"


def test_html_units():
    doc = """<html><head><title>t</title></head><body><section epub:type="chapter"><h2 id="x">A&nbsp; b</h2><p>one<br>two <a href="../c.html#y">l</a></p>
    <table><caption>cap</caption><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table><pre> code  x</pre><script>no()</script></section><p>open"""
    units, links = html.walk(doc)
    assert [(u.type, u.role) for u in units][:3] == [("section", "chapter"), ("text_block", "heading"), ("text_block", "paragraph")]
    assert html.folded("".join(units[1].text)) == "A b" and units[1].level == 2 and units[1].anchor == "x" and units[1].parent == 0
    assert [(u.row, u.column) for u in units if u.type == "table_cell"] == [(0, 0), (0, 1), (1, 1)]
    assert next("".join(u.text) for u in units if u.type == "code_block") == " code  x"
    assert links == [(2, "../c.html#y")] and "no()" not in "".join(t for u in units for t in u.text)
    assert units[0].path == "/html[1]/body[1]/section[1]"


def test_href():
    assert html.resolve("a/b.html", "../c%20d.html#x%20y") == "c d.html#x y" and html.resolve("a/b.html", "#z") == "a/b.html#z"
    assert html.resolve("b.html", "../../x") is None and html.resolve("b.html", "mailto:a@b") is None and html.resolve("b.html", "//host/x") is None


def test_clean_prose():
    assert html.clean_prose("a\xad b \t c \n d don 't it ’ s") == "a b c\nd don't it’s"


def book():
    out = BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title><dc:language>en</dc:language></metadata><manifest><item id="n" href="n.xhtml" properties="nav"/><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("O/n.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="a.xhtml">One</a><ol><li><a href="b.xhtml#x">Two</a></li></ol></li></ol></nav></body></html>')
        z.writestr("O/a.xhtml", "<p>A</p>")
        z.writestr("O/b.xhtml", "<p>B</p>")
    return out.getvalue()


def test_epub(spark):
    files = epub.members(book())
    info = epub.package(files)
    assert info["spine"] == ["O/b.xhtml", "O/a.xhtml"] and info["title"] == "T"
    assert epub.navigation(files, info) == [("One", "O/a.xhtml", 1), ("Two", "O/b.xhtml#x", 2)]
    rows = epub.pages(spark.createDataFrame([("x.epub", book()), ("bad.epub", b"no zip")], "path string, content binary")).collect()
    assert [(r["page_id"], r["html"], r["error"] is None) for r in rows] == [(0, "<p>B</p>", True), (1, "<p>A</p>", True), (None, None, False)]


def test_requests():
    assert Request.parse({"query": " a ", "source_ids": []}).source_ids is None
    for bad in ({"query": " "}, {"query": "a", "x": 1}, {"query": "a", "max_results": 0}, {"query": "a" * 9000}):
        with pytest.raises(RequestError):
            Request.parse(bad)


def test_json_round_trip(spark):
    from strataloom.sources import store

    df = spark.createDataFrame([(1, None, [1.5]), (2, "é", [])], "a long, b string, c array<double>")
    back = store.import_json(store.export_json(df), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    assert json.loads(store.export_json(df).orderBy("value").first()["value"]) == {"a": 1, "c": [1.5]}


def test_artifact_store(spark, tmp_path):
    from strataloom.sources import store

    path = str(tmp_path / "s")
    blobs = spark.createDataFrame([(b"x",), (b"y",), (b"x",)], "content binary")
    assert store.put(spark, path, blobs).count() == 2
    more = spark.createDataFrame([(b"x",), (b"z",)], "content binary")
    store.put(spark, path, more)
    got = store.get(spark, path, more.selectExpr("sha2(content, 256) as hash")).collect()
    assert sorted(r["content"] for r in got) == [b"x", b"z"]
    assert spark.read.parquet(path).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    from strataloom.operators.lifecycle import coalesced
    from strataloom.streaming.queue import QueueSink

    rng = random.Random(1)
    schema = "source_key string, detected_at timestamp, operation_id long"
    rows = [(f"k{rng.randrange(5)}", __import__("datetime").datetime(2024, 1, 1, 0, i), i if i % 3 else None) for i in range(30)]
    for i in range(3):
        spark.createDataFrame(rows[i * 10 : i * 10 + 10], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sink = QueueSink(spark, f"{tmp_path}/q")
    sink.start(stream, f"{tmp_path}/ck").awaitTermination()
    want = sorted(coalesced(spark.createDataFrame(rows, schema)).drop("operation_id").collect())
    assert sorted(sink.version(2).drop("operation_id", "attempts", "error").collect()) == want
