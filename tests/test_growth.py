"""Steps that must not grow faster than their input, and the same results as before."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from strataloom.functions import text
from strataloom.operators import annotations, graph, lexical, packing
from strataloom.plans import grain_queries, retrieval, tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def cited(spark):
    rng = random.Random(5)
    span = lambda: rng.choice([(None, 9), (3, None)]) if rng.random() < 0.2 else (a := rng.randrange(40), a + rng.randrange(-2, 9))
    refs = [(rng.randrange(80), rng.choice([None, *range(6)]), *span()) for _ in range(200)]
    frags = [(f"w{rng.randrange(12)}", rng.choice([None, *range(6)]), *span()) for _ in range(150)]
    return refs, frags, spark.createDataFrame(refs, "annotation_id long, unit_id long, start_char int, end_char int"), spark.createDataFrame(frags, "window_id string, unit_id long, start_char int, end_char int")


def test_overlaps_are_joined_by_sets_of_ranges(spark):
    refs, frags, r, f = cited(spark)
    want = {(i, w) for i, u, a, b in refs for w, v, c, d in frags if u is not None and u == v and (None in (a, b, c, d) or (a < d and c < b))}
    got = annotations.overlapping(r, f)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    text = plan(got)
    assert text.index("Generate explode(windows") < text.index("Exchange"), "pairs are not shuffled"


def test_cohorts_without_pairs(spark):
    _, _, r, f = cited(spark)
    inputs = spark.range(70).select(F.col("id").alias("annotation_id"), F.when(F.col("id") % 5 > 0, F.md5(F.col("id").cast("string"))).alias("content_hash"))
    inputs = inputs.union(inputs.filter("annotation_id < 9").withColumn("content_hash", F.lit("other")))
    want = annotations.cohorts(annotations.overlapping(r, f), inputs)
    assert sorted(map(tuple, annotations.overlap_cohorts(r, f, inputs).collect())) == sorted(map(tuple, want.collect()))


def test_postings_are_made_within_rows(spark):
    text = "a b a, ab a! B 7 77 7 straße Ab  ab.a"
    rows = spark.createDataFrame([(1, 1, text), (1, 2, None), (2, 3, " - "), (2, 4, "x")], "parse_id long, chunk_id long, text string")
    got = lexical.postings(rows)
    want = [(1, 1, t, n) for t, n in Counter("a b a ab a b 7 77 7 straße ab ab a".split()).items()] + [(2, 4, "x", 1)]
    assert sorted((r.parse_id, r.chunk_id, r.term, r.tf) for r in got.collect()) == sorted(want)
    assert {r.dl for r in got.filter("chunk_id = 1").collect()} == {13}
    assert "Exchange" not in plan(got)


def test_lexical_list_of_the_pool_is_capped_by_source_alone(spark, tmp_path):
    rows = [(i, "the idiot clown" + " word" * (i % 50), "en", f"src{i % 2}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(i, f"l{i % 3}", [float(i % 7), 1.0, 2.0]) for i in range(16)], "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    engine = retrieval.document_engine(spark, str(tmp_path))
    lists = engine.channels(retrieval.Request.parse({"query": "idiot clown"})).filter("list = 'lexical'")
    assert lists.count() > retrieval.CHANNEL_CAP
    want = con.sql(retrieval.fused_candidates_sql()).fetchall()
    got = retrieval.fused_candidates(spark, str(tmp_path)).select("key", "score", "rank").collect()
    assert sorted((k, round(s, 9), r) for k, s, r in got) == sorted((k, round(s, 9), r) for k, s, r in want)


def put(spark, folder):
    rows = [(i, "the idiot clown" + " word" * (i % 50), "en", f"src{i % 2}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, f"l{i % 3}", [float(i % 7), 1.0, 2.0]) for i in range(16)], "vec_id long, label string, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


def odd_texts():
    rng = random.Random(8)
    pool = "ab AÁáÀçÇßΣσς İ\u0870\u0e33क\u093e\u0967٣Ⅷ²ⅷ中\u9fa6\u9fff가\U0001e4d0\U0001d7d8\U00010d50_-.\n"
    return [None, "", " - _ ", "İ a\u0307", *("".join(rng.choices(pool, k=n)) for n in [3] * 30 + [60] * 30)]


def test_words_in_python_are_those_of_the_jvm(spark):
    every = [chr(i) for i in range(1, 0x30000) if not 0xD800 <= i < 0xE000]
    texts = [t or "" for t in odd_texts()] + ["a".join(every[i : i + 512]) for i in range(0, len(every), 512)]
    gap = F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split = text.splitter(spark)
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("low"), gap.alias("words")).collect():
        assert split(r.low) == r.words


def test_index_is_built_in_segments_without_a_shuffle(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lexical.Index, "SEGMENT", 50)
    texts = odd_texts() + ["common river", "river river common", "Ríver ríver river"] * 500
    rows = spark.createDataFrame([(f"s{i % 3}", i, t) for i, t in enumerate(texts)], "parse_id string, chunk_id long, text string").repartition(3)
    rows = spark.createDataFrame(rows.collect(), rows.schema)  # else its shuffle is counted
    tracker, group = spark.sparkContext.statusTracker(), str(tmp_path)
    spark.sparkContext.setJobGroup(group, "build")
    index = lexical.Index.build(rows, f"{tmp_path}/index")
    first = tracker.getJobInfo(min(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(first.stageIds) == 1, "the postings are written by one stage"
    held = spark.read.parquet(f"{tmp_path}/index/postings")
    assert held.filter("term is null").count() > 4
    terms = [r.term for r in held.filter("term is not null").select("term").distinct().collect()]
    want = sorted(map(tuple, lexical.postings(rows).select("term", "parse_id", "chunk_id", "tf", "dl").collect()))
    assert sorted(map(tuple, index.postings(terms).collect())) == want
    for query in ("river", "common river", "a b", "nothing of it", "中"):
        got, scan = ({r.chunk_id: round(r.score, 9) for r in x.collect()} for x in (index.scores(query), lexical.scores(rows, query)))
        assert got == scan
    assert lexical.Index.build(rows.limit(0), f"{tmp_path}/none").scores("river").count() == 0


def test_rows_are_dealt_where_row_groups_are_few(spark, tmp_path):
    rows = spark.range(400).select("id", F.lit("x").alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    rows.repartition(6).write.parquet(f"{tmp_path}/six")
    one, six = (spark.read.option("maxPartitionBytes", "1k").parquet(f"{tmp_path}/{n}") for n in ("one", "six"))
    dealt = tables.spread(one, "id")
    assert dealt.select(F.spark_partition_id()).distinct().count() >= 4 and dealt.count() == 400
    assert one.count() == six.count() == 400


def test_texts_of_the_pool_are_not_shuffled(spark, tmp_path):
    put(spark, tmp_path)
    got = retrieval.document_engine(spark, str(tmp_path))._seeds(retrieval.Request.parse({"query": "idiot clown"}))
    assert got.count() > 0
    lines = plan(got).splitlines()
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and "text" in x.split("ReadSchema")[1])
    assert "LeftSemi, BuildRight" in "".join(lines[at - 6 : at]), "texts meet the pool where they are read"


def test_shared_runs_are_those_of_all_runs(spark):
    rng = random.Random(4)
    texts = [None, "", "one", "B b, b b b", *(" ".join(rng.choices(["a", "B", "c!", "é", "क\u093e", "."], k=rng.randrange(20))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gap = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    words = {r.doc_id: r.w or [] for r in rows.select("doc_id", gap.alias("w")).collect()}
    want = {(k, " ".join(w[i : i + n])) for k, w in words.items() for n in (1, 4) for i in range(len(w) - n + 1)}
    got = annotations.shared_runs(rows, [1, 4])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = ["b b b b", "a", "a b c é", "no", "a b", *rng.sample(sorted({r for _, r in want}), 20)]
    got = annotations.shared_runs(rows, [1, 4], few)
    assert sorted(map(tuple, got.collect())) == sorted(x for x in want if x[1] in few)
    assert "explode" not in plan(got) and annotations.shared_runs(rows, [], []).count() == 0


def test_grounding_is_the_same_with_many_runs_of_quotes(spark, tmp_path, monkeypatch):
    item = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima"
    spark.createDataFrame([(1, item), (2, "quebec romeo sierra tango")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [f"x {item} y", item.upper(), item.replace("hotel", "hotol"), "Quebec, Romeo sierra; tango", "alpha bravo delta echo", None]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for few in (1 << 18, 0):
        monkeypatch.setattr(grain_queries, "FEW_RUNS", few)
        got.append(sorted(map(tuple, grain_queries.fuzzy_grounding(spark, str(tmp_path)).collect())))
    assert got[0] == got[1] == [(0, 1, True), (1, 1, True), (2, 1, True), (3, 2, True), (4, 1, False)]


def test_few_repairs_take_a_small_table(monkeypatch):
    tried, aligned = [], annotations._aligned
    monkeypatch.setattr(annotations, "_aligned", lambda s, q, n, o: tried.append(n) or aligned(s, q, n, o))
    quote = "the quick brown fox jumps over the lazy dog and runs away into the woods"
    assert annotations.grounded(f"so {quote.replace('fox', 'red fox')} then", quote) and tried == [0]
    rng = random.Random(6)
    for _ in range(60):
        q = "".join(rng.choices("abcd", k=rng.choice([8, 30, 60])))
        near = "".join(rng.choice(["", c, c, c, c, c, c + "z", "x"]) for c in q)
        s = "".join(rng.choices("abcd", k=rng.randrange(40))) + near + "".join(rng.choices("abcd", k=rng.randrange(200)))
        repairs, omissions = min(len(q) // 4, max(4, len(q) * 3 // 20)), max(32, len(q))
        assert annotations.grounded(s, q) == (q in s or aligned(s, q, repairs, omissions))


TEXTS = [None, "", "one\nline\n\n\ntwo", "\n \t\r\n a\n\x0b\nb. c! d", "x " * 900, "é f\n\x85\ng", "last\n"]


def blocks(text):
    out, at = [], 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\x0b\f\r"):
            if out and out[-1][1] == at - 1:
                out[-1] = (out[-1][0], at + len(line))
            else:
                out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def test_paragraphs_within_rows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = packing.paragraphs(docs)
    want = [(i, n, a, b, t[a:b]) for i, t in enumerate(TEXTS) for n, (a, b) in enumerate(blocks(t), 1)]
    assert sorted(map(tuple, got.collect())) == want
    assert "Exchange" not in plan(got)


def test_documents_are_packed_within_rows(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    p = packing.paragraphs(docs)
    units = p.select(F.col("doc_id").alias("parse_id"), F.col("paragraph").alias("sequence_index"), F.concat_ws(":", "doc_id", F.lpad(F.col("paragraph").cast("string"), 6, "0")).alias("unit_id"), "text")
    for whole in (False, True):
        got = packing.pack_documents(docs, 40, whole=whole)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, packing.pack_parses(units, 40, whole=whole).collect()))
        assert "Exchange" not in plan(got)


def test_runs_are_those_of_whole_text_counts():
    rng = random.Random(3)
    for _ in range(60):
        texts = ["".join(rng.choices(["a", "bc ", ". ", "!", "\n", "x.y-z", " "], k=rng.choice([3, 40]))) for _ in range(3)]
        members = [packing.Member(i, t) for i, t in enumerate(texts)]
        cap, fill = rng.choice([4, 7, 20]), rng.choice([0, 0.5, 1])
        assert packing.pack(members, cap, fill) == packing.pack(members, cap, fill, lambda t: packing.count_tokens(t))


class Reads(packing.WordCounter):
    read = 0

    def __call__(self, text):
        self.read += len(text)
        return super().__call__(text)

    def prefixes(self, text, ends):
        self.read += len(text)
        return super().prefixes(text, ends)


def test_a_long_member_is_not_read_anew_for_each_run():
    count = Reads()
    packing.pack([packing.Member(0, "word, and word. " * 4000)], 50, 0.5, count)
    assert count.read < 200_000


def test_only_chosen_seeds_carry_texts(spark, tmp_path):
    spark.createDataFrame([(i, "a b\n\nc d\n\ne f\n\ng") for i in range(40)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = grain_queries._seeds(spark, str(tmp_path))
    assert got.count() == 3 * 40 - sum(max(0, n - 100) for n in Counter(i % 3 for i in range(40) for _ in range(3)).values())
    assert max(len(r.parts) for r in got.collect()) == 2
    ranking = plan(got)[plan(got).index("WindowGroupLimit"):]
    assert "text" not in ranking.split("Project")[0]


def test_ancestry_is_not_broadcast(spark):
    up = spark.createDataFrame([(i, i // 3) for i in range(3, 700)], "unit_id long, parent_id long")
    got = graph.ancestry(up)
    want = []
    for i in range(3, 700):
        at, hops = i, 0
        while at >= 3:
            at, hops = at // 3, hops + 1
            want.append((i, at, hops))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Join" not in plan(got)
    for bad in ([(1, 2), (2, 1)], [(1, 2), (1, 3)], [(i, i + 1) for i in range(5)]):
        with pytest.raises(ValueError):
            graph.ancestry(spark.createDataFrame(bad, "unit_id long, parent_id long"), depth=4)
    assert graph.ancestry(spark.createDataFrame([(i, i + 1) for i in range(4)], "unit_id long, parent_id long"), depth=4).count() == 10
