"""The pipeline against each stage done plainly on what the one before it kept."""

import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as P
from strataloom.llm import decontamination, mixing, toxicity

from .test_simhash import slow_classes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices(["ta", "ri", "mo", "ne", "sul", "ka"], k=rng.randrange(2, 4)))
    bench = [(i, " ".join(word() for _ in range(20))) for i in range(5)]
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(rng.randrange(20, 60))]
        if i % 8 == 0:
            words[3:3] = ["idiot", "scum", "worthless"]
        if i % 50 == 1:
            words += bench[i % 5][1].split()
        text = " ".join(words)
        if i % 20 == 3:
            text = docs[-1][1].upper()
        docs.append((i, text, "en", f"s{rng.randrange(4)}", len(text)))
        labels.append((i, 1, int(i % 8 == 0)))
    docs += [(None, None, None, None, None), (900, "", "en", None, 0)]
    out = str(tmp_path_factory.mktemp("sf"))
    for name, rows, schema in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"),
        ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", bench, "item_id long, text string")):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{out}/{name}.parquet")
    return out


def test_stage_by_stage(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, tables[-1], folder).write.parquet(f"{tmp_path}/{i}")
        tables.append(spark.read.parquet(f"{tmp_path}/{i}"))
    ids = [Counter(r["doc_id"] for r in t.collect()) for t in tables]
    assert all(t.columns == columns for t in tables[:-1])
    scores = toxicity.score_documents(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    assert ids[1] == Counter(r["doc_id"] for r in scores if not r["predicted"])
    assert {r["doc_id"] for r in scores if r["predicted"]} == set(range(0, 400, 8))
    kept = [(r["doc_id"], r["text"]) for r in tables[1].collect()]
    firsts = {c if c is not None else fp for _, fp, c in slow_classes(kept)}
    assert sum(ids[2].values()) == len(firsts) and {d for d in ids[2] if d is not None} == {c for c in firsts if not isinstance(c, str)}
    items = [decontamination.word_numbers(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    def leaks(text):  # every item against the whole text, nothing joined
        t = decontamination.word_numbers(text)
        return any(sum(n for _, _, n in decontamination.tiles(x, np.where(np.isin(t, x), t, -1))) >= decontamination.COVERAGE * len(x) for x in items if len(x) >= decontamination.LEAST)

    assert ids[3] == Counter(r["doc_id"] for r in tables[2].collect() if not leaks(r["text"]))
    takes = {r["doc_id"]: len(r["shards"]) for r in mixing.mix_digest(tables[3]).collect()}
    assert ids[4] == Counter({d: n for d, n in takes.items() if n})
    last = tables[5].collect()
    assert Counter(r["doc_id"] for r in last) == ids[4] and tables[5].columns == [*columns, "shard", "slot"]
    for s in range(8):
        slots = sorted(r["slot"] for r in last if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sorted(map(str, P.run(spark, folder).collect())) == sorted(map(str, last))
