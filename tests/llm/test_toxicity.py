"""The label model against enumeration, held-out accuracy, and the edge cases of the docstrings."""

import itertools
import random
import zlib

import numpy as np
import pytest

from strataloom.llm import toxicity as T

SCHEMA = "doc_id long, text string, score string, label int"


def corpus(n=1500):
    rng = random.Random(3)
    base = ["stone", "river", "die", "walk", "green", "und", "house", "gross", "le", "table"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(base) + rng.choice(["", "a", "er", "ing"]) for _ in range(rng.randrange(5, 80))]
        toxic = rng.random() < 0.15
        if toxic:
            if rng.random() < 0.5:
                for w in rng.sample(["idiot", "scum", "worthless", "zorbit", "clown", "loser"], rng.randrange(2, 4)):
                    words.insert(rng.randrange(len(words)), w)
            else:  # insults of another language, known from labels alone, with changing ends
                for _ in range(3):
                    words.insert(rng.randrange(len(words)), rng.choice(["vloska", "brunti"]) + rng.choice(["a", "en", "is", "o", "ur"]))
        rows.append((i, " ".join(words), "x", 1))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    return rows, labels


@pytest.fixture(scope="module")
def scored(spark):
    rows, labels = corpus()
    extra = [(9000, None, "x", 1), (9001, "", "x", 1), (9002, "fine " * 20000 + "scum worthless idiot", "x", 1), (None, "green house", "x", 1), (3, rows[3][1], "x", 1)]
    bad = [(None, 1), (7, 0), (7, 1), (8, None), (9, 5)]
    docs, marks = spark.createDataFrame(rows + extra, SCHEMA), spark.createDataFrame(labels + bad, "doc_id long, toxic int")
    return rows, docs, marks, T.score_documents(docs, marks).collect()


def test_held_out(scored):
    rows, _, _, got = scored
    assert len(got) == len(rows) + 5
    by = {r["doc_id"]: r for r in got}
    toxic = {"idiot", "scum", "worthless", "zorbit", "clown", "loser"} | {w for _, t, *_ in rows for w in t.split() if w.startswith(("vloska", "brunti"))}
    right = held = 0
    for d, text, *_ in rows:
        r = by[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5)
        if r["held_out"]:
            held += 1
            right += r["predicted"] == int(bool(toxic & set(text.split())))
    assert right >= 0.98 * held
    assert [by[d]["predicted"] for d in (9000, 9001, 9002, None)] == [0, 0, 1, 0]


def test_filter_keeps_columns(scored):
    _, docs, marks, got = scored
    kept = T.drop_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if not r["predicted"])


def test_held_out_labels_are_not_used(spark, scored):
    rows, docs, marks, got = scored
    _, labels = corpus()
    flipped = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, y in labels] + [(None, 1), (7, 0), (7, 1), (8, None), (9, 5)]
    again = T.score_documents(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_posterior_by_enumeration():
    rng = np.random.default_rng(1)
    m = len(T.VOTERS)
    above = [-1, *(int(rng.integers(0, j)) for j in range(1, m))]
    model = T.LabelModel(0.3, above, rng.uniform(0.1, 0.9, (2, m, 2)))
    for pattern in map(int, rng.integers(0, 1 << m, 40)):
        joint = []
        for y, p in ((0, 0.7), (1, 0.3)):
            for j, a in enumerate(above):
                r = model.rates[y, j, pattern >> a & 1 if a >= 0 else 0]
                p *= r if pattern >> j & 1 else 1 - r
            joint.append(p)
        assert model.posterior(np.array([pattern]))[0] == pytest.approx(joint[1] / sum(joint))


def test_correlated_voters_form_an_edge():
    pattern, label, n = [], [], []
    for a, b, c in itertools.product([0, 1], repeat=3):
        pattern.append(a | b << 1 | c << 4)
        label.append(-1)
        n.append(400 if a == b else 10)
    above = T.fit_label_model(np.array(pattern), np.array(label), np.array(n)).above
    assert above[1] == 0 or above[0] == 1


def test_empty(spark):
    docs, marks = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, toxic int")
    assert T.score_documents(docs, marks).collect() == [] and T.drop_toxic(docs, marks).collect() == []
