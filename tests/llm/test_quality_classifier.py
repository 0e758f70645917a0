"""Shrinkage by hand, accuracy on planted sites, and the edge cases of the docstring."""

import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from strataloom.llm import quality_classifier as Q

SCHEMA = "doc_id long, text string, source string, lang string, score string, _h int"


def corpus():
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(1200):
        host = f"h{rng.randrange(12)}"
        good = rng.random() < (0.9 if host in ("h0", "h1", "h2") else 0.4)
        words = [rng.choice(["tree", "stone", "river", "walks"]) for _ in range(30)]
        text = " ".join(words) + "." if good else " ".join(w + "###" for w in words)
        if rng.random() < 0.1:
            text = "plain middling text with nothing to tell"
        rows.append((i, text, host, rng.choice(["en", None]), "x", 1))
        if rng.random() < 0.6:
            labels.append((i, int(good)))
    return rows, labels


def test_sites_and_documents(spark):
    rows, labels = corpus()
    extra = [(5000, None, "h0", "en", "x", 1), (5001, "", None, None, "x", 1), (None, "tree stone.", "new", "en", "x", 1), (3, rows[3][1], rows[3][2], rows[3][3], "x", 1), (5002, "river " * 20000, "h1", "en", "x", 1)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    marks = spark.createDataFrame(labels + [(None, 1), (8, None), (9, 7)], "doc_id long, quality int")
    got = Q.classify(docs, marks).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    clear = [(by[i]["kept"], "###" not in t) for i, t, *_ in rows if not t.startswith("plain")]
    assert sum(a == b for a, b in clear) >= 0.97 * len(clear)
    site = lambda h: [by[i]["score"] for i, t, s, *_ in rows if s == h and t.startswith("plain")]
    assert min(site("h0")) > max(site("h5"))
    assert all(0 <= r["score"] <= 1 and r["kept"] == (r["score"] >= 0.5) for r in got)


def slow_features(text):
    words = (text or "").split()
    x = [0.0] * (5 + Q.SHAPES + Q.TERMS)
    if not words:
        return x
    lines = [v for v in text.split("\n") if v.strip()]
    for i, w in enumerate(words):
        s = "".join("a" if c.isalpha() else "9" if c.isdigit() else c for c in w)
        s = "".join(c for c, b in zip(s, " " + s, strict=False) if c != b)
        if sum(c.isalpha() for c in w) > 1 and w.upper() == w:
            s = s.replace("a", "A")
        x[5 + xxhash.xxh64_intdigest(s.encode()) % Q.SHAPES] += 1
        x[5 + Q.SHAPES + xxhash.xxh64_intdigest(w.lower().encode()) % Q.TERMS] += 1
        x[2] += bool(i) and w == words[i - 1]
    n = len(words)
    x = [math.log1p(100 * v / n) for v in x]
    return [math.log1p(n), len(text) / n, x[2], len(set(words)) / n, math.log1p(100 * (1 - len(set(lines)) / max(len(lines), 1))), *x[5:]]


def slow_classify(rows, marks):
    """The whole query with numpy and dictionaries."""
    fold = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 2
    x = np.array([slow_features(t) for _, t, *_ in rows])
    known = {d: y for d, y in marks if y in (0, 1)}
    lab = np.array([known.get(r[0], -1) for r in rows])
    f = np.array([fold(r[0]) for r in rows])
    models = [Q.Linear(x[(f != k) & (lab >= 0)], lab[(f != k) & (lab >= 0)].astype(float)) for k in (0, 1)]
    p = np.array([models[k].probability(v[None])[0] for k, v in zip(f, x, strict=True)])
    own = np.where(lab >= 0, lab, p)
    cells, hosts = defaultdict(lambda: np.zeros(2)), defaultdict(lambda: np.zeros(2))
    for (_, _, h, q, *_), v in zip(rows, own, strict=True):
        cells[h, q] += (v, 1)
        hosts[h] += (v, 1)
    base = (own.sum() + 1) / (len(own) + 2)

    def strength(parts):
        v = noise = m = 0.0
        for (g, n), up in parts:
            v, noise, m = v + n * (g / n - up) ** 2, noise + up * (1 - up), m + n * up * (1 - up)
        return min(max(1 / max((v - noise) / max(m - noise, 1e-9), 1e-4) - 1, 0.5), 1e4)

    sh = strength([(c, base) for c in hosts.values()])
    sp = strength([(c, (hosts[h][0] + sh * base) / (hosts[h][1] + sh)) for (h, _), c in cells.items()])
    logit = lambda z: math.log(min(max(z, 1e-6), 1 - 1e-6) / (1 - min(max(z, 1e-6), 1 - 1e-6)))
    out = []
    for (d, _, h, q, *_), v, pd in zip(rows, own, p, strict=True):
        ph = (hosts[h][0] - v + sh * base) / (hosts[h][1] - 1 + sh)
        pp = (cells[h, q][0] - v + sp * ph) / (cells[h, q][1] - 1 + sp)
        out.append((d, pd, pp, ph, 1 / (1 + math.exp(-(logit(pd) + logit(pp) - logit(base))))))
    return out


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    good = np.array(labels) == 1
    return (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_against_a_plain_version(spark):
    rows, labels = corpus()
    rows = rows[:400] + [(7001, None, "h0", "en", "x", 1), (7002, "ÀB c1 2.5 %%\n\nc1 c1 x", None, "en", "x", 1)]
    ids = {r[0] for r in rows}
    labels = [x for x in labels if x[0] in ids]
    got = Q.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    want = {d: r for d, *r in slow_classify(rows, labels)}
    assert len(got) == len(rows)
    for r in got:
        assert [r["p_document"], r["p_path"], r["p_host"], r["score"]] == pytest.approx(want[r["doc_id"]], abs=2e-5)


def test_labels_of_the_own_fold_are_not_seen(spark):
    """Held-out ranking: each label is scored by a classifier of the other fold, with its own label out of its site's rates."""
    rows, labels = corpus()
    got = {r["doc_id"]: r for r in Q.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert auc([got[d]["p_document"] for d, _ in labels], [y for _, y in labels]) > 0.9
    flipped = [(d, 1 - y) if d == labels[0][0] else (d, y) for d, y in labels]
    again = {r["doc_id"]: r for r in Q.classify(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(flipped, "doc_id long, quality int")).collect()}
    assert got[labels[0][0]]["p_document"] == again[labels[0][0]]["p_document"]


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", "h", "en", "x", 1)], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in Q.classify(docs, none).collect()] == [pytest.approx(0.5)]
    assert Q.classify(docs.limit(0), none).collect() == []
