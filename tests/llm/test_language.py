"""Forward sums against every segmentation, expected counts against them, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from strataloom.llm import language as L

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return L.Pieces(PATH)


def segmentations(pieces, word):
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        ids = []
        for s in parts:
            if s in pieces.index:
                ids.append(pieces.index[s])
            elif len(s) == 1:
                ids += list(pieces.byte[list(s.encode())])
            else:
                break
        else:
            yield ids


@pytest.mark.parametrize("word", ["a", "the", "élan", "straße", "ꙮab", "theothers"])
def test_all_segmentations(pieces, word):
    p = np.random.default_rng(2).dirichlet(np.ones(pieces.size), 2).T
    each = [(ids, p[ids].prod(axis=0)) for ids in segmentations(pieces, L.START + word)]
    total = sum(x for _, x in each)
    assert L.log_scores(pieces, [word], p)[0] == pytest.approx(np.log(total))
    want = np.zeros(pieces.size)
    for ids, x in each:
        np.add.at(want, ids, 3 * x[0] / total[0])
    assert L.expected(pieces, [word], np.array([3.0]), p[:, 0]) == pytest.approx(want)


def corpus():
    rng = random.Random(6)
    bits = {"en": ["the", "ing", "wh", "sh", "and"], "de": ["sch", "und", "ung", "ein", "ü"], "fr": ["eau", "ê", "oi", "que", "les"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(bits))
        rows.append((i, " ".join("".join(rng.choices(bits[lang], k=rng.randrange(1, 4))) for _ in range(12)), lang, 1))
    return rows


def test_held_out(spark):
    rows = corpus()
    extra = [(400, None, "en", 1), (401, "", "en", 1), (402, "12 ²_ !", "en", 1), (403, "Undscheinung", None, 1), (None, "the shing", "en", 1), (404, "sch" * 900, "de", 1), (5, rows[5][1], rows[5][2], 1)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string, score int")
    got = L.predict_languages(docs, PATH).collect()
    assert len(got) == len(rows) + len(extra)
    by = {r["doc_id"]: r for r in got}
    for d, r in by.items():
        assert r["held_out"] == (zlib.crc32(("" if d is None else str(d)).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    assert [by[d]["lang_pred"] for d in (400, 401, 402, 403, 404)] == ["und", "und", "und", "de", "de"]
    held = [(by[d]["lang_pred"], lang) for d, _, lang, _ in rows if by[d]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)


def test_labels_of_held_out_rows_are_not_used(spark):
    rows = corpus()
    swapped = [(d, t, "xx" if zlib.crc32(str(d).encode()) % 4 == 2 else lang, 1) for d, t, lang, _ in rows]
    schema = "doc_id long, text string, lang string, score int"
    a, b = (sorted(map(tuple, L.predict_languages(spark.createDataFrame(x, schema), PATH).collect())) for x in (rows, swapped))
    assert a == b


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "x", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in L.predict_languages(docs, PATH).collect()} == {"und"}
    assert L.predict_languages(docs.limit(0), PATH).collect() == []


def log_domain(pieces, word, p):
    """Forward and backward sums in logarithms, and the expected uses, for one language."""
    w, n = L.START + word, len(word) + 1
    parts = lambda i, j: [pieces.index[w[i:j]]] if w[i:j] in pieces.index else list(pieces.byte[list(w[i:j].encode())]) if j == i + 1 else None
    arcs = [(i, j, ids) for i in range(n) for j in range(i + 1, min(n, i + pieces.longest) + 1) if (ids := parts(i, j))]
    alpha, beta = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    alpha[0] = beta[n] = 0
    for i, j, ids in arcs:
        alpha[j] = np.logaddexp(alpha[j], alpha[i] + np.log(p[ids]).sum())
    for i, j, ids in reversed(arcs):
        beta[i] = np.logaddexp(beta[i], beta[j] + np.log(p[ids]).sum())
    uses = np.zeros(pieces.size)
    for i, j, ids in arcs:
        np.add.at(uses, ids, np.exp(alpha[i] + np.log(p[ids]).sum() + beta[j] - alpha[n]))
    return alpha[n], uses


@pytest.mark.parametrize("word", ["中" * 100, "ꙮ" * 30, "ꙮ" * 5, "thesch" * 50, "the中ꙮ" * 75, "a" * 64, "undscheinung" * 500])
def test_long_words(pieces, word, monkeypatch):
    monkeypatch.setattr(L, "LOOKUP", 1000)
    rng = np.random.default_rng(4)
    for p in (np.full(pieces.size, 1 / pieces.size), rng.dirichlet(np.full(pieces.size, 0.2)) + 1e-12):
        log, uses = log_domain(pieces, word, p)
        assert L.log_scores(pieces, [word, "x"], p[:, None])[0, 0] == pytest.approx(log, rel=1e-9)
        assert L.expected(pieces, ["x", word], np.array([0.0, 2.0]), p) == pytest.approx(2 * uses, abs=1e-6)


def test_languages_in_blocks(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string, score int")
    a, b = (L.predict_languages(docs, PATH, block=n).orderBy("doc_id").collect() for n in (64, 1))
    assert [r["lang_pred"] for r in a] == [r["lang_pred"] for r in b]
    assert [r["score"] for r in a] == pytest.approx([r["score"] for r in b])
