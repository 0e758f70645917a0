"""Tiles against a plain greedy string tiling, and the cases of the docstrings."""

import random
import time

import numpy as np

from strataloom.llm import decontamination as D


def slow_tiles(item, text, least, ok=lambda t: t >= 0):
    """Wise's greedy string tiling: in each round, mark all longest matches of unmarked words."""
    fi, ft, out = [True] * len(item), [ok(t) for t in text], 0
    while True:
        best, found = least, []
        for x in range(len(item)):
            for t in range(len(text)):
                n = 0
                while x + n < len(item) and t + n < len(text) and fi[x + n] and ft[t + n] and item[x + n] == text[t + n]:
                    n += 1
                if n > best:
                    best, found = n, [(x, t)]
                elif n == best:
                    found.append((x, t))
        if not found:
            return out
        for x, t in found:
            if all(fi[x : x + best]) and all(ft[t : t + best]):
                fi[x : x + best], ft[t : t + best] = [False] * best, [False] * best
                out += best


def test_tiles_cover_what_greedy_tiling_covers():
    rng = random.Random(2)
    for _ in range(300):
        alphabet = rng.choice([2, 4, 30])
        item = [rng.randrange(alphabet) for _ in range(rng.randrange(0, 30))]
        parts = [item[i : i + 6] for i in range(0, len(item), 6)] + [[-1]] * 2 + [[rng.randrange(alphabet)] * 3]
        rng.shuffle(parts)
        text = sum(parts, [])
        got = D.tiles(np.array(item, dtype=np.int64), np.array(text, dtype=np.int64), 3)
        for x, t, n in got:
            assert item[x : x + n] == text[t : t + n] and n >= 3
        marked = [x + j for x, _, n in got for j in range(n)]
        assert len(marked) == len(set(marked))
        assert len(marked) == slow_tiles(item, text, 3)


def covers(item, text):
    """Whether brute-force tiles of the whole texts cover the item."""
    x, t = D.words(item), D.words(text)
    if len(x) < D.LEAST or len(t) > 5000:
        return len(x) >= D.LEAST and " ".join(x) in " ".join(t)
    near = set(x)
    return len(near & set(t)) > 2 and slow_tiles(x, [w if w in near else -1 for w in t], D.LEAST, ok=lambda w: w != -1) >= D.COVERAGE * len(x)


def test_equal_words_quickly():
    item, text = np.full(200, 7), np.full(8000, 7)
    start = time.perf_counter()
    assert sum(n for _, _, n in D.tiles(item, text)) == 200
    assert time.perf_counter() - start < 5


def data():
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    items = [(i, " ".join(word() for _ in range(rng.randrange(12, 40)))) for i in range(12)] + [(50, None), (51, ""), (52, "too short item")]
    docs, want = [], set()
    for i in range(120):
        text = [word() for _ in range(rng.randrange(5, 120))]
        if i % 3 == 0:
            k = rng.randrange(12)
            w = items[k][1].split()
            if i % 2:
                w = w[len(w) // 2 :] + ["in", "between"] + w[: len(w) // 2]  # halves change places
            at = rng.randrange(len(text))
            text[at:at] = [x.upper() + "," for x in w]
            want.add((i, k))
        elif i % 3 == 1:
            text[2:2] = items[i % 12][1].split()[:5]  # a shared phrase is not a passage
        docs.append((i, " ".join(text), "en", 1))
    docs += [(500, None, "en", 1), (501, "", "en", 1), (None, items[3][1], "en", 1), (0, docs[0][1], "en", 1), (502, "too short item", "en", 1), (503, "pad " * 30000 + items[4][1], "en", 1)]
    want |= {(None, 3), (503, 4)}
    return items, docs, want


def test_planted(spark):
    items, docs, want = data()
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(table, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want) + 1
    assert all(r["n_covered"] == sum(t["n_words"] for t in r["tiles"]) for r in got)
    slow = {(d, i) for d, t, *_ in docs for i, x in items if covers(x, t)}
    assert slow == want
    kept = D.drop_contaminated(table, bench)
    assert kept.columns == table.columns
    bad = {d for d, _ in want}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in docs if r[0] not in bad)


def test_empty(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert D.contaminated(table, item).collect() == [] and D.contaminated(one, bench).collect() == []
    assert D.drop_contaminated(one, bench).count() == 1 and D.drop_contaminated(one, item).count() == 0
