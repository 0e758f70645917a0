"""SimHash classes against brute force, and the edge cases of its docstrings."""

import random

import numpy as np
import xxhash

from strataloom.llm import simhash
from strataloom.llm.common import Scratch

DOC = "doc_id long, text string"


def slow_fingerprint(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_classes(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    left, out = set(range(len(rows))), {}
    while left:
        todo = [left.pop()]
        group = set(todo)
        while todo:
            x = todo.pop()
            near = {y for y in left if (fps[x] ^ fps[y]).bit_count() <= 2}
            left -= near
            group |= near
            todo += near
        ids = [rows[i][0] for i in group if rows[i][0] is not None]
        for i in group:
            out[i] = min(ids) if ids else None
    return sorted(((rows[i][0], f"{fps[i]:016x}", out[i]) for i in range(len(rows))), key=str)


def near_rows():
    rng = random.Random(5)
    base = [rng.choice(["ab", "Cd", "é", "fg"]) + str(rng.randrange(50)) for _ in range(300)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (6, "ONE"), (None, "one two"), (None, "lone null id row")]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "x" + str(rng.randrange(9))
        rows.append((100 + i, " ".join(words)))
    rows += [(100, rows[8][1]), (101, rows[9][1])]  # repeated rows
    rows += [(300 + i, " ".join(rng.choices(base, k=40))) for i in range(40)]
    return rows


def test_against_brute_force(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOC + ", fingerprint string, _fp int")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == slow_classes(rows)


def test_one_row_of_each_class_stays(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], DOC + ", component_id long")
    got = simhash.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    classes = {}
    for d, fp, c in slow_classes(rows):
        classes.setdefault(c if c is not None else fp, set()).add(d)
    kept = [r["doc_id"] for r in got.collect()]
    assert sorted(map(str, kept)) == sorted(str(min((d for d in ids if d is not None), default=None)) for ids in classes.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOC)
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.drop_near_duplicates(docs).collect() == []


def test_long_text_is_added_up_in_pieces(monkeypatch):
    text = " ".join(str(i * i % 97) for i in range(500))
    monkeypatch.setattr(simhash, "FLUSH", 7)
    assert int(simhash.fingerprints([text.encode(), b"a b"])[0]) == slow_fingerprint(text)


def test_tiles_lose_no_link():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, (1 << 64) - 1, 6, dtype=np.uint64)
    fps = np.unique(np.concatenate([centre, *(centre ^ np.uint64(1 << int(b)) for b in rng.integers(0, 64, 9))]))
    ones = np.bitwise_count(fps)
    order = np.argsort(ones, kind="stable")
    fps, ones = fps[order], ones[order]
    for tile in (2, 5, 1024):
        root = {i: i for i in range(len(fps))} | dict(simhash.tile_links(fps.view(np.int64), ones, tile=tile))
        for i in range(len(fps)):
            for j in range(len(fps)):
                if int(np.bitwise_count(fps[i] ^ fps[j])) <= 2:
                    assert root[i] == root[j]


def test_a_near_pair_shares_a_bucket():
    masks = [m % (1 << 64) for m in simhash._masks()]
    for i in range(64):
        for j in range(64):
            assert any(not m & (1 << i | 1 << j) for m in masks)


def test_large_buckets_in_tile_pairs(spark):
    """Fingerprints that share the bits of a bucket, far more than a tile holds, against brute force."""
    rng = np.random.default_rng(8)
    low = rng.integers(0, 1 << 22, 900, dtype=np.uint64)  # dense: many within two bits, all in one bucket of the top bits
    fps = sorted(set(low.tolist()) | {int(x) ^ 3 for x in low[:200]} | {int(x) ^ 1 << 63 for x in low[:50]})
    rows = [(f"d{i}", x - (1 << 64) if x >= 1 << 63 else x) for i, x in enumerate(fps)]
    got = simhash.near_classes(Scratch(spark), spark.createDataFrame(rows, "doc_id string, _fp long"), tile=64)
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {}
    for i, (d, _) in enumerate(rows):
        want.setdefault(find(i), []).append(d)
    least = {f: min(want[find(i)]) for i, (_, f) in enumerate(rows)}
    assert {r["_fp"]: r["component_id"] for r in got.collect()} == least
