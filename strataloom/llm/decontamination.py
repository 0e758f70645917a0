"""Benchmark decontamination by greedy string tiling, with running Karp-Rabin matches."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Shortest tile in words, and the length of seeds.
LEAST = 5
#: Share of an item's words that tiles must cover.
COVERAGE = 0.6
#: Hits of a text's windows in an item that are looked at together.
PAIRS = 1 << 18
#: Distinct words whose hashes a worker keeps.
HOLD = 1_000_000
#: Karp-Rabin: a rolling hash modulo 2^64 of the items' word numbers; every match is then compared word by word.
BASE = 1_000_003

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters, digits and underscores: case, punctuation and line ends don't hide a passage."""
    return _WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all windows of k numbers, each from the one before it (as differences of a running sum)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(BASE) + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    return out


def _runs(free: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _matches(item: np.ndarray, text: np.ndarray, free_i: np.ndarray, free_t: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """All maximal matches (-length, start in item, start in text) of `length` or more words, unmarked on both sides."""
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in _runs(free_i) if b - a >= length] or [np.zeros(0, dtype=np.int64)])
    if not len(starts):
        return []
    hashes = rolling(item, length)[starts]
    order = np.argsort(hashes, kind="stable")
    keys, starts = hashes[order], starts[order]
    out = []
    for a, b in _runs(free_t):
        own = rolling(text[a:b], length)
        lo, hi = np.searchsorted(keys, own, "left"), np.searchsorted(keys, own, "right")
        many = hi - lo
        at = np.flatnonzero(many)
        ends = np.cumsum(many[at])
        # item starts of every hit, PAIRS hits at once
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS, "right")))
            y = at[first:last]
            n = many[y]
            x = starts[np.repeat(lo[y] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            t = np.repeat(a + y, n)
            first = last
            # those that begin earlier are found there
            x0, t0 = np.maximum(x - 1, 0), np.maximum(t - 1, 0)
            inner = (x > 0) & (t > 0) & free_i[x0] & free_t[t0] & (item[x0] == text[t0])
            x, t = x[~inner], t[~inner]
            for j in range(length):  # equal hashes are compared word by word
                same = item[x + j] == text[t + j]
                if not same.all():
                    x, t = x[same], t[same]
            size = np.full(len(x), length)
            going = np.arange(len(x))
            while len(going):
                xe, te = x[going] + size[going], t[going] + size[going]
                going, xe, te = (z[(xe < len(item)) & (te < len(text))] for z in (going, xe, te))
                going = going[free_i[xe] & free_t[te] & (item[xe] == text[te])]
                size[going] += 1
            out += zip((-size).tolist(), x.tolist(), t.tolist(), strict=True)
    return out


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in item, start in text, length), longest first, no word in two tiles.

    Negative numbers in the text are words that no item has. The search length starts at half the item; a
    match of over twice that length starts the search again there. Otherwise matches are marked, longest first
    (ties: earlier in the item, then in the text); of one that others overlap, free stretches of the search length
    or more are marked in their turn. Then the search length is halved, down to `least`.
    """
    free_i, free_t = np.ones(len(item), dtype=bool), text >= 0
    out = []
    length = max(least, len(item) // 2)
    while len(item) >= least:
        heap = _matches(item, text, free_i, free_t, length)
        longest = -min(heap, default=(0,))[0]
        if longest > 2 * length:
            length = longest
            continue
        heapq.heapify(heap)
        while heap:
            n, x, t = heapq.heappop(heap)
            both = free_i[x : x - n] & free_t[t : t - n]
            if both.all():
                free_i[x : x - n] = free_t[t : t - n] = False
                out.append((x, t, -n))
            else:
                for a, b in _runs(both):
                    if b - a >= length:
                        heapq.heappush(heap, (a - b, x + a, t + a))
        if length == least:
            break
        length = max(least, length // 2)
    return out


_hashes: dict[str, int] = {}


def word_numbers(text: str | None) -> np.ndarray:
    """A 63-bit hash for each word; equal words have equal numbers on either side of the join."""
    own = words(text)
    if len(_hashes) > HOLD:
        _hashes.clear()
    for w in own:
        if w not in _hashes:
            _hashes[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) >> 1
    return np.fromiter(map(_hashes.__getitem__, own), dtype=np.int64, count=len(own))


def _items(benchmark: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """_item (a number of its own for each row), item_id, its words by number, and its seeds by start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [word_numbers(t) for t in b.column(2).to_pylist()]
            seeds = [rolling(i, least).view(np.int64) for i in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], names=["_item", "item_id", "words", "seeds"])

    light = benchmark.select(F.monotonically_increasing_id().alias("_item"), "item_id", F.col("text").alias("_text"))
    kind = light.schema["item_id"].dataType.simpleString()
    return scratch.write(light.mapInArrow(run, f"_item long, item_id {kind}, words array<long>, seeds array<long>").filter(F.size("seeds") > 0), "items")


def _sieve(seeds: DataFrame) -> np.ndarray:
    """Bits that are set for every seed: 16 a seed, and 2^30 (128 MB) at most, whatever the number of seeds.

    It spares the join most seeds of documents that no item has; those that pass without cause find no partner there.
    """
    size = 1 << min(30, max(10, int(16 * seeds.count()).bit_length()))
    bits = np.zeros(size // 8, dtype=np.uint8)
    for rows in seeds.select((F.col("seed").bitwiseAND(F.lit(size - 1))).alias("b")).distinct().toLocalIterator(prefetchPartitions=True):
        bits[rows[0] >> 3] |= 1 << (rows[0] & 7)
    return bits


def _hits(docs: DataFrame, bits, least: int) -> DataFrame:
    """Of docs(doc_id, _h, _text), the rows with a seed that passes the sieve: such seeds, once each, and the words in them with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = bits.value
        mask = np.uint64(8 * len(sieve) - 1)
        for b in batches:
            found = []
            for row, text in enumerate(b.column(2).to_pylist()):
                ids = word_numbers(text)
                seeds = rolling(ids, least)
                low = seeds & mask
                hit = (sieve[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 == 1
                if hit.any():
                    near = np.zeros(len(ids), dtype=bool)
                    for j in range(least):
                        near[j : j + len(hit)] |= hit
                    at = np.flatnonzero(near)
                    found.append((row, np.unique(seeds[hit]).view(np.int64), at.astype(np.int32), ids[at]))
            if found:
                row, seeds, at, ids = zip(*found, strict=True)
                keep = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [keep.column(0), keep.column(1), pa.array(seeds, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32())), pa.array(ids, pa.list_(pa.int64()))],
                    names=["doc_id", "_h", "seeds", "places", "near"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, _h long, seeds array<long>, places array<int>, near array<long>")


def tile_pair(item: np.ndarray, places: np.ndarray, near: np.ndarray, least: int, coverage: float) -> list[tuple[int, int, int]]:
    """Tiles of an item in a text of which the words `near` at `places` are given; none if they cover less than the threshold."""
    need = coverage * len(item)
    if np.isin(item, near).sum() < need:
        return []
    # a break between words that are not neighbours
    gap = np.flatnonzero(np.diff(places) > 1) + 1
    text, at = np.insert(near, gap, -1), np.insert(places, gap, -1)
    found = tiles(item, text, least)
    return [(x, int(at[t]), n) for x, t, n in found] if sum(n for _, _, n in found) >= need else []


TILE = "array<struct<item_start:int,text_start:int,n_words:int>>"


def _found(docs: DataFrame, benchmark: DataFrame, least: int, coverage: float) -> DataFrame:
    """doc_id, _h (a hash of the text), item_id, n_covered, n_item_words, coverage and tiles."""
    scratch = Scratch(docs.sparkSession)
    items = _items(benchmark, least, scratch)
    seeds = scratch.write(items.select("_item", F.explode("seeds").alias("seed"), F.size("words").alias("n")), "seeds")
    bits = docs.sparkSession.sparkContext.broadcast(_sieve(seeds))
    hits = scratch.write(_hits(docs.select("doc_id", F.xxhash64("text").alias("_h"), F.col("text").alias("_text")), bits, least).withColumn("_doc", F.monotonically_increasing_id()), "hits")
    # tiles lie in seeds that both have: a pair with too few can't reach the threshold
    shared = hits.select("_doc", F.explode("seeds").alias("seed")).join(seeds, "seed").groupBy("_doc", "_item").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    pairs = shared.filter(F.col("k") * least >= F.col("n") * coverage).select("_doc", "_item")
    given = pairs.join(hits.drop("seeds"), "_doc").join(items.drop("seeds"), "_item").select("doc_id", "_h", "item_id", "places", "near", "words")
    kinds = {c: given.schema[c].dataType.simpleString() for c in ("doc_id", "item_id")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                places, near, item = (b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (3, 4, 5))
                if found := tile_pair(item, places, near, least, coverage):
                    rows.append((i, sum(n for _, _, n in found), len(item), found))
            if rows:
                at, covered, n, found = zip(*rows, strict=True)
                keep = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([
                    *keep.columns[:3], pa.array(covered, pa.int32()), pa.array(n, pa.int32()), pa.array([c / k for c, k in zip(covered, n, strict=True)]),
                    pa.array([[dict(zip(("item_start", "text_start", "n_words"), x, strict=True)) for x in f] for f in found],
                             pa.list_(pa.struct([("item_start", pa.int32()), ("text_start", pa.int32()), ("n_words", pa.int32())])))],
                    names=["doc_id", "_h", "item_id", "n_covered", "n_item_words", "coverage", "tiles"])

    return given.mapInArrow(run, f"doc_id {kinds['doc_id']}, _h long, item_id {kinds['item_id']}, n_covered int, n_item_words int, coverage double, tiles {TILE}")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, n_covered, n_item_words, coverage and tiles of every row of docs and item that it covers.

    docs(doc_id, text), benchmark(item_id, text). Tiles of `least` words or more are found in any order, so a
    reordered passage counts; an item is covered if its tiles hold the share `coverage` of its words. Null and
    empty texts, and items of fewer than `least` words, match nothing. Repeated rows and items each answer; an
    empty table gives no rows; other columns are not read. One pass over docs, whatever the number of items: seeds
    of documents are hash-joined with those of items, and only pairs that share enough of them are tiled.
    """
    return _found(docs, benchmark, least, coverage).drop("_h")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that contaminated() would not name, with their columns as given; rows equal in doc_id and text share the verdict."""
    names = docs.columns
    held = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    scratch = Scratch(docs.sparkSession)
    bad = scratch.write(_found(docs, benchmark, least, coverage).select(F.col("doc_id").alias("_id"), "_h").distinct(), "bad")
    kept = held.join(bad, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_h")), "left_anti")
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
