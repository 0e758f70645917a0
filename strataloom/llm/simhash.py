"""SimHash near-duplicates: tiled exact comparison with numpy exclusive-or and bit counts."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected

BITS = 64
SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints along one side of a tile; a tile pair is compared as numpy arrays of at most TILE x TILE.
TILE = 1024
#: Shingle hashes turned into bits at once; a longer text is added up in pieces.
FLUSH = 1 << 17


def _hashes(text: bytes | None, k: int) -> list[int]:
    w = (text or b"").lower().split()  # both of bytes are ASCII-only: A-Z, and \x20 \x09-\x0D
    h = xxhash.xxh64_intdigest
    if not w:
        return []
    if len(w) < k:
        return [h(b" ".join(w), SEED)]
    return [h(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(k)), strict=False)]


def _bit_sums(values: np.ndarray, starts: list[int]) -> np.ndarray:
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints(texts: list[bytes | None], k: int = SHINGLE) -> np.ndarray:
    """One unsigned 64-bit fingerprint a text: a bit is set if it is in over half the shingle hashes."""
    sums = np.zeros((len(texts), BITS), dtype=np.int64)
    total = np.zeros(len(texts), dtype=np.int64)
    held, starts, owners = array("Q"), [], []

    def flush() -> None:
        nonlocal held, starts, owners
        if owners:
            np.add.at(sums, owners, _bit_sums(np.frombuffer(held, dtype="<u8"), starts))
        held, starts, owners = array("Q"), [], []

    for i, text in enumerate(texts):
        hashes = _hashes(text, k)
        total[i] = len(hashes)
        for at in range(0, len(hashes), FLUSH):
            starts.append(len(held))
            owners.append(i)
            held.extend(hashes[at : at + FLUSH])
            if len(held) >= FLUSH:
                flush()
    flush()
    on = 2 * sums > total[:, None]
    return np.packbits(on, axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprint(docs: DataFrame, keep: list[str], text: str = "text", k: int = SHINGLE) -> DataFrame:
    """The columns `keep` and `_fp`, the fingerprint as a signed long. Row-wise, no shuffle."""
    schema = docs.select(*keep).withColumn("_fp", F.lit(0).cast("long")).schema
    slot = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprints(b.column(slot).cast(pa.binary()).to_pylist(), k)
            yield pa.RecordBatch.from_arrays([*b.columns[:slot], pa.array(fp.view(np.int64))], names=[*keep, "_fp"])

    return docs.select(*keep, F.col(text).alias("_fp_text")).mapInArrow(run, schema)


def _masks() -> list[int]:
    """Nine sets of bits such that two fingerprints that differ in at most two bits agree on one whole set.

    Two differing bits touch at most two of three blocks, so one block agrees; within the other two,
    cut into three again, one block more agrees. Each set is one outer and one inner block.
    """

    def cut(bits: list[int]) -> list[list[int]]:
        n = len(bits)
        return [bits[n * i // 3 : n * (i + 1) // 3] for i in range(3)]

    out = []
    for outer in cut(list(range(BITS))):
        rest = [b for b in range(BITS) if b not in outer]
        out += [sum(1 << b for b in outer + inner) for inner in cut(rest)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def _hook(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """label with the classes of x and y joined, pair by pair; a label is the least number of its class."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label = label[label]


def tile_links(fps: np.ndarray, counts: np.ndarray, radius: int = RADIUS, tile: int = TILE, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span each component among fingerprints sorted by population count.

    Every tile pair whose population counts can be within the radius is compared exactly; a pair whose
    ranges lie further apart is skipped, as bit counts that differ by more than the radius cannot link.
    With `sides`, only fingerprints of different sides are compared.
    """
    fps = fps.view(np.uint64)  # bit counts of signed numbers are those of their absolute values
    label = np.arange(len(fps))
    for i in range(0, len(fps), tile):
        a = fps[i : i + tile]
        top = counts[min(i + tile, len(fps)) - 1]
        for j in range(i, len(fps), tile):
            if int(counts[j]) - int(top) > radius:
                break
            near = np.bitwise_count(a[:, None] ^ fps[None, j : j + tile]) <= radius
            if sides is not None:
                near &= sides[i : i + tile, None] != sides[None, j : j + tile]
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            if len(x):
                label = _hook(label, x[x < y], y[x < y])
    return [(i, r) for i, r in enumerate(label.tolist()) if r != i]


def _runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns after the first `keys`, of each run of rows that agree on those; runs go on over batches."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        key = np.stack([c.astype(np.int64) for c in cols[:keys]], axis=1)
        at = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if last is not None and (key[lo] != last).any():
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            held.append([c[lo:hi] for c in cols[keys:]])
            last = key[lo]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _linker(radius: int, tile: int, keys: int):
    """Links among the rows of each run: fingerprint, population count and, if given, the side of a tile pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for fp, ones, *sides in _runs_of(batches, keys):
            if len(fp) < 2:
                continue
            if len(fp) == 2:
                if int(np.bitwise_count(fp.view(np.uint64)[0] ^ fp.view(np.uint64)[1])) <= radius and not (sides and sides[0][0] == sides[0][1]):
                    a.append(int(fp[0]))
                    b.append(int(fp[1]))
            else:
                for x, y in tile_links(fp, ones, radius, tile, sides[0] if sides and (sides[0] != 0).any() else None):
                    a.append(int(fp[x]))
                    b.append(int(fp[y]))
            if len(a) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _tile_pairs(rows: DataFrame, scratch: Scratch, tile: int) -> DataFrame:
    """Of the rows (k, m, _fp, ones) of large buckets: each row once for every tile pair that it is in.

    A tile is the rows of a bucket with one population count and one hash class, of some `tile` rows. A tile is paired
    with itself and with those tiles of the bucket whose population count is at most RADIUS more.
    """
    sizes = scratch.write(rows.groupBy("k", "m", "ones").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("tiles")), "tiles")
    other = sizes.select(F.col("k").alias("k2"), F.col("m").alias("m2"), F.col("ones").alias("ones2"), F.col("tiles").alias("tiles2"))
    near = sizes.join(other, (F.col("k") == F.col("k2")) & (F.col("m") == F.col("m2")) & (F.abs(F.col("ones") - F.col("ones2")) <= RADIUS))
    # a bucket has 65 population counts at most, and each 5 neighbours at most
    near = near.groupBy("k", "m", "ones").agg(F.max("tiles").alias("tiles"), F.array_sort(F.collect_list(F.struct("ones2", "tiles2"))).alias("near"))
    placed = rows.join(near, ["k", "m", "ones"]).withColumn("at", F.pmod(F.xxhash64("_fp"), F.col("tiles")).cast("int"))
    dealt = placed.select("k", "m", "_fp", "ones", "at", F.explode("near").alias("o")).select(
        "*", F.explode(F.expr("sequence(0, o.tiles2 - 1)")).alias("at2"))
    first = (F.col("ones") < F.col("o.ones2")) | (F.col("ones") == F.col("o.ones2")) & (F.col("at") <= F.col("at2"))
    mine, theirs = F.struct(F.col("ones").cast("int").alias("o"), F.col("at").alias("t")), F.struct(F.col("o.ones2").cast("int").alias("o"), F.col("at2").alias("t"))
    return dealt.select(
        "k", "m", F.when(first, mine).otherwise(theirs).alias("l"), F.when(first, theirs).otherwise(mine).alias("r"), "_fp", "ones", F.when(first, 0).otherwise(1).alias("side"),
    ).select("k", "m", F.col("l.o").alias("lo"), F.col("l.t").alias("lt"), F.col("r.o").alias("ro"), F.col("r.t").alias("rt"), "_fp", "ones", "side")


def near_classes(scratch: Scratch, fps: DataFrame, tile: int = TILE) -> DataFrame:
    """Of rows (doc_id, _fp): one row per distinct fingerprint (_fp, component_id), linked at RADIUS bits or fewer.

    Copies meet as one row before anything is compared. A fingerprint is dealt to nine buckets, one of
    which it shares with any other within the radius. A bucket of up to `tile` fingerprints is one group, sorted by
    population count and compared at once; of a larger one every tile pair within the radius of population
    counts is a group of its own, so no group holds more than two tiles. A group answers with the links of a spanning
    forest, so dense groups stay linear.
    """
    groups = scratch.write(fps.groupBy("_fp").agg(F.min("doc_id").alias("least")), "groups")
    keyed = groups.select(
        F.posexplode(F.array(*(F.col("_fp").bitwiseAND(F.lit(m)) for m in _masks()))).alias("k", "m"), "_fp"
    ).select("k", "m", "_fp", F.bit_count("_fp").alias("ones"))
    # at most 9 / tile of a row for each fingerprint
    large = scratch.write(keyed.groupBy("k", "m").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("k", "m"), "large")
    some = bool(large.take(1))
    usual = keyed.join(large, ["k", "m"], "left_anti") if some else keyed
    links = (
        usual.repartition("k", "m").sortWithinPartitions("k", "m", "ones").select("k", "m", "_fp", "ones")
        .mapInArrow(_linker(RADIUS, tile, 2), "a long, b long")
    )
    if some:
        pairs = _tile_pairs(keyed.join(large, ["k", "m"]).select("k", "m", "_fp", "ones"), scratch, tile)
        key = ["k", "m", "lo", "lt", "ro", "rt"]
        links = links.union(pairs.repartition(*key).sortWithinPartitions(*key, "ones").mapInArrow(_linker(RADIUS, tile, len(key)), "a long, b long"))
    roots = connected(scratch, links)
    named = groups.join(roots, groups["_fp"] == roots["node"], "left").select(
        "_fp", "least", F.coalesce("root", "_fp").alias("root")
    )
    named = scratch.write(named, "rooted")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return scratch.write(named.join(least, "root").select("_fp", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per row of docs (doc_id, text).

    Null and empty texts have fingerprint zero and link like any other. Repeated rows give repeated rows.
    A null doc_id never names a component; one of null ids alone has a null component_id. An empty table
    gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    fps = scratch.write(with_fingerprint(docs, ["doc_id"]), "fps")
    classes = near_classes(scratch, fps)
    return fps.join(classes, "_fp").select(
        "doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each near-duplicate class: the one of the least doc_id (nulls last), then fingerprint.

    Columns come back as given, whatever their names. Rows equal in doc_id and text count as one. doc_id may be of any
    type that sorts; null and empty texts have fingerprint zero; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    names = docs.columns
    held = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    doc_id, text = (f"c{names.index(c)}" for c in ("doc_id", "text"))
    light = held.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_h"))
    fps = scratch.write(with_fingerprint(light, ["doc_id", "_h"]), "fps")
    classes = near_classes(scratch, fps)
    # a class of null ids alone has no component_id; its fingerprints stand for themselves
    first = fps.join(classes, "_fp").groupBy(
        F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("_fp").cast("string"))).alias("_class")
    ).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_fp", "_h")).alias("w"))
    key = lambda doc, h: F.concat_ws(":", F.coalesce(F.col(doc).cast("string"), F.lit("-")), h.cast("string"))
    winners = scratch.write(first.select(key("w.doc_id", F.col("w._h")).alias("_key")), "winners")
    # texts are shuffled once, by the key; dropping repeated rows by it needs no more
    kept = held.withColumn("_key", key(doc_id, F.xxhash64(text))).join(winners, "_key").dropDuplicates(["_key"])
    return kept.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
