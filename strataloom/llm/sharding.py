"""Sharding by a Feistel permutation over global row numbers, with cycle walking. DataFrame functions only."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROUNDS = 8
SEED = 20_240_229
#: Two primes under 2^31: products of two numbers below them stay within a signed 64-bit integer.
P1, P2 = 2_147_483_647, 2_147_483_629
#: Bits of monotonically_increasing_id() below the partition number.
LOW = 33


class Feistel:
    """A keyed permutation of 0..n-1, the same in Python integers and in Spark columns.

    A number is split into two digits, base a and base b, with a * b >= n. Each round adds a keyed
    function of one digit to the other, which can be undone for any function. Results of n or more are
    permuted again until they fall below n (cycle walking). There are under sqrt(n) such numbers, so the
    longest walk is found beforehand, exactly, and written out as that many steps.
    """

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        if not 0 <= n < 1 << 61:
            raise ValueError(f"cannot permute {n} rows")
        self.n, self.a = n, max(1, math.isqrt(max(n - 1, 0)) + 1)
        self.b = max(1, -(-n // self.a))
        self.keys = []
        for i in range(rounds):
            d = hashlib.sha256(f"{seed}:{i}".encode()).digest()
            self.keys.append(tuple(int.from_bytes(d[8 * j : 8 * j + 8], "big") % (P2 - 1) + 1 for j in range(4)))
        self.steps = 1 + max((self._walk(x) for x in range(n, self.a * self.b)), default=0)

    def once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i, (m, c, m2, c2) in enumerate(self.keys):
            if i % 2:
                right = (right + ((left * m + c) % P1 * m2 + c2) % P2) % self.b
            else:
                left = (left + ((right * m + c) % P1 * m2 + c2) % P2) % self.a
        return left * self.b + right

    def _walk(self, start: int) -> int:
        """Steps from a number of n or more until below n; 0 on a cycle of such numbers alone, which no row enters."""
        x, steps = self.once(start), 1
        while x >= self.n:
            if x == start:
                return 0
            x, steps = self.once(x), steps + 1
        return steps

    def __call__(self, x: int) -> int:
        x = self.once(x)
        while x >= self.n:
            x = self.once(x)
        return x

    def columns(self, df: DataFrame, number: str, out: str) -> DataFrame:
        """df with `out`, the permuted `number`; one narrow projection a round, so no expression is doubled."""
        names = df.columns
        big = lambda k: F.lit(k).cast("long")

        def mixed(v: Column, key: tuple[int, ...]) -> Column:
            m, c, m2, c2 = map(big, key)
            return ((v * m + c) % big(P1) * m2 + c2) % big(P2)

        df = df.select(*names, F.col(number).alias("_fx"))
        for step in range(self.steps):
            df = df.select(*names, "_fx", F.expr(f"_fx div {self.b}L").alias("_fl"), (F.col("_fx") % big(self.b)).alias("_fr"))
            for i, key in enumerate(self.keys):
                left, right = F.col("_fl"), F.col("_fr")
                if i % 2:
                    right = (right + mixed(left, key)) % big(self.b)
                else:
                    left = (left + mixed(right, key)) % big(self.a)
                df = df.select(*names, "_fx", left.alias("_fl"), right.alias("_fr"))
            walked = F.col("_fl") * big(self.b) + F.col("_fr")
            if step:  # one that is in range already has arrived
                walked = F.when(F.col("_fx") >= big(self.n), walked).otherwise(F.col("_fx"))
            df = df.select(*names, walked.alias("_fx"))
        return df.withColumnRenamed("_fx", out)


def numbered(df: DataFrame, order: list[Column], out: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """df with gapless global row numbers in the given order, and the number of rows.

    One range shuffle; the rows are written with the partition and place in it, so no later retry can
    number them otherwise. Of the partitions only counts are added up: as many rows as there were tasks.
    Rows equal in all of `order` are told apart by their place in the input, so that a run of them, however
    long, is dealt to many tasks.
    """
    tied = df.select("*", F.monotonically_increasing_id().alias("_tie"))
    sort = [*order, F.col("_tie")]
    placed = scratch.write(
        tied.repartitionByRange(*sort).sortWithinPartitions(*sort).drop("_tie").select("*", F.monotonically_increasing_id().alias("_at")),
        "placed",
    )
    part = F.shiftright("_at", LOW).alias("_part")
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))
    offsets = scratch.write(counts.selectExpr("_part as _p", "sum(_n) over (order by _part) - _n as _before", "_n"), "offsets")
    n = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << LOW) - 1))
    got = placed.join(F.broadcast(offsets.drop("_n")), F.shiftright("_at", LOW) == F.col("_p"))
    return got.select(*df.columns, number.alias(out)), int(n)


def _placed(rows: DataFrame, doc_id: str, text: str, drop: list[str], shards: int, seed: int) -> DataFrame:
    if shards < 1:
        raise ValueError("at least one shard is needed")
    whole = F.coalesce(F.col(text), F.lit(""))
    sized = rows.select("*", (F.octet_length(whole) + 1).cast("long").alias("_size"), F.crc32(whole.cast("binary")).alias("_crc")).drop(*drop)
    order = [F.col(doc_id).asc_nulls_first(), F.col("_crc"), F.col("_size")]
    numbers, n = numbered(sized, order, "_row", Scratch(rows.sparkSession))
    mixed = Feistel(n, seed).columns(numbers, "_row", "_p")
    return mixed.select("*", (F.col("_p") % shards).cast("int").alias("_shard"), F.expr(f"_p div {shards}L").alias("_slot"))


def shard(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """The columns of docs, then shard and slot: a reproducible shuffle into shards of even row counts.

    Rows are numbered by doc_id (nulls first), then crc32 and size of the text; number p of the permutation
    goes to shard p mod shards, slot p div shards, so any row's place can be computed from its number alone.
    Size is the text's UTF-8 bytes plus 1; a null text counts as empty. Rows equal in doc_id and text are
    interchangeable. An empty table gives no rows. Columns named shard or slot are replaced.
    """
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    held = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)))
    placed = _placed(held, f"c{names.index('doc_id')}", f"c{names.index('text')}", [], shards, seed)
    return placed.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


def shard_digest(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard: the places that shard() gives, without moving a text."""
    placed = _placed(docs.select("doc_id", F.col("text").alias("_text")), "doc_id", "_text", ["_text"], shards, seed)
    return placed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
