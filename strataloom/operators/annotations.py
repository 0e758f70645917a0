"""Annotations against windows: overlap joins, cohorts, the one window of a unit, grounding."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.text import splitter
from ..functions.vectors import cosine
from ..runtime import prepare


def _windows_of(refs: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(annotation_id, cites), an annotation once, and (cites, windows): the windows of each set of ranges that annotations cite.

    Annotations that cite the same ranges have the same windows, so ranges are joined once for each set of them, with the ranges of a
    window's unit as one row. What is joined and shuffled grows with the rows and with the sets, not with their product.
    """
    part = F.col("start_char").isNull() | F.col("end_char").isNull()
    span = F.struct("unit_id", *(F.when(~part, F.col(c)).alias(c) for c in ("start_char", "end_char")))
    cites = refs.filter("unit_id is not null").select("annotation_id", span.alias("c")).groupBy("annotation_id").agg(F.array_sort(F.collect_set("c")).alias("cites"))
    held = fragments.select("window_id", "unit_id", F.struct(F.col("start_char").alias("s"), F.col("end_char").alias("e")).alias("r")).distinct()
    held = held.groupBy("window_id", "unit_id").agg(F.collect_list("r").alias("ranges"))
    each = cites.select("cites").distinct().select("cites", F.explode("cites").alias("c")).select("cites", "c.*").join(held, "unit_id")
    hit = lambda r: F.coalesce((F.col("start_char") < r["e"]) & (r["s"] < F.col("end_char")), F.lit(True))
    whole = lambda r: F.col("start_char").isNull() | r["s"].isNull() | r["e"].isNull() | hit(r)
    pairs = each.filter(F.exists("ranges", whole)).select("cites", "window_id").distinct()
    return cites, pairs.groupBy("cites").agg(F.collect_list("window_id").alias("windows"))


def overlapping(refs: DataFrame, fragments: DataFrame) -> DataFrame:
    """(annotation_id, window_id), each once: references and window fragments of one unit whose ranges overlap; a missing range is the whole unit."""
    cites, windows = _windows_of(refs, fragments)
    return cites.join(windows, "cites").select("annotation_id", F.explode("windows").alias("window_id"))


def overlap_cohorts(refs: DataFrame, fragments: DataFrame, inputs: DataFrame) -> DataFrame:
    """cohorts() of overlapping(), without the pairs: (window_id, n_members, input_hash).

    Windows are dealt to as many groups as tasks run at once. A group gets each annotation that one of its windows holds once, with
    those windows, in order of (annotation_id, content_hash); a task keeps a hash and a count for each of its windows.
    """
    cites, windows = _windows_of(refs, fragments)
    n = max(1, refs.sparkSession.sparkContext.defaultParallelism)
    group = F.pmod(F.xxhash64("window_id"), F.lit(n)).cast("int").alias("_g")
    dealt = windows.select("cites", F.explode("windows").alias("window_id")).groupBy("cites", group).agg(F.collect_list("window_id").alias("windows"))
    members = cites.join(inputs.select("annotation_id", "content_hash").distinct(), "annotation_id")
    each = members.join(dealt, "cites").select("_g", "annotation_id", "content_hash", "windows")
    rows = each.repartitionById(n, F.col("_g")).sortWithinPartitions("annotation_id", "content_hash")
    piece = F.concat_ws(":", F.col("annotation_id").cast("string"), "content_hash").alias("piece")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict = {}
        hashes: dict = {}
        for batch in batches:
            pieces = [p.encode() for p in batch.column("piece").to_pylist()]
            lists = batch.column("windows")
            coded = lists.flatten().dictionary_encode()
            code = coded.indices.to_numpy()
            row = np.repeat(np.arange(len(pieces)), lists.value_lengths().to_numpy())
            at = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))
            for window, of in zip(coded.dictionary.to_pylist(), np.split(row[at], ends[:-1]), strict=True):
                text = b",".join([pieces[i] for i in of.tolist()])
                if window in hashes:
                    hashes[window].update(b",")
                else:
                    count[window], hashes[window] = 0, hashlib.sha256()
                hashes[window].update(text)
                count[window] += len(of)
        if count:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(count), type=kind), pa.array(list(count.values()), type=pa.int32()), pa.array([h.hexdigest() for h in hashes.values()])], names=["window_id", "n_members", "input_hash"])

    schema = T.StructType([T.StructField("window_id", fragments.schema["window_id"].dataType), T.StructField("n_members", T.IntegerType()), T.StructField("input_hash", T.StringType())])
    kind = to_arrow_type(schema["window_id"].dataType)
    return rows.select(piece, "windows").mapInArrow(fold, schema)


def cohorts(pairs: DataFrame, inputs: DataFrame) -> DataFrame:
    """Per window its annotations by id, and a hash of (id, content hash) of them all; inputs(annotation_id, content_hash)."""
    each = pairs.join(inputs, "annotation_id")
    got = each.groupBy("window_id").agg(F.array_sort(F.collect_set(F.struct("annotation_id", "content_hash"))).alias("members"))
    text = F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["annotation_id"].cast("string"), m["content_hash"])), ",")
    return got.select("window_id", F.size("members").alias("n_members"), F.sha2(text, 256).alias("input_hash"))


def only_window(windows: DataFrame) -> DataFrame:
    """(unit_id, window_id): the window of a unit, null if several cite it. windows(window_id, unit_ids)."""
    each = windows.select("window_id", F.explode("unit_ids").alias("unit_id"))
    return each.groupBy("unit_id").agg(F.when(F.min("window_id") == F.max("window_id"), F.min("window_id")).alias("window_id"))


def consolidate(hits: DataFrame, windows: DataFrame, nominated: DataFrame) -> DataFrame:
    """Unit hits with the key they are fused under: their only window if that was nominated, else the unit."""
    own = only_window(windows).join(nominated.select("window_id").distinct(), "window_id", "left_semi")
    got = hits.join(own, "unit_id", "left")
    return got.withColumn("key", F.coalesce(F.concat(F.lit("w"), F.col("window_id").cast("string")), F.concat(F.lit("u"), F.col("unit_id").cast("string"))))


def best_per_kind(vectors: DataFrame, cap: int) -> DataFrame:
    """Of (kind, key, vector_id, similarity): the best of each key, ties to the lesser id; then the first `cap` keys of a kind."""
    from .ranking import top_per

    best = vectors.groupBy("kind", "key").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "vector_id")).alias("b"))
    rows = best.select("kind", "key", (-F.col("b.s")).alias("similarity"), F.col("b.vector_id").alias("vector_id"))
    return top_per(rows, ["kind"], [F.col("similarity").desc(), F.col("key").asc()], cap)


def scan(vectors: DataFrame, query: Sequence[float], cap: int, source: str = "source") -> DataFrame:
    """(list, window_id, score, source_score, vector_id, position) of published vectors(kind, window_id, vector_id, vector).

    Each kind is one list of at most `cap` windows, a window once: by its best vector of the kind, ties to the lesser id. Only a window
    with a vector of the kind `source` is nominated, and its best source similarity breaks ties; then the window's key does.
    """
    from .ranking import top_per

    scored = vectors.select("kind", "window_id", "vector_id", cosine(F.col("vector"), query).alias("s")).filter("s is not null and not isnan(s)")
    best = scored.groupBy("kind", "window_id").agg(F.min(F.struct((-F.col("s")).alias("s"), "vector_id")).alias("b"))
    own = best.filter(F.col("kind") == source).select("window_id", (-F.col("b.s")).alias("source_score"))
    each = best.join(own, "window_id").select(F.col("kind").alias("list"), "window_id", (-F.col("b.s")).alias("score"), "source_score", F.col("b.vector_id").alias("vector_id"))
    return top_per(each, ["list"], [F.col("score").desc(), F.col("source_score").desc(), F.col("window_id").cast("string").asc()], cap, "position")


def plain(text: str) -> str:
    return "".join(c for c in text.lower() if c.isalnum())


def _common(masks: dict[str, int], n: int, text: str) -> int:
    """Length of the longest common subsequence of a quote of n letters, given as a bit mask for each letter, and a text.

    One addition of n-bit numbers for each letter of the text: a bit is off where the length grows by one.
    """
    whole = (1 << n) - 1
    v = whole
    for c in text:
        if m := masks.get(c):
            u = v & m
            v = (v + u | v - u) & whole
    return n - v.bit_count()


def grounded(source: str, quote: str) -> bool:
    """Whether a quote is in its source, letters and digits alone counting.

    As a substring, or aligned with few repairs (characters put in or changed: a quarter of the quote at most, and 4 or 15 %)
    and few omissions (source characters passed over inside the match: 32, or the quote's length). A match lies in a stretch of
    the quote's length and the omissions, so the source is looked at in windows that overlap by that; a window is aligned only if
    it has enough of the quote's letters in order, which every match needs.
    """
    q, s = plain(quote), plain(source)
    if not q:
        return False
    if q in s:
        return True
    repairs = min(len(q) // 4, max(4, len(q) * 3 // 20))
    omissions = max(32, len(q))
    if len(q) - repairs > len(s):
        return False
    masks: dict[str, int] = {}
    for i, c in enumerate(q):
        masks[c] = masks.get(c, 0) | 1 << i
    reach = len(q) + omissions
    step = max(1, reach // 4)
    for at in range(0, max(len(s) - reach, 0) + step, step):
        part = s[at : at + reach + step]
        # what needs few repairs is found in a small table
        if _common(masks, len(q), part) >= len(q) - repairs and any(_aligned(part, q, n, omissions) for n in sorted({0, min(4, repairs), repairs})):
            return True
    return False


def _aligned(s: str, q: str, repairs: int, omissions: int) -> bool:
    """The table has for each number of repairs the fewest omissions that end at each place of the source; a row is one numpy pass."""
    letters = np.frombuffer(s.encode("utf-32-le"), dtype="<u4")
    far, at = omissions + 1, np.arange(len(s) + 1, dtype=np.int32)
    before = np.full((repairs + 1, len(s) + 1), far, dtype=np.int32)
    before[0] = 0
    for i, c in enumerate(q, 1):
        now = np.full_like(before, far)
        same = letters == ord(c)
        now[:, 1:] = np.where(same, before[:, :-1], far)
        now[1:, 1:] = np.minimum(now[1:, 1:], np.where(same, far, before[:-1, :-1]))
        now[1:] = np.minimum(now[1:], before[:-1])
        now[i + 1 :] = far
        if i <= repairs:
            now[i, 0] = 0
        # an omission moves one place to the right at the cost of one
        before = np.minimum(np.minimum.accumulate(now - at, axis=1) + at, far)
        if before.min() > omissions:
            return False
    return bool((before <= omissions).any())


def shared_runs(texts: DataFrame, lengths: Sequence[int], wanted: Sequence[str] | None = None) -> DataFrame:
    """(id, run), each once: runs of so many words of texts(id, text), words being lower-cased letters and digits, joined by spaces.

    With `wanted`, only those runs. Runs of a text are looked up by numbers made of their words' numbers, all at once, before any is spelt.
    """
    split = splitter(prepare(texts.sparkSession))
    key, low = texts.columns
    bits = 20

    def numbers(ids: np.ndarray, n: int) -> np.ndarray:
        out = ids[: len(ids) - n + 1]
        for j in range(1, n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : len(ids) - n + 1 + j]
        return (out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, number, maybe = frozenset(wanted or ()), {}, {n: np.zeros(1 << bits, dtype=bool) for n in lengths}
        for run in whole:
            words = run.split(" ")
            if len(words) in maybe:
                maybe[len(words)][numbers(np.array([number.setdefault(w, len(number) + 1) for w in words], dtype=np.uint64), len(words))] = True
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = split(text or "")
                own: dict[str, None] = {}
                ids = np.array([number.get(w, 0) for w in words], dtype=np.uint64) if wanted is not None else None
                for n in lengths:
                    if len(words) < n:
                        continue
                    at = range(len(words) - n + 1) if ids is None else np.flatnonzero(maybe[n][numbers(ids, n)]).tolist()
                    own.update((r, None) for i in at if (r := " ".join(words[i : i + n])) in whole or ids is None)
                rows += [row] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), pa.array(found, type=pa.string())], names=["id", "run"])

    return texts.select(key, F.lower(low)).mapInArrow(find, T.StructType([T.StructField("id", texts.schema[key].dataType), T.StructField("run", T.StringType())]))


@F.pandas_udf(T.BooleanType())
def grounded_col(source: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([a is not None and b is not None and grounded(a, b) for a, b in zip(source, quote, strict=True)])


def attributed(targets: list[tuple[str, str]], quotes: list[str]) -> list[str]:
    """The targets (id, text) that ground one of the quotes; all of them if none does."""
    hit = [i for i, text in targets if any(grounded(text, q) for q in quotes)]
    return hit or [i for i, _ in targets]
