"""A document quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Labelled rows that the document classifier is fitted on, at most: those of the least hash of id.
SAMPLE = 20_000
RIDGE = 3.0
STEPS = 25
#: Documents are scored by a classifier that has seen no label of their own fold.
FOLDS = 2
SHAPES, TERMS = 64, 256
#: Shares enter as log(1 + SPREAD * share).
SPREAD = 100.0
#: Words that a worker keeps the buckets of.
HOLD = 1_000_000
#: A site's sums are of values in millionths, so that they don't depend on the order of rows.
UNIT = 1_000_000

_LETTERS = (re.compile(r"[^\W\d_]+"), re.compile(r"\d+"))


def shape(word: str) -> str:
    """The word with runs of letters as a, or A if in capitals, runs of digits as 9, and runs of one other character as that."""
    out = _LETTERS[0].sub(lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a", word)
    return re.sub(r"([^aA9])\1+", r"\1", _LETTERS[1].sub("9", out))


def bucket(word: str) -> tuple[int, int]:
    h = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))
    return h(shape(word)) % SHAPES, h(word.lower()) % TERMS


_buckets: dict[str, tuple[int, int]] = {}


def features(text: str | None) -> np.ndarray:
    """Of the whole text: log words, characters a word, shares of words equal to the one before and of distinct words and lines, then of
    words by the bucket of their shape and by that of the word itself. Null counts as empty."""
    words = text.split() if text else []
    out = np.zeros(5 + SHAPES + TERMS)
    if not words:
        return out
    n = len(words)
    if len(_buckets) > HOLD:
        _buckets.clear()
    counts = Counter(words)
    for w, k in counts.items():
        if w not in _buckets:
            _buckets[w] = bucket(w)
        s, t = _buckets[w]
        out[5 + s] += k
        out[5 + SHAPES + t] += k
    lines = [x for x in text.split("\n") if x.strip()]
    out[5:] = np.log1p(SPREAD * out[5:] / n)
    out[:5] = (
        math.log1p(n), len(text) / n, math.log1p(SPREAD * sum(map(eq, words, words[1:])) / n), len(counts) / n, math.log1p(SPREAD * (1 - len(set(lines)) / max(len(lines), 1))))
    return out


class Linear:
    """Ridge logistic regression on standardised features; log-odds of quality 1. Without rows, 0."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        k = 5 + SHAPES + TERMS
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(k), np.ones(k))
        self.scale[self.scale < 1e-9] = 1e9  # what does not vary says nothing
        z, self.beta = self._design(x) if len(x) else np.zeros((0, k + 1)), np.zeros(k + 1)
        ridge = np.full(k + 1, RIDGE)
        ridge[0] = 1e-3
        for _ in range(STEPS if len(x) else 0):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            w = np.maximum(p * (1 - p), 1e-6)
            step = np.linalg.solve((z * w[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * self.beta)
            self.beta = self.beta + np.clip(step, -2, 2)

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.ones((len(z), 1)), z], axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.round(1 / (1 + np.exp(-np.clip(self._design(x) @ self.beta, -30, 30))), 6)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(q / (1 - q))


def _strength(cells: DataFrame, up: Column) -> float:
    """Prior strength by moments: how much less the cells' rates differ from the level above than they would by chance alone.

    Sums over cells only: variance of rates about the prior = p (1 - p) (1 / (s + 1)) + sampling noise.
    """
    rate = F.col("good") / F.col("n")
    row = cells.filter("n > 0").agg(
        F.sum(F.col("n") * (rate - up) * (rate - up)).alias("v"), F.sum(up * (1 - up)).alias("noise"), F.sum(F.col("n") * up * (1 - up)).alias("m")).first()
    if not row["m"]:
        return 10.0
    rho = (row["v"] - row["noise"]) / max(row["m"] - row["noise"], 1e-9)
    return round(float(min(max(1 / max(rho, 1e-4) - 1, 0.5), 10_000.0)), 6)


def _fitted(docs: DataFrame, marks: DataFrame, scratch: Scratch) -> list[Linear]:
    """One classifier a fold, of the labelled rows of the other folds."""
    # the sample is of labelled documents, so that it doesn't shrink where labels name ids that are not there
    ids = scratch.write(marks.join(docs.select(F.col("doc_id").alias("_d")), F.col("_id") == F.col("_d"), "left_semi").orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE), "sample")
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).select(fold(F.col("doc_id")).alias("fold"), "label", "_text", "_id")  # SAMPLE ids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features(t) for t in b.column(2).to_pylist()], pa.list_(pa.float64()))], names=["fold", "label", "x"])

    # a sampled id with many rows counts once for each distinct text, and those of one id are taken in the order of their hash
    each = rows.dropDuplicates().withColumn("_o", F.xxhash64("_id", "_text")).orderBy("_o").limit(SAMPLE).drop("_o", "_id")
    got = each.mapInArrow(run, "fold long, label double, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, 5 + SHAPES + TERMS)
    y, k = got.column("label").to_numpy(), got.column("fold").to_numpy()
    order = np.lexsort((*x.T[:5], y))
    x, y, k = x[order], y[order], k[order]
    return [Linear(x[k != f], y[k != f]) for f in range(FOLDS)]


def _scored(docs: DataFrame, models: list[Linear]) -> DataFrame:
    keep = ["doc_id", "host", "path", "_fold"]
    schema = docs.select(*keep).withColumn("p_document", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, p = b.column(3).to_numpy(), np.zeros(b.num_rows)
            x = np.array([features(t) for t in b.column(4).to_pylist()]).reshape(b.num_rows, -1)
            for f, m in enumerate(models):
                if (at == f).any():
                    p[at == f] = m.probability(x[at == f])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(p)], names=[*keep, "p_document"])

    return docs.select(*keep, "_text").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """doc_id, p_document, p_path, p_host, score and kept (score >= 0.5) of every row of docs.

    docs(doc_id, text, host, path), labels(doc_id, quality). A document's probability comes from a classifier fitted on labels of
    the other fold of ids alone. Each host's rate of good documents is shrunk to the global rate, each path's (path
    within host) to its host's, with strengths estimated over all cells. Cells count labels where there are any and the
    classifier's probability elsewhere, so sites without labels are told apart too; the document itself is left out of the rates
    that judge it. score adds to the document's log-odds those of its path against the global rate.
    Null hosts and paths are sites of their own; null and empty texts are scored as
    empty; ids labelled both ways, null ids and labels other than 0 and 1 are not used. Without labels every score is 0.5.
    Repeated rows each answer; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    light = docs.select(
        docs["doc_id"].alias("doc_id"), docs[host].cast("string").alias("host"), docs[path].cast("string").alias("path"), docs["text"].alias("_text"), fold(docs["doc_id"]).alias("_fold"))
    marks = scratch.write(labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("a"), F.max("quality").alias("b")).filter("a = b").select(
        F.col("doc_id").alias("_id"), F.col("a").cast("double").alias("label")), "marks")
    scored = scratch.write(_scored(light, _fitted(light, marks, scratch)), "documents")
    value = F.round(F.coalesce("label", "p_document") * UNIT).cast("long")
    scored = scratch.write(scored.join(marks, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "host", "path", "p_document", value.alias("v")), "values")
    paths = scratch.write(scored.groupBy("host", "path").agg(F.sum("v").alias("v"), F.count("*").alias("c")).selectExpr("host", "path", f"v / {UNIT}D good", "cast(c as double) n"), "paths")
    hosts = scratch.write(paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")), "hosts")
    good, n = hosts.agg(F.sum("good"), F.sum("n")).first()
    base = round((good + 1) / (n + 2), 9) if n else 0.5
    s_host = _strength(hosts, F.lit(base))
    above = hosts.select(F.col("host").alias("_hh"), F.col("good").alias("h_good"), F.col("n").alias("h_n"))
    under = paths.join(above, F.col("host").eqNullSafe(F.col("_hh"))).drop("_hh")
    s_path = _strength(under, (F.col("h_good") + s_host * base) / (F.col("h_n") + s_host))
    sites = scratch.write(under.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "good", "n", "h_good", "h_n"), "sites")
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    own = F.col("v") / float(UNIT)
    rates = joined.withColumn("p_host", (F.col("h_good") - own + s_host * base) / (F.col("h_n") - 1 + s_host)).withColumn(
        "p_path", (F.col("good") - own + s_path * F.col("p_host")) / (F.col("n") - 1 + s_path))
    score = F.round(1 / (1 + F.exp(-(_logit(F.col("p_document")) + _logit(F.col("p_path")) - _logit(F.lit(base))))), 9)
    return rates.select("doc_id", "p_document", "p_path", "p_host", score.alias("score")).withColumn("kept", F.col("score") >= 0.5)
