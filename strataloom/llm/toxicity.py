"""Toxicity by weak supervision: a generative label model over lexicon and pattern voters, then a linear classifier."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FOLDS, HELD = 5, 0
#: Rows of which the classifier is fitted, at most: SAMPLE of each posterior class, by a hash of id and text.
SAMPLE = 6_000
#: Terms of the classifier, at most, and the z value of their association with the posterior labels that they must pass.
TERMS, Z = 2_000, 6.0
ROUNDS = 60
RIDGE = 0.05

# Common English terms of abuse by kind, from general knowledge.
LEXICONS: dict[str, tuple[str, ...]] = {
    "stupidity": ("idiot", "idiots", "idiotic", "moron", "morons", "moronic", "imbecile", "imbeciles"),
    "dullness": ("stupid", "dumb", "dumbass", "dimwit", "halfwit", "brainless", "dunce", "simpleton"),
    "ridicule": ("clown", "clowns", "buffoon", "joke", "laughable", "laughingstock", "fool", "fools"),
    "failure": ("loser", "losers", "failure", "nobody", "reject", "washout"),
    "contempt": ("pathetic", "worthless", "useless", "contemptible", "despicable", "miserable"),
    "filth": ("trash", "garbage", "filth", "filthy", "rubbish", "sewage"),
    "scum": ("scum", "scumbag", "vermin", "lowlife", "parasite", "maggot", "degenerate"),
    "disgust": ("disgusting", "revolting", "repulsive", "vile", "sickening", "gross", "hideous", "ugly"),
    "profanity": ("damn", "crap", "hell", "bastard", "bastards", "jerk", "ass", "asshole", "bitch", "shit", "fuck", "fucking"),
    "animals": ("pig", "pigs", "swine", "rat", "rats", "snake", "cockroach", "dog", "donkey"),
    "hate": ("hate", "hateful", "loathe", "detest", "despise"),
    "violence": ("kill", "die", "murder", "hang", "strangle", "stab", "exterminate"),
}
#: Pattern voters over the lower-cased text.
PATTERNS: dict[str, str] = {
    "address": r"\b(?:you|u|he|she|they|it)(?:'re| are| is|)\s+(?:an?\s+|such\s+an?\s+|the\s+)?(?:idiot|moron|loser|clown|stupid|pathetic|worthless|disgusting|trash|scum)",
    "dismissal": r"\b(?:shut up|get lost|go away|drop dead|piss off|screw you)\b",
    "epithet": r"\b(?:stupid|pathetic|worthless|disgusting|dumb|filthy|ugly)\s+(?:idiot|moron|loser|clown|trash|scum|fool|pig)",
    "shouting": r"!{3,}",
}
#: Voters whose lexicons are mined from labelled rows: terms and word beginnings, dealt out by rank.
MINED = 4
#: Mined terms, at most, and documents of the labelled sample that must have one.
MINED_TERMS, MINED_DF = 400, 5
VOTERS = (*LEXICONS, *PATTERNS, *(f"mined {i + 1}" for i in range(MINED)))
_WORD = re.compile(r"[^\W\d_]+")
_VOTE = {w: 1 << i for i, words in enumerate(LEXICONS.values()) for w in words}
_PATTERNS = [(re.compile(p), 1 << len(LEXICONS) + i) for i, p in enumerate(PATTERNS.values())]
#: Every pattern needs one of these somewhere; most texts have none, and are spared the search.
_GATE = re.compile(r"!!!|shut up|get lost|go away|drop dead|piss off|screw you|idiot|moron|loser|clown|stupid|pathetic|worthless|disgusting|trash|scum|dumb|filthy|ugly")


def features(text: str | None) -> set[str]:
    """Lower-cased words, and after `^` their first four and five letters, as insults are inflected."""
    words = set(_WORD.findall(text.lower())) if text else set()
    return words | {"^" + w[:4] for w in words if len(w) > 4} | {"^" + w[:5] for w in words if len(w) > 5}


def votes(text: str | None, mined: dict[str, int] | None = None) -> int:
    """Bit i is set if voter i fires on the whole text. len(VOTERS) is 20, so there are some million patterns at most."""
    if not text:
        return 0
    low, has = text.lower(), features(text)
    out = 0
    for w in _VOTE.keys() & has:
        out |= _VOTE[w]
    for w in mined.keys() & has if mined else ():
        out |= mined[w]
    if out or _GATE.search(low):
        for p, bit in _PATTERNS:
            if p.search(low):
                out |= bit
    return out


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


@dataclass
class LabelModel:
    """P(toxic) and, for each class, a tree of voters: P(vote | class, vote of the voter above)."""

    prior: float
    above: list[int]
    rates: np.ndarray  # [class, voter, vote of the voter above] -> P(fires)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        bits = (patterns[:, None] >> np.arange(len(self.above))) & 1
        logs = np.tile(np.log([1 - self.prior, self.prior]), (len(patterns), 1))
        for j, a in enumerate(self.above):
            at = bits[:, a] if a >= 0 else np.zeros(len(bits), dtype=np.int64)
            for y in (0, 1):
                r = self.rates[y, j][at]
                logs[:, y] += np.log(np.where(bits[:, j] == 1, r, 1 - r))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))

    @property
    def accuracies(self) -> dict[str, float]:
        """P(voter says what the class is), voters on their own."""
        return {v: float((1 - self.prior) * (1 - self.rates[0, j].mean()) + self.prior * self.rates[1, j].mean()) for j, v in enumerate(VOTERS)}


def _tree(bits: np.ndarray, weight: np.ndarray) -> list[int]:
    """Chow and Liu's tree: the spanning tree of the most mutual information given the class. weight: [pattern, class]."""
    m = bits.shape[1]
    gain = np.zeros((m, m))
    for y in (0, 1):
        w = weight[:, y]
        total = w.sum()
        if total <= 0:
            continue
        on = bits * w[:, None]
        both = (bits.T @ on + 0.25) / (total + 1)
        one = (on.sum(axis=0) + 0.5) / (total + 1)
        for a, b, p in ((one[:, None], one[None, :], both), (one[:, None], 1 - one[None, :], one[:, None] - both),
                        (1 - one[:, None], one[None, :], one[None, :] - both), (1 - one[:, None], 1 - one[None, :], 1 - one[:, None] - one[None, :] + both)):
            p = np.maximum(p, 1e-12)
            gain += total * p * np.log(p / np.maximum(a * b, 1e-12))
    above, inside = [-1] * m, [0]
    while len(inside) < m:
        rest = [j for j in range(m) if j not in inside]
        i, j = max(((i, j) for i in inside for j in rest), key=lambda x: (gain[x], -x[0], -x[1]))
        above[j] = i
        inside.append(j)
    return above


def fit_label_model(patterns: np.ndarray, label: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns; label is 1, 0 or -1 (unknown), n the rows of each.

    Known labels are kept as they are, unknown ones are latent. Accuracies are the voters' rates by class,
    correlations the tree's edges, chosen anew in each round. Without any known label a row starts as toxic
    if a voter fires.
    """
    m = len(VOTERS)
    bits = ((patterns[:, None] >> np.arange(m)) & 1).astype(np.int64)
    fires = bits.sum(axis=1)
    y = np.where(label >= 0, label, np.where(fires > 0, 0.8, 0.02)).astype(float)
    model = None
    for _ in range(rounds):
        w = np.stack([n * (1 - y), n * y], axis=1)
        above = _tree(bits, w)
        rates = np.zeros((2, m, 2))
        for j, a in enumerate(above):
            for v in (0, 1):
                there = (bits[:, a] if a >= 0 else np.zeros(len(bits), dtype=np.int64)) == v
                for c in (0, 1):
                    # a rare vote above leans on the voter's rate in the class as a whole
                    base = (w[:, c] @ bits[:, j] + 0.05) / (w[:, c].sum() + 1)
                    rates[c, j, v] = ((w[:, c] * there) @ bits[:, j] + 2 * base) / ((w[:, c] * there).sum() + 2)
        prior = float(np.clip(w[:, 1].sum() / max(w.sum(), 1), 1e-6, 1 - 1e-6))
        new = LabelModel(prior, above, np.clip(rates, 1e-7, 1 - 1e-7))
        latent = new.posterior(patterns)
        z = np.where(label >= 0, label, latent).astype(float)
        done = model is not None and float(np.abs(z - y) @ n) < 1e-6 * n.sum()
        model, y = new, z
        if done:
            break
    return model


@dataclass
class Classifier:
    """A linear classifier over presence of terms; the log-odds of label 1."""

    terms: list[str]
    weights: np.ndarray
    bias: float

    def scorer(self):
        weight = dict(zip(self.terms, self.weights.tolist(), strict=True))
        known, bias = weight.keys(), self.bias

        def score(text: str | None) -> float:
            x = bias + sum(weight[w] for w in sorted(known & features(text)))
            return float(1 / (1 + np.exp(-min(max(x, -50.0), 50.0))))

        return score


def fit_classifier(rows: list[tuple[list[int], float, float]], terms: list[str], steps: int = 800) -> Classifier:
    """Ridge logistic regression on (term numbers, posterior label, weight), by gradient steps with momentum."""
    k = len(terms)
    flat = np.array([t for r in rows for t in r[0]], dtype=np.int64)
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y, w = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    beta, speed, bias, bias_speed = np.zeros(k), np.zeros(k), 0.0, 0.0
    hess = np.bincount(flat, weights=w[owner], minlength=k) / 4 + RIDGE
    for _ in range(steps):
        x = bias + np.bincount(owner, weights=beta[flat], minlength=len(rows))
        g = w * (1 / (1 + np.exp(-np.clip(x, -50, 50))) - y)
        speed = 0.9 * speed - 0.2 * (np.bincount(flat, weights=g[owner], minlength=k) + RIDGE * beta) / hess
        bias_speed = 0.9 * bias_speed - 0.2 * g.sum() / (w.sum() / 4)
        beta, bias = beta + speed, bias + bias_speed
    return Classifier(terms, beta, float(bias))


class Toxicity:
    """label_model and classifier, learned from docs(doc_id, text) and labels(doc_id, toxic)."""

    def __init__(self, label_model: LabelModel, classifier: Classifier):
        self.label_model, self.classifier = label_model, classifier


def _unit(o: Column) -> Column:
    return F.pmod(o, F.lit(1 << 30)) / float(1 << 30)


def _telling(sample: DataFrame, least: int, most: int) -> list[str]:
    """Features of sample(target, words) whose association with the target passes Z, the strongest first."""
    mean = sample.agg(F.avg("target")).first()[0]
    if mean is None:
        return []
    stats = sample.select("target", F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("df"), F.sum("target").alias("hits")).filter(F.col("df") >= least)
    z = (F.col("hits") - F.col("df") * mean) / F.sqrt(F.col("df") * F.lit(max(mean * (1 - mean), 1e-9)))
    return [(r["term"], r["z"]) for r in stats.withColumn("z", z).filter(F.abs("z") > Z).orderBy(F.abs("z").desc(), "term").limit(most).collect()]


def _worded(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and the features of _text."""
    schema = rows.select(*keep).selectExpr("*", "cast(null as array<string>) words").schema
    slot = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:slot], pa.array([sorted(features(t)) for t in b.column(slot).to_pylist()], pa.list_(pa.string()))], names=[*keep, "words"])

    return rows.select(*keep, "_text").mapInArrow(run, schema)


def mine(train: DataFrame, known: DataFrame, scratch: Scratch) -> dict[str, int]:
    """Bits of the mined voters by term: the features that mark labelled rows as toxic.

    From a sample of SAMPLE rows of each label, in the mean, by a hash of the id: ids alone are joined with labels, and
    only the sample's texts are read. A labelled id's rows all count.
    """
    marked = train.select("doc_id").join(known, "doc_id").withColumn("o", F.xxhash64(F.col("doc_id").cast("string")))
    sizes = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("label") == label, min(1.0, SAMPLE / n)).otherwise(share)
    ids = scratch.write(marked.filter(_unit(F.col("o")) < share).select("doc_id", F.col("label").cast("double").alias("target")).distinct(), "mined-ids")
    rows = train.join(F.broadcast(ids), "doc_id")  # some 2 * SAMPLE ids
    sample = scratch.write(_worded(rows, ["target"]), "mined-sample")
    terms = [t for t, z in _telling(sample, MINED_DF, MINED_TERMS) if z > 0]
    return {t: 1 << len(LEXICONS) + len(PATTERNS) + i % MINED for i, t in enumerate(terms)}


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Toxicity:
    """Learned from rows of docs(doc_id, _text) that are not held out.

    Votes are taken of all of them and come to the driver as counts of patterns (2^20 at most, by label; those
    that occur are few). Mined lexicons and the classifier come from bounded samples of labelled rows.
    """
    train = docs.filter(~held_out(F.col("doc_id")))
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("a"), F.max("toxic").alias("b")).filter("a = b").select("doc_id", F.col("a").alias("label"))
    mined = mine(train, known, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array([votes(t, mined) for t in b.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), got, b.column(2)], names=["doc_id", "votes", "o"])

    order = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("_text"), F.lit("")))
    voted = scratch.write(
        train.select("doc_id", "_text", order.alias("o")).mapInArrow(run, train.select("doc_id", F.lit(0).alias("votes"), F.lit(0).cast("long").alias("o")).schema), "votes")
    marked = voted.join(known, "doc_id", "left").select("votes", F.coalesce("label", F.lit(-1)).cast("int").alias("label"), "o")
    counts = marked.groupBy("votes", "label").agg(F.count("*").alias("n")).toArrow()
    pattern, label, n = (counts.column(c).to_numpy().astype(np.int64) for c in ("votes", "label", "n"))
    if not len(n):
        pattern, label, n = np.array([0]), np.array([-1]), np.array([1])
    model = fit_label_model(pattern, label, n)
    every = np.unique(pattern)
    post = dict(zip(every.tolist(), model.posterior(every).tolist(), strict=True))
    # a bounded sample of each posterior class, by hash: the bound is known from the counts
    share = {}
    for side in (0, 1):
        size = sum(int(k) for p, k in zip(pattern, n, strict=True) if (post[int(p)] >= 0.5) == bool(side))
        share[side] = (min(1.0, SAMPLE / size) if size else 1.0)
    pairs = scratch.spark.createDataFrame([(int(p), float(x)) for p, x in post.items()], "votes int, posterior double")
    cut = F.when(F.col("posterior") >= 0.5, F.lit(share[1])).otherwise(F.lit(share[0]))
    unit = _unit(F.col("o"))
    chosen = train.withColumn("o", order).filter(unit < max(share.values()))

    worded = _worded(chosen, ["o"])
    kept = voted.join(F.broadcast(pairs), "votes").filter(unit < cut).select("o", "posterior", (1 / cut).alias("weight")).distinct()
    kept = scratch.write(kept, "sample-ids")  # 2 * SAMPLE rows in the mean
    sample = scratch.write(worded.join(F.broadcast(kept), "o"), "sample")
    if not sample.limit(1).count():
        return Toxicity(model, Classifier([], np.zeros(0), float(np.log(model.prior / (1 - model.prior)))))
    # each sampled row counts once
    terms = [t for t, _ in _telling(sample.withColumn("target", F.col("posterior")), 3, TERMS)]
    at = scratch.spark.createDataFrame([(t, i) for i, t in enumerate(terms)], "term string, i int")
    # 2 * SAMPLE rows in the mean, each with the numbers of its terms
    known_terms = sample.select("o", "posterior", "weight", F.explode_outer("words").alias("term")).join(F.broadcast(at), "term", "left")
    rows = known_terms.groupBy("o", "posterior", "weight").agg(F.array_sort(F.collect_set("i")).alias("at")).orderBy("o").collect()
    mean_weight = sum(r["weight"] for r in rows) / len(rows)
    got = [(r["at"], r["posterior"], r["weight"] / mean_weight) for r in rows]
    return Toxicity(model, fit_classifier(got, terms))


def _scored(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    schema = docs.select(*keep).selectExpr("*", "cast(0 as double) _score").schema
    slot = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:slot], pa.array([score(t) for t in b.column(slot).to_pylist()], pa.float64())], names=[*keep, "_score"])

    return docs.select(*keep, "_text").mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text); learned as in learn().

    Null and empty texts get the score of a text without any term. Ids labelled both ways count as unlabelled, as do
    null ids and labels other than 0 and 1. A null doc_id counts as the empty string for the fold. Equal
    texts get equal scores; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    light = docs.select("doc_id", F.col("text").alias("_text"))
    model = learn(light, labels, scratch)
    got = _scored(light.withColumn("held_out", held_out(F.col("doc_id"))), model.classifier, ["doc_id", "held_out"])
    return got.select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose score is under 0.5, with their columns as given."""
    names = docs.columns
    scratch = Scratch(docs.sparkSession)
    light = docs.select("doc_id", F.col("text").alias("_text"))
    model = learn(light, labels, scratch)
    held = docs.select(*(docs[c].alias(f"c{i}") for i, c in enumerate(names)), docs["text"].alias("_text"))
    got = _scored(held, model.classifier, [f"c{i}" for i in range(len(names))]).filter("_score < 0.5")
    return got.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
