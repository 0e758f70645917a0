"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

FOLDS, HELD = 4, 2
ROUNDS = 2
SMOOTH = 0.05
#: Keeps forward sums near 1: every letter's share is multiplied by it, and taken out in the logarithm.
SCALE = 12.0
#: Sums of longer words, and sums under SMALL, are taken again with a scale of their own at each letter, as doubles may
#: underflow; above both, they can't lose anything that counts.
SHORT, SMALL = 64, 1e-200
#: Letters of a long word that are looked up at once.
LOOKUP = 4096
#: Languages whose probabilities are held at once, 8 bytes a language and piece; more of them take further passes.
BLOCK = 64
#: Words that a task counts before it passes its counts on, and words that a worker keeps scores of.
HOLD = 250_000
#: Words of a language that are taken together in a round.
GATHER = 50_000
START = "▁"
#: Multiplier of the rolling hash of letters.
HASH = np.uint64(0x9E3779B97F4A7C15)

_RUN = re.compile(r"[^\W\d_]+")


def letters(run: str) -> str:
    return run if run.isalpha() else "".join(c for c in run if c.isalpha())


class Pieces:
    """The vocabulary: pieces of lower-case letters, with the word start, and one piece a byte for other letters."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        self.index, self.byte = {}, np.zeros(256, dtype=np.int64)
        for i in range(self.size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)) and (bare := piece.removeprefix(START)) == bare.lower() and (bare.isalpha() or piece == START):
                self.index[piece] = i
        self.longest = max(map(len, self.index))
        self.by_length = []
        for m in range(1, self.longest + 1):
            own = [(p, i) for p, i in self.index.items() if len(p) == m]
            h = np.zeros(len(own), dtype=np.uint64)
            codes = np.array([p for p, _ in own], dtype=f"<U{m}").view("<u4").reshape(len(own), m)
            for j in range(m):
                h = h * HASH + codes[:, j]
            order = np.argsort(h)
            self.by_length.append((h[order], np.array([i for _, i in own], dtype=np.int32)[order]))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """For words of one length: piece numbers [word, start, length - 1], `size` where there is none, and
        size + 1 + k for the k-th of the letters that are no piece, which are returned.

        All substrings of one length are looked up at once, by 64-bit rolling hashes."""
        n, none = len(words[0]), self.size
        k = min(n, self.longest)
        codes = np.array(words, dtype=f"<U{n}").view("<u4").reshape(len(words), n)
        out = np.full((len(words), n, k), none, dtype=np.int32)
        h = np.zeros((len(words), n), dtype=np.uint64)
        for m in range(1, k + 1):
            h = h[:, : n - m + 1] * HASH + codes[:, m - 1 :]
            keys, ids = self.by_length[m - 1]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                out[:, : n - m + 1, m - 1] = np.where(keys[at] == h, ids[at], none)
        missing = out[:, :, 0] == none
        letters_, which = np.unique(codes[missing], return_inverse=True)
        out[:, :, 0][missing] = none + 1 + which
        return out, [chr(c) for c in letters_]

    def table(self, p: np.ndarray, other: list[str]) -> np.ndarray:
        """Probabilities by the numbers of lattice(): p[piece, ...], none, and products over the bytes of other letters."""
        rows = [p[self.byte[list(c.encode("utf-8", "surrogatepass"))]].prod(axis=0) for c in other]
        return np.concatenate([p, np.zeros((1, *p.shape[1:])), *(r[None] for r in rows)])


def _by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of the words of SHORT letters at most, those of one length together."""
    groups = defaultdict(list)
    for i, w in enumerate(words):
        if len(w) <= SHORT:
            groups[len(w)].append(i)
    for n, at in groups.items():
        step = max(16, 40_000 // n)
        for i in range(0, len(at), step):
            yield at[i : i + step]


def forward(ids: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Sums over all segmentations of each prefix, [position, word, ...], each letter scaled by SCALE."""
    _, n, k = ids.shape
    power = SCALE ** np.arange(1, k + 1)
    alpha = np.zeros((n + 1, ids.shape[0], *p.shape[1:]))
    alpha[0] = 1
    for i in range(n):
        for m in range(min(k, n - i)):
            alpha[i + m + 1] += alpha[i] * (p[ids[:, i, m]] * power[m])
    return alpha


def _stretches(pieces: Pieces, word: str, p: np.ndarray, back: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """The lattice of one word of any length, LOOKUP starts at a time: first start, piece numbers, probabilities, other letters."""
    first = range(0, len(word), LOOKUP)
    for a in reversed(first) if back else first:
        ids, other = pieces.lattice([word[a : a + LOOKUP + pieces.longest - 1]])
        yield a, ids[0, :LOOKUP], pieces.table(p, other), other


def log_forward(pieces: Pieces, word: str, p: np.ndarray, every: bool = False) -> np.ndarray:
    """log of the sum over all segmentations of a word of any length, [language]; of each of its prefixes if `every`.

    The sums of the next prefixes are divided by the largest of them at each letter, and the logarithm of that is kept.
    """
    k = pieces.longest
    ahead, scale = np.zeros((k + 1, *p.shape[1:])), np.zeros(p.shape[1:])
    ahead[0] = 1
    kept = [scale]
    for _, ids, table, _ in _stretches(pieces, word, p):
        for row in ids:
            ahead[1 : len(row) + 1] += ahead[0] * table[row]
            ahead[:-1] = ahead[1:]
            ahead[-1] = 0
            top = ahead.max(axis=0)
            ahead /= top
            scale = scale + np.log(top)
            if every:
                with np.errstate(divide="ignore"):
                    kept.append(np.log(ahead[0]) + scale)
    return np.stack(kept) if every else np.log(ahead[0]) + scale


def _long_expected(pieces: Pieces, word: str, count: float, p: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected uses of each piece in one word of any length, under one language, to `total`."""
    k, alpha = pieces.longest, log_forward(pieces, word, p, every=True)
    ahead = np.full(k + 1, -np.inf)  # logarithms of the sums over the next suffixes
    ahead[0] = 0
    for a, ids, table, other in _stretches(pieces, word, p, back=True):
        seen = np.zeros(len(table))
        with np.errstate(divide="ignore"):
            logs = np.log(table)
        for i in range(len(ids) - 1, -1, -1):
            row = ids[i]
            q = logs[row] + ahead[: len(row)]
            np.add.at(seen, row, np.exp(alpha[a + i] + q - alpha[-1]))
            top = q.max()
            ahead[1:] = ahead[:-1]
            ahead[0] = top + np.log(np.exp(q - top).sum())
        total += count * seen[: pieces.size]
        for c, x in zip(other, seen[pieces.size + 1 :], strict=True):
            np.add.at(total, pieces.byte[list(c.encode("utf-8", "surrogatepass"))], count * x)


def log_scores(pieces: Pieces, words: list[str], p: np.ndarray) -> np.ndarray:
    """log P(word | language) of each word, [word, language], over all segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    marked = [START + w for w in words]
    alone = [i for i, w in enumerate(marked) if len(w) > SHORT]
    for at in _by_length(marked):
        ids, other = pieces.lattice([marked[i] for i in at])
        end = forward(ids, pieces.table(p, other))[-1]
        out[at] = np.log(np.maximum(end, SMALL)) - len(marked[at[0]]) * np.log(SCALE)
        alone += [at[i] for i in np.flatnonzero((end < SMALL).any(axis=1))]
    for i in alone:
        out[i] = log_forward(pieces, marked[i], p)
    return out


def expected(pieces: Pieces, words: list[str], counts: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in words seen `counts` times, under the probabilities p of one language."""
    total = np.zeros(pieces.size)
    marked = [START + w for w in words]
    for i, w in enumerate(marked):
        if len(w) > SHORT:
            _long_expected(pieces, w, counts[i], p, total)
    for at in _by_length(marked):
        ids, other = pieces.lattice([marked[i] for i in at])
        table = pieces.table(p, other)
        _, n, k = ids.shape
        power = SCALE ** np.arange(1, k + 1)
        alpha = forward(ids, table)
        beta = np.zeros_like(alpha)
        beta[n] = 1
        seen = np.zeros(len(table))
        sound = alpha[n] >= SMALL
        weight = np.where(sound, counts[at] / np.maximum(alpha[n], SMALL), 0.0)
        for i in np.flatnonzero(~sound):
            _long_expected(pieces, marked[at[i]], counts[at[i]], p, total)
        for i in range(n - 1, -1, -1):
            for m in range(min(k, n - i)):
                q = table[ids[:, i, m]] * power[m] * beta[i + m + 1]
                beta[i] += q
                seen += np.bincount(ids[:, i, m], weights=alpha[i] * q * weight, minlength=len(table))
        total += seen[: pieces.size]
        for c, x in zip(other, seen[pieces.size + 1 :], strict=True):
            np.add.at(total, pieces.byte[list(c.encode("utf-8", "surrogatepass"))], x)
    return total


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased, whatever their length."""
    return _RUN.findall(text.lower()) if text else []


_pieces: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, n over all rows of docs(lang, _text); counted within tasks before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[lang].update(words_of(text))
            if sum(map(len, held.values())) > HOLD:
                yield from out()
        yield from out()

    return docs.select("lang", "_text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages in blocks of BLOCK, each with its probabilities [piece, language] as a broadcast."""

    def __init__(self, path: str, blocks: list[tuple[list[str], object]]):
        self.path, self.blocks = path, blocks


def _maximise(counts: DataFrame, path: str, languages: list[str], rounds: int) -> np.ndarray:
    pieces, sc = pieces_of(path), counts.sparkSession.sparkContext
    at = {x: i for i, x in enumerate(languages)}
    own = counts.filter(F.col("lang").isin(languages))
    p = np.full((pieces.size, len(languages)), 1.0 / pieces.size)
    # only pieces that words can use share what is set aside for the unseen
    usable = np.zeros(pieces.size, dtype=bool)
    usable[[*pieces.index.values(), *pieces.byte]] = True
    for _ in range(rounds):
        shared = sc.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocab, p = pieces_of(path), shared.value
            total = np.zeros((len(at), p.shape[0]))
            held: dict[str, Counter] = defaultdict(Counter)

            def add(least: int) -> None:
                for x in [x for x, c in held.items() if len(c) >= least]:
                    c = held.pop(x)
                    total[at[x]] += expected(vocab, list(c), np.fromiter(c.values(), dtype=float, count=len(c)), p[:, at[x]])

            for b in batches:
                for x, r, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if w := letters(r):
                        held[x][w] += k
                add(GATHER)  # words of one length are scored together, so the more at once the better
            add(1)
            i, j = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["l", "piece", "n"])

        # one number a piece of the vocabulary and language of the block
        got = own.mapInArrow(run, "l int, piece int, n double").groupBy("l", "piece").agg(F.sum(F.round("n", 6)).alias("n")).toArrow()
        seen = np.zeros_like(p)
        seen[got.column("piece").to_numpy(), got.column("l").to_numpy()] = got.column("n").to_numpy()
        p = (seen + SMOOTH * usable[:, None]) / (seen.sum(axis=0) + SMOOTH * usable.sum())
        shared.unpersist()
    return p


def learn(docs: DataFrame, path: str, scratch: Scratch, rounds: int = ROUNDS, block: int = BLOCK) -> Model:
    """Piece probabilities of each language by expectation-maximisation over the words of docs(lang, _text), all rows.

    Words are counted once; rounds go over distinct words, `block` languages at a time, however many there are.
    """
    counts = scratch.write(word_counts(docs), "words")
    languages = sorted(r["lang"] for r in counts.filter("n > 0").select("lang").distinct().collect())
    sc = docs.sparkSession.sparkContext
    parts = [languages[i : i + block] for i in range(0, len(languages), block)]
    return Model(path, [(x, sc.broadcast(_maximise(counts, path, x, rounds))) for x in parts])


def identify(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns `keep`, lang_pred and score of every row of docs(..., _text). Row-wise, no shuffle.

    A block of languages is a pass of the same stage, which hands on the best language so far, its logarithm, and the
    sum of all languages' shares against it.
    """
    slot, path = len(keep), model.path
    last = max(len(model.blocks) - 1, 0)
    out = docs.select(*keep, F.col("_text"), F.lit(None).cast("string").alias("_best"), F.lit(0.0).alias("_log"), F.lit(0.0).alias("_sum"))
    done = docs.select(*keep).selectExpr("*", "cast(null as string) lang_pred", "cast(null as double) score").schema

    def scorer(languages: list[str], shared, final: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocab, p = pieces_of(path), shared.value if shared else None
            row: dict[str, int] = {}
            scores = np.zeros((0, len(languages)))
            for b in batches:
                texts = [words_of(t) for t in b.column(slot).to_pylist()]
                if len(row) > HOLD:
                    row, scores = {}, scores[:0]
                fresh = list({w for t in texts for w in t} - row.keys())
                if fresh and languages:
                    clean = [letters(w) for w in fresh]
                    got = np.zeros((len(fresh), len(languages)))
                    real = [i for i, w in enumerate(clean) if w]
                    if real:
                        got[real] = log_scores(vocab, [clean[i] for i in real], p)
                    row.update(zip(fresh, range(len(row), len(row) + len(fresh)), strict=True))
                    scores = np.concatenate([scores, got])
                best, top, rest = (b.column(slot + i).to_pylist() for i in (1, 2, 3))
                for i, t in enumerate(texts):
                    if not languages or not any(letters(w) for w in t):
                        continue
                    logs = scores[[row[w] for w in t]].sum(axis=0)
                    at = int(logs.argmax())
                    before = best[i] is None
                    high = logs[at] if before else max(logs[at], top[i])
                    rest[i] = float(np.exp(logs - high).sum() + (0.0 if before else rest[i] * np.exp(top[i] - high)))
                    if before or logs[at] > top[i]:
                        best[i] = languages[at]
                    top[i] = float(high)
                if final:
                    named = [x or "und" for x in best]
                    share = [1 / r if x else 0.0 for x, r in zip(best, rest, strict=True)]
                    yield pa.RecordBatch.from_arrays([*b.columns[:slot], pa.array(named, pa.string()), pa.array(share, pa.float64())], names=[*keep, "lang_pred", "score"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*b.columns[: slot + 1], pa.array(best, pa.string()), pa.array(top, pa.float64()), pa.array(rest, pa.float64())], names=b.schema.names)

        return run

    for i, (languages, shared) in enumerate(model.blocks or [([], None)]):
        out = out.mapInArrow(scorer(languages, shared, i == last), done if i == last else out.schema)
    return out


def predict_languages(docs: DataFrame, path: str, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs(doc_id, text, lang).

    Learned from text and non-null lang of all rows that are not held out. lang_pred is `und`, with score 0,
    for null texts, texts without a letter, or when nothing was learned; otherwise the likeliest language
    (the first by name of equals), each equally likely beforehand, and its posterior. A null doc_id counts as the empty string for
    the fold. Repeated rows are judged alike; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    light = docs.select("doc_id", F.col("lang").alias("lang"), F.col("text").alias("_text"))
    model = learn(light.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()), path, scratch, rounds, block)
    return identify(light.withColumn("held_out", held_out(F.col("doc_id"))), model, ["doc_id", "held_out"])
