"""Quality rules with risk-controlled thresholds. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch

WINDOW = 5
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
#: Over this percentage of words in repeated windows fails.
MOST_REPEATED = 20
#: Of good documents at most this share may be rejected by all rules together, in every stratum at once, with confidence 1 - RISK.
FALSE_REJECTION = 0.03
RISK = 0.05
#: A cutoff must reject this many times as large a share of bad documents as of good ones.
WORTH = 4.0
#: rule: (signal, 1 to reject above the cutoff or -1 below, cutoffs from lax to strict)
RULES: dict[str, tuple[str, int, tuple[float, ...]]] = {
    "symbols": ("symbol_ratio", 1, (2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03)),
    "dup_lines": ("dup_line_ratio", 1, (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "repeats": ("repeat_ratio", 1, (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05)),
    "long_words": ("word_length", 1, (40.0, 30.0, 25.0, 20.0, 17.0, 15.0, 13.0, 12.0, 11.0, 10.0)),
    "short_words": ("word_length", -1, (1.0, 1.25, 1.5, 1.75, 2.0, 2.25, 2.5, 2.75, 3.0)),
    "few_words": ("n_words", -1, (10.0, 12.0, 15.0, 20.0, 25.0, 30.0)),
}


def signals(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns `keep`, then the counts of the rules. All within a row: nothing is exploded or shuffled."""
    t = F.coalesce(F.col(text), F.lit(""))
    bare = t
    for c in SPACE:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    symbols = sum((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))
    trimmed = F.btrim(t, F.lit(SPACE))
    no_words = F.array().cast("array<string>")
    df = docs.select(
        *keep, F.length(bare).cast("long").alias("word_chars"), symbols.cast("long").alias("n_symbols"),
        F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(no_words).alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias("_l"),
    )
    n = F.size("_w")
    df = df.select(
        *keep, "word_chars", "n_symbols", n.cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, F.transform(
            F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get("_w", i + j) for j in range(WINDOW))))).alias("_h"),
    )
    counts = ["word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    # most texts repeat no window; only for others are windows sorted
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.select(*keep, *counts, F.when(repeats, F.array_sort(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("_s"))
    same = lambda e, j: (F.get("_s", j - 1)["h"] == e["h"]) | (F.get("_s", j + 1)["h"] == e["h"])
    at = F.array_sort(F.transform(F.filter("_s", lambda e, j: F.coalesce(same(e, j), F.lit(False))), lambda e: e["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n")))
    return df.select(*keep, *counts, F.coalesce(covered["n"], F.lit(0)).cast("long").alias("n_repeat_words"))


def _ratios(df: DataFrame) -> DataFrame:
    by = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return df.select(
        "*", by("n_symbols", "n_words").alias("symbol_ratio"), by("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        by("n_repeat_words", "n_words").alias("repeat_ratio"), by("word_chars", "n_words").alias("word_length"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def most_allowed(n: Column, rate: float, log_risk: Column) -> Column:
    """The largest x with P(Binomial(n, rate) <= x) <= exp(log_risk), exactly; -1 if not even 0 is.

    So long as the true rate is above `rate`, x or fewer are seen with probability under the risk. Terms are
    added up in logarithms, from 0 to the mean.
    """
    odds = math.log(rate / (1 - rate))
    first = n * math.log1p(-rate)
    start = F.struct(first.alias("term"), first.alias("total"), F.when(first <= log_risk, 0).otherwise(-1).cast("long").alias("x"))

    def add(acc: Column, k: Column) -> Column:
        term = acc["term"] + F.log((n - k + 1) / k) + odds
        top = F.greatest(acc["total"], term)
        total = top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))
        return F.struct(term.alias("term"), total.alias("total"), F.when(total <= log_risk, k).otherwise(acc["x"]).alias("x"))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(n * rate).cast("long"))), start, add)["x"]


def cutoffs(held: DataFrame) -> DataFrame:
    """Of labelled rows (stratum, good, signals): (stratum, rule, cutoff) of the chosen cutoffs.

    For each stratum and rule the cutoffs are tested from lax to strict, each by the exact binomial test that
    good documents are rejected at over FALSE_REJECTION / rules; the sequence ends at the first that is not
    refuted, which needs no correction, and the risk is divided by the number of strata and rules
    (Bonferroni). Of the cutoffs passed, the one of the largest gain is taken, if it has any.
    """
    counts = []
    for rule, (signal, sign, grid) in RULES.items():
        for step, c in enumerate(grid):
            hit = (F.col(signal) > c) if sign > 0 else (F.col(signal) < c)
            counts.append(F.struct(
                F.lit(rule).alias("rule"), F.lit(step).alias("step"), F.lit(float(c)).alias("cutoff"),
                F.sum((hit & F.col("good")).cast("long")).alias("x"), F.sum((hit & ~F.col("good")).cast("long")).alias("hits")))
    cells = held.groupBy("stratum").agg(
        F.sum(F.col("good").cast("long")).alias("n"), F.sum((~F.col("good")).cast("long")).alias("bad"), F.array(*counts).alias("cells"))
    strata = cells.agg(F.count("*").alias("strata"))
    log_risk = F.log(F.lit(RISK) / (F.greatest("strata", F.lit(1)) * len(RULES)))
    limits = cells.join(F.broadcast(strata)).select("*", most_allowed(F.col("n"), FALSE_REJECTION / len(RULES), log_risk).alias("most"))
    each = limits.select("stratum", "n", "bad", "most", F.explode("cells").alias("c")).select("stratum", "n", "bad", "most", "c.*")
    passed = each.groupBy("stratum", "rule").agg(
        F.coalesce(F.min(F.when(F.col("x") > F.col("most"), F.col("step"))), F.lit(10_000)).alias("end"),
        F.collect_list(F.struct(
            (F.coalesce(F.col("hits") / F.nullif("bad", F.lit(0)), F.lit(0.0)) - WORTH * F.col("x") / F.greatest("n", F.lit(1))).alias("gain"),
            (-F.col("step")).alias("lax"), "cutoff")).alias("all"))
    best = passed.select("stratum", "rule", F.array_max(F.filter("all", lambda e: (-e["lax"] < F.col("end")) & (e["gain"] > 0))).alias("b"))
    return best.filter("b is not null").select("stratum", "rule", "b.cutoff")


def judge(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rules of every row of docs.

    labels (doc_id, quality) is the holdout: the cutoffs tried are fixed beforehand, so labels only test them.
    An id labelled more than once counts as good if all its labels are 1; null ids and null labels are
    not used. A stratum with too few labels to certify a cutoff, or a null one without labels, keeps all
    but what base_failed rejects. Null and empty texts have no words and fail the base rules. Repeated
    rows are judged alike; an empty table gives no rows; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    light = docs.select(docs[doc_id].alias("doc_id"), docs[stratum].cast("string").alias("stratum"), docs[text].alias("_text"))
    table = scratch.write(_ratios(signals(light, "_text", ["doc_id", "stratum"])), "signals")
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    held = table.join(marks, "doc_id")
    chosen = cutoffs(held)
    pick = [F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES]
    wide = scratch.write(chosen.groupBy("stratum").agg(*pick).withColumnRenamed("stratum", "_of"), "cutoffs")
    judged = table.join(wide, table["stratum"].eqNullSafe(wide["_of"]), "left")
    failed = F.filter(F.array(*(
        F.when((F.col(s) > F.col(f"cut_{r}")) if sign > 0 else (F.col(s) < F.col(f"cut_{r}")), F.lit(r)) for r, (s, sign, _) in RULES.items())),
        lambda x: x.isNotNull())
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"),
        (~base_failed() & (F.size(failed) == 0)).alias("kept"), F.array_join(failed, ",").alias("failed_rules"))


def oracle() -> str:
    """The same as DuckDB SQL."""
    ws = r"[\x20\x09-\x0D]"
    cells = ", ".join(
        f"('{r}', {i}, {c!r}::double)" for r, (_, _, grid) in RULES.items() for i, c in enumerate(grid))
    hit = " OR ".join(f"(rule = '{r}' AND {s} {'>' if sign > 0 else '<'} cutoff)" for r, (s, sign, _) in RULES.items())
    rate = FALSE_REJECTION / len(RULES)
    fails = ", ".join(f"bool_or(CASE WHEN rule = '{r}' THEN {s} {'>' if sign > 0 else '<'} cutoff END) AS f_{r}" for r, (s, sign, _) in RULES.items())
    words = ", ".join(f"CASE WHEN f_{r} THEN '{r}' END" for r in RULES)
    strip = "regexp_replace(t, '[" + "".join("\\" + c for c in SYMBOLS) + "]', '', 'g')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '{ws}+'), lambda x: x <> '') AS w FROM d),
h AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS h
      FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM h) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + j) AS n FROM rep, range(5) AS g(j) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
s AS (
  SELECT d.r, d.doc_id, d.stratum, len(w.w)::bigint AS n_words, length(regexp_replace(t, '{ws}', '', 'g'))::bigint AS word_chars,
         (length(t) - length({strip}))::bigint AS n_symbols, (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, len(l)::bigint AS n_lines,
         coalesce(cov.n, 0)::bigint AS n_repeat_words
  FROM d JOIN w USING (r) JOIN lines USING (r) LEFT JOIN cov USING (r)),
q AS (
  SELECT *, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_ratio, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length
  FROM s),
m AS (SELECT doc_id, min(quality) = 1 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
held AS (SELECT q.*, good FROM q JOIN m USING (doc_id)),
cells(rule, step, cutoff) AS (VALUES {cells}),
x AS (SELECT stratum, rule, step, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS bad,
             count(*) FILTER (WHERE good AND ({hit})) AS x, count(*) FILTER (WHERE NOT good AND ({hit})) AS hits
      FROM held, cells GROUP BY stratum, rule, step, cutoff),
strata AS (SELECT count(DISTINCT coalesce(stratum, '?null')) AS k FROM held),
tail AS (
  SELECT n, x, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({rate!r}) + (n - j) * ln(1 - {rate!r}))) AS p
  FROM (SELECT DISTINCT n, x FROM x WHERE x <= n * {rate!r} + 1), unnest(range(x + 1)) AS u(j) GROUP BY n, x),
y AS (SELECT x.*, coalesce(p <= {RISK} / (k * {len(RULES)}), false) AS ok FROM x LEFT JOIN tail USING (n, x), strata),
z AS (SELECT *, min(CASE WHEN NOT ok THEN step END) OVER (PARTITION BY stratum, rule) AS stop,
             CASE WHEN bad > 0 THEN hits / bad ELSE 0 END - {WORTH} * x / greatest(n, 1) AS gain FROM y),
c AS (SELECT stratum, rule, cutoff FROM z WHERE gain > 0 AND step < coalesce(stop, 10000)
      QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step) = 1),
f AS (SELECT q.r, {fails} FROM q LEFT JOIN c ON q.stratum IS NOT DISTINCT FROM c.stratum GROUP BY q.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules
FROM (SELECT q.*, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words) AS base_failed,
             concat_ws(',', {words}) AS failed_rules FROM q JOIN f USING (r))
"""
