"""Passages: greedy admission of scored windows, provenance, and the evidence pack."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import canonical_hash
from .packing import count_tokens

Part = tuple[str, int, int]  # unit, start, end


@dataclass
class Passage:
    score: float
    key: str
    source: object
    parts: list[Part]
    text_of: dict[str, str]
    matches: list[str] = field(default_factory=list)

    def covers(self, other: Passage) -> bool:
        return self.source == other.source and all(any(u == v and a <= c and b >= d for u, a, b in self.parts) for v, c, d in other.parts)

    def overlaps(self, other: Passage) -> bool:
        return self.source == other.source and any(u == v and a < d and c < b for u, a, b in self.parts for v, c, d in other.parts)

    def text(self) -> str:
        return "\n\n".join(self.text_of[u][a:b] for u, a, b in self.parts)

    def with_parts(self, other: Passage) -> Passage:
        return Passage(self.score, self.key, self.source, union([*self.parts, *other.parts]), self.text_of | other.text_of, sorted({*self.matches, *other.matches}))


def union(parts: list[Part]) -> list[Part]:
    """Ranges by unit in reading order, overlapping and abutting ones as one."""
    out: list[Part] = []
    for u, a, b in sorted(parts):
        if out and out[-1][0] == u and a <= out[-1][2]:
            out[-1] = (u, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((u, a, b))
    return out


def admit(seeds: list[Passage], limit: int, max_tokens: int = 512, max_units: int = 64, count: Callable[[str], int] = count_tokens) -> list[Passage]:
    """Seeds by (score desc, key): one that is covered lends its matches, a disjoint one is added, an overlapping one is merged
    with all it overlaps if the result stays within the limits, and otherwise lends its matches. The first `limit` stay."""
    kept: list[Passage] = []
    for seed in sorted(seeds, key=lambda s: (-s.score, s.key)):
        if not seed.parts:
            continue
        over = next((p for p in kept if p.covers(seed)), None)
        if over is not None:
            over.matches = sorted({*over.matches, *seed.matches})
            continue
        near = [i for i, p in enumerate(kept) if p.overlaps(seed)]
        if not near:
            kept.append(seed)
            continue
        trial = kept[near[0]].with_parts(seed)
        fits = lambda p: len({u for u, _, _ in p.parts}) <= max_units and count(p.text()) <= max_tokens
        ok = fits(trial)
        for i in near[1:]:
            if ok:
                trial = trial.with_parts(kept[i])
                ok = fits(trial)
        if ok:
            kept[near[0]] = trial
            kept = [p for i, p in enumerate(kept) if i not in near[1:]]
        else:
            for i in near:
                held = {u for u, _, _ in kept[i].parts}
                kept[i].matches = sorted({*kept[i].matches, *(m for m in seed.matches if m in held)})
    return kept[:limit]


ADMITTED = "query_id long, rank int, score double, source_id string, candidate_id string, unit_ids array<string>, text string, matches array<string>"


def candidate_id(p: Passage) -> str:
    """Hash of the source and the ranges, as canonical JSON."""
    return canonical_hash([str(p.source), [list(x) for x in p.parts]])


def clipped(p: Passage, max_tokens: int = 512, max_units: int = 64, count: Callable[[str], int] = count_tokens) -> Passage:
    """A seed within the limits: trailing parts go first; a lone part keeps the longest beginning that ends a word and fits."""
    out = Passage(p.score, p.key, p.source, p.parts[:max_units], p.text_of, p.matches)
    while len(out.parts) > 1 and count(out.text()) > max_tokens:
        out.parts = out.parts[:-1]
    if len(out.parts) == 1 and count(out.text()) > max_tokens:
        u, a, b = out.parts[0]
        text = out.text_of[u][a:b]
        ends = [m.end() for m in re.finditer(r"\S+", text)]
        low, high = 0, len(ends)  # the first `low` words fit
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if count(text[: ends[mid - 1]]) <= max_tokens else (low, mid - 1)
        out.parts = [(u, a, a + ends[low - 1])] if low else []
    held = {u for u, _, _ in out.parts}
    out.matches = [m for m in p.matches if m in held]
    return out


def passages(seeds: DataFrame, limit: int, max_tokens: int = 512, max_units: int = 64, clip: bool = False) -> DataFrame:
    """Admission for each query of seeds(query_id, key, score, source_id, parts array<struct<unit_id, start_char, end_char, text>>).

    A fold over the few best seeds of a query (pool limits bound them), queries being independent; `text` is the unit's whole text.
    With `clip` each seed is first cut to the limits.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        given = [Passage(float(r.score), str(r.key), r.source_id, union([(str(p["unit_id"]), int(p["start_char"]), int(p["end_char"])) for p in r.parts]),
                         {str(p["unit_id"]): p["text"] for p in r.parts}, sorted({str(p["unit_id"]) for p in r.parts})) for r in rows.itertuples()]
        if clip:
            given = [clipped(p, max_tokens, max_units) for p in given]
        got = admit(given, limit, max_tokens, max_units)
        return pd.DataFrame({
            "query_id": [int(rows.query_id.iloc[0])] * len(got), "rank": range(1, len(got) + 1), "score": [p.score for p in got], "source_id": [str(p.source) for p in got], "candidate_id": [candidate_id(p) for p in got],
            "unit_ids": [list(dict.fromkeys(u for u, _, _ in p.parts)) for p in got], "text": [p.text() for p in got], "matches": [p.matches for p in got]})

    return seeds.groupBy("query_id").applyInPandas(fold, ADMITTED)


def evidence_pack(admitted: DataFrame, max_units: int = 6400, max_tokens: int = 3_276_800) -> DataFrame:
    """(query_id, position, unit_id, rank): units of passages in rank order, each once, at its first place. Ceilings are errors, not cuts."""
    each = admitted.select("query_id", "rank", F.posexplode("unit_ids").alias("at", "unit_id"))
    first = each.groupBy("query_id", "unit_id").agg(F.min(F.struct("rank", "at")).alias("f"))
    placed = first.select("query_id", "unit_id", F.col("f.rank").alias("rank"), F.row_number().over(Window.partitionBy("query_id").orderBy("f.rank", "f.at")).alias("position"))
    units = F.count("*").over(Window.partitionBy("query_id"))
    checked = F.when(units > max_units, F.raise_error(F.lit(f"more than {max_units} evidence units"))).otherwise(F.col("position"))
    tokens = admitted.groupBy("query_id").agg(F.sum(F.size(F.split("text", r"\s+"))).alias("_t"))
    limited = F.when(F.col("_t") > max_tokens, F.raise_error(F.lit(f"more than {max_tokens} evidence tokens"))).otherwise(checked)
    return placed.withColumn("_c", checked).join(tokens, "query_id").select("query_id", F.when(F.col("_t") <= max_tokens, F.col("_c")).otherwise(limited).alias("position"), "unit_id", "rank")


def provenance(admitted: DataFrame, hits: DataFrame) -> DataFrame:
    """Per passage and unit: the channels that found it, sorted; without any it is context. hits(unit_id, channel)."""
    each = admitted.select("query_id", "rank", F.explode("unit_ids").alias("unit_id"))
    own = hits.join(F.broadcast(each.select("unit_id").distinct()), "unit_id", "left_semi")  # passages are few: a limit for each query
    of = own.groupBy("unit_id").agg(F.array_sort(F.collect_set("channel")).alias("channels"))
    got = each.join(of, "unit_id", "left")
    return got.select("query_id", "rank", "unit_id", F.coalesce("channels", F.array().cast("array<string>")).alias("channels"), F.when(F.col("channels").isNull(), "context").otherwise("matched").alias("role"))


def ranking_text(headings, text, notes):
    """Headings, the text, then distinct notes in order, by blank lines: what a reranker reads."""
    return F.concat_ws("\n\n", F.array_join(headings, " / "), text, F.array_join(F.array_sort(F.array_distinct(notes)), "\n"))
