"""Gold-set tooling: candidates, greedy coverage, review, alignment of two readings, scorecards."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MIN_LINE, MAX_LINE = 12, 140
#: Review answers that mean a suggestion is right.
OK_WORDS = ["ok", "okay", "yes", "y", "correct", "right", "सही", "ठीक", "हाँ", "✓"]


def candidates(runs: DataFrame) -> DataFrame:
    """(legacy, source, block, run): distinct legacy runs of fitting length, where they come first. runs: (source, block, run, text)."""
    t = F.regexp_replace(T.collapse("text"), r"\A +| +\z", "")
    rows = runs.withColumn("legacy", t).where(F.length("legacy").between(MIN_LINE, MAX_LINE))
    return rows.groupBy("legacy").agg(F.min(F.struct("source", "block", "run")).alias("at")).select("legacy", "at.*")


def greedy_cover(items: DataFrame, most: int, key: str = "legacy", slots: str = "used_keys") -> list[tuple[str, int]]:
    """(key, newly covered) of the items picked: most new slots, then shorter, then smaller key; ends when none adds.

    A pick depends on those before, so each is one aggregation over the items; the covered
    slots, at most as many as the font table has, are all that the driver holds.
    """
    covered: list[str] = []
    out: list[tuple[str, int]] = []
    for _ in range(most):
        gain = F.array_except(slots, F.array(*map(F.lit, covered)).cast("array<string>"))
        best = items.select(key, gain.alias("new")).agg(F.min(F.struct((-F.size("new")).alias("neg"), F.length(key).alias("len"), F.col(key).alias("k"), F.array_sort("new").alias("new"))).alias("b")).first().b
        if best is None or best.neg == 0:
            break
        out.append((best.k, -best.neg))
        covered += best.new
    return out


def mark_blind(items: DataFrame, share: float, key: str = "legacy") -> DataFrame:
    """items with blind: the round(n * share) with the least hash of the key."""
    n = round(items.count() * share)
    blind = items.orderBy(F.xxhash64(key), key).limit(n).select(key, F.lit(True).alias("blind"))
    return items.join(blind, key, "left").withColumn("blind", F.coalesce("blind", F.lit(False)))


def collect_review(rows: DataFrame, suggestion: Column) -> DataFrame:
    """rows (verdict, blind, ...) with outcome and expected: what a reviewer's answer means.

    A blank answer is none; "ok" without having seen the suggestion is rejected.
    """
    v = F.trim("verdict")
    ok = F.lower(v).isin(OK_WORDS)
    outcome = F.when(v.isNull() | (v == ""), "blank").when(ok & F.col("blind"), "rejected").when(ok, "agreed").when(T.normalise(v) == suggestion, "agreed").otherwise("corrected")
    out = rows.withColumn("outcome", outcome)
    return out.withColumn("expected", F.when(F.col("outcome") == "agreed", suggestion).when(F.col("outcome") == "corrected", T.normalise(v)))


def disagreement_rates(reviewed: DataFrame) -> DataFrame:
    """Corrected shares of sighted and blind rows, and whether the blind one is far above."""
    seen = F.col("outcome").isin("agreed", "corrected")
    part = lambda b: F.coalesce(F.try_divide(F.count_if(seen & (F.col("blind") == b) & (F.col("outcome") == "corrected")), F.count_if(seen & (F.col("blind") == b))), F.lit(0.0))
    out = reviewed.agg(F.round(part(False), 6).alias("sighted"), F.round(part(True), 6).alias("blind_rate"), F.count_if(F.col("outcome") == "rejected").alias("rejected"))
    return out.withColumn("alarm", F.col("blind_rate") > 2 * F.col("sighted") + 0.05)


_WORD = re.compile(T.ALIGNMENT_WORD)


def _differences(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in parts:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = _WORD.findall(x or ""), _WORD.findall(y or "")
            found = []
            for op, i, j, k, m in difflib.SequenceMatcher(None, p, q, autojunk=False).get_opcodes():
                if op in ("replace", "delete"):
                    right = q[k:m] if op == "replace" else []
                    found += [{"lhs": w, "rhs": right[n] if n < len(right) else ""} for n, w in enumerate(p[i:j])]
            out.append(found)
        yield pd.Series(out)


def align(pairs: DataFrame, left: str, right: str, systematic: int = 3) -> DataFrame:
    """(lhs, rhs, n, systematic): word differences between two readings; what recurs is the table's fault, not the scan's."""
    rows = pairs.select(F.explode(F.pandas_udf(_differences, "array<struct<lhs:string,rhs:string>>")(left, right)).alias("d")).groupBy("d.lhs", "d.rhs").agg(F.count("*").alias("n"))
    return rows.withColumn("systematic", F.col("n") >= systematic)


def conversion_card(gold: DataFrame) -> DataFrame:
    """usable: whether pairs that people checked (not the seed) reach .98. gold: (seed, n, char_accuracy)."""
    own = ~F.col("seed")
    acc = F.sum(F.when(own, F.col("char_accuracy") * F.col("n"))) / F.sum(F.when(own, F.col("n")))
    return gold.agg(F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)).alias("n"), F.round(acc, 6).alias("accuracy")).withColumn("usable", F.coalesce(F.col("accuracy") >= 0.98, F.lit(False)))


def retrieval_card(n: Column, p5: Column, random: Column, se: Column) -> Column:
    return F.when(n < 30, "too few letters").when(p5 - random > 2 * se, "beats random").otherwise("no better than random")


def drafting_card(n: Column, median: Column) -> Column:
    return F.when(n < 10, "too few dispatches").when(median <= 0.30, "useful").when(median <= 0.70, "marginal").otherwise("not useful")
