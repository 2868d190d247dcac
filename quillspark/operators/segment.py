"""Splitting a document into letters, and scoring them.

Lines are tagged with Column expressions. The walk over a document's lines depends on what
came before, so it is one Arrow-batched function of a document's tagged lines; forms,
completeness, trust and verdicts are Column expressions again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

STARTS = {n for n, role, *_ in R.ANCHORS if role == "start"}
ENDS = {n for n, role, *_ in R.ANCHORS if role == "end"}
LOOK_BACK, PROSE_LINE, HEAD_LINES = 8, 200, 14
#: Going back from a second subject, a line with one of these belongs to the letter before.
STOPPERS = {"closing", "distribution", "salutation"}


def line_tags(col: Column, extra: dict[str, list[str]] | None = None) -> Column:
    """The names of a line's anchors. A reference is no letter number; page furniture is nothing else."""
    hit = {n: R.search(col, R.anchor_pattern(n, extra)) for n, *_ in R.ANCHORS}
    hit["letter_number"] = hit["letter_number"] & ~hit["reference"]
    every = F.array_compact(F.array(*(F.when(h, F.lit(n)) for n, h in hit.items())))
    return F.when(hit["noise"], F.array(F.lit("noise"))).otherwise(every)


def tag_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, idx, line, tags): a row for each line."""
    rows = docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("idx", "line"))
    return rows.withColumn("tags", line_tags(F.col("line"), extra))


_ADDRESSEE, _ORDER = re.compile(R.ADDRESSEE_LINE, re.M), re.compile(R.ORDER_MARKER, re.M)


def _endorsement(text: str, has: Counter) -> bool:
    """A short block with a distribution line and nothing that begins a letter, nor a heading of an order."""
    if len(text) > R.MAX_ENDORSEMENT or not has["distribution"] or has["subject"] or has["salutation"] or has["addressee"]:
        return False
    return not (_ADDRESSEE.search(text) or _ORDER.search("\n".join(text.splitlines()[:HEAD_LINES])))


def _openings(lines: list[str], tags: list[set]) -> list[tuple[int, str]]:
    """(line, reason) of each letter's first line."""
    content = [i for i, (s, t) in enumerate(zip(lines, tags, strict=True)) if s.strip() and "noise" not in t]
    if not content:
        return []
    out, closed, size = {(content[0], "file-start")}, False, 0
    firsts = [content[0]]
    for i in content[1:]:
        size += len(lines[i])
        if tags[i] & ENDS:
            closed = True
        elif closed and size >= R.MIN_SEGMENT and tags[i] & STARTS:
            out.add((i, f"{'letter_number' if 'letter_number' in tags[i] else 'header'}-after-close"))
            firsts.append(i)
            closed, size = False, 0
    # a second subject without a closing before it: the letter begins at the earliest letterhead line above
    for lo, hi in zip(firsts, [*firsts[1:], len(lines)], strict=True):
        for s in [i for i in range(lo, hi) if "subject" in tags[i]][1:]:
            above = range(s - 1, max(lo, s - LOOK_BACK) - 1, -1)
            stop = next((j for j in above if tags[j] & STOPPERS or len(lines[j]) > PROSE_LINE), min(above, default=s) - 1)
            at = min((j for j in range(stop + 1, s) if tags[j] & (STARTS | {"addressee"})), default=s)
            if at > lo:
                out.add((at, "repeated-subject"))
    return sorted(out, key=lambda x: x[0])


def _join(a: tuple, b: tuple) -> tuple:
    return a[0], b[1], f"{a[2]}\n{b[2]}", a[3] + b[3], a[4]


def split_letters(lines: list[str], tags: list[set]) -> list[tuple[int, int, str, Counter, str]]:
    """(first line, end, text, anchor counts, reason) of each letter of a document."""
    opened = _openings(lines, tags)
    if not opened:
        return []
    parts = []
    for (lo, why), (hi, _) in zip(opened, [*opened[1:], (len(lines), "")], strict=True):
        kept = [i for i in range(lo, hi) if "noise" not in tags[i]]
        text = "\n".join(lines[i] for i in kept).strip()
        if text:
            parts.append((lo, hi, text, Counter(n for i in kept for n in tags[i]), why))
    whole: list[tuple] = []
    for p in parts:  # an endorsement belongs to the letter above it
        whole = [*whole[:-1], _join(whole[-1], p)] if whole and _endorsement(p[2], p[3]) else [*whole, p]
    out: list[tuple] = []
    short = None
    for p in whole:  # what is too short to be a letter belongs to the one below, or at the end above
        p = p if short is None else _join(short, p)
        short = p if len(p[2]) < R.MIN_SEGMENT else None
        if short is None:
            out.append(p)
    if short is not None:
        out = [*out[:-1], _join(out[-1], short)] if out else [short]
    return out


SEGMENTS = "array<struct<start_line:int,end_line:int,text:string,anchors:map<string,int>,opened_by:string>>"


def _split(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(
            lambda rows: [
                {"start_line": a, "end_line": b, "text": t, "anchors": dict(c), "opened_by": w}
                for a, b, t, c, w in split_letters([r["line"] for r in rows], [set(r["tags"] if r["tags"] is not None else ()) for r in rows])
            ]
        )


def segment(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, seq, start_line, end_line, text, anchors, opened_by): a row for each letter; end_line is exclusive."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.struct(x.alias("line"), line_tags(x, extra).alias("tags")))
    return docs.select(key, F.posexplode(F.pandas_udf(_split, SEGMENTS)(lines)).alias("seq", "s")).select(key, "seq", "s.*")


def _has(name: str, anchors: Column | str = "anchors") -> Column:
    return F.coalesce(F.try_element_at(F.col(anchors) if isinstance(anchors, str) else anchors, F.lit(name)), F.lit(0)) > 0


def form(text: Column, anchors: Column) -> Column:
    """letter, order, endorsement or fragment: the most specific evidence first."""
    head = F.array_join(F.slice(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), 1, HEAD_LINES), "\n")
    n = F.length(text)
    endorse = (n <= R.MAX_ENDORSEMENT) & _has("distribution", anchors) & ~(_has("subject", anchors) | _has("salutation", anchors) | _has("addressee", anchors))
    return (
        F.when(R.search(text, R.ADDRESSEE_LINE), "letter").when(R.search(head, R.ORDER_MARKER), "order").when(endorse, "endorsement")
        .when(_has("letter_number", anchors) & _has("date", anchors) & (n >= R.BODY_TARGET), "order").otherwise("fragment")
    )


def completeness(form_: Column, anchors: Column, text: Column) -> Column:
    """Weights of the form's parts that are there, plus the body's length."""
    body = R.BODY_WEIGHT * F.least(F.lit(1.0), F.length(text) / R.BODY_TARGET)
    out = None
    for name, weights in R.FORM_WEIGHTS.items():
        total = F.lit(0.0)
        for part, w in weights.items():
            total = total + F.when(_has(part, anchors), w).otherwise(0.0)
        out = F.when(form_ == name, total) if out is None else out.when(form_ == name, total)
    return F.bround(F.least(F.lit(1.0), out + body), 4)


def missing(form_: Column, anchors: Column) -> Column:
    """The form's parts that are not there, sorted."""
    out = None
    for name, weights in R.FORM_WEIGHTS.items():
        gone = F.array_compact(F.array(*(F.when(~_has(p, anchors), F.lit(p)) for p in sorted(weights))))
        out = F.when(form_ == name, gone) if out is None else out.when(form_ == name, gone)
    return out


def trust(conversion: Column, complete: Column, tier: Column) -> Column:
    """Conversion .45, completeness .35, source tier .20."""
    tiers = F.create_map(*(F.lit(x) for p in R.SOURCE_TIERS.items() for x in p))
    return F.bround(0.45 * conversion + 0.35 * complete + 0.20 * F.coalesce(F.try_element_at(tiers, tier), F.lit(0.4)), 4)


def score(segments: DataFrame, tier: Column, conversion: Column | None = None) -> DataFrame:
    """Segments with form, completeness, missing, conversion_confidence, trust and verdict."""
    out = segments.withColumn("form", form(F.col("text"), F.col("anchors")))
    out = out.withColumn("completeness", completeness(F.col("form"), F.col("anchors"), F.col("text"))).withColumn("missing", missing(F.col("form"), F.col("anchors")))
    out = out.withColumn("conversion_confidence", T.quality("text") if conversion is None else conversion)
    out = out.withColumn("trust", trust(F.col("conversion_confidence"), F.col("completeness"), tier))
    cuts, rest, strict = T.SEGMENT_CUTS
    return out.withColumn("verdict", T.bucket("trust", cuts, rest, strict))


def audit(segments: DataFrame) -> DataFrame:
    """(opened_by, n, share): what opened the letters."""
    n = segments.groupBy("opened_by").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("opened_by", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def anchor_counts(segments: DataFrame) -> DataFrame:
    """(anchor, lines, letters): how many lines have each anchor, and how many letters."""
    rows = segments.select(F.explode("anchors").alias("anchor", "k"))
    return rows.groupBy("anchor").agg(F.sum("k").cast("long").alias("lines"), F.count("*").alias("letters"))


def shares(scored: DataFrame, column: str) -> DataFrame:
    """(column, n, share) of forms, verdicts or causes."""
    n = scored.groupBy(column).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(column, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


def outliers(segments: DataFrame, key: str = "doc_id", times: float = 5.0) -> DataFrame:
    """(key, seq, chars, p95, merged): letters of over ``times`` the 95th percentile of lengths; merged if they have two closings or subjects."""
    rows = segments.select(key, "seq", F.length("text").alias("chars"), ((_count_of("closing") >= 2) | (_count_of("subject") >= 2)).alias("merged"), F.lit(1).alias("_all"))
    from .store import index_percentiles  # which imports this module

    p95 = index_percentiles(rows, "_all", "chars", {"p95": 0.95}).select("p95")  # one row
    return rows.crossJoin(F.broadcast(p95)).where(F.col("chars") > times * F.col("p95")).select(key, "seq", "chars", "p95", "merged")


def _count_of(name: str) -> Column:
    return F.coalesce(F.try_element_at("anchors", F.lit(name)), F.lit(0))
