"""Mining of boilerplate skeletons: lines that the letters of a cell share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T

MIN_LINE, SHARE, MIN_CELL, MAX_LINE = 4, 0.30, 8, 120
SALUTATION, CLOSING = R.ROLE_ORDER["salutation"], R.ROLE_ORDER["closing"]
#: What ends a line.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def line_role(col: Column) -> Column:
    """The role of the first anchor, in rule order, that a line has; null if it has none."""
    return F.coalesce(*(F.when(R.search(col, R.anchor_pattern(n)), F.lit(R.ROLE_ORDER[n])) for n, *_ in R.ANCHORS if n in R.ROLE_ORDER))


def measured(df: DataFrame) -> DataFrame:
    """Few rows, kept so that Spark joins them by their measured size and leaves long texts where they are."""
    df = df.persist()
    df.count()
    return df


def cells(letters: DataFrame, cell: list[str], floor: int = MIN_CELL) -> DataFrame:
    """(cell..., n) of the cells with enough letters."""
    return measured(letters.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") >= floor))


def lines(letters: DataFrame, cell: list[str], key: str = "doc_id") -> DataFrame:
    """(cell..., key, idx, total, line, canon) of each line of four or more characters in cells with enough letters."""
    big = letters.join(cells(letters, cell).select(*cell), cell, "left_semi")
    parts = F.split("text", LINE_END)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    rows = big.select(*cell, key, parts.alias("p")).select(*cell, key, F.greatest(F.size("p"), F.lit(1)).alias("total"), F.posexplode("p").alias("idx", "raw"))
    rows = rows.withColumn("line", F.btrim("raw", F.lit(T.WHITE))).drop("raw").where(F.length("line") >= MIN_LINE)
    # as a generator's column: an expression would be computed again in each filter and key
    return rows.select("*", F.explode_outer(F.array(T.canonical_line("line"))).alias("canon"))


def shared(rows: DataFrame, sizes: DataFrame, cell: list[str], share: float = SHARE) -> DataFrame:
    """Of rows those that may be boilerplate, kept: lines whose hash stands in a cell as often as boilerplate is in letters.

    Hashes are what is shuffled. Lines of equal hashes, or that a letter repeats, may be let
    in; ``boilerplate`` compares and counts what is left exactly.
    """
    rows = rows.where("canon <> ''").withColumn("_h", F.xxhash64("canon"))
    often = rows.groupBy(*cell, "_h").agg(F.count("*").alias("_k")).join(sizes, cell).where(F.col("_k") >= F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(share))))
    return rows.join(measured(often.select(*cell, "_h")), [*cell, "_h"], "left_semi").drop("_h").persist()


def upper_median(values: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """sorted[n // 2] of each group, over counts of distinct values."""
    k = values.groupBy(*by, value).agg(F.count("*").alias("k"))
    w = Window.partitionBy(*by)
    r = k.withColumn("upto", F.sum("k").over(w.orderBy(value))).withColumn("n", F.sum("k").over(w))
    return r.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy(*by).agg(F.min(value).alias(name))


def boilerplate(rows: DataFrame, sizes: DataFrame, cell: list[str], key: str = "doc_id", share: float = SHARE) -> DataFrame:
    """(cell..., canon, letters, n): canonical lines in at least max(2, share of n) letters of a cell."""
    in_letters = rows.where("canon <> ''").groupBy(*cell, "canon", key).agg(F.lit(1).alias("one")).groupBy(*cell, "canon").agg(F.count("*").alias("letters"))
    return in_letters.join(sizes, cell).where(F.col("letters") >= F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(share))))


def modal_literal(rows: DataFrame, found: DataFrame, cell: list[str], key: str = "doc_id") -> DataFrame:
    """(cell..., canon, literal, times): the commonest form of each line; of equals the first seen, by key and position."""
    k = rows.join(found.select(*cell, "canon"), [*cell, "canon"], "left_semi").groupBy(*cell, "canon", "line").agg(F.count("*").alias("times"), F.min(F.struct(key, "idx")).alias("seen"))
    best = k.groupBy(*cell, "canon").agg(F.min(F.struct((-F.col("times")).alias("neg"), "seen", "line")).alias("b"))
    return best.select(*cell, "canon", F.col("b.line").alias("literal"), (-F.col("b.neg")).alias("times"))


def positions(rows: DataFrame, found: DataFrame, cell: list[str], key: str = "doc_id") -> DataFrame:
    """(cell..., canon, pos): the upper median of where each line first stands in its letters, as a share of their lines."""
    some = rows.join(found.select(*cell, "canon"), [*cell, "canon"], "left_semi")
    first = some.groupBy(*cell, "canon", key).agg(F.min(F.round(F.col("idx") / F.col("total"), 9)).alias("at"))
    return upper_median(first, [*cell, "canon"], "at", "pos")


def roles(found: DataFrame, literals: DataFrame, at: DataFrame, cell: list[str]) -> DataFrame:
    """(cell..., canon, literal, letters, pos, role, rank, is_body): each line's role, its own or its nearest landmark's.

    A cell has few boilerplate lines, as each is in a share of its letters; its landmarks
    are gathered as one array.
    """
    rows = found.join(literals, [*cell, "canon"]).join(at, [*cell, "canon"]).withColumn("role", line_role(F.col("literal")))
    marks = rows.where("role is not null").groupBy(*cell).agg(F.collect_set(F.struct("pos", "role")).alias("marks"), F.min(F.when(F.col("role") == CLOSING, F.col("pos"))).alias("closing_pos"))
    near = F.array_min(F.transform("marks", lambda m: F.struct(F.round(F.abs(m["pos"] - F.col("pos")), 9).alias("d"), m["role"].alias("role"))))["role"]
    rows = rows.join(marks, cell, "left").withColumn("rank", F.coalesce("role", near, F.lit(R.UNANCHORED_ROLE)))
    above = F.col("role").isNull() & (F.col("rank") >= CLOSING) & (F.col("pos") < F.col("closing_pos"))
    body = ((F.col("rank") > SALUTATION) & (F.col("rank") < CLOSING)) | (F.length("literal") > MAX_LINE) | F.coalesce(above, F.lit(False))
    return rows.select(*cell, "canon", "literal", "letters", "pos", "role", "rank", body.alias("is_body"))


def coverage(rows: DataFrame, kept: DataFrame, cell: list[str], key: str = "doc_id") -> DataFrame:
    """(cell..., letters, coverage): the mean share of a letter's lines that its skeleton has, repeats counted."""
    hit = kept.where("not is_body").select(*cell, "canon", F.lit(1).alias("hit"))
    per = rows.join(hit, [*cell, "canon"], "left").groupBy(*cell, key).agg(F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
    return per.groupBy(*cell).agg(F.count("*").alias("letters"), F.round(F.avg("share"), 6).alias("coverage"))


def blank_labels(letters: DataFrame, sizes: DataFrame, cell: list[str], share: float = SHARE) -> DataFrame:
    """(cell..., label, n): labels that stand before a fill-in run in enough letters' texts."""
    label = F.explode(F.regexp_extract_all("text", F.lit(rf"([ऀ-ॿ]{{2,16}})\s*[:ः]?\s*{R.BLANK_RUN}"), F.lit(1)))
    k = letters.select(*cell, label.alias("label")).groupBy(*cell, "label").agg(F.count("*").alias("times"))
    return k.join(sizes, cell).where(F.col("times") >= F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(share)))).select(*cell, "label", "times")


def skeletons(letters: DataFrame, cell: list[str], key: str = "doc_id", floor: int = MIN_CELL) -> DataFrame:
    """One row for each cell: its size, ordered boilerplate, blanks, coverage and upper-median length."""
    sizes = cells(letters, cell, floor)
    rows = lines(letters, cell, key)
    near = shared(rows, sizes, cell)
    found = boilerplate(near, sizes, cell, key)
    kept = measured(roles(found, modal_literal(near, found, cell, key), positions(near, found, cell, key), cell))
    order = F.sort_array(F.collect_list(F.when(~F.col("is_body"), F.struct("rank", "pos", "canon", "literal", "letters"))))
    parts = kept.groupBy(*cell).agg(F.transform(order, lambda x: F.struct(x["canon"].alias("canonical"), x["letters"].alias("count"), x["literal"].alias("literal"), x["rank"].alias("role"))).alias("boilerplate"))
    blanks = blank_labels(letters, sizes, cell).groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct((-F.col("times")).alias("neg"), "label"))).alias("b"))
    median = upper_median(letters.withColumn("_n", F.length("text")), cell, "_n", "median_body_chars")
    out = sizes.join(parts, cell, "left").join(coverage(rows, kept, cell, key).drop("letters"), cell, "left").join(blanks, cell, "left").join(median, cell, "left")
    return out.withColumn("blanks", F.transform("b", lambda x: F.struct(x["label"].alias("label"), (-x["neg"]).alias("count")))).drop("b")


def before_subject(boilerplate_: Column) -> Column:
    return F.filter(boilerplate_, lambda x: x["role"] < SALUTATION)


def salutation(boilerplate_: Column) -> Column:
    return F.filter(boilerplate_, lambda x: x["role"] == SALUTATION)


def after_body(boilerplate_: Column) -> Column:
    return F.filter(boilerplate_, lambda x: x["role"] >= CLOSING)
