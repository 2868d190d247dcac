"""The letter store as operators on DataFrames: insert-if-new, refresh, labels, filters, counts, drafts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import fields, segment


def with_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))


def first_by_hash(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_hash): the least key of each distinct text; partial minima make copies cheap."""
    return with_hash(df).groupBy("text_hash").agg(F.min(key).alias(key)).select(key, "text_hash")


def insert_if_new(incoming: DataFrame, existing: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text_hash): incoming texts that are not in store, each once."""
    return first_by_hash(incoming, key).join(with_hash(existing).select("text_hash"), "text_hash", "left_anti").select(key, "text_hash")


def refresh(letters: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Letters whose derived columns are overwritten, nulls included, where a row came in for them."""
    new = incoming.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_in"))
    out = letters.join(new, key, "left")
    kept = [F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in letters.columns]
    return out.select(*kept)


def label_where_null(letters: DataFrame, labels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Labels from ``labels`` first, else those that letters have."""
    new = labels.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    return letters.join(new, key, "left").select(*(F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in letters.columns))


def migrate(letters: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Letters with the schema's missing columns added as nulls."""
    return letters.select("*", *(F.lit(None).cast(t).alias(c) for c, t in schema.items() if c not in letters.columns))


def delete(letters: DataFrame, by: DataFrame, key: str) -> DataFrame:
    return letters.join(by.select(key).distinct(), key, "left_anti")


def correct(letters: DataFrame, fixes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Letters with corrected texts; the hash follows the text."""
    out = refresh(letters, fixes, key, ["text"])
    return with_hash(out.drop("text_hash")) if "text_hash" in letters.columns else out


def correct_and_score(letters: DataFrame, fixes: DataFrame, key: str = "doc_id", tier: str = "source_tier") -> DataFrame:
    """Letters with corrected texts judged anew: subject, quality, form, completeness, missing, trust, verdict, violations and hash.

    Form and completeness are those of the first letter that the corrected text splits into;
    a correction without any text is none. letters has these columns, or gets them as nulls.
    """
    derived = {
        "subject": "string", "conversion_confidence": "double", "completeness": "double", "trust": "double", "verdict": "string", "form": "string",
        "violations": "map<string,int>", "missing": "array<string>",
    }
    letters = migrate(letters, derived | {"text_hash": "string"})
    strip = F.regexp_replace("text", r"(?U)\A\s+|\s+\z", "")
    new = fixes.select(key, strip.alias("text")).where("text <> ''").join(letters.select(key, F.col(tier).alias("_tier")), key)
    first = segment.segment(new, key).where("seq = 0").select(key, F.col("text").alias("_part"), "anchors")
    rows = new.join(first, key, "left").withColumn("subject", fields.extract(F.col("text"))["subject"]["value"]).withColumn("conversion_confidence", T.quality("text")).withColumn("violations", T.violations("text"))
    rows = rows.withColumn("form", F.when(F.col("_part").isNotNull(), segment.form(F.col("_part"), F.col("anchors"))))
    rows = rows.withColumn("completeness", F.coalesce(segment.completeness(F.col("form"), F.col("anchors"), F.col("_part")), F.lit(0.0)))
    rows = rows.withColumn("missing", F.coalesce(segment.missing(F.col("form"), F.col("anchors")), F.array().cast("array<string>")))
    rows = rows.withColumn("trust", segment.trust(F.col("conversion_confidence"), F.col("completeness"), F.col("_tier")))
    cuts, rest, strict = T.SEGMENT_CUTS
    rows = with_hash(rows.withColumn("verdict", T.bucket("trust", cuts, rest, strict)))
    return refresh(letters, rows.select(key, "text", "text_hash", *(F.col(c).cast(t).alias(c) for c, t in derived.items())), key, ["text", "text_hash", *derived])


def record_drafts(drafts: DataFrame, folder: str) -> DataFrame:
    """Appends drafts to a folder, those that are never sent as well; the same rows with their ids."""
    rows = drafts.withColumn("id", F.sha2(F.to_json(F.struct(*drafts.columns)), 256))
    rows.write.mode("append").parquet(folder)
    return rows


def browse(letters: DataFrame, verdict: str | None = None, form: str | None = None, limit: int = 50, key: str = "doc_id") -> DataFrame:
    """Letters of a verdict and a form, where these are given, in order of trust."""
    out = letters
    for column, value in (("verdict", verdict), ("form", form)):
        if value is not None:
            out = out.where(F.col(column) == value)
    return out.orderBy("trust", key).limit(limit)


def count(letters: DataFrame, verdict: str | None = None) -> DataFrame:
    """How many letters there are, of a verdict if one is given."""
    return (letters if verdict is None else letters.where(F.col("verdict") == verdict)).agg(F.count("*").alias("n"))


def keep(min_trust: float = 0.0, department: str | None = None, letter_type: str | None = None, exclude: tuple = (), columns=("trust", "department", "letter_type", "id")) -> Column:
    """The retrieval filter: null trust or label never passes a test on it."""
    trust, dept, kind, key = columns
    out = F.col(trust) >= min_trust
    if department is not None:
        out &= F.col(dept) == department
    if letter_type is not None:
        out &= F.col(kind) == letter_type
    if exclude:
        out &= ~F.col(key).isin(*exclude)
    return out


def quarantined(letters: DataFrame, limit: int = 50, key: str = "doc_id") -> DataFrame:
    return letters.where("verdict <> 'index'").orderBy("trust", key).limit(limit)


def corpus_stats(letters: DataFrame, columns: list[str]) -> DataFrame:
    return letters.agg(F.count("*").alias("letters"), *(F.round(F.avg(c), 4).alias(f"avg_{c}") for c in columns))


def counts_by(letters: DataFrame, column: str) -> DataFrame:
    return letters.groupBy(F.coalesce(F.col(column), F.lit("?")).alias(column)).agg(F.count("*").alias("n"))


def share_by(df: DataFrame, group: str, amount: Column, name: str) -> DataFrame:
    """Sum by group and its share of the whole; the window runs over one row a group."""
    out = df.groupBy(group).agg(F.sum(amount).alias(name))
    return out.withColumn("share", F.round(F.col(name) / F.sum(name).over(Window.partitionBy()), 4))


def index_percentiles(df: DataFrame, group: str, value: str, points: dict[str, float]) -> DataFrame:
    """sorted[min(n - 1, int(n * p))] of each group.

    Values are counted first, so that what is sorted is one row for each distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("k"))
    up = Window.partitionBy(group).orderBy(value)
    ranked = counts.withColumn("upto", F.sum("k").over(up)).withColumn("n", F.sum("k").over(Window.partitionBy(group)))
    at = {name: F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(p))) for name, p in points.items()}
    return ranked.groupBy(group).agg(
        F.first("n").alias("n"), *(F.min(F.when(F.col("upto") > i, F.col(value))).alias(name) for name, i in at.items()), F.max(value).alias("max")
    )


def record_dispatch(drafts: DataFrame, sent: DataFrame, key: str = "id") -> DataFrame:
    """Drafts with the dispatched text and the effort that it took; unknown ids are no drafts."""
    out = drafts.join(sent.select(key, F.col("text").alias("dispatched_text")), key, "left")
    return out.withColumn("effort", F.when(F.col("dispatched_text").isNotNull(), T.effort("draft_text", "dispatched_text")))


def draft_stats(drafts: DataFrame) -> DataFrame:
    return drafts.agg(F.count("*").alias("generated"), F.count("dispatched_text").alias("dispatched")).withColumn("abandoned", F.col("generated") - F.col("dispatched"))


def effort_summary(scores: DataFrame, column: str = "effort") -> DataFrame:
    """Count, median of the middle two, nearest-rank p90 (the maximum below ten), failures over .70 and those as drafted.

    Scores are counted by value first; what is ranked is one row for each distinct value.
    """
    counts = scores.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("k"))
    ranked = counts.withColumn("upto", F.sum("k").over(Window.partitionBy().orderBy("v"))).withColumn("n", F.sum("k").over(Window.partitionBy()))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("v")))
    n = F.col("n")
    return ranked.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("n"), at(F.floor((n - 1) / 2)).alias("lo"), at(F.floor(n / 2)).alias("hi"),
        F.when(F.max("n") >= 10, at(F.bround(F.lit(0.9) * n, 0) - 1)).otherwise(F.max("v")).alias("p90"),
        F.coalesce(F.sum(F.when(F.col("v") > 0.70, F.col("k"))), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.when(F.col("v") <= 0.10, F.col("k"))), F.lit(0)).alias("as_drafted"),
    ).select("n", ((F.col("lo") + F.col("hi")) / 2).alias("median"), "p90", "failed", "as_drafted")
