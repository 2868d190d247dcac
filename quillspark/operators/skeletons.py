"""Skeletons for drafting: corrected files read back, mined ones for the rest, and an office-wide one to fall back on."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as T
from . import templates

#: What a skeleton's body is taken to hold if its file doesn't say.
BODY_CHARS = 600
_STATE = "struct<section:string,before:array<string>,after:array<string>,blanks:array<string>,body:int>"


def parse(text: Column) -> Column:
    """struct(before, salutation, after, blanks, median_body_chars) of a skeleton's Markdown, which a person may have edited.

    Only section headings have to be there: lines may have been added, moved or stripped of
    their counts. A file of one section is split at its first closing line.
    """
    none = F.array().cast("array<string>")

    def step(acc: Column, raw: Column) -> Column:
        s = F.trim(raw)
        head = s.startswith("##")
        is_ = lambda p: head & F.lower(s).rlike(p)
        section = (
            F.when(is_(r"^##\s*(before|above|fixed|salutation)"), "before").when(is_(r"^##\s*(after|below)"), "after").when(is_(r"^##\s*(slots|blanks)"), "blanks")
            .when(head, "").otherwise(acc["section"])
        )
        line = F.trim(F.regexp_replace(s, r"^[-*]?\s*\[?\(?\d+\s*[x×]?\)?\]?\s{2,}|^\d+\s*[x×]\s+", ""))
        content = (line != "") & ~s.startswith("#")
        add = lambda k: F.when(content & (acc["section"] == k), F.concat(acc[k], F.array(line))).otherwise(acc[k])
        body = F.when(is_(r"^##\s*body"), F.regexp_extract(s, r"(\d+)", 1).try_cast("int")).otherwise(acc["body"])
        return F.struct(section.alias("section"), add("before").alias("before"), add("after").alias("after"), add("blanks").alias("blanks"), body.alias("body")).cast(_STATE)

    start = F.struct(F.lit("").alias("section"), none.alias("before"), none.alias("after"), none.alias("blanks"), F.lit(None).cast("int").alias("body")).cast(_STATE)
    read = F.aggregate(F.split(text, templates.LINE_END), start, step)

    def done(x: Column) -> Column:
        # a line's role is looked up once: 0 for those that are neither closing nor salutation
        role = lambda y: F.when(R.search(y, R.anchor_pattern("closing")), templates.CLOSING).when(R.search(y, R.anchor_pattern("salutation")), templates.SALUTATION).otherwise(0)
        return T.let(F.transform(x["before"], lambda y: F.struct(y.alias("line"), role(y).alias("role"))), lambda r: parts(x, r))

    def parts(x: Column, rows: Column) -> Column:
        first = F.array_position(F.transform(rows, lambda y: y["role"]), templates.CLOSING)
        return T.let(F.when((F.size(x["after"]) == 0) & (first > 0), first.cast("int")).otherwise(F.size(rows) + 1), lambda at: cut(x, rows, at))

    def cut(x: Column, rows: Column, at: Column) -> Column:
        above = F.slice(rows, 1, at - 1)
        lines = lambda test: F.transform(F.filter(above, test), lambda y: y["line"])
        return F.struct(
            lines(lambda y: y["role"] != templates.SALUTATION).alias("before"), lines(lambda y: y["role"] == templates.SALUTATION).alias("salutation"),
            F.concat(F.transform(F.slice(rows, at, F.size(rows) + 1), lambda y: y["line"]), x["after"]).alias("after"), x["blanks"].alias("blanks"), F.coalesce(x["body"], F.lit(BODY_CHARS)).alias("median_body_chars"),
        )

    return T.let(read, done)


def overrides(spark: SparkSession, folder: str) -> DataFrame:
    """(department, letter_type, before, salutation, after, median_body_chars) of the folder's readable files: those with a heading of both labels and a section."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    head = r"(?m)\A\s*#\s*([^/\n#]*?)\s*/\s*([^(\n]*?)\s*(?:\([^)\n]*\))?\s*$"
    found = files.where(F.col("value").rlike(head) & F.col("value").rlike(r"(?im)^##\s*(before|above|fixed|salutation|after|below)"))
    s = found.select(F.regexp_extract("value", head, 1).alias("department"), F.regexp_extract("value", head, 2).alias("letter_type"), parse(F.col("value")).alias("s"))
    return s.select("department", "letter_type", "s.before", "s.salutation", "s.after", "s.median_body_chars")


def load(letters: DataFrame, folder: str | None = None, floor: int = templates.MIN_CELL) -> DataFrame:
    """(department, letter_type, before, salutation, after, median_body_chars): corrected skeletons, mined ones for other cells, and one for ('', '').

    letters: (doc_id, text, department, letter_type); those without both labels are left out
    (``classify.by_rules`` gives labels to those that have none).
    An empty folder is told by a warning; files of which none can be read are an error.
    """
    rows = letters.where("department <> '' and letter_type <> ''")
    cell = ["department", "letter_type"]
    mined = templates.skeletons(rows, cell, floor=floor).unionByName(templates.skeletons(rows.withColumns({c: F.lit("") for c in cell}), cell, floor=1))
    literals = lambda x: F.transform(x, lambda y: y["literal"])
    b = F.coalesce("boilerplate", F.array().cast(mined.schema["boilerplate"].dataType))
    mined = mined.select(*cell, literals(templates.before_subject(b)).alias("before"), literals(templates.salutation(b)).alias("salutation"), literals(templates.after_body(b)).alias("after"), "median_body_chars")
    if folder is None:
        return mined
    spark = letters.sparkSession
    own = overrides(spark, folder)
    if own.isEmpty():
        if not spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder).isEmpty():
            raise ValueError(f"none of the skeletons in {folder} can be read: each needs its heading and its sections")
        warnings.warn(f"{folder} holds no skeletons, so mined ones are used", stacklevel=2)
        return mined
    return mined.join(own.select(*cell), cell, "left_anti").unionByName(own)
