"""Writing results: texts, JSON reports, TSV, skeleton Markdown, snapshots."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_texts(docs: DataFrame, folder: str, key: str = "doc_id") -> None:
    """A folder for each document with its text."""
    docs.select(key, F.col("text").alias("value")).write.mode("overwrite").partitionBy(key).text(folder)


def json_rows(df: DataFrame) -> DataFrame:
    """(value): a JSON object for each row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_tsv(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").csv(folder, sep="\t", header=True)


def gold_lines(pairs: DataFrame, table: str, note: str = "") -> DataFrame:
    """(value): a gold file's lines, a comment that says what it is and then legacy TAB expected TAB table TAB note."""
    head = pairs.sparkSession.createDataFrame([(0, f"# gold pairs of {table}"), (1, "# legacy\texpected\ttable\tnote")], "n int, value string")
    rows = pairs.select(F.concat_ws("\t", "legacy", "expected", F.lit(table), F.lit(note)).alias("value"))
    return head.orderBy("n").select("value").unionByName(rows)


def review_rows(candidates: DataFrame) -> DataFrame:
    """What a reviewer is shown: (id, verdict_or_correction, legacy, suggested, blind, table, font, source, novel_slots); a blind row hides its suggestion."""
    empty = F.lit("")
    extra = [F.col(c).cast("string").alias(c) if c in candidates.columns else empty.alias(c) for c in ("table", "font", "source", "novel_slots")]
    return candidates.select("id", empty.alias("verdict_or_correction"), "legacy", F.when(F.col("blind"), "").otherwise(F.col("suggested")).alias("suggested"), F.when(F.col("blind"), "yes").otherwise("").alias("blind"), *extra)


def prune(spark: SparkSession, folder: str, keep: int) -> list[str]:
    """Removes all but the ``keep`` last snapshots of a folder, in order of name; the names of those removed."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory())
    gone = names[: max(len(names) - keep, 0)]
    for n in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}"), True)
    return gone


def safe_name(department: Column, letter_type: Column) -> Column:
    return F.concat(F.regexp_replace(department, r'[\\/:*?"<>|\s]', "_"), F.lit("_"), F.regexp_replace(letter_type, r'[\\/:*?"<>|\s]', "_"), F.lit(".md"))


def skeleton_markdown(skeletons: DataFrame, department: str, letter_type: str) -> DataFrame:
    """(name, value): a skeleton as Markdown of three sections."""
    bullets = lambda test: F.array_join(F.transform(F.filter("boilerplate", test), lambda x: x["literal"]), "\n")
    text = F.concat(
        F.lit("# "), F.col(department), F.lit(" / "), F.col(letter_type), F.lit(" ("), F.col("n").cast("string"), F.lit(" letters)\n\n## Before the subject\n"), bullets(lambda x: x["role"] < 7),
        F.lit("\n\n## Salutation\n"), bullets(lambda x: x["role"] == 7), F.lit("\n\n## After the body\n"), bullets(lambda x: x["role"] >= 9), F.lit("\n"),
    )
    return skeletons.select(safe_name(F.col(department), F.col(letter_type)).alias("name"), text.alias("value"))


def snapshot(df: DataFrame, folder: str) -> int:
    """Writes a copy, reads it again and compares counts; the number of rows."""
    df.write.mode("errorifexists").parquet(folder)
    n, m = df.count(), df.sparkSession.read.parquet(folder).count()
    if n != m:
        raise OSError(f"the copy has {m} rows, not {n}")
    return n


def docx_bytes(text: Column | str, font: str | None = None) -> Column:
    """binary: a minimal DOCX with a paragraph for each line."""

    def run(s: pd.Series) -> pd.Series:
        head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
        types = f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
        rels = f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
        props = f'<w:rPr><w:rFonts w:ascii="{escape(font)}" w:hAnsi="{escape(font)}" w:cs="{escape(font)}"/></w:rPr>' if font else ""

        def one(t: str | None) -> bytes:
            body = "".join(f'<w:p><w:r>{props}<w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in (t or "").split("\n"))
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("[Content_Types].xml", types)
                z.writestr("_rels/.rels", rels)
                z.writestr("word/document.xml", f'{head}<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
            return buf.getvalue()

        return s.map(one)

    return F.pandas_udf(run, "binary")(text)
